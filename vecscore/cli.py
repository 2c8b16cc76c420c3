"""Build an index from files: ``python -m vecscore.cli --refs ... --norm ... --mcc ... --out ...``."""

from __future__ import annotations

import argparse
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession

from .plans.index import RecallTooLow, checked_build
from .sources import readers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vecscore")
    for name, text in (("refs", "labelled records, JSON, gzipped or not"), ("norm", "normalisation constants"), ("mcc", "risk by merchant category"), ("out", "folder of the index")):
        p.add_argument(f"--{name}", required=True, help=text)
    for name, kind, default in (("k", int, 2048), ("iters", int, 25), ("batch", int, 100_000), ("nprobe", int, 4), ("seed", int, 42), ("recall-floor", float, 0.99), ("recall-sample", int, 1000)):
        p.add_argument(f"--{name}", type=kind, default=default)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("vecscore").getOrCreate()
    try:
        refs = readers.records(spark, a.refs, spark.sparkContext.defaultParallelism)
        norms, risk = readers.norms(spark, a.norm), readers.mcc_risk(spark, a.mcc)
        got = checked_build(refs, a.out, a.k, a.iters, a.batch, a.nprobe, a.seed, a.recall_floor, a.recall_sample, asdict(norms), risk)
    except (RecallTooLow, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    print(f"recall@5={got}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
