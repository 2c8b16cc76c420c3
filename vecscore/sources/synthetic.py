"""Invented labelled vectors for trials: groups on a grid, normal noise, every n-th fraudulent."""

from __future__ import annotations

import calendar
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import gaussian
from .schemas import DIMENSIONS


def timestamps(year: int = 2027, leap: int = 2028) -> list[str]:
    """Texts in and around the strict format, by rule: fields at, below and above their ranges, days at the ends of months, signs and lengths off by one."""
    text = "{:04}-{:02}-{:02}T{:02}:{:02}:{:02}Z"
    middle = [year, 6, 18, 9, 41, 27]
    out = [text.format(*middle)]
    for field, (low, high) in enumerate([(1, 12), (1, 30), (0, 23), (0, 59), (0, 59)], 1):
        out += [text.format(*middle[:field], v, *middle[field + 1 :]) for v in (low - 1, low, high, high + 1) if v >= 0]
    for y in (year, leap, 1900, 2000):
        for month in range(1, 13):
            days = calendar.monthrange(y, month)[1]
            out += [text.format(y, month, day, *middle[3:]) for day in (days, days + 1)]
    base = out[0]
    signs = [i for i, c in enumerate(base) if not c.isdigit()]
    out += [base[:i] + c + base[i + 1 :] for i in signs for c in " -:T" if c != base[i]]
    out += [base[:i] + base[i + 1 :] for i in range(len(base))] + [base[:i] + "0" + base[i:] for i in (0, 5, 8, 11, 14, 17)]
    out += [base[:i] + "o" + base[i + 1 :] for i in range(len(base)) if i not in signs] + [base + c for c in ("Z", " ", "0")] + [c + base for c in " +-"] + [""]
    return sorted(set(out))


def _uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the parts only."""
    h = F.pmod(F.xxhash64(F.lit(seed).cast("long"), *parts), F.lit(1 << 40).cast("long"))
    return (h.cast("double") + 0.5) / float(1 << 40)


def vectors(spark: SparkSession, n: int, centres: int = 16, grid: float = 50.0, sigma: float = 0.5, fraud_every: int = 9, seed: int = 7, d: int = DIMENSIONS) -> DataFrame:
    """(ref_id, vector, is_fraud) for ids 0 to n - 1; each row is computed from its id alone, so partitions do not matter."""
    rows = spark.range(n).withColumnRenamed("id", "ref_id")
    side = max(1, round(centres**0.5))
    own = F.col("ref_id") % centres
    middle = [(own % side) * F.lit(grid), F.floor(own / side) * F.lit(grid)]
    noise = lambda i: gaussian(_uniform(seed, F.col("ref_id"), F.lit(2 * i)), _uniform(seed, F.col("ref_id"), F.lit(2 * i + 1))) * F.lit(sigma)
    vector = F.array(*[(middle[i] if i < 2 else F.lit(0.0)) + noise(i) for i in range(d)])
    return rows.select("ref_id", vector.alias("vector"), (F.col("ref_id") % fraud_every == 0).cast("int").alias("is_fraud"))


def as_records(rows: DataFrame) -> str:
    """The rows as the text of a record file, in order of id; for small trials."""
    got = rows.orderBy("ref_id").select("vector", F.when(F.col("is_fraud") == 1, "fraud").otherwise("legit").alias("label")).toLocalIterator()
    return json.dumps([{"vector": list(r.vector), "label": r.label} for r in got])
