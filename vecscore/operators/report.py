"""Reports as one-row tables and as text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluate


def load_test(outcomes: DataFrame, latencies: DataFrame | None = None, column: str = "ms") -> DataFrame:
    """One row of a labelled load test: counts, failure rate, weighted errors, scores, p99.

    ``outcomes`` is (approved, expected_approved), ``latencies`` milliseconds; without them p99 is 0, no time at all.
    """
    counts = evaluate.confusion(outcomes)
    p99 = evaluate.percentiles(latencies, column, (99,)).select(F.coalesce(F.col("p99").cast("double"), F.lit(0.0)).alias("p99")) if latencies is not None else counts.select(F.lit(0.0).alias("p99"))
    got = evaluate.composite(counts.crossJoin(F.broadcast(p99)))
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn") + F.col("errors")
    share = lambda x: F.when(n > 0, x / F.when(n > 0, n)).otherwise(F.lit(0.0))
    return got.withColumns({"failure_rate": share(F.col("fp") + F.col("fn") + F.col("errors")), "weighted_errors": F.col("fp") + 3 * F.col("fn") + 5 * F.col("errors")}).transform(_parts, share)


def _parts(got: DataFrame, share) -> DataFrame:
    """Add epsilon, and the parts of the detection score, which are null where too many failed."""
    weighted = F.col("weighted_errors").cast("double")
    kept = lambda x: F.when(F.col("failure_rate") <= 0.15, x)
    rate, penalty = evaluate.components(weighted, share(weighted))
    return got.withColumns({"epsilon": share(weighted), "rate_component": kept(rate), "absolute_penalty": kept(penalty)})


def load_test_json(report: DataFrame, expected: DataFrame | None = None) -> str:
    """The report as text; ``expected`` is the one row of the data set's statistics. The keys are fixed values of the format."""
    r = report.first().asDict()
    opinion = lambda x: None if x is None else round(x, 2)
    breakdown = {"false_positive_detections": r["fp"], "false_negative_detections": r["fn"], "true_positive_detections": r["tp"], "true_negative_detections": r["tn"], "http_errors": r["errors"]}
    cut = {"p99_score": r["p99"] > 2000, "detection_score": r["failure_rate"] > 0.15}
    scores = {name: {"value": round(r[name], 2), "cut_triggered": cut[name]} for name in cut}
    scores["detection_score"] = {"value": scores["detection_score"]["value"], "rate_component": opinion(r["rate_component"]), "absolute_penalty": opinion(r["absolute_penalty"]), "cut_triggered": cut["detection_score"]}
    scoring = {"breakdown": breakdown, "failure_rate": f"{round(100 * r['failure_rate'], 2):g}%", "weighted_errors_E": r["weighted_errors"], "error_rate_epsilon": round(r["epsilon"], 6), **scores, "final_score": round(r["final_score"], 2)}
    return json.dumps({"expected": expected.first().asDict() if expected is not None else None, "p99": f"{r['p99']:.2f}ms", "scoring": scoring}, indent=2)


def latency_line(samples: DataFrame, column: str) -> str:
    r = evaluate.percentiles(samples, column).first()
    return f"p50={r.p50} p95={r.p95} p99={r.p99} p99.9={r.p99_9} max={r.max}"


def sweep_lines(found: list[tuple[int, float, float]]) -> list[str]:
    return [f"nprobe={p} recall@5={r:.4f} {ms:.0f} ms" for p, r, ms in found]
