import json

from vecscore.operators import cluster, evaluate, report
from vecscore.sources import readers, synthetic


def test_load_test(spark):
    outcomes = spark.createDataFrame([(True, True)] * 98 + [(False, True), (False, False)], "approved boolean, expected_approved boolean")
    ms = spark.createDataFrame([(float(i),) for i in range(1, 101)], "ms double")
    row = report.load_test(outcomes, ms).first()
    assert (row.tn, row.fp, row.tp, row.p99, row.failure_rate, row.weighted_errors) == (98, 1, 1, 100.0, 0.01, 1)
    said = json.loads(report.load_test_json(report.load_test(outcomes, ms)))
    assert said["p99"] == "100.00ms" and said["scoring"]["breakdown"]["false_positive_detections"] == 1 and not said["scoring"]["p99_score"]["cut_triggered"]
    assert report.load_test(outcomes).first().p99_score == 0
    assert report.latency_line(ms, "ms") == "p50=51.0 p95=96.0 p99=100.0 p99.9=100.0 max=100.0"


def test_synthetic(spark, tmp_path):
    rows = synthetic.vectors(spark, 900)
    assert sorted(map(str, rows.collect())) == sorted(map(str, synthetic.vectors(spark, 900).repartition(5).collect()))
    assert rows.agg({"is_fraud": "sum"}).first()[0] == 100
    (tmp_path / "r.json").write_text(synthetic.as_records(synthetic.vectors(spark, 50)))
    back = readers.records(spark, str(tmp_path / "r.json")).orderBy("ref_id").collect()
    assert len(back) == 50 and [r.is_fraud for r in back] == [int(i % 9 == 0) for i in range(50)]


def test_sweep(spark):
    refs = synthetic.vectors(spark, 800).cache()
    cells = cluster.centroid_table(spark, [[float(x) for x in r.vector] for r in refs.orderBy("ref_id").limit(16).collect()])
    rows = cluster.assigned(refs, cells)
    q = evaluate.drawn_queries(refs, 800, 15, 7)
    one = {r.nprobe: r.recall for r in evaluate.sweep(rows, cells, q, 16, d=14).collect()}
    each = evaluate.timed_sweep(rows, cells, q, 16, d=14)
    assert {p: r for p, r, _ in each} == one and sorted(one) == [4, 8, 16] and one[16] == 1.0
    assert len(report.sweep_lines(each)) == 3 and evaluate.sampled_recall(rows, cells, 800, 16, 10, 3, 14) == 1.0
