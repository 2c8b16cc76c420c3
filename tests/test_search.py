import numpy as np
import pytest
from pyspark.sql import functions as F

from vecscore.operators import cluster, evaluate, scoring, search


def table(spark, x, labels=None):
    rows = [(i, [float(v) for v in r], int(labels[i]) if labels is not None else i % 9 == 0 and 1 or 0) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "ref_id long, vector array<double>, is_fraud int")


def queries(spark, q):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)], "qid long, q array<double>")


def brute(x, q, k=5):
    out = {}
    for i, v in enumerate(q):
        d = ((x - v) ** 2).sum(1)
        out[i] = list(np.lexsort((np.arange(len(x)), d))[:k])
    return out


def found(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.ref_id)
    return out


def clustered(n, d=14, centres=16, seed=1):
    r = np.random.default_rng(seed)
    c = np.zeros((centres, d))
    c[:, :4] = r.integers(0, 8, (centres, 4)) * 50
    return c[r.integers(0, centres, n)] + r.normal(0, 0.5, (n, d))


@pytest.fixture(scope="module")
def cells(spark):
    x = clustered(3000)
    refs = table(spark, x).cache()
    cent = cluster.centroid_table(spark, x[:32].tolist())
    rows = cluster.assigned(refs, cent).cache()
    return x, refs, rows, cent.drop("radius").join(cluster.radii(rows, 32), "cluster_id").cache()


def test_exact(spark, cells):
    x, refs, *_ = cells
    q = x[::100] + 0.01
    assert found(search.exact_knn(refs, queries(spark, q), 5, 14)) == brute(x, q)
    assert found(search.exact_knn(refs, queries(spark, q), 5)) == brute(x, q)


def test_ties_go_to_the_smaller_id(spark):
    x = np.array([[1.0, 0], [0, 1.0], [-1.0, 0], [0, -1.0], [2.0, 0], [0, 0]] * 2)
    assert found(search.exact_knn(table(spark, x), queries(spark, [[0.0, 0.0]]), 5, 2))[0] == [5, 11, 0, 1, 2]


def test_query_blocks_give_the_same(spark, cells, monkeypatch):
    x, refs, *_ = cells
    q = x[::150]
    monkeypatch.setattr(search, "BLOCK_NUMBERS", 14 * 5)
    assert len(search.blocks(queries(spark, q), 14)) > 1
    assert found(search.exact_knn(refs, queries(spark, q), 5, 14)) == brute(x, q)


def test_all_probes_are_exact(spark, cells):
    x, refs, rows, cent = cells
    q = queries(spark, x[::150])
    assert evaluate.same_set(search.ivf_knn(rows, cent, q, 99, 5, 14), search.exact_knn(refs, q, 5, 14)).where("not same").count() == 0


@pytest.mark.parametrize("grid", [False, True])
def test_pruning_changes_nothing(spark, cells, grid):
    if grid:  # many equal distances
        x = np.random.default_rng(3).integers(0, 3, (1500, 14)).astype(float)
        refs = table(spark, x)
        cent = cluster.centroid_table(spark, x[:16].tolist()).drop("radius")
        rows = cluster.assigned(refs, cent).cache()
        cent = cent.join(cluster.radii(rows, 16), "cluster_id")
    else:
        x, _, rows, cent = cells
    q = queries(spark, x[::60])
    assert found(search.ivf_knn_pruned(rows, cent, q, 8, 5, 14)) == found(search.ivf_knn(rows, cent, q, 8, 5, 14))
    if not grid:
        probed = search.probes(q, cent, 8, 14)
        _, later = search.pruned_probes(probed, rows, 5, 14)
        assert later.count() < probed.where("probe_rank > 1").count()


def test_few_references(spark):
    refs = table(spark, np.eye(3), [1, 1, 0])
    q = queries(spark, [[0.0, 0.0, 0.0]])
    got = scoring.voted(search.exact_knn(refs, q, 5, 3)).first()
    assert (got.fraud_count, got.fraud_score, got.approved) == (2, 0.4, True)
    rows = cluster.assigned(refs, cluster.centroid_table(spark, np.eye(3).tolist()))
    cent = cluster.centroid_table(spark, np.eye(3).tolist()).drop("radius").join(cluster.radii(rows, 3), "cluster_id")
    assert search.ivf_knn_pruned(rows, cent, q, 3, 5, 3).count() == 3
    assert search.exact_knn(refs.limit(0), q, 5, 3).count() == 0
    assert scoring.voted(search.exact_knn(refs.limit(0), q, 5, 3), q).first().fraud_count == 0


def test_bodies(spark):
    rows = spark.createDataFrame([(n,) for n in range(6)], "n int").select(scoring.body("n").alias("b"), scoring.approved("n").alias("a")).collect()
    assert [r.b for r in rows] == [f'{{"approved":{str(n < 3).lower()},"fraud_score":{s}}}' for n, s in enumerate(["0", "0.2", "0.4", "0.6", "0.8", "1"])]
    assert [r.a for r in rows] == [True] * 3 + [False] * 3
    status, body = scoring.response(F.col("p"), F.col("v"), "n")
    got = spark.createDataFrame([(False, False, None), (True, False, None), (True, True, None), (True, True, 5)], "p boolean, v boolean, n int").select(status.alias("s"), body.alias("b")).collect()
    assert [r.s for r in got] == [400, 400, 500, 200] and "invalid_json" in got[0].b and "invalid_payload" in got[1].b
