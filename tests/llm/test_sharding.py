import zlib

from vecscore.llm import sharding

SCHEMA = "doc_id bigint, text string, size string, shard int, _row int, bucket string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", 9, 9, "b") for i, t in rows], SCHEMA)


def test_permutation():
    for n in (1, 2, 3, 5, 16, 17, 100, 1000, 4097):
        assert sorted(sharding.permuted(x, n, 7) for x in range(n)) == list(range(n))
        assert all(sharding._back(sharding._once(x, n, 3), n, 3) == x for x in range(n))


def test_plan_computes_the_same(spark):
    for n in (1, 2, 7, 1000):
        got = sharding.permute(spark.range(n).withColumn("x", __import__("pyspark").sql.functions.col("id")), "x", n, 7).collect()
        assert {r.id: r.x for r in got} == {x: sharding.permuted(x, n, 7) for x in range(n)}


def test_shards(spark):
    rows = [(i, f"text {i % 50} é") for i in range(500)] + [(None, None), (None, "x"), (3, ""), (7, "same"), (7, "same"), (7, "same"), (8, "y" * 100_000)]
    got = sharding.shard(docs(spark, rows)).collect()
    want = sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    again = sharding.shard(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_many_copies_and_none(spark, monkeypatch):
    from vecscore.llm import common

    monkeypatch.setattr(common, "COPIES_PER_TASK", 10)
    got = sharding.shard(docs(spark, [(1, "a")] * 95 + [(2, "b")])).collect()
    assert len({(r.shard, r.slot) for r in got}) == 96
    assert sharding.shard(docs(spark, [])).collect() == []
