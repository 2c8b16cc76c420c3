import re

import pytest
from pyspark.sql import functions as F

from vecscore.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size string, target int, _copy int"


def water(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    """Targets by doing it: share out, cut what is over, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, got, free = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while free and left > 1e-9:
        total = sum(w[s] for s in free)
        part = {s: left * w[s] / total for s in free}
        left = 0.0
        for s, p in part.items():
            got[s] += p
            if got[s] >= repeats * sizes[s]:
                left += got[s] - repeats * sizes[s]
                got[s] = repeats * sizes[s]
                free.discard(s)
    return got


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 2) for i, t, s in rows], SCHEMA)


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 50, "c": 60, "d": 500}, {"a": 7, "b": 1000, None: 3}, {"a": 10}, {f"s{i:02}": 100 + 13 * i for i in range(20)}, {"a": 0, "b": 5}, {"a": 1, "b": 1, "c": 10_000, "d": 4}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(rows, (5, 2, 1), 1.5, 2).collect()}
    for s, t in water(sizes).items():
        assert got[s] == pytest.approx(t, abs=1e-6)


def test_mix_takes_the_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 23), "abc"[i % 3] if i % 11 else None) for i in range(300)]
    rows += [(5000, None, "a"), (None, "one two", "b"), (5001, "", None), (5002, "\x1c\x85 x", "c")] + [(7, "same same", "a")] * 5
    d = docs(spark, rows)
    got = mixing.mix(d).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    by = {}
    for i, t, s in rows:
        by.setdefault((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))), []).append(s)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        s = by[(r.doc_id, r.size)][0]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
    for s, t in water(sizes).items():
        assert target[s] == pytest.approx(t)
        assert t - 1 < taken[s] <= t + 1e-6
    again = mixing.mix(d.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_documents(spark):
    rows = [(i, "w " * (1 + i % 9), "abc"[i % 3]) for i in range(200)] + [(900, None, "a"), (901, "", "b"), (None, "x y", "a"), (3, "w w w", "c"), (3, "w w w", "c")]
    d = docs(spark, rows)
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns
    times = {}
    for r in mixing.mix(d).collect():
        if r.size:
            times[(r.doc_id, r.size)] = times.get((r.doc_id, r.size), 0) + -(-r.taken // r.size)
    got = {}
    for r in out.collect():
        got[(r.doc_id, len(r.text.split()))] = got.get((r.doc_id, len(r.text.split())), 0) + 1
    assert got == {k: v for k, v in times.items() if v}


def test_mixed_rows_keep_their_source_and_columns(spark):
    """One text under two sources, rows equal but for other columns, names that clash: each row as often as it is taken."""
    schema = "doc_id bigint, text string, source string, _copy int, _key string, _id int, _row string, _times int, tie int"
    rows = [(1, "a b c", "x", 7, "k", 8, "r", 9, 1), (1, "a b c", "y", 7, "k", 8, "r", 9, 1)] + [(2, "d e", "y", i, None, i, "r", 9, i) for i in range(4)]
    rows += [(3, "f g " * 40, "y", 0, "k", 0, "r", 0, 0)] * 2 + [(None, "h", None, 1, "k", 1, "r", 1, 1), (4, None, "x", 0, "k", 0, "r", 0, 0)]
    d = spark.createDataFrame(rows, schema)
    outs = [sorted(map(str, mixing.mixed_documents(d.repartition(n)).collect())) for n in (1, 4)]
    assert outs[0] == outs[1]
    plan = [(r.doc_id, r.source, r.size, -(-r.taken // r.size)) for r in mixing._mixed(mixing._rows(d, 11, F.lit(0).cast("long")), (5, 2, 1), 1.5, 2).collect() if r.size]
    got = [(r.doc_id, r.source) for r in mixing.mixed_documents(d).collect()]
    for i, s in {(p[0], p[1]) for p in plan}:
        assert got.count((i, s)) == sum(p[3] for p in plan if p[:2] == (i, s)), (i, s)
    assert got.count((1, "x")) == 2 and set(outs[0]) <= set(map(str, d.collect()))
    long = spark.createDataFrame([(1, "w " * 400_000, "x"), (2, "v", "x")], "doc_id bigint, text string, source string")
    assert sum(r.taken for r in mixing.mix(long).collect()) == int(1.5 * 400_001)


def test_empty(spark):
    assert mixing.mix(docs(spark, [])).collect() == []
    assert mixing.mixed_documents(docs(spark, [])).collect() == []


def test_many_copies_are_cut(spark, monkeypatch):
    from vecscore.llm import common

    monkeypatch.setattr(common, "COPIES_PER_TASK", 10)
    d = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"), F.explode(F.sequence(F.lit(1), F.lit(95))).alias("k"))
    got = mixing.mix(d).collect()
    assert len(got) == 95 and sum(r.taken for r in got) == int(1.5 * 190)
