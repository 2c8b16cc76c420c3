"""Queries over events against their SQL, on amounts that the given tables hardly have."""

import collections
import datetime

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from vecscore.operators import nearest
from vecscore.operators.nearest import Found

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Users whose first amount is 0 or makes averages of which ratios end in a half at the tenth digit."""
    rows = []
    for user, (first, cents) in enumerate((f, c) for f in (0.0, 5.12, 10.24, 25.6) for c in (0, *range(1, 240, 3))):
        for amount in (first, cents / 100):
            rows.append((len(rows), START + datetime.timedelta(seconds=97 * len(rows)), user, ("click", "purchase", "error")[len(rows) % 3], amount, f'{{"k": {len(rows) % 100}}}'))
    path = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


def both(spark, path, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view events as select * replace (ts::timestamp as ts) from '{path}/events.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(n) for n in names]
    got = entry.queries()[name](spark, path).select(*names)
    return collections.Counter(str(tuple(r)) for r in got.collect()), collections.Counter(str(tuple(r[i] for i in at)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["payload_json_roundtrip", "feature_amount_vs_avg"])
def test_zero_amounts_and_ties(spark, events, name):
    got, want = both(spark, events, name)
    assert got == want


def test_neighbours_of_all_events(spark, events):
    got, want = both(spark, events, "events_fraud_score")
    assert got == want and len(got) > 10


def test_nearest_like_all_pairs(spark, monkeypatch):
    """Small boxes and bounds, ties, empty tables, fewer rows than k, vectors with parts that are no numbers."""
    r = np.random.default_rng(2)
    v = r.integers(0, 4, (700, 5)) / 3 + r.choice([0, 0.01], (700, 5))
    v[r.random(v.shape) < 0.03] = np.nan
    q, refs = v[::20], Found(35, 4)
    for name, x in (("LEAF", 6), ("FIRST", 50), ("QUERIES", 8), ("HELD", 100)):
        monkeypatch.setattr(nearest, name, x)
    order = r.permutation(700)
    for part in np.array_split(order, 3):
        nearest._search(refs, q, v[part], part, part % 2)
    gaps = np.array([[sum(x for x in (a - b) ** 2 if x == x) for b in v] for a in q])
    want = [(i, gaps[i, j], j) for i in range(35) for j in sorted(range(700), key=lambda j: (gaps[i, j], j))[:4]]
    assert list(zip(*(x.tolist() for x in refs.best[:3]))) == want
    table = lambda rows: spark.createDataFrame(rows, "ref_id long, vector array<double>, is_fraud int")
    rows = table([(3, [0.0, 1.0], 1), (4, [0.0, None], 0), (5, None, 0)])
    ask = lambda refs: sorted(map(tuple, nearest.nearest(refs, rows.selectExpr("ref_id as qid", "vector as q").where("qid < 5"), 5, 2).drop("is_fraud").collect()))
    assert ask(rows) == [(3, 1, 3, 0.0), (3, 2, 4, 0.0), (3, 3, 5, 0.0), (4, 1, 3, 0.0), (4, 2, 4, 0.0), (4, 3, 5, 0.0)] and ask(table([])) == []


def test_no_row_for_a_pair_is_sorted(spark, events):
    """What grows with the product of events and queries must not be sorted, for a sort goes to disk."""
    plan = entry.queries()["events_fraud_score"](spark, events)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
