import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from vecscore.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SCHEMA = "doc_id bigint, text string, spans string, t int, email string"


def luhn(d):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def holds(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in s.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(t):
    return [(k, m.start(), m.end()) for k in BASE for m in re.finditer(BASE[k], t or "") if holds(k, m[0])]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def check(rows, got):
    texts = dict(rows)
    for r in got:
        spans = brute(texts[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (texts[r.doc_id] or "")[:80]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in spans) for k in BASE)
        every = [s.split(":") for s in r.spans.split(",") if s]
        assert set(f"{k}:{a}:{b}" for k, a, b in spans) <= set(":".join(s) for s in every)
        assert [(list(BASE).index(k), int(a)) for k, a, _ in every] == sorted((list(BASE).index(k), int(a)) for k, a, _ in every)


ODD = [
    None, "", "a@b.c_d@e.f x@y", "a@b.com.x@y.z 1.2.3.4.5.6.7.8 256.1.1.1 00001.002.3.4 0.0.0.0000", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111", "+1 (171) 555-2028, +4930 1234567 x +1 2 +12345678901234567",
    "\x01a@b.co\x01 é+49 30 123456789", "x " + "1.2.3.4 " * 3000, "9" * 20_000, "a" * 100_000 + "@b.co", "a.b@" + "c." * 9000 + "d", "+1" + " " * 20_000, "a@b.c\n+1 555\n1234567\n4111 1111\n1111 1111", "日本 a@b.co 😀 +49 30 1234567", "@@a@b.c@d.e.", "1.2.3 4.5.6.7", "+1-2-3-4-5-6-7-8-",
]


def test_base_spans(spark):
    rows = list(enumerate(ODD)) + [(1000, "plain")]
    got = pii.digest(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    check(rows, got)
    same = pii.digest(docs(spark, [(None, "a@b.co"), (None, "a@b.co")])).collect()
    assert len(same) == 2 and same[0] == same[1] and same[0].spans == "email:0:6"
    assert pii.digest(docs(spark, [])).collect() == []


def test_chosen_spans(spark):
    hits = {"call (555) 123-4567 now": "phone:5:19", "mail bob (at) example (dot) com please": "email:5:31", "visa 378282246310005 ok": "card:5:20"}
    clean = ["order 20260311 shipped", "he was at home. Then they left", "version 1.2.3 of 2024-05-06", "id 1234567890123456", "a look at this dot there", "sum 12345678 and 99", "page 10 of 2000"]
    rows = list(enumerate([*hits, *clean]))
    got = {r.doc_id: r.spans for r in pii.digest(docs(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == [*hits.values(), *[""] * len(clean)]


def test_numbers_next_to_numbers(spark):
    cases = {
        "see 7536784127813050 4845168114407329 ok": ["card:4:20", "card:21:37"],
        "see 2353820953013749 4550997810720808 ok": ["card:21:37"],
        "see 4111 1111 1111 1111 5500 0000 0000 0004 ok": ["card:4:23", "card:24:43"],
        "at +1 (826) 555-4081 190.137.223.204 then": ["ip:21:36", "phone:3:20"],
        "at +1 (843) 555-7672 170.106.47.218 then": ["ip:21:35", "phone:3:20"],
        "call (555) 123-4567 555-987-6542 now": ["phone:5:19", "phone:20:32"],
        "rows 12 345 6789 01 2345 678 90 of them": [],
    }
    got = {r.doc_id: r.spans for r in pii.digest(docs(spark, list(enumerate(cases)))).collect()}
    assert [got[i] for i in range(len(cases))] == [",".join(x) for x in cases.values()]


def test_proposals_overlap_and_spans_do_not(spark):
    t = "555 123 4567 555 123 4568 " * 2000
    df = docs(spark, [(1, "a 12 345 6789 0123 b"), (2, t)]).withColumn("t", F.col("text"))
    p = pii._proposals(df.where("doc_id = 1")).first()
    assert {(x.start, x.end) for x in p.try_phone} == {(2, 13), (2, 18), (5, 13), (5, 18), (9, 18)} and [(x.start, x.end) for x in p.try_card] == [(2, 18)]
    spans = sorted(tuple(map(int, s.split(":")[1:])) for s in pii.digest(docs(spark, [(2, "call " + t)])).first().spans.split(",") if s)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    v = "array(" + ", ".join(f"named_struct('start', {a}L, 'end', {b}L, 'score', {c}D)" for a, b, c in [(0, 10, 1), (8, 18, 2), (16, 26, 3), (16, 20, 3), (30, 40, 1)]) + ")"
    assert [(x.k, x.start, x.end) for x in spark.range(1).select(F.expr(pii._chosen(v, 3)).alias("x")).first().x] == [(3, 0, 10), (3, 16, 26), (3, 30, 40)]


def test_trees_rank_held_out_sentences(spark):
    for bias, trees, least in pii._fitted(spark, 5).values():
        assert len(trees) == pii.TREES and least is not None
    x = [[0.0, 1.0], [1.0, 0.0], [0.0, 0.0], [1.0, 1.0]] * 20
    y = [a > b for a, b in x]
    bias, trees = pii.boost(x, y, 60)
    assert all((bias + sum(pii.score(t, r) for t in trees) > 0) == w for r, w in zip(x, y))
    assert pii.threshold([3.0, 2.0, 1.0], [True, True, False]) == 2.0 and pii.threshold([1.0], [False]) is None


def test_redaction(spark):
    got = pii.redact(docs(spark, [(1, "x a@b.co y +1 (171) 555-2028 z"), (2, "none"), (3, None), (4, "1.2.3.4")])).collect()
    assert {r.doc_id: r.text for r in got} == {1: "x [email] y [phone] z", 2: "none", 3: None, 4: "[ip]"}


def test_tables(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    check([(r.doc_id, r.text) for r in d.collect()], pii.digest(d).collect())
