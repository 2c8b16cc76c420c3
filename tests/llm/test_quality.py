import os
import re

import pytest

from vecscore.llm import quality as Q


def brute(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    cover = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


TEXTS = ["", " ", "a", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 30, "é 日本\x85x y z\x1cq", "l1\nl1\n\n \nl2\nl1 ", "## $$ %% && || << >> **", " ".join("abcdefgh") + " q " + " ".join("abcdefgh") + " r s", "\n".join(["one two three four five six seven eight nine"] * 3), "w%d " * 5000 % tuple(i % 700 for i in range(5000))]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, True) for i, t in rows], "doc_id bigint, text string, n_words int, kept boolean")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_base():
    for t in TEXTS:
        raw = t.encode()
        assert Q.base(t, raw, raw.split()) == brute(t), t
    assert [len(g) for g in Q.word_grams([])] == [0, 0] and [len(g) for g in Q.word_grams([b'x'])] == [1, 0]


def test_verdicts(spark):
    good = [(i, f"this is plain text number {i} with quite common words and a second sentence of the same kind here, as usual number {i + 1} follows") for i in range(60)]
    bad = [(100 + i, " ".join(f"w{i}{j}###$$$ %%%{j}&&&" for j in range(40))) for i in range(20)]
    odd = [(500, None), (501, ""), (502, "too short"), (None, good[0][1]), (0, good[0][1]), (503, "same words " * 40)]
    d = docs(spark, good + bad + odd)
    lab = labels(spark, [(i, 1, 0) for i in range(0, 60, 2)] + [(100, 0, 0), (None, 1, 0), (0, 1, 0), (7, None, None)])
    got = Q.rate(d, lab).collect()
    assert len(got) == 86
    for r in got:
        t = dict(good + bad + odd[:3] + odd[5:]).get(r.doc_id) if r.doc_id is not None else good[0][1]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t or "")
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and (r.doc_id is None or r.doc_id < 100))
    kept = Q.keep(d, lab)
    assert kept.columns == d.columns and kept.count() == 62
    assert Q.rate(docs(spark, []), lab).collect() == [] and {r.kept for r in Q.rate(d.where("doc_id < 150 and doc_id <> 503"), labels(spark, [])).collect()} == {True}


def test_ratio(spark):
    import numpy as np

    rows = [(1, "aaab b b"), (2, "aaac aaac b")]
    got = Q.log_ratio(docs(spark, rows), labels(spark, [(1, 1, 0)]), 10, 5.0)
    raw, good = np.zeros((Q.KINDS, Q.BUCKETS)), np.zeros((Q.KINDS, Q.BUCKETS))
    for i, t in rows:
        w = t.encode().split()
        found = [Q.grams(t[j : j + 3].encode())[0] for j in range(len(t) - 2)], [Q.word_grams([x])[0][0] for x in w], [Q.word_grams([x, y])[1][0] for x, y in zip(w, w[1:])]
        for k, own in enumerate(found):
            for b in own:
                raw[k, int(b)] += 1
                good[k, int(b)] += i == 1
    p = (raw + 1) / (raw.sum(1, keepdims=True) + Q.BUCKETS)
    want = np.log((good + 5 * p) / (good.sum(1, keepdims=True) + 5)) - np.log(p)
    assert got == pytest.approx(want.ravel())
    score = Q.verdicts(["aaab b b", None, "aa"], got, 0.0)[3]
    assert score[1] == 0 and score[2] == pytest.approx(want[1, int(Q.word_grams([b"aa"])[0][0])] * Q.WEIGHTS[1])
    mean = lambda k, own: np.mean([want[k, int(b)] for b in own])
    w = b"aaab b b".split()
    assert score[0] == pytest.approx(np.dot(Q.WEIGHTS, [mean(0, Q.grams(b"aaab b b")), mean(1, Q.word_grams(w)[0]), mean(2, Q.word_grams(w)[1])]))


def test_all_trusted_documents_count(spark):
    rows = [(i, f"text {i} of {'abcdefghij'[i]} words") for i in range(10)] + [(None, "no id"), (3, "again three")]
    lab = labels(spark, [(i, 1, 0) for i in range(7)] + [(None, 1, 0), (8, 0, 0), (3, 1, 0)])
    got = [Q.log_ratio(docs(spark, rows), lab, most, 5.0) for most in (100, 7, 6, 2)]
    assert all((x == got[0]).all() for x in got) and got[0].any()


def test_labels_that_were_not_counted(spark):
    """Trusted are half of the labelled documents; the verdicts on the other half are what is measured."""
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    fit, held = lab.where("pmod(doc_id div 7, 2) = 0"), lab.where("pmod(doc_id div 7, 2) = 1")
    got = Q.rate(spark.read.parquet(f"{sf}/documents.parquet"), fit).join(held, "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in got if r.quality == q] for q in (1, 0))
    assert len(good) > 1000 and sum(good) >= 0.99 * len(good)
    assert len(bad) > 100 and sum(not k for k in bad) >= 0.95 * len(bad)
