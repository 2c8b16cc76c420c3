import zlib

import numpy as np
import pytest

from vecscore.llm import language as L

WORDS = {"en": "the and that with from house water people", "de": "der und nicht mit über straße wasser häuser", "fr": "le et que avec été élève château garçon"}


def text(lang, i, n=30):
    w = WORDS[lang].split()
    r = np.random.default_rng(i)
    return " ".join(w[j] for j in r.integers(0, len(w), n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, x, "s", 0.5) for i, t, x in rows], "doc_id bigint, text string, lang string, source string, score double")


def brute(texts, t):
    """Code length of ``t`` by counting contexts in dictionaries."""
    seen = {}
    for raw in (L._PAD + x.lower().encode() for x in texts):
        for i in range(L.ORDER, len(raw)):
            for k in range(L.ORDER + 1):
                c = seen.setdefault(raw[i - k : i], {})
                c[raw[i]] = c.get(raw[i], 0) + 1
    raw, bits = L._PAD + t.lower().encode(), 0.0
    for i in range(L.ORDER, len(raw)):
        for k in range(L.ORDER, -1, -1):
            c = seen.get(raw[i - k : i])
            if c is None:
                continue
            n, u = sum(c.values()), len(c)
            if raw[i] in c:
                bits += np.log2((n + u) / c[raw[i]])
                break
            bits += np.log2((n + u) / u)
        else:
            bits += 8
    return bits


def test_code_lengths():
    train = {x: [text(x, i) for i in range(3)] for x in WORDS}
    m = L.Model(train)
    for t in ("the water", "Häuser über", "日本", "xyzzy 123", text("fr", 99)):
        got = m.bits([L._PAD + t.lower().encode(), L._PAD + b"q"])[0]
        for i, x in enumerate(m.langs):
            assert got[i] == pytest.approx(brute(train[x], t), rel=1e-5)


def test_blocks_add_up(monkeypatch):
    m = L.Model({x: [text(x, 1)] for x in WORDS})
    t = text("de", 5, 400)
    whole = m.bits([L._PAD + t.encode()])[0]
    monkeypatch.setattr(L, "BLOCK", 64)
    raw = L._PAD + t.encode()
    parts = m.bits([raw[i : i + 64 + L.ORDER] for i in range(0, len(raw) - L.ORDER, 64)]).sum(0)
    assert parts == pytest.approx(whole)
    assert m.predict([t, "", None, "123 !"])[0] == ["de", "und", "und", "und"]


def test_operator(spark):
    rows = [(i, text(x, i), x) for i, x in enumerate(list(WORDS) * 40)]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 +++", "de"), (None, text("fr", 3), "fr"), (1003, text("en", 4), None), (5, text("en", 7, 20_000), "en"), (6, "same", "de"), (6, "same", "de")]
    got = L.identify(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    at = {r.doc_id: r for r in got}
    assert all(at[i].lang_pred == x for i, x in enumerate(list(WORDS) * 40) if i not in (5, 6))
    assert [at[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and at[1000].score == 0
    assert at[None].lang_pred == "fr" and not at[None].held_out and at[1003].lang_pred == "en"
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got if r.doc_id is not None)
    assert L.identify(docs(spark, [])).collect() == []
    assert [r.lang_pred for r in L.identify(docs(spark, [(1, "abc", None)])).collect()] == ["und"]


def test_nothing_of_the_held_out_is_learned(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows = [(i, text("en", i), "zz" if i in held else "en") for i in range(200)]
    assert {r.lang_pred for r in L.identify(docs(spark, rows)).collect()} == {"en"}


def test_accuracy(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
