from vecscore.llm import lines

SCHEMA = "doc_id bigint, text string, n_chars bigint, lines string, _pos int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), "x", 3) for i, t in rows], SCHEMA)


def worded(x):
    return bool(x.strip(" \t\n\r\x0b\x0c"))


def brute(rows):
    """By text: windows in order of (doc_id, text's place), later ones cover."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out[i] = (0, 0, None)
            continue
        own = t.split("\n")
        at = [k for k, x in enumerate(own) if worded(x)]
        gone, fresh = set(), []
        for j in range(len(at) - 2):
            w = tuple(own[at[j + k]] for k in range(3))
            if w in seen:
                gone |= {j, j + 1, j + 2}
            seen.add(w)
        stay, no = [], -1
        for x in own:
            no += worded(x)
            if no not in gone:
                stay.append(x)
        out[i] = (len(at), len(gone), "\n".join(stay))
    return out


def test_like_brute_force(spark):
    import random

    r = random.Random(4)
    line = [f"line {k}" for k in range(12)] + ["", "  ", "é 日"]
    rows = [(i, "\n".join(r.choice(line) for _ in range(r.randrange(12)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "a\nb\nc\nd"), (204, "x\na\nb\nc\ny"), (205, "q\nb\nc\nd\nr"), (206, "z\nz\nz\nz\nz\nz"), (207, "a\nb"), (208, "\n".join(f"u{k}" for k in range(3000))), (209, "\n".join(f"u{k}" for k in range(3000)))]
    got = lines.dedup(docs(spark, rows)).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in got} == brute(rows)
    whole = lines.dedup_documents(docs(spark, rows))
    assert whole.columns == docs(spark, []).columns
    want = brute(rows)
    for r_ in whole.collect():
        assert r_.text == want[r_.doc_id][2] and r_.n_chars == len(r_.text or "") and (r_.lines, r_._pos) == ("x", 3)


def test_equal_rows_and_null_ids(spark):
    t = "a\nb\nc"
    got = sorted((str(r.doc_id), r.n_removed, r.text) for r in lines.dedup(docs(spark, [(1, t), (1, t), (2, t), (None, "q\na\nb\nc")])).collect())
    assert got == [("1", 3, ""), ("1", 3, ""), ("2", 3, ""), ("None", 0, "q\na\nb\nc")]
    assert [r.n_removed for r in lines.dedup(docs(spark, [(1, t), (1, t)])).collect()] == [0, 0]


def test_empty(spark):
    assert lines.dedup(docs(spark, [])).collect() == [] and lines.dedup_documents(docs(spark, [])).collect() == []


def test_only_texts_that_lose_lines_move(spark, monkeypatch):
    """Whatever the size: a join with all texts would shuffle the whole input as soon as it is too large to broadcast."""
    rows = [(i, f"a {i}\nb {i}\nc {i}\nd {i}") for i in range(400)] + [(1000 + i, f"x\na {i}\nb {i}\nc {i}\ny") for i in range(20)] + [(None, "a 1\nb 1\nc 1"), (2000, None)]
    table = docs(spark, rows)
    lost = lines.covered(table)
    marked = lines._marked(table, lost)
    keys = {(r._id, r._hash) for r in lost.collect()}
    got = {(r.doc_id, r._key): r._maybe for r in marked.collect()}
    assert len(keys) == 21 and all(got[k] for k in keys) and sum(got.values()) < 30
    monkeypatch.setattr(lines, "PLACES", 8)  # far too few bits: more texts move, the result is the same
    monkeypatch.setattr(lines, "MOST", 1)
    want = brute([(i if i is not None else -1, t) for i, t in rows])
    assert {(-1 if r.doc_id is None else r.doc_id): (r.n_lines, r.n_removed, r.text) for r in lines.dedup(table).collect()} == want
