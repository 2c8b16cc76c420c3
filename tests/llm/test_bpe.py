import hashlib
import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vecscore.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, n_tokens string, ids int"


@pytest.fixture(scope="module")
def v():
    return bpe.vocabulary(bpe._spec(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    r = random.Random(1)
    out = ["", " ", "a", "it's  we'll\t\tfoo 　 x", "<|endoftext|> hi<|endoftext|>", "\n\n  \r\n", "日本語" * 500, "😀é" * 300, "a" * 9000, "ab" * 9000 + " \n\n  x", " " * 7000 + "x", "-" * 9000, "�́", "\x00\x01"]
    out += ["".join(r.choice("thaeion ,.'0\nÉ") for _ in range(r.randrange(400))) for _ in range(200)]
    out += ["".join(r.choice("abcdetinrs") for _ in range(20_000)), "a1" * 100_000, "word " * 60_000]
    return out


def test_like_the_library(v, library):
    n, ids = bpe.counter(v), bpe.encoder(v)
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        assert bpe.count(v, t, n) == len(want)
        got = [i for some in bpe.encode(v, t) for i in some]
        assert got == want
        text = library.decode(want, skip_special_tokens=False)
        assert bpe.round_trip(v, t, ids) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_whole_tokens_are_proven(v, library):
    some = random.Random(2).sample(sorted(v.whole), 3000)
    assert all(library.encode(t, add_special_tokens=False).ids == [v.whole[t]] for t in some)


def test_transducer_is_stable_and_bounded(v):
    r = random.Random(3)
    for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz", "aA-", " "):
        raw = "".join(r.choice(alphabet) for _ in range(5 * v.look)).encode()
        t, got, most = bpe.Transducer(v), [], 0
        for i in range(0, len(raw), 501):
            for some in t.feed(raw[i : i + 501]):
                got += some
            most = max(most, len(t.held))
        assert got + t.flush() == v.merge(raw) and most <= 2 * v.look


def test_lookahead_of_a_chain():
    # "ab" is undone by "bc", which is undone by "cd": three bytes beyond the first decide.
    assert bpe.lookahead([("c", "d"), ("b", "c"), ("a", "b")]) >= 3
    assert bpe.lookahead([("a", "b")]) == 1


def test_decoder_carries_bytes_over(v):
    ids = [v.first[b] for b in "é日😀".encode()]
    d = bpe.Decoder(v)
    assert "".join(d.feed([i]) for i in ids) + d.flush() == "é日😀"
    d = bpe.Decoder(v)
    assert d.feed(ids[:1]) + d.flush() == "�"


def test_memo_is_bounded_in_bytes(v, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 5000)
    memo = bpe.encoder.__wrapped__(v)
    t = " ".join(f"w{i}x" for i in range(1000))
    assert bpe.round_trip(v, t, memo)[0] == sum(len(v.merge(p.encode())) for p in bpe.PATTERN.findall(t))
    assert len(memo) + len(memo.old) < 50


def test_long_pieces_are_streamed_and_not_kept(v, library):
    memo, numbers = bpe.encoder.__wrapped__(v), bpe.counter.__wrapped__(v)
    t = "x " + "ab" * 9000 + " y " + "q" * 100
    want = library.encode(t, add_special_tokens=False).ids
    assert bpe.round_trip(v, t, memo)[:2] == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
    assert bpe.count(v, t, numbers) == len(want)
    assert memo and max(map(len, memo)) <= bpe.KEPT and max(map(len, set(numbers) - set(v.whole)), default=0) <= bpe.KEPT


def test_memory_does_not_grow_with_a_pre_token(v, monkeypatch):
    """Of ten million letters in one pre-token the transducer holds two lookaheads, emits runs no longer, and keeps nothing."""
    held, runs = [0], [0]
    feed, merge = bpe.Transducer.feed, v.merge
    monkeypatch.setattr(v, "merge", lambda raw: merge(raw[:0]) or [v.first[b] for b in raw])  # a list of ids as long, made faster

    def watched(self, raw):
        for ids in feed(self, raw):
            runs[0] = max(runs[0], len(ids))
            yield ids
        held[0] = max(held[0], len(self.held))

    monkeypatch.setattr(bpe.Transducer, "feed", watched)
    memo = bpe.encoder.__wrapped__(v)
    n, _, text = bpe.round_trip(v, "ab" * 5_000_000, memo)
    assert n == 10_000_000 and text == hashlib.sha256(b"ab" * 5_000_000).hexdigest()
    assert 0 < held[0] <= 2 * v.look and 0 < runs[0] <= 2 * v.look and not memo


def test_operators(spark, library):
    rows = [(1, "Hello world"), (2, None), (3, ""), (None, "x <|endoftext|>"), (1, "Hello world"), (5, "é" * 3000)]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], SCHEMA)
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in bpe.token_counts(df, PATH).collect()), key=key) == sorted(want, key=key)
    assert {r.doc_id: r.over_limit for r in bpe.token_counts(df, PATH).collect()}[5] == (want[5][2] > 1024)
    assert sorted(((r.doc_id, r.n_tokens) for r in bpe.encode_decode(df, PATH).collect()), key=key) == sorted(((i, n) for i, _, n in want), key=key)
    assert sorted((str(r.doc_id), list(r.ids)) for r in bpe.token_ids(df, PATH).collect()) == sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    for f in (bpe.token_counts, bpe.encode_decode):
        assert f(df.limit(0), PATH).collect() == []


def test_spec_of_a_small_vocabulary():
    s = bpe.byte_symbols()
    spec = {"model": {"vocab": {c: i for i, c in enumerate(s)} | {"ab": 256, "abc": 257}, "merges": [["a", "b"], ["ab", "c"]]}, "added_tokens": []}
    v = bpe.vocabulary(json.dumps(spec))
    assert v.merge(b"xabcab") == [s.index("x"), 257, 256]
