"""Byte-level BPE from a tokenizer file: whole-token counts, a bounded-lookahead encoder and an incremental decoder.

Two operators share the parts here.

``token_counts`` (whole-token shortcut): beforehand, every vocabulary string that is a pre-token by itself is put
through the merges; those that come out as one token are proven, and their pre-tokens count 1 without merging.
All other pre-tokens are merged.

``encode_decode`` (streaming transducer): every pre-token is fed to a transducer that holds at most two lookaheads of
bytes. What it has merged is final up to the merge list's sufficient lookahead before the end of what it has seen
(:func:`lookahead`), or up to the pre-token's end, whichever comes first; that is emitted and forgotten. Ids are hashed
as they come; the decoder turns them back into text with a byte-to-text state machine that carries an unfinished
character over. What the transducer gives for a pre-token of up to KEPT characters is remembered, up to a number of
bytes; of longer ones nothing is kept, neither ids nor text, so memory does not grow with a pre-token.

Texts are cut into windows at points where a pre-token surely ends, so lists of pre-tokens stay short however long
a text is. Nulls: a null text is empty (0 tokens, hashes of nothing); null ids pass through. An empty table
gives an empty result. Equal rows give equal results. Only doc_id and text are read. Special strings inside a text
are one token, as is the library's default. The vocabulary is the only thing sent to tasks (its file is read where
the plan is built), of a fixed size.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import itertools
import json
import operator
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, worked_off

WINDOW = 1 << 17
#: Bytes, about, that each of the two generations of a memo of merged pre-tokens may hold, and characters of what it keeps.
MEMO, KEPT = 96 << 20, 64
#: The pre-tokenizer's pattern (fixed value of the byte-level BPE format).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A pre-token ends before each match: a letter, digit or black run is over there, whatever follows.
_ENDS = r"(?<=\p{L})\P{L}|(?<=\p{N})\P{N}|(?<=\S)\s"
_LAST_END, _NEXT_END = regex.compile("(?r)" + _ENDS), regex.compile(_ENDS)
_NONE = 1 << 62
_IDS, _DECIMAL = operator.itemgetter(0), operator.itemgetter(1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b if b in own else next(extra)) for b in range(256)]


def lookahead(merges: list[tuple[str, str]]) -> int:
    """Bytes after a token's end that decide it.

    A merge happens or not by the earlier-ranked merges whose spans overlap its own; one that also reaches further
    right brings in what decides itself. So a merge's reach is the most, over earlier merges that overlap it by a
    suffix of it or contain it, of the bytes by which they go beyond it plus their own reach. Ranks fall along
    such a chain, so one pass in rank order is enough. Equal ranks go left to right and don't look right.
    A token is final if every merge that could still cover its end is decided.
    """
    starts: dict[str, int] = {}
    within: dict[str, int] = {}
    most = 0
    for left, right in merges:
        s = left + right
        n = len(s)
        reach = max([within.get(s, 0), *(starts.get(s[i:], 0) for i in range(n))])
        most = max(most, n - 1 + reach)
        for i in range(n):
            for k in range(i + 1, n + 1):
                v = n - k + reach
                if v > within.get(s[i:k], 0):
                    within[s[i:k]] = v
                if i == 0 and v > starts.get(s[:k], 0):
                    starts[s[:k]] = v
    return most


class Vocabulary:
    """A byte-level BPE file: merges by rank, bytes of each id, special strings, proven whole tokens."""

    def __init__(self, spec: dict):
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        symbols = byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        self.first = [ids[c] for c in symbols]
        self.pairs = {}
        for rank, (a, b) in enumerate(merges):
            self.pairs.setdefault(ids[a] << 20 | ids[b], rank << 20 | ids[a + b])
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in ids.items()}
        added = spec.get("added_tokens") or []
        self.special = {t["content"]: t["id"] for t in added}
        self.bytes_of |= {t["id"]: t["content"].encode() for t in added}
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.look = lookahead(merges)
        self.whole = self._proven()

    def _proven(self) -> dict[str, int]:
        found = {}
        for i, raw in self.bytes_of.items():
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                continue
            if text not in self.special and PATTERN.findall(text) == [text] and self.merge(raw) == [i]:
                found[text] = i
        return found

    def merge(self, raw: bytes) -> list[int]:
        """All merges of ``raw``: the lowest rank first, the leftmost of equal ones first."""
        ids = [self.first[b] for b in raw]
        if len(ids) > 96:
            return self._merge_long(ids)
        get = self.pairs.get
        ranks = [get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            i = ranks.index(low)
            ids[i : i + 2] = [low & 0xFFFFF]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        get, n = self.pairs.get, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(v >> 20, i, ids[i], ids[i + 1]) for i in range(n - 1) if (v := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = get(a << 20 | b) & 0xFFFFF, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (v := get(ids[i] << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (v >> 20, i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (v := get(ids[h] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (v >> 20, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def windows(self, text: str) -> Iterator[list[str] | int]:
        """Pre-tokens, a list for each window; the id of a special string by itself."""
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                yield self.special[part]
                continue
            at = 0
            while len(part) - at > WINDOW:
                cut = _LAST_END.search(part, at + 1, at + WINDOW) or _NEXT_END.search(part, at + WINDOW)
                if not cut:
                    break
                yield PATTERN.findall(part[at : cut.start()])
                at = cut.start()
            yield PATTERN.findall(part[at:])


class Transducer:
    """Feeds on bytes of one pre-token; gives ids as soon as no later byte can change them."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.held = vocabulary, b""

    def feed(self, raw: bytes) -> Iterator[list[int]]:
        look, size = self.v.look, self.v.bytes_of
        for at in range(0, len(raw), look):
            self.held += raw[at : at + look]
            if len(self.held) >= 2 * look:
                end, out = 0, []
                for i in self.v.merge(self.held):
                    if end + len(size[i]) > len(self.held) - look:
                        break
                    end += len(size[i])
                    out.append(i)
                self.held = self.held[end:]
                yield out

    def flush(self) -> list[int]:
        raw, self.held = self.held, b""
        return self.v.merge(raw)


class Decoder:
    """Ids to text, piece by piece; the state is the unfinished bytes of one character."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of, self.state = vocabulary.bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def flush(self) -> str:
        return self.state.decode(b"", True)


@functools.lru_cache(maxsize=2)
def vocabulary(spec: str) -> Vocabulary:
    return Vocabulary(json.loads(spec))


class _Memo(dict):
    """What the transducer gives for a short pre-token. A full generation becomes the old one; what is met again moves to the new."""

    def __init__(self, make, known=()):
        super().__init__(known)
        self.make, self.known, self.old, self.held = make, dict(known), {}, 0

    def __missing__(self, piece: str):
        if self.held > MEMO:
            self.old = dict(self)
            self.clear()
            self.update(self.known)
            self.held = 0
        made = self.old.get(piece)
        self[piece] = made = self.make(piece) if made is None else made
        self.held += 250 + 20 * len(piece)  # an entry, its text, its ids and their decimals
        return made


def emitted(v: Vocabulary, piece: str) -> Iterator[list[int]]:
    """Ids of one pre-token as the transducer gives them."""
    t = Transducer(v)
    for at in range(0, len(piece), v.look):
        yield from t.feed(piece[at : at + v.look].encode())
    yield t.flush()


def _counted(v: Vocabulary, piece: str) -> int:
    return sum(map(len, emitted(v, piece)))


def count(v: Vocabulary, text: str, memo: _Memo) -> int:
    n = 0
    for w in v.windows(text):
        if isinstance(w, int):
            n += 1
        elif max(map(len, w), default=0) <= KEPT:
            n += sum(map(memo.__getitem__, w))
        else:
            n += sum(memo[piece] if len(piece) <= KEPT or piece in memo.known else _counted(v, piece) for piece in w)
    return n


@functools.lru_cache(maxsize=2)
def counter(v: Vocabulary) -> _Memo:
    """Memo of pre-token -> how many tokens it is, the proven ones known beforehand; one for all tasks of a process."""
    return _Memo(lambda piece: _counted(v, piece), dict.fromkeys(v.whole, 1))


@functools.lru_cache(maxsize=2)
def encoder(v: Vocabulary) -> _Memo:
    """Memo of pre-token -> (its ids, the same in decimal with commas); one for all tasks of a process."""

    def make(piece: str) -> tuple[tuple[int, ...], str]:
        ids = tuple(itertools.chain.from_iterable(emitted(v, piece)))
        return ids, ",".join(map(str, ids))

    return _Memo(make)


def _pieces(v: Vocabulary, w: list[str], memo: _Memo) -> Iterator[tuple[list[int], str]]:
    """(ids, the same in decimal with commas) of a window's pre-tokens; long ones as they come out of the transducer."""
    if max(map(len, w), default=0) <= KEPT:
        found = list(map(memo.__getitem__, w))
        yield list(itertools.chain.from_iterable(map(_IDS, found))), ",".join(map(_DECIMAL, found))
        return
    for piece in w:
        if len(piece) <= KEPT:
            yield memo[piece]
            continue
        for ids in emitted(v, piece):
            yield ids, ",".join(map(str, ids))


def round_trip(v: Vocabulary, text: str, memo: _Memo) -> tuple[int, str, str]:
    """(number of ids, sha256 of the ids, sha256 of the text they decode to), in memory of one window."""
    ids_hash, text_hash, decoder, n = hashlib.sha256(), hashlib.sha256(), Decoder(v), 0
    for w in v.windows(text):
        for got, said in [([w], str(w))] if isinstance(w, int) else _pieces(v, w, memo):
            if got:
                ids_hash.update((("," if n else "") + said).encode())
                text_hash.update(decoder.feed(got).encode())
                n += len(got)
    text_hash.update(decoder.flush().encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def encode(v: Vocabulary, text: str) -> Iterator[list[int]]:
    """Token ids of ``text`` in order, some at a time."""
    for w in v.windows(text):
        if isinstance(w, int):
            yield [w]
            continue
        for piece in w:
            yield from emitted(v, piece)


def _spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs`` (doc_id, text)."""
    spec = docs.sparkSession.sparkContext.broadcast(_spec(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(spec.value)
        memo = counter(v)
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [count(v, t, memo) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select("doc_id", "text")
    return worked_off(rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"), "counted")


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of ``docs`` (doc_id, text)."""
    spec = docs.sparkSession.sparkContext.broadcast(_spec(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(spec.value)
        memo = encoder(v)
        for b in slices(batches):
            n, ids, text = zip(*(round_trip(v, t or "", memo) for t in b.column(1).to_pylist())) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", "text")
    return worked_off(rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"), "encoded")


def token_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids array<int>): the ids themselves."""
    spec = docs.sparkSession.sparkContext.broadcast(_spec(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(spec.value)
        for b in slices(batches):
            ids = [[i for some in encode(v, t or "") for i in some] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")
