"""N-gram Jaccard join: universe partitions by size band, segment subsets, one-deletion neighbourhoods, exact checks.

Two documents link if the Jaccard similarity of their sets of word shingles is at least PERCENT / 100. Sizes fall into
bands, each reaching from lo to lo / t, so a partner of a size in band g is in g or g + 1. For the pairs whose
smaller size is in band g, sets differ in at most H_g tokens. The token universe is cut by hash into
m_g = H_g + 1 + x_g segments: a linked pair agrees on the whole subset in at least 1 + x_g of them. Each
document therefore indexes the hash of each of its subsets, for its own band and the one below, and documents
that share one are candidates. Documents of equal text are one node from the start.

The allocation is by cost, band by band. Small sets (up to WIDE differences) take half as many segments, each worth a
difference of one: all subsets and their one-deletion neighbourhoods, a row for each token, which is little there
and tells far more than subsets of three or four tokens would. Larger sets take one row a segment.

x_g pays for segments that tell nothing: empty ones, and *common* subsets that many unlike documents share.
A pair is lost only if both documents have more than x_g of these. Such documents, and only they, go on to a second
index, which costs a row for each of their tokens: half as many segments, with one-deletion neighbourhoods. Sets whose
segments would hold too few tokens skip it.

What even this leaves are documents that share much with many unlike ones, such as copies of one text with more
changes than the threshold allows. The ones of a band are a group. A group of at most SMALL members is compared by
parities in one task. A larger one is described by its *base*, the tokens that most members of a sample have, and by
what each member differs from it. Two linked members either share a difference, then one of their H_g + 1
rarest in the group, or none, and then both link with the member that is cheapest by its differences, x extra and y missing
tokens: with a = (1 - t) / (1 + t) sets of disjoint differences link if and only if their costs, (1 - a) x + (1 + a) y, are
together at most 2 a |base|. So that member is compared with all others, and the members that share a difference are
the next groups. A difference is what fewer than half have, so groups halve; and a member with so many differences of
its own that no other can be similar enough is done. That is exact for any base.

Candidates are not all pairs of those that share a subset. The group's smallest member is compared with all
others, links are merged to components, and only what is still in different components goes on: members outside the
largest component, if few, are compared with all others; if many, one from the smallest component is, in ROUNDS
rounds. A subset still split after them is common; which are, a bitmap tells each task. So work per round is linear in the group, no pair is emitted
within a component, and no link between components is lost.

Subset hashes travel packed by hash range; ranges hold a bounded number each, by the input's size. A task first
joins what it has itself: of LOCAL documents or more that share a subset, the smallest is paired with the others
there and then, and it alone goes to the range. So a subset that most documents share puts one row a task and
buffer into its range. Joins by a subset, label or text that many rows share deal these over parts.
Candidates are refuted by parity bits where possible and checked exactly on the sets of shingle hashes (64 bits)
otherwise; sets are made once, for the documents that take part in any candidate.

Words are ASCII-space separated, A-Z lower-cased; a document of fewer than WORDS words has its whole sequence as
its one shingle; a very long one has a row for each segment, so more rows, not larger ones. Nulls: a null text, or one without words, has no shingles and no links (component: its own
id); a null id can be in a component but not name it; ids may be of any type that has an order. Equal texts are one
node, named by a 64-bit hash; unlike texts that share one are named by a second hash. An empty table gives an empty
result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import clean_shuffles, settings, shared_path, stored
from .common import ONE_TASK, SMALL_BATCHES, Scratch, met, row_of, slices, tie_of, unpacked
from .graph import components

#: Subset hashes in one range, at about one for every 16 bytes of text.
RANGE = 250_000
#: Ids that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Members outside the largest component up to which a group is finished at once; rounds for larger ones.
FEW, ROUNDS = 8, 1
#: Subset hashes a task buffers; documents of one subset among them that it joins itself.
_FLUSH, LOCAL = 400_000, 8
#: Differences up to which a band's first index takes one-deletion neighbourhoods: sets of about twenty tokens.
WIDE = 3
#: Tokens that a segment of the second index should hold on average; where it would be fewer, a band has none.
FULL = 4
#: Members of a group, about, whose majority makes its base; and members up to which a group is compared in one task.
SAMPLE, SMALL = 64, 1024
#: Bits of a part of a bitmap of hashes, as bitmap_construct_agg makes it; bits for each row of a table of them, and parts at most (32 MB).
PART, BITS, PARTS = 32_768, 16, 8192
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of ``text``."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = min(words, len(w))
    out = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mixed(out + h[i : len(w) - n + 1 + i])
    return np.unique(out)


class Bands:
    """Size bands and the number of segments of each, for a threshold in percent."""

    def __init__(self, percent: int):
        self.percent, self.lo, self.hi, self.partner, self.differ = percent, [], [], [], []
        lo = 1
        while len(self.lo) < 250:  # far beyond any text; the band's number shares a byte
            hi = max(lo, lo * 100 // percent)
            most = hi * 100 // percent
            self.lo.append(lo)
            self.hi.append(hi)
            self.partner.append(most)
            self.differ.append((100 - percent) * (hi + most) // (100 + percent))
            lo = hi + 1
        self.starts = np.array([min(x, 1 << 62) for x in self.lo], np.int64)

    def of(self, n: int) -> Iterator[int]:
        """Bands in which a set of ``n`` looks for partners."""
        g = int(np.searchsorted(self.starts, n, "right")) - 1
        yield g
        if g and n <= self.partner[g - 1]:
            yield g - 1

    def wide(self, g: int) -> bool:
        """Whether the first index takes neighbourhoods: sets are small, so they cost few rows and tell much more."""
        return 0 < self.differ[g] <= WIDE

    def spare(self, g: int) -> int:
        return self.spare_wide(g) if self.wide(g) else self.differ[g] // 20 + 2 if self.differ[g] >= 8 else 0

    def segments(self, g: int) -> int:
        return self.differ[g] + 1 + self.spare(g)

    def spare_wide(self, g: int) -> int:
        return self.differ[g] // 40 + 1 if self.differ[g] >= 8 else 0

    def segments_wide(self, g: int) -> int:
        return self.differ[g] // 2 + 1 + self.spare_wide(g)

    def second(self, g: int) -> bool:
        """Whether band ``g`` has a second index."""
        return not self.wide(g) and self.lo[g] >= FULL * self.segments_wide(g)


def _subsets(tokens: np.ndarray, m: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first, end) of each non-empty segment in ``tokens``, sorted by what decides the segment."""
    at = ((tokens >> _U(32)) * _U(m)) >> _U(32)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[first], first, np.concatenate((first[1:], [len(at)]))


def _signed(hashes: np.ndarray, at: np.ndarray, g: int) -> np.ndarray:
    """Subset hashes that hold their band in the lowest byte."""
    return (_mixed(hashes + _mixed(at * _U(256) + _U(g))) & ~_U(255)) | _U(g)


def _sums(tokens: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(tokens + _U(0x9E3779B97F4A7C15)), dtype=np.uint64)))


def index_hashes(tokens: np.ndarray, bands: Bands) -> Iterator[tuple[int, int, np.ndarray]]:
    """(band, segments to spare that are left, hashes) of the first index, for the bands of a set."""
    for g in bands.of(len(tokens)):
        spare, hashes, _ = level_hashes(tokens, bands, g, 0)
        yield g, spare, np.unique(hashes)


def neighbourhood_hashes(tokens: np.ndarray, bands: Bands, g: int, seed: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(segments of fewer than two tokens, hashes of all subsets and their one-deletion neighbourhoods, segment of each)."""
    tokens = np.sort(_mixed(tokens + _U(seed)))
    m = bands.segments_wide(g)
    at, first, end = _subsets(tokens, m)
    sums = _sums(tokens)
    whole = sums[end] - sums[first]
    size = end - first
    own = sums[1:] - sums[:-1]
    big = np.repeat(size > 1, size)
    less = (np.repeat(whole, size) - own)[big]
    of = np.concatenate((at, np.repeat(at, size)[big]))
    return m - int((size > 1).sum()), _signed(np.concatenate((whole, less)), of, g), of


def level_hashes(tokens: np.ndarray, bands: Bands, g: int, level: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(segments to spare that are left, hashes, segment of each) in band ``g``: of the first index (level 0) or the second (1)."""
    if level or bands.wide(g):
        poor, hashes, of = neighbourhood_hashes(tokens, bands, g, level)
        return bands.spare_wide(g) - poor, hashes, of
    m = bands.segments(g)
    at, first, end = _subsets(tokens, m)
    sums = _sums(tokens)
    return bands.spare(g) - (m - len(at)), _signed(sums[end] - sums[first], at, g), at


def gathered(hashes: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which entries stay as they are, places of the centres, place of the centre for each other entry).

    The others stand in groups of LOCAL or more of equal hash; a group's centre is its smallest node.
    """
    order = np.lexsort((nodes, hashes))
    h = hashes[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(h)))
    many = size >= LOCAL
    own = np.repeat(many, size)
    return np.sort(order[~own]), order[first[many]], np.stack([order[own], np.repeat(order[first[many]], size[many])])


#: Packed rows, by kind: arrays of 64 bits each. 0 (hash, node); 1 the same, of a centre; 2 (node, band) with too many
#: segments that tell nothing; 4 pairs and 5 (hash, member) of groups a task joined itself. Kind 3 is a table of documents.
_WIDTH = {0: 2, 1: 2, 2: 2, 4: 2, 5: 2}


def _index(rows: DataFrame, words: int, bands: Bands, ranges: int) -> DataFrame:
    """(range, kind, payload) of (doc_id, node, text): packed subset hashes with nodes, and documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        hashes, nodes, sparse, docs, held = [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h = np.concatenate(hashes or [np.empty(0, np.uint64)])
            n = np.concatenate(nodes or [np.empty(0, np.int64)]).view(np.uint64)
            stay, centres, (own, to) = gathered(h, n)
            poor = np.array(sparse, np.int64).reshape(-1, 2).T.copy().view(np.uint64)
            other = own != to
            out: list[tuple[int, int, bytes]] = []
            for kind, keys, payload in (
                (0, h[stay] >> _U(8), [h[stay], n[stay]]),
                (1, h[centres] >> _U(8), [h[centres], n[centres]]),
                (2, poor[0], poor),
                (4, n[own[other]], [n[own[other]], n[to[other]]]),
                (5, n[own], [h[own], n[own]]),
            ):
                at = (keys % _U(ranges)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                for k, part in zip(*_runs(at[order], order)):
                    out.append((int(k), kind, np.stack([x[part] for x in payload]).tobytes()))
            for t in docs:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema) as w:
                    w.write_batch(t)
                out.append((int(t["node"][0].as_py()) % ranges, 3, sink.getvalue().to_pybytes()))
            for x in (hashes, nodes, sparse, docs):
                x.clear()
            for i in range(0, len(out), 16):
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out[i : i + 16]], t) for j, t in enumerate((pa.int32(), pa.int8(), pa.binary()))], ["range", "kind", "payload"])

        for b in slices(batches):
            sizes = []
            for node, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                tokens = shingles(text, words)
                sizes.append(len(tokens))
                if not len(tokens) or node in seen:
                    continue
                seen.add(node)
                for g, spare, found in index_hashes(tokens, bands):
                    hashes.append(found)
                    nodes.append(np.full(len(found), node, np.int64))
                    held += len(found)
                    if spare < 0:
                        sparse.append((node, g))
            docs.append(pa.RecordBatch.from_arrays([*(pa.array(c.to_pylist(), c.type) for c in b.columns[:2]), pa.array(sizes, pa.int64())], ["doc_id", "node", "n"]))
            if held > _FLUSH:
                yield from flush()
                held = 0
        yield from flush()

    return rows.mapInArrow(run, "range int, kind byte, payload binary")


def _first_hash(text: Column) -> Column:
    return F.xxhash64(text)


def nodes_of(docs: DataFrame) -> Column:
    """The node of a row of ``docs``.

    Rows of equal text are one node. Unlike texts of one 64-bit hash, of which a handful is to be expected among 10^10
    texts, are told apart by a second one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    one, two = _first_hash(text), F.xxhash64(F.lit(7), text)
    shared = docs.select(one.alias("a"), two.alias("b")).groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low <> high")
    unsafe = [r[0] for r in shared.select("a").collect()]  # a share of 2^-65 of the square of the number of texts
    return F.when(one.isin(unsafe), two).otherwise(one).alias("_node") if unsafe else one.alias("_node")


def _runs(keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    if not len(keys):
        return keys, []
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.split(order, first[1:])


def star(hashes: np.ndarray, nodes: np.ndarray, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, centre) for each member of a group but its smallest, and (hash, x) of groups of three or more without it.

    Groups of the hashes in ``whole`` have members elsewhere: all that are here are given.
    """
    order = np.lexsort((nodes, hashes))
    h, n = hashes[order], nodes[order]
    if len(h):
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (n[1:] != n[:-1])))
        h, n = h[new], n[new]
    if not len(h):
        e = np.empty(0, np.int64)
        return e, e, e, e
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    size = np.diff(np.append(first, len(h)))
    at = np.repeat(first, size)
    member = np.arange(len(h)) != at
    pairs = np.unique(np.stack([n[member], n[at[member]]], 1), axis=0)
    large = member & (np.repeat(size, size) > 2)
    if whole is not None and len(whole):
        large |= np.isin(h, whole)
    return pairs[:, 0], pairs[:, 1], h[large].view(np.int64), n[large]


def _found(parts: list[tuple[int, np.ndarray, np.ndarray]], docs: pa.Table) -> pa.Table:
    """One table of (kind, a, b, doc_id) from parts (kind, a, b) and, of kind 3, documents: a the size, b the node."""
    cols: list[list] = [[], [], [], []]
    for kind, a, b in parts:
        for c, x in zip(cols, (np.full(len(a), kind, np.int8), a, b)):
            c.append(pa.array(x))
        cols[3].append(pa.nulls(len(a), docs.schema.field("doc_id").type))
    for c, x in zip(cols, (pa.array(np.full(docs.num_rows, 3, np.int8)), *(docs[k].combine_chunks() for k in ("n", "node", "doc_id")))):
        c.append(x)
    return pa.table([pa.chunked_array(c, t) for c, t in zip(cols, (pa.int8(), pa.int64(), pa.int64(), docs.schema.field("doc_id").type))], names=["kind", "a", "b", "doc_id"])


def _meet(empty: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    """What the packed rows of one range have in common: kinds 0 pairs, 1 members of groups, 2 sparse nodes, 3 documents."""

    def run(table: pa.Table) -> pa.Table:
        parts: dict[int, list[np.ndarray]] = {k: [np.empty((w, 0), np.uint64)] for k, w in _WIDTH.items()}
        docs = [pa.table([pa.array([], f.type) for f in empty], schema=empty)]
        for kind, payload in zip(table["kind"], table["payload"]):
            raw = payload.as_buffer()
            if kind.as_py() == 3:
                with pa.ipc.open_stream(raw) as r:
                    docs.append(r.read_all().cast(empty))
            else:
                parts[kind.as_py()].append(np.frombuffer(raw, np.uint64).reshape(_WIDTH[kind.as_py()], -1))
        got = {k: np.concatenate(v, 1) for k, v in parts.items()}
        at = np.concatenate((got[0], got[1]), 1)
        x, centre, h, member = star(at[0], at[1].view(np.int64), got[1][0])
        signed = {k: [r.view(np.int64) for r in got[k]] for k in (2, 4, 5)}
        return _found([(0, x, centre), (1, h, member), (2, *signed[2]), (0, *signed[4]), (1, *signed[5])], pa.concat_tables(docs))

    return run


def parity(tokens: np.ndarray) -> bytes:
    """Bits, four or more for each token and a power of two of them: how often a token's bucket was met, modulo 2.

    A token that only one of two sets holds flips one bit, so bits that differ are never more than tokens that do.
    """
    n = 1 << max(6, (4 * len(tokens) - 1).bit_length() if len(tokens) else 6)
    met = np.bincount((_mixed(tokens) & _U(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(met.astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of parities as rows of ``width`` words: of the longer ones halves are added until they are as short."""
    while bits.shape[1] > width:
        bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
    return bits


def differ(p: pa.Array, q: pa.Array) -> np.ndarray:
    """Least number of tokens by which two sets differ, by their parities; the longer one is folded to the shorter."""
    widths = [pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) // 8 for x in (p, q)]
    out = np.zeros(len(p), np.int64)
    for w, v in np.unique(np.stack(widths, 1), axis=0):
        at = np.flatnonzero((widths[0] == w) & (widths[1] == v))
        rows = pa.array(at)
        one, two = (np.frombuffer(b"".join(x.take(rows).to_pylist()), np.uint64).reshape(len(at), -1) for x in (p, q))
        width = min(w, v)
        out[at] = np.bitwise_count(_folded(one, width) ^ _folded(two, width)).sum(1, dtype=np.int64)
    return out


class Checker:
    """Checks of candidate pairs: parities, an eighth of a byte for each bit, refute most unlinked pairs; sets decide the rest."""

    def __init__(self, sets: DataFrame, percent: int, scratch: Scratch):
        self.sets, self.percent, self.scratch = sets, percent, scratch

    def _meet(self, pairs: DataFrame, column: str, n: int) -> DataFrame:
        """(a, b, _p, _q) with ``column`` of both; few pairs are broadcast, so that sets without one do not move."""
        one, two = (self.sets.select(F.col("node").alias(k), *[F.col(c).alias(x) for c, x in ((column, v), ("n", m))]) for k, v, m in (("a", "_p", "_m"), ("b", "_q", "_n")))
        if n <= BROADCAST_IDS:
            two = two.join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
            both = one.join(F.broadcast(pairs), "a").join(two, "b")
        else:
            both = met(one.join(pairs, "a"), two, "b", n, F.xxhash64("a"))
        # Sizes that cannot link are seen here, before anything is compared.
        near = 100 * F.least("_m", "_n") >= self.percent * F.greatest("_m", "_n")
        return both.where(near).select("a", "b", "_p", "_q", "_m", "_n")

    def links(self, pairs: DataFrame, n: int) -> DataFrame:
        """Those of the ``n`` pairs (a, b) that link. The node of the two that has more pairs had best be b."""
        percent = self.percent

        def rough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in slices(batches):
                m, n = (x.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
                yield x.select([0, 1]).filter(pa.array((100 + percent) * differ(x.column(2), x.column(3)) <= (100 - percent) * (m + n)))

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                keep = []
                for p, q in zip(x.column(2), x.column(3)):
                    p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                    same = int((q[at] == p).sum())
                    keep.append(100 * same >= percent * (len(p) + len(q) - same))
                yield x.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        some, n = self.scratch.cut_and_count(self._meet(pairs, "parity", n).mapInArrow(rough, "a bigint, b bigint"))
        return self._meet(some, "tokens", n).mapInArrow(exact, "a bigint, b bigint")


def _sets(rows: DataFrame, words: int, needed: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """(node, n, parity, tokens) of the ``n`` needed nodes; tokens are the sorted hashes as bytes."""
    if n <= BROADCAST_IDS:
        needed = F.broadcast(needed)
    texts = rows.join(needed.withColumnRenamed("node", "_node"), "_node").groupBy(F.col("_node").alias("node")).agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [shingles(t, words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in got], pa.int64()), pa.array([parity(t) for t in got], pa.binary()), pa.array([t.tobytes() for t in got], pa.binary())], ["node", "n", "parity", "tokens"])

    return scratch.cut(texts.mapInArrow(run, "node bigint, n bigint, parity binary, tokens binary"), slim=False)


def _bitmap(hashes: DataFrame, n: int) -> np.ndarray:
    """Bits of the hashes in column ``hash``, of which there are ``n`` at most: small enough for the driver and for every task, however many."""
    places = PART * max(1, min(PARTS, -(-n * BITS // PART)))
    at = hashes.select(F.pmod(F.shiftrightunsigned("hash", 8), F.lit(places)).alias("_m"))
    bits = np.zeros(places // 8, np.uint8)
    for part, got in at.groupBy(F.expr(f"_m div {PART}")).agg(F.expr(f"bitmap_construct_agg(_m % {PART})")).toLocalIterator():
        bits[part * PART // 8 : (part + 1) * PART // 8] = np.frombuffer(got, np.uint8)
    return bits


def _in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be one of those of :func:`_bitmap`: true for all of them, and for few others."""
    at = (hashes.view(np.uint64) >> _U(8)) % _U(8 * len(bits))
    return (bits[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1


def _those_in(groups: DataFrame, bits: np.ndarray) -> DataFrame:
    """Rows (hash, node) whose hash may be in ``bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_in_bitmap(bits, b.column(0).to_numpy())))

    return groups.select("hash", "node").mapInArrow(run, "hash bigint, node bigint")


def _members(groups: DataFrame, bits: np.ndarray) -> DataFrame:
    """(node, g) of rows (hash, node) whose hash may be in ``bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            keep = _in_bitmap(bits, h)
            own = np.unique(np.stack([node[keep], h[keep] & 255], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1])], ["node", "g"])

    return groups.select("hash", "node").mapInArrow(run, "node bigint, g bigint").distinct()


class Merger:
    """Labels of nodes; the groups that share a subset are worked off against it."""

    def __init__(self, nodes: DataFrame, n: int, check: Checker):
        self.check, self.scratch, self.n = check, check.scratch, n
        self.labels = nodes.select("node", F.col("node").alias("label"))

    def _with(self, rows: DataFrame, few: DataFrame, key: str, n: int, spread: str, how: str = "inner") -> DataFrame:
        """A join in which one key may have most of the ``n`` rows; up to ONE_TASK of them are in one partition anyway."""
        return rows.join(few, key, how) if n <= ONE_TASK else met(rows, few, key, n, F.xxhash64(spread), how)

    def add(self, pairs: DataFrame, n: int) -> None:
        """Check the ``n`` pairs (a, b) and merge the labels of those that link."""
        if not n:
            return
        links, n = self.scratch.cut_and_count(self.check.links(pairs, n))
        if not n:
            return
        at = [self.labels.select(F.col("node").alias(k), F.col("label").alias(x)) for k, x in (("a", "_a"), ("b", "_b"))]
        both = self._with(links.join(at[0], "a"), at[1], "b", n, "a")
        merged = components(both.select(F.col("_a").alias("a"), F.col("_b").alias("b")), self.scratch).select(F.col("node").alias("label"), F.col("label").alias("_new"))
        self.labels = self.scratch.cut(self._with(self.labels, merged, "label", self.n, "node", "left").select("node", F.coalesce("_new", "label").alias("label")))

    def _alike(self, groups: DataFrame) -> DataFrame:
        """(hash, _like): for each hash of two members or more the smallest hash of its band that has the same members.

        Documents that agree on a segment agree on all its one-deletion neighbourhoods, so many groups are one group.
        Members are told by their number, the smallest, the largest, and two sums of 31 bits of each.
        """
        sums = {f"_s{k}": F.sum(F.shiftrightunsigned(F.xxhash64("node", F.lit(k)), 33)) for k in (1, 2)}
        told = {"_n": F.count(F.lit(1)), "_least": F.min("node"), "_most": F.max("node"), **sums}
        each = groups.groupBy("hash").agg(*[c.alias(k) for k, c in told.items()]).where("_least < _most")
        like = F.min("hash").over(Window.partitionBy(F.expr("hash & 255L"), *told))
        return self.scratch.cut(each.select("hash", like.alias("_like")))

    def work_off(self, groups: DataFrame, n: int, rounds: int) -> np.ndarray:
        """Compare members of each group (hash, node) across labels; the bitmap of the hashes still split after ``rounds`` comes back.

        Bitmaps hold some other hashes too. A group that is compared though another has the same members only costs, and a
        hash that counts as common sends documents on that need not go.
        """
        done, same, most = 0, self._alike(groups), n
        groups, n = self.scratch.cut_and_count(_those_in(groups, _bitmap(same.where("hash = _like"), n)))
        while True:
            at = groups.join(self.labels, "node")
            sizes = at.groupBy("hash", "label").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("_least"))
            split = sizes.groupBy("hash").agg(
                F.max(F.struct("_n", "label")).alias("_top"), F.min(F.struct("_n", "label", "_least")).alias("_low"), F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_kinds")
            ).where("_kinds > 1").select("hash", F.col("_top.label").alias("_main"), F.col("_low._least").alias("_centre"), F.col("_low.label").alias("_lc"), (F.col("_all") - F.col("_top._n") <= FEW).alias("_few"))
            if not n or done >= rounds:
                each = same.select(F.col("_like").alias("hash"), F.col("hash").alias("_each")).join(split.select("hash"), "hash")
                return _bitmap(each.select(F.col("_each").alias("hash")), most)
            open_, n = self.scratch.cut_and_count(self._with(at, split, "hash", n, "node"))
            done += 1
            outside = open_.where("_few and label <> _main").select("hash", F.col("node").alias("_u"), F.col("label").alias("_lu"))
            few = self._with(open_.where("_few"), outside, "hash", n, "node").where("label <> _lu and (label = _main or node < _u)").select(F.col("node").alias("a"), F.col("_u").alias("b"))
            many = open_.where("not _few and label <> _lc").select(F.col("node").alias("a"), F.col("_centre").alias("b"))
            self.add(*self.scratch.cut_and_count(few.union(many).distinct()))
            groups, n = self.scratch.cut_and_count(open_.where("not _few and node <> _centre").select("hash", "node"))

    def finish(self, left: DataFrame, bands: Bands) -> None:
        """Work off the members (node, g) of each band against each other, to the end."""
        groups, n = self.scratch.cut_and_count(left.select(F.col("g").alias("hash"), "node"))
        while n:
            at = groups.join(self.labels, "node")
            split = at.groupBy("hash").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count(F.lit(1)).alias("_size")).where("_low <> _high").select("hash", "_size")
            members, n = self.scratch.cut_and_count(self._with(at, split, "hash", n, "node").select(F.expr("hash & 255L").alias("g"), F.col("hash").alias("key"), "node", "label", "_size"))
            if not n:
                return
            self.add(*self.scratch.cut_and_count(_near(members.where(F.col("_size") <= SMALL), self.check.sets, self.check.percent).distinct()))
            many, n = self.scratch.cut_and_count(members.where(F.col("_size") > SMALL))
            if not n:
                return
            sets = self.check.sets.select("node", "tokens")
            based = self._with(many, _bases(many, sets), "key", n, "node", "left").join(sets, "node")
            seen = self.scratch.cut(_differences(based, bands), slim=False)
            centres = seen.groupBy("key").agg(F.min(F.struct("cost", "node", "label")).alias("_c")).select("key", F.col("_c.node").alias("b"), F.col("_c.label").alias("_lb"))
            pairs = self._with(seen.select("key", F.col("node").alias("a"), "label"), centres, "key", n, "a").where("label <> _lb").select("a", "b")
            self.add(*self.scratch.cut_and_count(pairs.distinct()))
            each, n = self.scratch.cut_and_count(seen.select("key", "node", "room", F.size("differences").alias("all"), F.explode("differences").alias("_d")).select("key", "node", "room", "all", "_d.hash", "_d.extra"))
            groups, n = self.scratch.cut_and_count(self._rarest(each, n, bands))

    def _rarest(self, each: DataFrame, n: int, bands: Bands) -> DataFrame:
        """(hash, node): the rarest H + 1 differences of each member, if others have them too and the member can have a partner at all.

        Of (key, node, room, all, hash, extra), all being a member's number of differences. With e tokens that only it has and
        m that only it lacks, a set of n tokens has none above (n - e) / (n + m); room is 100 (n - e) - percent (n + m) as if
        that held for all its differences. Those that nobody shares are the rarest and are not joined, only counted.
        """
        shared = each.groupBy("hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        member = Window.partitionBy("key", "node")
        ranked = self._with(each, shared, "hash", n, "node").withColumns({
            "_at": F.row_number().over(member.orderBy("_n", "hash")),
            "_shared": F.count(F.lit(1)).over(member),
            "_won": F.sum(F.when(F.col("extra"), 100).otherwise(bands.percent)).over(member),
        })
        most = F.element_at(F.array(*[F.lit(min(h, 1 << 62) + 1) for h in bands.differ]), (F.expr("hash & 255L") + 1).cast("int"))
        return ranked.where((F.col("all") - F.col("_shared") + F.col("_at") <= most) & (F.col("room") + F.col("_won") >= 0)).select("hash", "node")


def _near(few: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different labels in groups (key, node, label) of at most SMALL that parities cannot refute."""

    def run(x: pa.Table) -> pa.Table:
        node, label, n = (x[c].to_numpy() for c in ("node", "label", "n"))
        bits = [np.frombuffer(p.as_buffer(), np.uint64)[None] for p in x["parity"]]
        bits = np.concatenate([_folded(p, min(p.shape[1] for p in bits)) for p in bits])
        found: list[list[np.ndarray]] = [[node[:0]], [node[:0]]]
        for k in range(len(node) - 1):
            away = np.bitwise_count(bits[k + 1 :] ^ bits[k]).sum(1, dtype=np.int64)
            m = n[k + 1 :]
            near = (label[k + 1 :] != label[k]) & ((100 + percent) * away <= (100 - percent) * (m + n[k])) & (100 * np.minimum(m, n[k]) >= percent * np.maximum(m, n[k]))
            found[0].append(np.full(int(near.sum()), node[k]))
            found[1].append(node[k + 1 :][near])
        return pa.table([pa.array(np.concatenate(f), pa.int64()) for f in found], names=["a", "b"])

    return few.join(sets.select("node", "n", "parity"), "node").select("key", "node", "label", "n", "parity").groupBy("key").applyInArrow(run, "a bigint, b bigint")


def _bases(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, base): the tokens that more than half of about SAMPLE members of each group (key, node, _size) have."""
    few = members.where(F.pmod(F.xxhash64("node", F.lit(5)), F.ceil(F.col("_size") / SAMPLE)) == 0)

    def run(key: tuple[pa.Scalar, ...], x: pa.Table) -> pa.Table:
        kinds, n = np.unique(np.concatenate([np.frombuffer(t.as_buffer(), np.uint64) for t in x["tokens"]]), return_counts=True)
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([kinds[2 * n > x.num_rows].tobytes()], pa.binary())], names=["key", "base"])

    return few.join(sets, "node").select("key", "tokens").groupBy("key").applyInArrow(run, "key bigint, base binary")


def _differences(based: DataFrame, bands: Bands) -> DataFrame:
    """(key, node, label, room, cost, differences) of (g, key, node, label, base, tokens): hashes of what a member has beyond the base, or lacks of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cost, room, hashes, extras, ends = [], [], [], [], [0]
            for g, key, base, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist(), b.column(5)):
                base, own = np.frombuffer(base or b"", np.uint64), np.frombuffer(raw.as_buffer(), np.uint64)
                extra, missing = np.setdiff1d(own, base, True), np.setdiff1d(base, own, True)
                cost.append(2 * bands.percent * len(extra) + 200 * len(missing))
                room.append(100 * (len(own) - len(extra)) - bands.percent * (len(own) + len(missing)))
                hashes.append(_signed(_mixed(np.concatenate((extra, missing))), np.array([key], np.int64).view(np.uint64), g).view(np.int64))
                extras.append(np.arange(len(hashes[-1])) < len(extra))
                ends.append(ends[-1] + len(hashes[-1]))
            each = pa.StructArray.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(extras))], ["hash", "extra"])
            differences = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array(room, pa.int64()), pa.array(cost, pa.int64()), differences], ["key", "node", "label", "room", "cost", "differences"])

    return based.select("g", "key", "node", "label", "base", "tokens").mapInArrow(run, "key bigint, node bigint, label bigint, room bigint, cost bigint, differences array<struct<hash: bigint, extra: boolean>>")


_SET = "node bigint, g bigint, n bigint, tokens binary"


def _going_on(asked: DataFrame, bands: Bands, level: int, common: np.ndarray) -> DataFrame:
    """Of (node, g, n, tokens) those with more segments at ``level`` that tell nothing than they can spare; ``common`` is the bitmap of common hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for g, raw in zip(b.column(1).to_pylist(), b.column(3)):
                spare, hashes, of = level_hashes(np.frombuffer(raw.as_buffer(), np.uint64), bands, g, level)
                keep.append(spare < 0 or len(np.unique(of[_in_bitmap(common, hashes)])) > spare)
            yield b.filter(pa.array(keep, pa.bool_()))

    return asked.select("node", "g", "n", "tokens").mapInArrow(run, _SET)


def _second(left: DataFrame, bands: Bands) -> DataFrame:
    """(hash, node) of (node, g, n, tokens): the second index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, g, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)):
                _, hashes, _ = level_hashes(np.frombuffer(raw.as_buffer(), np.uint64), bands, g, 1)
                values = np.unique(hashes).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.full(len(values), node, np.int64))], ["hash", "node"])

    return left.mapInArrow(run, "hash bigint, node bigint")


def join(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, node, label) for each row of ``docs`` (doc_id, text); a label names a component."""
    spark, bands = docs.sparkSession, Bands(percent)
    with clean_shuffles(spark), settings(spark, **SMALL_BATCHES):
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        ranges = max(8, size // 16 // RANGE + 1)
        scratch, own = Scratch(spark), nodes_of(docs)
        rows = docs.select("doc_id", own, "text")
        id_type = rows.schema["doc_id"].dataType
        empty = pa.schema([("doc_id", to_arrow_type(id_type)), ("node", pa.int64()), ("n", pa.int64())])
        found = _index(rows, words, bands, ranges).groupBy("range").applyInArrow(_meet(empty), f"kind byte, a bigint, b bigint, doc_id {id_type.simpleString()}")
        found = scratch.cut(found, slim=False)
        pairs, n_pairs = scratch.cut_and_count(found.where("kind = 0").select("a", "b").distinct())
        groups, n_groups = scratch.cut_and_count(found.where("kind = 1").select(F.col("a").alias("hash"), F.col("b").alias("node")))
        sparse = found.where("kind = 2").select(F.col("a").alias("node"), F.col("b").alias("g")).distinct()
        nodes, n_nodes = scratch.cut_and_count(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(sparse.select("node")).distinct())
        merger = Merger(nodes, n_nodes, Checker(_sets(rows.select("_node", "text"), words, nodes, n_nodes, scratch), percent, scratch))
        merger.add(pairs, n_pairs)
        common = merger.work_off(groups, n_groups, ROUNDS)
        # The documents that may have too much in common with others: those with common subsets, and sparse ones.
        asked = _members(groups, common).union(sparse).distinct().join(merger.check.sets.drop("parity"), "node")
        left, n = scratch.cut_and_count(_going_on(asked, bands, 0, common), slim=False)
        if n:
            one = scratch.cut(left.where(F.col("g").isin([g for g in range(len(bands.lo)) if bands.second(g)])), slim=False)
            shared, n_shared = scratch.cut_and_count(_second(one, bands))
            common = merger.work_off(shared, n_shared, ROUNDS)
            rest = left.where(~F.col("g").isin([g for g in range(len(bands.lo)) if bands.second(g)]))
            merger.finish(_going_on(one, bands, 1, common).unionByName(rest), bands)
        out = stored(_named(found, merger, scratch), shared_path(spark, "joined"))
        scratch.close()
    return out


def _named(found: DataFrame, merger: Merger, scratch: Scratch) -> DataFrame:
    """Rows with the smallest id of their component. Texts and components that most rows share are dealt over parts."""
    rows = found.where("kind = 3").select("doc_id", F.col("a").alias("n_shingles"), F.col("b").alias("node"))
    texts = rows.groupBy("node").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_rows")).join(merger.labels, "node", "left").where("_rows > 1 or label is not null")
    texts, n = scratch.cut_and_count(texts.select("node", F.coalesce("label", "node").alias("label"), "_least", "_rows"), slim=False)
    own = texts.groupBy("label").agg(F.min("_least").alias("component_id"), F.sum("_rows").alias("_all"))
    texts = met(texts.select("node", "label"), own.select("label", "component_id"), "label", n, F.xxhash64("node"))
    total = rows.count()
    named = met(rows, texts.withColumn("_met", F.lit(True)), "node", total, how="left")
    component = F.when((F.col("n_shingles") == 0) | F.col("_met").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), "node", F.coalesce("label", "node").alias("label"))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates: the one of smallest (doc_id, node), nulls last.

    Texts without a word are in no group: all such rows stay. Of rows equal in doc_id and text one stays, the one whose other
    columns have the smallest hash, so reruns agree. Columns may have any names.
    """
    found = join(docs, words, percent).where("n_shingles > 0")
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "node")).alias("_f"))
    kept = first.select(F.col("_f.doc_id").alias("_id"), F.col("_f.node").alias("_kept"))
    own = nodes_of(docs)
    rows = docs.select(row_of(docs).alias("_row"), tie_of(docs).alias("_tie"), F.col("doc_id").alias("_doc"), own, F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("_worded"))
    some = rows.where("_worded").join(kept, (F.col("_node") == F.col("_kept")) & F.col("_doc").eqNullSafe(F.col("_id")), "left_semi")
    one = some.groupBy("_node", "_doc").agg(F.min_by("_row", "_tie").alias("_row")).select("_row")
    return unpacked(one.unionByName(rows.where("not _worded").select("_row")), docs)


#: The same by all pairs that share a shingle; for small tables.
JOIN_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) >= 4 then list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
         when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as shingle from w),
n as (select w.doc_id, count(s.shingle) as n from w left join s on s.doc_id = w.doc_id group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as same from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * same >= 85 * (a.n + b.n - same)),
e as (select x, y from l union all select y, x from l),
r(doc_id, c) as (select doc_id, doc_id from n union select r.doc_id, e.y from r join e on e.x = r.c)
select n.doc_id, cast(n.n as bigint) as n_shingles, m.c as component_id from n join (select doc_id, min(c) as c from r group by 1) m on m.doc_id = n.doc_id
"""
