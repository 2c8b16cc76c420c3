"""Language identification by prediction by partial matching.

For each language a context tree over bytes of lower-cased text gives the probability of a byte after its last
ORDER bytes; a byte that the context has not seen costs an escape (method C: of n occurrences and u kinds, each
kind counts its occurrences over n + u, the escape u over n + u, no exclusions) and is priced by the next shorter
context, down to 1/256. The statistics are frozen, so the code length of a text is a sum over its bytes of a
price that depends on the last ORDER + 1 bytes only; all prices seen in training are tabled beforehand,
the others are put together from the tables of lower orders. The language of the shortest code wins, ties go to
the first in code-point order. The score is the winner's posterior under equal priors.

Fitted on a bounded sample: of the documents that may be learned from (crc32 of the id's text mod 5 is not 0;
text and lang not null), per language the ``sample_docs`` of
smallest hash, those over ``long_bytes`` after all others, as far as their texts come to ``sample_bytes``; the last one
is cut there. So a language's share of the tables is bounded in bytes, whatever its documents are; every language in the
table is learned. The tables are the one thing sent to tasks. Every whole text is scored, in blocks of BLOCK bytes.

Nulls: a null text, and one without a letter, gives ``und`` with score 0; a null id is neither held out nor
learned from; without anything to learn from all is ``und``. Equal texts get equal predictions; an empty
table gives an empty result. Only doc_id, text and, for learning, lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

ORDER = 4
BLOCK = 1 << 20
FOLDS = 5
_PAD = b"\n" * ORDER
_LETTER = regex.compile(r"\p{L}")
_SLOT_BITS = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _windows(raw: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each place of ``raw`` from ORDER on, as one number."""
    at = np.zeros(max(0, len(raw) - ORDER), np.uint64)
    for i in range(n):
        at = at << np.uint64(8) | raw[ORDER + 1 - n + i : len(raw) + 1 - n + i]
    return at


class Model:
    """Prices in bits, per order: of grams (last byte after its context) and of escaping from a context."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        raws = [[np.frombuffer(_PAD + t.lower().encode(), np.uint8).astype(np.uint64) for t in texts[x]] for x in self.langs]
        self.grams, self.price, self.contexts, self.escape = [], [], [], []
        n_langs = len(self.langs)
        for k in range(ORDER + 1):  # k bytes of context
            counted = [np.unique(np.concatenate([_windows(r, k + 1) for r in own]), return_counts=True) for own in raws]
            grams = np.unique(np.concatenate([g for g, _ in counted])) if counted else np.empty(0, np.uint64)
            ctx = np.unique(grams >> np.uint64(8))
            escape = np.zeros((len(ctx), n_langs))
            self.grams.append(grams)
            self.contexts.append(ctx)
            self.escape.append(escape)
            price = self._lower(grams, k) if len(grams) else np.zeros((0, n_langs))
            for i, (g, c) in enumerate(counted):
                at = np.searchsorted(ctx, g >> np.uint64(8))
                n, u = np.bincount(at, c, len(ctx)), np.bincount(at, minlength=len(ctx))
                seen = u > 0
                escape[seen, i] = np.log2((n + u)[seen] / u[seen])
                where = np.searchsorted(grams, g)
                own = np.log2((n + u)[at] / c)
                price[:, i] += escape[np.searchsorted(ctx, grams >> np.uint64(8)), i]
                price[where, i] = own
            self.price.append(price)
        # The grams of full length by a hash of one probe; what finds its slot taken goes the long way.
        self.slot_key = np.full(1 << _SLOT_BITS, np.iinfo(np.uint64).max, np.uint64)
        self.slot_at = np.zeros(1 << _SLOT_BITS, np.int32)
        if len(self.grams[ORDER]):
            slots = self._slots(self.grams[ORDER])
            self.slot_key[slots] = self.grams[ORDER]
            self.slot_at[slots] = np.arange(len(slots))
        self.full = self.price[ORDER].astype(np.float32)

    @staticmethod
    def _slots(windows: np.ndarray) -> np.ndarray:
        return ((windows * _SPREAD) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def _lower(self, windows: np.ndarray, k: int) -> np.ndarray:
        """Price by contexts of fewer than k bytes, for windows of k + 1."""
        if k == 0:
            return np.full((len(windows), len(self.langs)), 8.0)
        return self.prices(windows & np.uint64((1 << 8 * k) - 1), k - 1)

    def prices(self, windows: np.ndarray, k: int) -> np.ndarray:
        """(window, language): bits of the last byte of windows of k + 1 bytes after the k before it."""
        grams = self.grams[k]
        at = np.minimum(np.searchsorted(grams, windows), max(0, len(grams) - 1))
        found = grams[at] == windows if len(grams) else np.zeros(len(windows), bool)
        out = np.empty((len(windows), len(self.langs)))
        out[found] = self.price[k][at[found]]
        if len(rest := windows[~found]):
            ctx, by = self.contexts[k], rest >> np.uint64(8)
            at = np.minimum(np.searchsorted(ctx, by), max(0, len(ctx) - 1))
            known = ctx[at] == by if len(ctx) else np.zeros(len(rest), bool)
            out[~found] = self._lower(rest, k) + np.where(known[:, None], self.escape[k][at], 0.0) if len(ctx) else self._lower(rest, k)
        return out

    def bits(self, pieces: list[bytes]) -> np.ndarray:
        """(piece, language): code length of each piece, whose first ORDER bytes are context only."""
        raw = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint64)
        w = _windows(raw, ORDER + 1)
        slots = self._slots(w)
        hit = self.slot_key[slots] == w
        at = self.full[self.slot_at[slots]]
        if not hit.all():
            kinds, back = np.unique(w[~hit], return_inverse=True)
            at[~hit] = self.prices(kinds, ORDER)[back]
        ends = np.cumsum([len(p) for p in pieces])
        starts = ends - [len(p) for p in pieces]
        bounds = np.stack([starts, ends - ORDER], 1).ravel()
        bounds[-1] = min(bounds[-1], len(w))
        sums = np.add.reduceat(at, bounds[:-1] if bounds[-1] == len(w) else bounds, axis=0, dtype=np.float64)
        return sums[::2]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        total = np.zeros((len(texts), len(self.langs)))
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            if held:
                np.add.at(total, [i for i, _ in held], self.bits([p for _, p in held]))
                held.clear()

        told = [bool(self.langs and t and _LETTER.search(t)) for t in texts]
        for i, t in enumerate(texts):
            if not told[i]:
                continue
            raw = _PAD + t.lower().encode()
            for at in range(0, len(raw) - ORDER, BLOCK):
                held.append((i, raw[at : at + BLOCK + ORDER]))
                size += len(held[-1][1])
                if size >= BLOCK:
                    flush()
                    size = 0
        flush()
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        best = total.argmin(1) if len(texts) else np.empty(0, int)
        score = 1 / np.exp2(np.clip(total.min(1, keepdims=True) - total, -1000, 0)).sum(1) if len(texts) else []
        return [self.langs[b] if ok else "und" for b, ok in zip(best, told)], [float(s) if ok else 0.0 for s, ok in zip(score, told)]


def fit(docs: DataFrame, sample_docs: int = 300, long_bytes: int = 20_000, sample_bytes: int = 1 << 20) -> Model:
    """The model of all languages, on at most ``sample_docs`` documents and ``sample_bytes`` bytes of each.

    Counts come first; from them follows the share of a language's hash range that holds about four times the
    sample, so no more than that is ever ranked, however many documents a language has.
    """
    learn = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 0))
    learn = learn.select("lang", "doc_id", "text", (F.octet_length("text") > long_bytes).alias("_long"), (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / float(1 << 32)).alias("_at"))
    sizes = learn.groupBy("lang").agg(F.count_if(~F.col("_long")).alias("short"), F.count_if("_long").alias("long"))
    cuts = []
    for lang, short, long in sizes.collect():
        cuts.append((lang, False, min(1.0, 4 * sample_docs / max(short, 1))))
        cuts.append((lang, True, min(1.0, 4 * max(0, sample_docs - short) / max(long, 1))))
    shares = F.broadcast(docs.sparkSession.createDataFrame(cuts, "lang string, _long boolean, _share double"))
    by = Window.partitionBy("lang").orderBy("_long", "_at", "doc_id")
    chosen = learn.join(shares, ["lang", "_long"]).where("_at < _share").withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= sample_docs)
    before = F.coalesce(F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = chosen.withColumn("_before", before).where(F.col("_before") < sample_bytes)
    texts: dict[str, list[str]] = {}
    for lang, text in within.select("lang", F.expr(f"left(text, int(least({sample_bytes} - _before, {sample_bytes})))").alias("text")).orderBy("lang", "_rank").toLocalIterator():
        texts.setdefault(lang, []).append(text)
    return Model(texts)


def identify(docs: DataFrame, sample_docs: int = 300, long_bytes: int = 20_000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs`` (doc_id, text, lang)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, sample_docs, long_bytes))
    rows = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, score = model.value.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
