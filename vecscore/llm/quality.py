"""Quality rules: a hashed n-gram log-likelihood ratio between trusted text and the raw corpus, beside base counts.

Byte n-grams of NGRAM bytes and word n-grams of one and two words are hashed to BUCKETS each. Each kind has two
multinomials: one counted over every document (raw), one over trusted ones, ids that ``labels`` gives quality 1. The
score of a document is the mean over its n-grams of a kind of log p_trusted - log p_raw, the kinds weighted by
WEIGHTS, so length does not matter; a document is kept if it passes the base rules and its score is at least ``threshold``. The
trusted multinomial is drawn towards the raw one by ``smooth`` bytes of it, so a small trusted corpus says little
about what it has not seen. The threshold is fixed, so the verdict depends on the document and the multinomials only.

Both sides count all their documents. Up to ``trusted_docs`` trusted ids are broadcast, and no text is shuffled;
of more, the trusted side is a join by id that Spark plans, which may shuffle the texts once. Tasks send KINDS * BUCKETS
sums at most. A very long text is read once, in memory of a few numbers for each of its bytes.

Nulls: a null text is an empty one (0 words, rejected); a null id is never trusted; without trusted documents
every score is 0 and the base rules decide alone. Equal rows get equal results, an empty table an empty one. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settings
from .common import SMALL_BATCHES, slices, worked_off

NGRAM = 3
BITS = 14
BUCKETS = 1 << BITS
#: Kinds of n-grams: bytes, single words, pairs of words; and what each counts for. Bytes say most about words not seen before.
KINDS = 3
WEIGHTS = (0.6, 0.2, 0.2)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Fixed values of the base rules.
SPACES, SYMBOLS, SPAN, LEAST_WORDS, REPEAT_PERCENT = b" \t\n\x0b\x0c\r", b"#*$%&|<>", 8, 20, 30


def grams(raw: bytes) -> np.ndarray:
    """Bucket of the n-gram at each byte of ``raw``."""
    a = np.frombuffer(raw, np.uint8)
    if len(a) < NGRAM:
        return np.empty(0, np.uint32)
    g = a[: len(a) - NGRAM + 1].astype(np.uint32)
    for i in range(1, NGRAM):
        g = g << np.uint32(8) | a[i : len(a) - NGRAM + 1 + i]
    return (g * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of the pairs of neighbouring words."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    pairs = (h[:-1] * _SPREAD) ^ (h[1:] + _SPREAD)
    return h >> np.uint64(64 - BITS), (pairs * _SPREAD) >> np.uint64(64 - BITS)


def every_gram(raw: bytes, words: list[bytes]) -> list[np.ndarray]:
    """Buckets of a text's n-grams by kind, one range of BUCKETS after the other."""
    return [g.astype(np.int64) + k * BUCKETS for k, g in enumerate((grams(raw), *word_grams(words)))]


def repeated_words(words: list[bytes]) -> int:
    """Words inside SPAN-word windows that the text holds at least twice, the first included."""
    if len(words) <= SPAN:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    width, kinds = 1, len(known)
    while width < SPAN:  # ids of windows of twice the width, exactly
        pairs = ids[: len(ids) - width] * kinds + ids[width:]
        found, ids = np.unique(pairs, return_inverse=True)
        if len(found) == len(pairs):
            return 0
        width, kinds = 2 * width, len(found)
    again = np.bincount(ids)[ids] > 1
    steps = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + SPAN, -1)
    return int((np.cumsum(steps)[:-1] > 0).sum())


def base(text: str, raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text, given its bytes and words too."""
    spaces = len(raw) - len(raw.translate(None, SPACES))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def log_ratio(docs: DataFrame, labels: DataFrame, trusted_docs: int, smooth: float) -> np.ndarray:
    """log p_trusted - log p_raw of each bucket of each kind."""
    ids = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select("doc_id", "text")
    if ids.limit(trusted_docs + 1).count() <= trusted_docs:
        sent = F.broadcast(ids.withColumn("_trusted", F.lit(1)))
        rows = rows.join(sent, F.col("doc_id") == F.col("_id"), "left").select(F.lit(True).alias("raw"), F.col("_trusted").isNotNull().alias("trusted"), "text")
    else:
        good = rows.join(ids, F.col("doc_id") == F.col("_id"), "left_semi")
        rows = rows.select(F.lit(True).alias("raw"), F.lit(False).alias("trusted"), "text").unionByName(good.select(F.lit(False).alias("raw"), F.lit(True).alias("trusted"), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, KINDS * BUCKETS), np.int64)
        for b in slices(batches):
            for raw_side, trusted, text in zip(*(c.to_pylist() for c in b.columns)):
                if text:
                    raw = text.encode()
                    n = np.bincount(np.concatenate(every_gram(raw, raw.split())), minlength=KINDS * BUCKETS)
                    if raw_side:
                        sums[0] += n
                    if trusted:
                        sums[1] += n
        at = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[0][at]), pa.array(sums[1][at])], ["bucket", "raw", "trusted"])

    counts = rows.mapInArrow(run, "bucket int, raw bigint, trusted bigint").groupBy("bucket").agg(F.sum("raw"), F.sum("trusted"))
    raw, good = np.zeros(KINDS * BUCKETS), np.zeros(KINDS * BUCKETS)
    with settings(docs.sparkSession, **SMALL_BATCHES):
        sums = counts.collect()  # KINDS * BUCKETS rows at most
    for k, r, t in sums:
        raw[k], good[k] = r, t
    if not good.any():
        return np.zeros(KINDS * BUCKETS)

    def ratio(good: np.ndarray, raw: np.ndarray, smooth: float) -> np.ndarray:
        p = (raw + 1) / (raw.sum() + len(raw))
        return np.log((good + smooth * p) / (good.sum() + smooth)) - np.log(p)

    return np.concatenate([ratio(good[k], raw[k], smooth) for k in (slice(i * BUCKETS, (i + 1) * BUCKETS) for i in range(KINDS))])


def rate(docs: DataFrame, labels: DataFrame, threshold: float = -0.3, trusted_docs: int = 1_000_000, smooth: float = 5_000.0) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) for each row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(log_ratio(docs, labels, trusted_docs, smooth))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, failed, kept, score = verdicts(b.column(1).to_pylist(), sent.value, threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, n.T.copy()), pa.array(failed), pa.array(kept), pa.array(score)], ["doc_id", *names, "base_failed", "kept", "score"])

    rows = docs.select("doc_id", "text")
    made = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{x} bigint' for x in names)}, base_failed boolean, kept boolean, score double")
    return worked_off(made, "rated")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = -0.3, trusted_docs: int = 1_000_000, smooth: float = 5_000.0) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(log_ratio(docs, labels, trusted_docs, smooth))
    at = docs.columns.index("text")
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(verdicts(b.column(at).to_pylist(), sent.value, threshold)[2]))

    return worked_off(rows.mapInArrow(run, rows.schema), "kept").toDF(*docs.columns)


def verdicts(texts: list[str | None], ratio: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(base counts, whether base rules fail, whether kept, score) of each text."""
    counts, scores = [], []
    for text in texts:
        raw = (text or "").encode()
        words = raw.split()
        counts.append(base(text or "", raw, words))
        scores.append(float(sum(w * ratio[g].mean() for w, g in zip(WEIGHTS, every_gram(raw, words)) if len(g))))
    n, score = np.array(counts, np.int64).reshape(-1, 5), np.array(scores, np.float64)
    failed = (n[:, 0] < LEAST_WORDS) | (100 * n[:, 4] > REPEAT_PERCENT * n[:, 0])
    return n, failed, ~failed & (score >= threshold), score
