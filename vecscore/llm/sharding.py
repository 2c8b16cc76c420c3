"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 without gaps, a keyed permutation of 0..n-1 shuffles the numbers, and shard and slot
are remainder and quotient of the permuted number. Anyone who knows (n, seed) can compute where row i went,
and counts of shards differ by one at most. The permutation is a generalised Feistel network over Z_a x Z_b
with a*b >= n; numbers that fall outside 0..n-1 walk on along their cycle until they are inside. How many steps
the longest walk takes is computed beforehand from the fewer than a numbers outside, so the plan has a fixed length.

Numbering is by content, not by file or partition: equal rows are first counted (map-side), the distinct rows
are dealt to ``BUCKETS`` hash buckets, numbered inside each, and shifted by the prefix sum of the bucket totals.
A rerun on another layout of the same rows gives the same shards. Bytes are not balanced beyond what chance gives:
the law is ``rows``. Groups of equal texts are not kept together.

Nulls: a null text counts as empty (size 1, crc of no bytes); null ids are a value like any other. Rows that
are equal in id and text are interchangeable and each gets its own slot. An empty table gives an empty result.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import struct

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, each_copy, utf8_size

BUCKETS = 16_384
ROUNDS = 6


def _sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, -(-max(n, 1) // a)


def _key(seed: int, k: int) -> int:
    return seed * 1_000_003 + k


def _mix(x: int, seed: int, k: int, base: int) -> int:
    """As Spark's ``pmod(xxhash64(key, x), base)``."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", x), xxhash.xxh64_intdigest(struct.pack("<q", _key(seed, k)), 42))
    return (h - (h >> 63 << 64)) % base


def _once(x: int, n: int, seed: int) -> int:
    a, b = _sides(n)
    left, right = divmod(x, b)
    for k in range(ROUNDS):
        if k % 2:
            right = (right + _mix(left, seed, k, b)) % b
        else:
            left = (left + _mix(right, seed, k, a)) % a
    return left * b + right


def _back(x: int, n: int, seed: int) -> int:
    a, b = _sides(n)
    left, right = divmod(x, b)
    for k in reversed(range(ROUNDS)):
        if k % 2:
            right = (right - _mix(left, seed, k, b)) % b
        else:
            left = (left - _mix(right, seed, k, a)) % a
    return left * b + right


def permuted(x: int, n: int, seed: int) -> int:
    """Where row number ``x`` of ``n`` goes; the plan computes the same."""
    x = _once(x, n, seed)
    while x >= n:
        x = _once(x, n, seed)
    return x


def longest_walk(n: int, seed: int) -> int:
    """Applications after which every number below ``n`` is back inside."""
    a, b = _sides(n)
    at = [x for x in range(n, a * b) if _back(x, n, seed) < n]
    steps = 1
    while at:
        at = [y for x in at if (y := _once(x, n, seed)) >= n]
        steps += 1
    return steps


def permute(df: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """Replace the row numbers in ``column`` by their permuted ones."""
    a, b = _sides(n)

    def mixed(x: str, k: int, base: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(_key(seed, k)).cast("long"), F.col(x)), F.lit(base).cast("long"))

    df = df.withColumn("_x", F.col(column))
    for step in range(longest_walk(n, seed)):
        df = df.withColumns({"_l": F.expr(f"_x div {b}L"), "_r": F.expr(f"_x % {b}L")})
        for k in range(ROUNDS):
            side, other, base = ("_r", "_l", b) if k % 2 else ("_l", "_r", a)
            df = df.withColumn(side, F.pmod(F.col(side) + mixed(other, k, base), F.lit(base).cast("long")))
        there = F.col("_l") * F.lit(b).cast("long") + F.col("_r")
        df = df.withColumn("_x", there if step == 0 else F.when(F.col("_x") < n, F.col("_x")).otherwise(there))
    return df.withColumn(column, F.col("_x")).drop("_x", "_l", "_r")


def shard(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs`` (doc_id, text)."""
    text = F.col("text")
    rows = docs.select("doc_id", (utf8_size(text) + 1).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    key = ["doc_id", "size", "text_crc32"]
    kinds = cut(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(BUCKETS).cast("long"))))
    n, most = kinds.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0))).first()
    # At most BUCKETS rows: one window over all of them, and a broadcast of known size.
    starts = kinds.groupBy("bucket").agg(F.sum("copies").alias("_total")).select("bucket", (F.sum("_total").over(Window.orderBy("bucket")) - F.col("_total")).alias("_start"))
    before = Window.partitionBy("bucket").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    first = kinds.withColumn("_before", F.coalesce(F.sum("copies").over(before), F.lit(0))).join(F.broadcast(starts), "bucket").withColumn("_first", F.col("_start") + F.col("_before"))
    numbered = each_copy(first.select(*key, "copies", "_first"), "copies", "_copy", most).select(*key, (F.col("_first") + F.col("_copy")).alias("_row"))
    dealt = permute(numbered, "_row", n, seed)
    return dealt.select(
        *key, F.lit("rows").alias("law"), (F.col("_row") % shards).cast("int").alias("shard"), F.expr(f"_row div {shards}L").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
