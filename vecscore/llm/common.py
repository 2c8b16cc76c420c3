"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialized, settings, shared_path, stored, removed

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Arrow batches of texts stay small, in rows and bytes.
SMALL_BATCHES = {"spark__sql__execution__arrow__maxRecordsPerBatch": "1000", "spark__sql__execution__arrow__maxBytesPerBatch": str(8 << 20)}
#: Slim rows that one task may hold.
ONE_TASK = 500_000
#: Rows of one key that a task may hold in a join, at least; and keys that may have more, at most.
HOT, MOST_HOT = 1_000, 1_000_000
#: Copies of one row that a single task writes out.
COPIES_PER_TASK = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder: the result reads it, so it stays until the application ends."""
    return materialized(df, "cut")


def worked_off(df: DataFrame, name: str) -> DataFrame:
    """As :func:`cut`, for what Python makes of whole texts: small batches go to it, which a result computed later could not have
    without a change to its session."""
    with settings(df.sparkSession, **SMALL_BATCHES):
        return materialized(df, name)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what Python makes of one stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def row_of(docs: DataFrame) -> Column:
    """A whole row in one struct, so that no column's name can clash with those an operator makes."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def unpacked(rows: DataFrame, docs: DataFrame, column: str = "_row") -> DataFrame:
    """The columns of ``docs`` again, from structs of :func:`row_of`."""
    return rows.select(*[F.col(column).getField(c).alias(c) for c in docs.columns])


def tie_of(docs: DataFrame, *known: str) -> Column:
    """A number that tells rows apart by their columns other than text and ``known``, the same in every run."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", *known)]
    return F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0).cast("long")


class Scratch:
    """Tables of a loop, in the shared folder until :meth:`close`.

    A loop must not checkpoint: Spark takes a checkpoint's size from the estimate of the plan behind it, and estimates of
    joins are products, so after some rounds they are numbers of millions of digits. A table's size is that of its files.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, shared_path(spark, "scratch"), 0

    def cut(self, df: DataFrame, slim: bool = True) -> DataFrame:
        return self.cut_and_count(df, slim=slim)[0]

    def cut_and_count(self, df: DataFrame, condition: Column | None = None, slim: bool = True) -> tuple[DataFrame, int]:
        """The table, and how many of its rows meet the condition, counted on the way.

        A ``slim`` table (a few numbers a row) of at most ONE_TASK rows comes in one partition: joins and groups of such
        tables then need no shuffle, which for some thousand rows is all that they would cost.
        """
        self.n += 1
        path, seen = f"{self.path}/{self.n}", Observation()
        one = F.lit(1) if condition is None else F.when(condition, F.lit(1))
        made = stored(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(one).alias("n")), path)
        return made.coalesce(1) if slim and seen.get["rows"] <= ONE_TASK else made, seen.get["n"]

    def close(self) -> None:
        removed(self.spark, self.path)


def met(rows: DataFrame, few: DataFrame, key: str, n: int, spread: Column | None = None, how: str = "inner") -> DataFrame:
    """``rows`` joined by ``key`` with ``few``, which holds few rows of any key, whereas ``rows`` may hold most of its ``n`` under one.

    Rows of a key with more than HOT, or a millionth of ``n``, are dealt by ``spread`` over parts of that many, and the
    rows of ``few`` go to each part. There are at most MOST_HOT such keys, so their list is small enough to broadcast.
    """
    limit = max(HOT, n // MOST_HOT)
    hot = F.broadcast(rows.groupBy(F.col(key).alias("_hot_k")).agg(F.ceil(F.count(F.lit(1)) / limit).alias("_hot_parts")).where("_hot_parts > 1"))
    parts = F.coalesce("_hot_parts", F.lit(1))
    spread = F.monotonically_increasing_id() if spread is None else spread
    one = rows.withColumn("_hot_spread", spread).join(hot, F.col(key) == F.col("_hot_k"), "left").withColumn("_hot_part", F.pmod("_hot_spread", parts)).drop("_hot_spread", "_hot_k", "_hot_parts")
    two = few.join(hot, F.col(key) == F.col("_hot_k"), "left").withColumn("_hot_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_hot_k", "_hot_parts")
    return one.join(two, [key, "_hot_part"], how).drop("_hot_part")


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def each_copy(df: DataFrame, copies: str, index: str, most: int) -> DataFrame:
    """One row for each of the ``copies`` of a row, numbered from 0 in ``index``.

    ``most`` is the largest count there is. A row of very many copies is first cut into runs of
    ``COPIES_PER_TASK``, which are dealt over tasks before they are written out.
    """
    few = df.where(F.col(copies) <= COPIES_PER_TASK).withColumn(index, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1)))
    if most <= COPIES_PER_TASK:
        return few
    step = F.lit(COPIES_PER_TASK).cast("long")
    runs = df.where(F.col(copies) > COPIES_PER_TASK).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / step))))
    many = runs.repartition(*[F.col(c) for c in runs.columns]).withColumn(index, F.explode(F.sequence(F.col("_run") * step, F.least((F.col("_run") + 1) * step, F.col(copies)) - 1)))
    return few.unionByName(many.drop("_run"))
