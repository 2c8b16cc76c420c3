"""Mixing sources to target weights.

Each source gets a share of the budget by weight, never more than ``repeats`` times its own size; what is over
goes to the others by weight (water-filling, in closed form over one row per source). Inside a source documents
stand in the order of a random key, a hash of id and text. That order is cut exactly at the source's target:
whole epochs first, then the documents whose words come before the cut. The document the cut goes through gives
only the words that are left, so a source's taken words miss its target by less than one word.

Range-sort: the keys are uniform, so their first hex digits are range partitions without any sampling; a hot
source is spread over ``16 ** PREFIX`` of them. Sizes are summed per (source, range), prefix-summed over the
ranges of each source, and a window inside one (source, range) finishes the distributed prefix sum.

Nulls: a null text has size 0 and nothing is taken of it; a null source is a source of its own, last in
order; a null id is hashed as an empty string. Rows equal in id, source and text are counted first and stand next to each other.
A source without words gets target 0. An empty table gives an empty result. A very long text is one row of a few numbers
after its first reading. Other columns are not read by :func:`mix`; :func:`mixed_documents` keeps them, whatever their names, and
lets rows equal but for them follow a hash of them, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, each_copy, row_of, tie_of, unpacked, word_count

WEIGHTS = (5, 2, 1)
PREFIX = 3


def _key(seed: int) -> Column:
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size). One row per source goes through one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_w", weight).withColumn("_cap", F.lit(float(repeats)) * F.col("source_size"))
    up = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({
        "_budget": F.lit(share) * F.sum("source_size").over(every),
        "_full": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_rest": F.sum("_w").over(up.rowsBetween(0, Window.unboundedFollowing)),
    }).withColumn("_level", (F.col("_budget") - F.col("_full")) / F.col("_rest"))
    # The water stands at the level of the first source that it does not fill; further on levels only fall.
    level = F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(every)
    return s.withColumn("_water", level).select("source", "source_size", F.when(F.col("_water").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_water") * F.col("_w"))).alias("target"))


def _rows(docs: DataFrame, seed: int, tie: Column) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _key(seed).alias("key"), tie.alias("tie"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2, seed: int = 11) -> DataFrame:
    """(doc_id, size, source_size, target, taken, key) for each row of ``docs`` (doc_id, text, source); key names the row's text and id."""
    return _mixed(_rows(docs, seed, F.lit(0).cast("long")), weights, share, repeats).drop("source", "tie")


def _mixed(rows: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """(doc_id, source, size, key, tie, source_size, target, taken) for each of ``rows`` (doc_id, source, size, key, tie)."""
    kinds = cut(rows.groupBy("doc_id", "source", "size", "key", "tie").agg(F.count(F.lit(1)).alias("copies")).withColumn("_range", F.substring("key", 1, PREFIX)))
    words = F.col("size") * F.col("copies")
    ranges = cut(kinds.groupBy("source", "_range").agg(F.sum(words).alias("_words")))
    to = targets(ranges.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, repeats)
    along = Window.partitionBy("source").orderBy("_range")
    starts = ranges.withColumn("_start", F.sum("_words").over(along) - F.col("_words")).join(to.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("source").alias("_source"), F.col("_range").alias("_in"), "_start", "source_size", "target"
    )
    inside = Window.partitionBy("source", "_range").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = kinds.withColumn("_inside", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_in")))
    most = kinds.agg(F.coalesce(F.max("copies"), F.lit(0))).first()[0]
    each = each_copy(placed.select("doc_id", "source", "size", "key", "tie", "copies", "source_size", "target", (F.col("_start") + F.col("_inside")).alias("_first")), "copies", "_copy", most)
    before = F.col("_first") + F.col("_copy") * F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    left = F.floor("target").cast("long") - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left - before))
    return each.select("doc_id", "source", "size", "key", "tie", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2, seed: int = 11) -> DataFrame:
    """The mix as rows of ``docs``: a document stands once for each time it is taken, whole, under its own source.

    The document a cut goes through is written whole, so a source exceeds its target by less than one document.
    """
    tie = tie_of(docs, "doc_id", "source")
    plan = _mixed(_rows(docs, seed, tie), weights, share, repeats).withColumn("_times", F.expr("case when size > 0 then cast(ceil(taken / size) as int) else 0 end"))
    # Rows equal in every column are one kind; the times of all of them are dealt out over one row.
    times = plan.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_from"), F.col("key").alias("_k"), F.col("tie").alias("_t")).agg(F.sum("_times").alias("_times")).where("_times > 0")
    one = docs.select(row_of(docs).alias("_row"), F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), _key(seed).alias("_key"), tie.alias("_tie")).dropDuplicates(["_doc", "_source", "_key", "_tie"])
    most = times.agg(F.coalesce(F.max("_times"), F.lit(0))).first()[0]
    same = F.col("_doc").eqNullSafe(F.col("_id")) & F.col("_source").eqNullSafe(F.col("_from")) & (F.col("_key") == F.col("_k")) & (F.col("_tie") == F.col("_t"))
    return unpacked(each_copy(one.join(times, same).select("_row", "_times", "_key", "_tie"), "_times", "_copy", most), docs)


MIX_SQL = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         md5('11:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as key from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, [5.0, 2.0, 1.0][(row_number() over (order by source asc nulls last) - 1) % 3 + 1]::double as w,
             2.0::double * source_size as cap from s),
u as (select *, 1.5::double * (sum(source_size) over ())::double as budget,
             coalesce(sum(cap) over (order by cap / w, source asc nulls last rows between unbounded preceding and 1 preceding), 0.0) as filled,
             sum(w) over (order by cap / w, source asc nulls last rows between current row and unbounded following) as rest from w),
v as (select *, (budget - filled) / rest as level from u),
t as (select source, source_size, w, cap, max(case when level * w <= cap then level end) over () as water from v),
g as (select source, source_size, case when water is null then cap else least(cap, water * w) end as target from t),
e as (select d.doc_id, d.size, g.source_size, g.target,
             coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as before
      from d join g on d.source is not distinct from g.source)
select doc_id, size, source_size, target,
       cast(case when source_size = 0 then 0 else (floor(target)::bigint // source_size) * size
         + greatest(0, least(size, floor(target)::bigint - (floor(target)::bigint // source_size) * source_size - before)) end as bigint) as taken
from e
"""
