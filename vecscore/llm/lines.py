"""Line dedup: windows of three consecutive lines that occur again anywhere are removed where they occur later.

A document's lines are those of its text between line feeds that hold a word; wordless lines go with the line
before them. Every run of WINDOW lines is hashed (two independent 64-bit hashes over the line hashes). Of each
window that occurs twice or more, the first occurrence is the smallest (doc_id, hash of the text, position); all
others are covered, and a document loses the union of the lines its covered windows hold. Occurrences may overlap.
A removed line always has a copy earlier in that order, and the earliest copy of all stays.

A window's count and first occurrence are aggregated map-side, so a window that a third of the documents hold makes one row per
task; the join back is by an equi-join whose hot keys Spark splits. Only texts that lose lines, and a few others, move to meet
their covered positions: which, bitmaps of the keys of such documents tell, which are broadcast. The rest stay where they are read.

Nulls: a null text has no lines and stays null; a null id sorts first. Rows equal in id and text are one document
here: none is the other's later occurrence, each gets the same result. Texts of fewer than WINDOW lines
stay as they are, an empty text too. An empty table gives an empty result. Columns other than doc_id and text pass through
:func:`dedup_documents` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import removed, shared_path, stored
from .common import cut

WINDOW = 3
#: Bits of a bitmap, as Spark's bitmap_construct_agg makes them; bits for each key; bitmaps at most (4 KB each).
PLACES, BITS, MOST = 32_768, 32, 8192
_HAS_WORD = r"[^\\x20\\x09-\\x0D]"


def _lines(df: DataFrame) -> DataFrame:
    """Add _l, all lines, and _at, the places in it of those with a word."""
    df = df.withColumn("_l", F.split(F.coalesce(F.col("text"), F.lit("")), "\n"))
    return df.withColumn("_at", F.expr(f"transform(filter(transform(_l, (x, i) -> struct(i, x rlike '{_HAS_WORD}' as w)), e -> e.w), e -> e.i)"))


def covered(docs: DataFrame) -> DataFrame:
    """(_id, _hash, _pos): for each document that loses lines, the first lines of its covered windows."""
    own = _lines(docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), "text").where(F.col("text").isNotNull()))
    own = own.where(F.size("_at") >= WINDOW).withColumn("_h", F.expr("transform(_at, i -> struct(xxhash64(_l[i]) as a, xxhash64(7L, _l[i]) as b))"))
    both = [", ".join(f"_h[j + {k}].{x}" for k in range(WINDOW)) for x in "ab"]
    own = own.select("_id", "_hash", F.explode(F.expr(f"transform(sequence(0, size(_h) - {WINDOW}), j -> struct(j as pos, xxhash64({both[0]}) as a, xxhash64({both[1]}) as b))")).alias("w"))
    path = shared_path(docs.sparkSession, "windows")
    windows = stored(own.select("_id", "_hash", F.col("w.pos").alias("_at"), F.col("w.a").alias("_a"), F.col("w.b").alias("_b")), path)
    place = F.struct("_id", "_hash", "_at")
    first = windows.groupBy("_a", "_b").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_a").alias("_fa"), F.col("_b").alias("_fb"), "_first")
    later = windows.join(first, (F.col("_a") == F.col("_fa")) & (F.col("_b") == F.col("_fb"))).where(~place.eqNullSafe(F.col("_first")))
    found = cut(later.groupBy("_id", "_hash").agg(F.collect_set("_at").alias("_pos")))
    removed(docs.sparkSession, path)
    return found


def _marked(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """``docs`` with _key and _maybe: true for all documents that lose lines, and for few others.

    Keys are marked in bitmaps of PLACES bits each, BITS of these for each key, which are broadcast: 4 bytes a key, MOST of them at
    most. Beyond that more documents than need be are marked, and so move, which changes no result.
    """
    maps = max(1, min(MOST, -(-lost.count() * BITS // PLACES)))
    mark = lambda i, key: F.pmod(F.xxhash64(i, key), F.lit(maps * PLACES))
    own = lost.select(mark("_id", "_hash").alias("_m"))
    bits = own.groupBy(F.expr(f"cast(_m div {PLACES} as int)").alias("_map")).agg(F.expr(f"bitmap_construct_agg(_m % {PLACES})").alias("_bits"))
    df = docs.withColumn("_key", F.xxhash64("text")).withColumn("_m", mark("doc_id", "_key"))
    df = df.join(F.broadcast(bits), F.expr(f"cast(_m div {PLACES} as int)") == F.col("_map"), "left")
    byte = F.expr(f"cast(conv(hex(substring(_bits, cast(_m % {PLACES} div 8 as int) + 1, 1)), 16, 10) as int)")
    return df.withColumn("_maybe", F.coalesce(F.getbit(byte, (F.col("_m") % 8).cast("int")) == 1, F.lit(False))).drop("_m", "_map", "_bits")


def _rebuilt(docs: DataFrame) -> DataFrame:
    """``docs`` with _n_lines, _n_removed and _new, the text that is left."""
    lost = covered(docs)
    df = _marked(docs, lost)
    # A hint, so that small tables move what large ones do.
    moved = df.where("_maybe").join(lost.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_hash")), "left").drop("_id", "_hash")
    df = _lines(moved.unionByName(df.where("not _maybe").withColumn("_pos", F.lit(None).cast(lost.schema["_pos"].dataType))))
    gone = f"array_distinct(flatten(transform(_pos, p -> array({', '.join(f'p + {k}' for k in range(WINDOW))}))))"
    df = df.withColumn("_stay", F.expr(f"case when _pos is not null then array_except(sequence(0, size(_at) - 1), {gone}) end"))
    kept = "flatten(transform(_stay, j -> slice(_l, _at[j] + 1, coalesce(get(_at, j + 1), size(_l)) - _at[j])))"
    return df.withColumns({
        "_n_lines": F.size("_at").cast("long"),
        "_n_removed": F.when(F.col("_stay").isNull(), F.lit(0)).otherwise(F.size("_at") - F.size("_stay")).cast("long"),
        "_new": F.when(F.col("_stay").isNull(), F.col("text")).otherwise(F.expr(f"array_join(concat(slice(_l, 1, _at[0]), {kept}), '\\n')")),
    })


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) for each row of ``docs`` (doc_id, text); n_lines counts lines with a word."""
    return _rebuilt(docs.select("doc_id", "text")).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.col("_new").alias("text"))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the text that is left, and n_chars, where there is one, to match."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    left = _rebuilt(docs.select("doc_id", "text", whole)).withColumn("_cut", F.col("_n_removed") > 0)
    new = {"text": F.col("_new"), "n_chars": F.when(F.col("_cut"), F.char_length("_new").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None}
    return left.select(*[(new[c] if c in new else F.col("_row").getField(c)).alias(c) for c in docs.columns])


LINES_SQL = r"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null),
n as (select *, regexp_matches(line, '[^\x20\x09-\x0D]') as worded,
        sum(case when regexp_matches(line, '[^\x20\x09-\x0D]') then 1 else 0 end) over (partition by doc_id order by pos) as no from l),
w as (select doc_id, no, line || chr(10) || lead(line, 1) over d || chr(10) || lead(line, 2) over d as win from n where worded
      window d as (partition by doc_id order by no)),
f as (select doc_id, no, win, row_number() over (partition by win order by doc_id, no) as nth from w where win is not null),
c as (select distinct doc_id, no + k as no from f, (values (0), (1), (2)) as o(k) where nth > 1),
k as (select n.*, c.no is not null as gone from n left join c on n.doc_id = c.doc_id and n.no = c.no),
g as (select doc_id, count(*) filter (worded) as n_lines, count(*) filter (worded and gone) as n_removed,
        string_agg(line, chr(10) order by pos) filter (not gone) as text from k group by doc_id)
select d.doc_id, cast(coalesce(g.n_lines, 0) as bigint) as n_lines, cast(coalesce(g.n_removed, 0) as bigint) as n_removed,
       case when d.text is null then null else coalesce(g.text, '') end as text
from documents d left join g on d.doc_id = g.doc_id
"""
