"""The driver's tables as references, queries and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A stated query set: rows whose id is divisible by this are searched for, against all rows.
EVERY = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_refs(spark: SparkSession, sf_dir: str, d: int = 64) -> DataFrame:
    """(ref_id, vector, is_fraud): labels 0 to 2 count as fraud."""
    e = table(spark, sf_dir, "embeddings")
    vector = F.col("embedding") if d == 64 else F.slice("embedding", 1, d)
    return e.select(F.col("vec_id").alias("ref_id"), vector.cast("array<double>").alias("vector"), F.coalesce(F.col("label").isin(0, 1, 2).cast("int"), F.lit(0)).alias("is_fraud"))


def queries_of(refs: DataFrame, every: int = EVERY) -> DataFrame:
    """(qid, q): the stated query set."""
    return refs.where(F.col("ref_id") % every == 0).select(F.col("ref_id").alias("qid"), F.col("vector").alias("q"))


def first_centroids(refs: DataFrame, k: int = 16) -> DataFrame:
    """(cluster_id, centroid): the vectors of the ``k`` smallest ids, a seeding that needs no randomness."""
    rows = refs.orderBy("ref_id").limit(k).select("ref_id", "vector")
    return rows.select((F.row_number().over(Window.orderBy("ref_id")) - 1).alias("cluster_id"), F.col("vector").alias("centroid"))


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, payload, is_fraud): events as transactions of a user at one of twenty merchants.

    Money is added up in whole cents, so the order of a sum does not matter.
    """
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    e = e.withColumns({"cents": F.floor(F.col("value") * 100 + 0.5).cast("long"), "merchant_id": F.concat(F.lit("MERC-"), F.lpad((F.col("k") % 20).cast("string"), 3, "0")), "us": F.unix_micros(F.col("ts").cast("timestamp"))})
    user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = user.rowsBetween(Window.unboundedPreceding, -1)
    day = Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0)
    # Twenty merchants: their sums come map-side and go back by a broadcast, no row moves for them.
    merchants = e.groupBy("merchant_id").agg(F.sum("cents").alias("m_cents"), F.count(F.lit(1)).alias("m_n"))
    e = e.join(F.broadcast(merchants), "merchant_id", "left")
    e = e.withColumns({
        "prior": F.count(F.lit(1)).over(before), "prior_cents": F.sum("cents").over(before), "recent": F.count(F.lit(1)).over(day) - 1,
        "known": F.collect_set("merchant_id").over(before), 
        "last_ts": F.lag("ts").over(user), "last_k": F.lag("k").over(user),
    })
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    mean = lambda cents, n: F.when(F.col(n) > 0, F.col(cents) / F.lit(100.0) / F.col(n)).otherwise(F.lit(0.0))
    kind = F.col("event_type")
    mcc = F.create_map(*map(F.lit, ("click", "5411", "view", "5812", "purchase", "7802", "error", "7995", "signup", "9999")))
    payload = F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.struct(F.col("value").alias("amount"), (1 + F.col("k") % 12).cast("double").alias("installments"), stamp("ts").alias("requested_at")).alias("transaction"),
        F.struct(mean("prior_cents", "prior").alias("avg_amount"), F.col("recent").cast("double").alias("tx_count_24h"), F.col("known").alias("known_merchants")).alias("customer"),
        F.struct(F.col("merchant_id").alias("id"), F.try_element_at(mcc, kind).alias("mcc"), mean("m_cents", "m_n").alias("avg_amount")).alias("merchant"),
        F.struct(kind.isin("click", "view", "signup").alias("is_online"), (kind == "purchase").alias("card_present"), (F.col("k") * F.lit(10.5)).alias("km_from_home")).alias("terminal"),
        F.when(F.col("last_ts").isNotNull(), F.struct(stamp("last_ts").alias("timestamp"), (F.abs(F.col("k") - F.col("last_k")) * F.lit(7.0)).alias("km_from_current"))).alias("last_transaction"),
    )
    return e.select("event_id", payload.alias("payload"), (kind == "error").cast("int").alias("is_fraud"))


def rounded(x: str | Column, digits: int = 9) -> Column:
    """A derived double without its last bits; never for what decides an order.

    Scaled, made whole (halves away from zero) and scaled back, as SQL engines do: F.round with digits goes by the shortest
    decimal of a double, which decides ties of that many digits otherwise.
    """
    x, scale = F.col(x) if isinstance(x, str) else x, F.lit(10.0**digits)
    return F.round(x * scale) / scale


def known(x: Column) -> Column:
    """A feature, null where it is no number: 0 against an average of 0."""
    return F.nanvl(x, F.lit(None).cast("double"))
