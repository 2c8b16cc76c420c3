"""k-nearest-neighbour search: exact, through an inverted file, and with lossless cell pruning.

Reference rows are (ref_id, vector, is_fraud[, cluster_id]), queries (qid, q), centroids (cluster_id, centroid, radius).
Distances are squared Euclidean in double precision; ties go to the smaller ref_id, so probing all cells gives the
exact result. Queries meet references in blocks of bounded size: a block is broadcast, the large side never moves;
per query only what the first stage of the window keeps is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import sq_l2, sq_l2_any
from ..sources.shared import materialized

#: Numbers of vectors (rows times dimension) that one broadcast block of queries may hold.
BLOCK_NUMBERS = 1 << 20


def distance(a: str, b: str, d: int | None) -> Column:
    return sq_l2(a, b, d) if d else sq_l2_any(a, b)


def blocks(queries: DataFrame, d: int | None) -> list[DataFrame]:
    """``queries`` cut by hash into blocks that are small enough to broadcast; one where they all are."""
    n = -(-queries.count() * (d or 64) // BLOCK_NUMBERS) or 1
    if n == 1:
        return [queries]
    return [queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for i in range(n)]


def top(pairs: DataFrame, k: int, by: str = "qid", dist: str = "dist", tie: str = "ref_id", rank: str = "rank") -> DataFrame:
    """The ``k`` nearest of each query, numbered from 1 in ``rank``."""
    w = Window.partitionBy(by).orderBy(F.col(dist), F.col(tie))
    return pairs.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def exact_knn(refs: DataFrame, queries: DataFrame, k: int = 5, d: int | None = None) -> DataFrame:
    """(qid, rank, ref_id, dist, is_fraud): the k nearest references of each query among all."""
    found = [
        refs.crossJoin(F.broadcast(block.select("qid", "q"))).select("qid", "ref_id", "is_fraud", distance("q", "vector", d).alias("dist")) for block in blocks(queries, d)
    ]
    return top(reduce(DataFrame.union, found), k).select("qid", "rank", "ref_id", "dist", "is_fraud")


def probes(queries: DataFrame, centroids: DataFrame, nprobe: int, d: int | None = None) -> DataFrame:
    """(qid, q, cluster_id, probe_rank, dc, radius): the nearest ``nprobe`` cells of each query; more than there are means all."""
    pairs = queries.select("qid", "q").crossJoin(F.broadcast(centroids)).select("qid", "q", "cluster_id", "radius", distance("q", "centroid", d).alias("dc"))
    return top(pairs, nprobe, dist="dc", tie="cluster_id", rank="probe_rank")


def scan(probed: DataFrame, refs: DataFrame, d: int | None, *more: str) -> DataFrame:
    """Distances between queries and the references of their probed cells. Probes are broadcast in blocks, references stay.

    A stored index is partitioned by cell, so the cells of a block also prune its files.
    """
    found = [refs.join(F.broadcast(block), "cluster_id").select("qid", "ref_id", "is_fraud", *more, distance("q", "vector", d).alias("dist")) for block in blocks(probed.select("qid", "q", "cluster_id", *more), d)]
    return reduce(DataFrame.union, found)


def ivf_knn(refs: DataFrame, centroids: DataFrame, queries: DataFrame, nprobe: int, k: int = 5, d: int | None = None) -> DataFrame:
    """As :func:`exact_knn`, over the references in the ``nprobe`` nearest cells of each query."""
    return top(scan(materialized(probes(queries, centroids, nprobe, d)), refs, d), k).select("qid", "rank", "ref_id", "dist", "is_fraud")


def pruned_probes(probed: DataFrame, refs: DataFrame, k: int, d: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(k best of the nearest cell, later probes that can still hold a better one).

    A cell is left out if even its nearest possible member, at distance sqrt(dc) - radius, is further than the k-th best
    found in the first cell. On equal distance it stays, since a tie may go to a smaller id inside.
    """
    first = materialized(top(scan(probed.where("probe_rank = 1"), refs, d), k).select("qid", "rank", "ref_id", "dist", "is_fraud"))
    bound = first.where(F.col("rank") == k).select(F.col("qid").alias("_qid"), F.col("dist").alias("_bound"))
    gap = F.sqrt("dc") - F.col("radius")
    far = (gap > 0) & (gap * gap > F.col("_bound"))
    later = probed.where("probe_rank > 1").join(bound, F.col("qid") == F.col("_qid"), "left").where(~F.coalesce(far, F.lit(False)))
    return first, later.drop("_qid", "_bound")


def ivf_knn_pruned(refs: DataFrame, centroids: DataFrame, queries: DataFrame, nprobe: int, k: int = 5, d: int | None = None) -> DataFrame:
    """The same result as :func:`ivf_knn`; cells that cannot change it are not scanned. Radii must bound the references given."""
    first, later = pruned_probes(materialized(probes(queries, centroids, nprobe, d)), refs, k, d)
    both = first.select("qid", "ref_id", "is_fraud", "dist").unionByName(scan(materialized(later), refs, d))
    return top(both, k).select("qid", "rank", "ref_id", "dist", "is_fraud")
