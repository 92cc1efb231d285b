"""Speaker vectors: nearest cluster with a margin, outliers, close centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DISTANCE, LEAST_MARGIN, OUTLIER, TOO_CLOSE = 0.65, 0.10, 0.45, 0.45
#: Centroids ride along with the probes in blocks of this many.
BLOCK_CLUSTERS = 200


def cosine_distance(a: Column, b: Column) -> Column:
    """P-20: 1 - cosine; infinite if either vector has no length; null for unequal lengths."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(F.size(a) == F.size(b), F.when((norm(a) == 0) | (norm(b) == 0), F.lit(float("inf"))).otherwise(1 - dot / (norm(a) * norm(b))))


def centroids(vectors: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Mean vector per cluster; exploded by position, so a cluster of any size is pre-aggregated."""
    flat = vectors.select(F.col(cluster).alias("cluster"), F.posexplode(F.col(vector)).alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return flat.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda v: v["x"]).alias("centroid"))


def _against_blocks(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """``rows`` with ``held``, an array of about ``BLOCK_CLUSTERS`` centroids: once per block of the centroids.

    The centroids are the query set; every block is sent by itself, so what is
    sent is bounded however many there are.
    """
    known = clusters.where("centroid is not null")
    n = max(1, -(-known.count() // BLOCK_CLUSTERS))
    held = known.groupBy(F.pmod(F.xxhash64("cluster"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("cluster", F.col("centroid").alias("v"))).alias("held"))
    out = None
    for k in range(n):
        met = rows.crossJoin(F.broadcast(held.where(F.col("block") == k).select("held")))  # one row
        out = met if out is None else out.unionByName(met)
    return out


def nearest_cluster(probes: DataFrame, probe_id: str, vector: str, clusters: DataFrame) -> DataFrame:
    """A-09/J-21: nearest centroid, runner-up and margin for each probe; abstains if too far or too close to call.

    Centroids pass in blocks, each block as one array against all probes; of each
    block the two nearest remain, of all blocks then the two nearest.  Probes
    without centroids, or of another length, have no cluster.  Ties go to the
    smaller cluster.
    """
    two = F.slice(F.array_sort(F.filter(F.transform("held", lambda c: F.struct(cosine_distance(F.col("_v"), c["v"]).alias("d"), c["cluster"].alias("cluster"))), lambda x: x["d"].isNotNull())), 1, 2)
    asked = probes.select(F.col(probe_id).alias("probe_id"), F.col(vector).alias("_v"))
    met = _against_blocks(asked, clusters).select("probe_id", two.alias("two"))
    ranked = met.groupBy("probe_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("two"))), 1, 2).alias("r"))
    scored = asked.select("probe_id").distinct().join(ranked, "probe_id", "left").withColumn("a", F.try_element_at("r", F.lit(1))).withColumn("b", F.try_element_at("r", F.lit(2)))
    margin = F.when(F.col("a").isNotNull(), F.coalesce(F.col("b.d") - F.col("a.d"), F.lit(float("inf"))))
    ok = F.coalesce((F.col("a.d") <= MAX_DISTANCE) & (margin >= LEAST_MARGIN), F.lit(False))
    return scored.select("probe_id", "a.cluster", F.round("a.d", 6).alias("distance"), F.round(margin, 6).alias("margin"), ok.alias("decided"))


def worst_outliers(vectors: DataFrame, vec_id: str, cluster: str, vector: str) -> DataFrame:
    """A-10: the member farthest from its own centroid, of clusters with two members or more."""
    c = centroids(vectors, cluster, vector)
    d = vectors.select(F.col(vec_id).alias("vec_id"), F.col(cluster).alias("cluster"), F.col(vector).alias("v")).join(c, "cluster").withColumn("distance", F.round(cosine_distance(F.col("v"), F.col("centroid")), 6))
    worst = d.groupBy("cluster").agg(F.max(F.struct("distance", "vec_id")).alias("w"), F.count("*").alias("n")).where("n >= 2")
    return worst.select("cluster", "n", F.col("w.vec_id").alias("vec_id"), F.col("w.distance").alias("distance"), (F.col("w.distance") > OUTLIER).alias("flagged"))


def close_clusters(clusters: DataFrame, below: float = TOO_CLOSE) -> DataFrame:
    """J-22: pairs of centroids nearer than ``below``, each pair once; centroids meet in blocks, as in ``nearest_cluster``."""
    far = F.transform("held", lambda c: F.struct(c["cluster"].alias("b"), F.round(cosine_distance(F.col("centroid"), c["v"]), 6).alias("distance")))
    near = _against_blocks(clusters.select(F.col("cluster").alias("a"), "centroid"), clusters).select("a", F.explode(far).alias("p"))
    return near.where((F.col("p.b") > F.col("a")) & (F.col("p.distance") < below)).select("a", "p.b", "p.distance")
