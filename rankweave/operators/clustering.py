"""Balanced binary label clustering: all nodes of a level are split in one pass.

Labels are rows of (i, j, v); nodes are heap numbers (root 1); a leaf's code is its number
less 2 ** depth. A node's half with the smaller scores (ties: smaller label) goes left.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import uniform_bin
from . import sparse
from .storage import cut


#: Labels of a node that one task ranks; larger nodes are ranked by a sort over all tasks.
RANK_ROWS = 2_000_000


def depth_for(labels: int, size: int = 100) -> int:
    return int(math.log2(labels // size + 1))


def depth_for_clusters(clusters: int) -> int:
    return int(math.log2(clusters))


def ranked(df: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """Adds ``rank`` from 1 in each group and the group's size ``n``; ``most``: rows of the largest group."""
    if most <= RANK_ROWS:
        w = Window.partitionBy(group)
        return df.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count("*").over(w))
    placed = cut(sparse.numbered(df, group, *order))
    starts = placed.groupBy(group).agg(F.min("pos").alias("_start"), F.count("*").alias("n"))
    return placed.join(starts, group).withColumn("rank", F.col("pos") - F.col("_start") + 1).drop("pos", "_start")


def split(scored: DataFrame, most: int = 0) -> DataFrame:
    """(i, node, score) to (i, node) one level down; ``most``: labels of the largest node."""
    right = F.when(F.col("n") > 1, (F.col("rank") > F.floor(F.col("n") / 2)).cast("long")).otherwise(F.lit(0).cast("long"))
    return ranked(scored, "node", ["score", "i"], most).withColumn("_r", right).select("i", (F.col("node") * 2 + F.col("_r")).alias("node"))


def two_means(m: DataFrame, depth: int, spherical: bool = True, max_iter: int = 20) -> DataFrame:
    """(i, code) by balanced 2-means; the first centres are a node's largest and smallest label."""
    m = cut(sparse.row_l2(m) if spherical else m)  # read in every round
    nodes = m.select("i").distinct().withColumn("node", F.lit(1).cast("long"))
    labels = nodes.count()
    for level in range(depth):
        most = (labels >> level) + level + 1  # halves differ by one label at most
        ends = nodes.groupBy("node").agg(F.min("i").alias("lo"), F.max("i").alias("hi")).where("lo < hi")
        high = ends.join(m, ends["hi"] == m["i"]).select("node", "j", "v")
        low = ends.join(m, ends["lo"] == m["i"]).select("node", "j", (-F.col("v")).alias("v"))
        toward = high.unionByName(low).groupBy("node", "j").agg(F.sum("v").alias("d"))
        was = None
        for _ in range(max_iter):
            s = nodes.join(m, "i").join(toward, ["node", "j"]).groupBy("i").agg(F.sum(F.col("v") * F.col("d")).alias("score"))
            halves = cut(split(nodes.join(s, "i", "left").select("i", "node", F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score")), most))
            if was is not None and halves.join(was, ["i", "node"], "left_anti").isEmpty():
                break
            was = halves
            sides = centroids(halves, m, spherical)
            signed = F.when(F.col("node") % 2 == 1, F.col("v")).otherwise(-F.col("v"))
            toward = sides.select(F.floor(F.col("node") / 2).alias("node"), "j", signed.alias("v")).groupBy("node", "j").agg(F.sum("v").alias("d"))
        nodes = was
    return nodes.select("i", (F.col("node") - (1 << depth)).alias("code"))


def centroids(nodes: DataFrame, m: DataFrame, spherical: bool) -> DataFrame:
    """(node, j, v): a node's sum at length 1 (``spherical``) or its mean."""
    total = nodes.join(m, "i").groupBy("node", "j").agg(F.sum("v").alias("v"))
    if spherical:
        length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("node")))
        return total.withColumn("v", F.col("v") / F.nullif(length, F.lit(0.0)))
    size = nodes.groupBy("node").agg(F.count("*").alias("n"))
    return total.join(size, "node").select("node", "j", (F.col("v") / F.col("n")).alias("v"))


def kd_tree(m: DataFrame, depth: int, dims: int, cyclic: bool = False) -> DataFrame:
    """(i, code): median splits on feature level % dims, or in ``cyclic`` runs of depth / dims levels."""
    nodes = m.select("i").distinct().withColumn("node", F.lit(1).cast("long"))
    labels = nodes.count()
    for d in range(depth):
        f = (d // max(1, depth // dims)) % dims if cyclic else d % dims
        own = m.where(F.col("j") == f).select("i", F.col("v").alias("score"))
        nodes = split(nodes.join(own, "i", "left").select("i", "node", F.coalesce("score", F.lit(0.0)).alias("score")), (labels >> d) + d + 1)
    return nodes.select("i", (F.col("node") - (1 << depth)).alias("code"))


def projection(features: DataFrame, dims: int, seed: int) -> DataFrame:
    """(j, dim) matrix of whole-number weights from -50 to 50, the same in any engine."""
    spark = features.sparkSession
    k = F.col("j") * 7919 + F.col("d") * 104729 + seed * 15485863
    return features.select("j").distinct().crossJoin(spark.range(dims).select(F.col("id").alias("d"))).select(
        F.col("j").alias("i"), F.col("d").alias("j"), ((k * 48271 % 2147483647) % 101 - 50).cast("double").alias("v")
    )


def projected(m: DataFrame, dims: int, seed: int) -> DataFrame:
    """Products to nine decimals, so that values on an edge of a bin are the same in any order of the sums."""
    return sparse.matmul(m, projection(m, dims, seed)).withColumn("v", F.round("v", 9))


def ordinal_bins(z: DataFrame, kdim: int) -> DataFrame:
    """Each column's ranks in steps of equal size, as q from 0."""
    most = z.groupBy("j").count().agg(F.max("count")).first()[0] or 0
    placed = ranked(z, "j", ["v", "i"], most)
    return placed.withColumn("q", F.floor((F.col("rank") - 1) / F.ceil(F.col("n") / F.lit(kdim)))).drop("rank", "n")


def uniform_bins(z: DataFrame, kdim: int) -> DataFrame:
    """Each column's values in bins of equal width, as q from 0."""
    return z.join(F.broadcast(sparse.column_range(z)), "j").withColumn("q", uniform_bin(F.col("v"), F.col("lo"), F.col("hi"), kdim))


def hash_code(q: DataFrame, kdim: int) -> DataFrame:
    """(i, code): sum of q * kdim ** j."""
    return q.groupBy("i").agg(F.sum(F.col("q") * F.pow(F.lit(kdim), F.col("j"))).cast("long").alias("code"))


def ordinal_codes(m: DataFrame, kdim: int, dims: int, seed: int = 0) -> DataFrame:
    """Random projection, ranks in equal steps."""
    return hash_code(ordinal_bins(projected(m, dims, seed), kdim), kdim)


def uniform_codes(m: DataFrame, kdim: int, dims: int, seed: int = 0) -> DataFrame:
    """Random projection, bins of equal width."""
    return hash_code(uniform_bins(projected(m, dims, seed), kdim), kdim)


def balanced_ordinal(m: DataFrame, depth: int, seed: int = 0) -> DataFrame:
    return kd_tree(projected(m, depth, seed), depth, depth, cyclic=True)


def random_codes(labels: DataFrame, depth: int, seed: int = 0) -> DataFrame:
    """A code for each label by a seeded hash: of the label, if it is a whole number, else of its crc32."""
    key = F.crc32(F.col("i").cast("binary")) if labels.schema["i"].dataType.simpleString() == "string" else F.col("i")
    return labels.select("i", F.floor(sparse.hashed_unit(key, seed) * (1 << depth)).alias("code"))


def one_hot(codes: DataFrame) -> DataFrame:
    return codes.select("i", F.col("code").alias("j"), F.lit(1.0).alias("v"))


def members(codes: DataFrame) -> DataFrame:
    return codes.groupBy("code").agg(F.sort_array(F.collect_set("i")).alias("labels"))


#: Algorithm numbers of the index.
KMEANS, KD, RANDOM_ORDINAL, RANDOM_UNIFORM, ORDINAL, SKMEANS, KD_CYCLIC, RANDOM = 0, 1, 2, 3, 4, 5, 11, 12


def generate(m: DataFrame, kdim: int, depth: int, algorithm: int = SKMEANS, seed: int = 0, max_iter: int = 20, dims: int | None = None) -> DataFrame:
    """(i, code) by the numbered algorithm; trees are binary, so ``kdim`` must be 2 for them."""
    if algorithm in (RANDOM_ORDINAL, RANDOM_UNIFORM):
        return (ordinal_codes if algorithm == RANDOM_ORDINAL else uniform_codes)(m, kdim, depth, seed)
    if kdim != 2:
        raise ValueError("this algorithm makes binary trees")
    if algorithm in (KMEANS, SKMEANS):
        return two_means(m, depth, algorithm == SKMEANS, max_iter)
    if algorithm in (KD, KD_CYCLIC):
        return kd_tree(m, depth, dims or m.agg(F.max("j")).first()[0] + 1, algorithm == KD_CYCLIC)
    if algorithm == ORDINAL:
        return balanced_ordinal(m, depth, seed)
    if algorithm == RANDOM:
        return random_codes(m.select("i").distinct(), depth, seed)
    raise ValueError(f"unknown algorithm {algorithm}")


#: Index methods by name.
METHODS = {"none": SKMEANS, "skmeans": SKMEANS, "kmeans": KMEANS, "kdtree": KD, "random": RANDOM, "ordinal": ORDINAL, "uniform": RANDOM_UNIFORM}


def codes_by_name(features: DataFrame, name: str | None, size: int = 100, max_iter: int = 20, seed: int = 0) -> DataFrame:
    """(i, code) by a method's name; the depth follows from clusters of ``size`` labels."""
    key = (name or "none").lower()
    if key not in METHODS:
        raise ValueError(f"unknown index method {name!r}; there are {', '.join(METHODS)}")
    depth = depth_for(features.select("i").distinct().count(), size)
    return generate(features, 2, depth, METHODS[key], seed, max_iter)


def parents(code: Column, branching: int = 2) -> Column:
    return F.floor(code / branching)
