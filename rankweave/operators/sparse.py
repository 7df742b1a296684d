"""Sparse matrices as relations (i, j, v): scaling, products, reductions.

Products are equi-joins with grouped sums, so Catalyst partially aggregates before each
shuffle and AQE splits skewed inner keys. Missing entries are 0; stored zeros are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0.0)), a)


def row_l2(m: DataFrame) -> DataFrame:
    """Rows to Euclidean length 1; zero rows stay."""
    return m.withColumn("v", _ratio(F.col("v"), F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("i")))))


def row_l1(m: DataFrame) -> DataFrame:
    return m.withColumn("v", _ratio(F.col("v"), F.sum(F.abs("v")).over(Window.partitionBy("i"))))


def from_entries(m: DataFrame) -> DataFrame:
    """Entries with the same place are summed."""
    return m.groupBy("i", "j").agg(F.sum("v").alias("v"))


def concat_columns(left: DataFrame, right: DataFrame, width: int, normalise: bool = True) -> DataFrame:
    """[left, right] side by side; ``width`` columns on the left."""
    if normalise:
        left, right = row_l2(left), row_l2(right)
    out = left.select("i", "j", "v").unionByName(right.select("i", (F.col("j") + width).alias("j"), "v"))
    return row_l2(out) if normalise else out


def composite_features(first: DataFrame, second: DataFrame, width: int, form: int) -> DataFrame:
    """Forms 0 to 5: both side by side, the first, the second, with rows of length 1; then again as they are.

    Side by side, each part's rows always have length 1; in form 0 the joined rows have, too.
    """
    if form not in range(6):
        raise ValueError(f"feature form {form} is not one of 0 to 5")
    normalise, pick = form < 3, form % 3
    if pick == 0:
        both = concat_columns(row_l2(first), row_l2(second), width, normalise=False)
        return row_l2(both) if normalise else both
    one = (first if pick == 1 else second).select("i", "j", "v")
    return row_l2(one) if normalise else one


def append_constant(m: DataFrame, rows: DataFrame, column: int, value: float = 1.0) -> DataFrame:
    """A constant column for each of ``rows`` (i), those without entries too."""
    return m.select("i", "j", "v").unionByName(rows.select("i", F.lit(column).cast(m.schema["j"].dataType).alias("j"), F.lit(float(value)).alias("v")))


def densify(m: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Every cell of rows (i) x columns (j): the frame is the result, so its size is inherent."""
    frame = rows.select("i").crossJoin(F.broadcast(columns.select("j")))
    return frame.join(m, ["i", "j"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def dense_cells(m: DataFrame, row: str, values: str) -> DataFrame:
    """An array column as entries, zeros included."""
    return m.select(F.col(row).alias("i"), F.posexplode(values).alias("j", "v")).select("i", "j", F.col("v").cast("double").alias("v"))


def identity(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def scale(m: DataFrame, rows: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """v * rows.s * columns.s; scales are (i, s) and (j, s), missing ones 1."""
    for key, side in (("i", rows), ("j", columns)):
        if side is not None:
            m = m.join(side.select(key, F.col("s").alias("_s")), key, "left").withColumn("v", F.col("v") * F.coalesce("_s", F.lit(1.0))).drop("_s")
    return m


def permute(m: DataFrame, rows: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """new = perm[old]; permutations are (old, new)."""
    for key, side in (("i", rows), ("j", columns)):
        if side is not None:
            m = m.join(side.select(F.col("old").alias(key), F.col("new").alias("_n")), key).withColumn(key, F.col("_n")).drop("_n")
    return m


def subtract_mean(m: DataFrame) -> DataFrame:
    """Less the mean of the stored entries."""
    return m.crossJoin(F.broadcast(m.agg(F.avg("v").alias("_m")))).withColumn("v", F.col("v") - F.col("_m")).drop("_m")


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def cast(m: DataFrame, kind: str) -> DataFrame:
    """Values as ``kind`` ('float', 'double')."""
    return m.withColumn("v", F.col("v").cast(kind))


def flatten(m: DataFrame, columns: int) -> DataFrame:
    return m.select((F.col("i") * columns + F.col("j")).alias("idx"), "v")


def replicate(vector: DataFrame, n: int) -> DataFrame:
    """A vector (j, v) as each of n rows."""
    return vector.crossJoin(vector.sparkSession.range(n).select(F.col("id").alias("i"))).select("i", "j", "v")


def threshold(m: DataFrame, least: float) -> DataFrame:
    """Entries with |v| >= least."""
    return m.where(F.abs("v") >= least)


def drop_zeros(m: DataFrame) -> DataFrame:
    return from_entries(m).where("v <> 0")


def subset(m: DataFrame, rows: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    if rows is not None:
        m = m.join(rows.select("i"), "i", "left_semi")
    return m if columns is None else m.join(columns.select("j"), "j", "left_semi")


def nnz(m: DataFrame, by: str = "i") -> DataFrame:
    return m.groupBy(by).agg(F.count("*").alias("n"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """a (i, j, v) times b (i, j, v), joined on a.j = b.i."""
    right = b.select(F.col("i").alias("_k"), F.col("j").alias("_j"), F.col("v").alias("_w"))
    return a.join(right, a["j"] == right["_k"]).groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("v") * F.col("_w")).alias("v"))


def gemm(alpha: float, a: DataFrame, b: DataFrame, beta: float, c: DataFrame) -> DataFrame:
    """alpha a b + beta c."""
    left = matmul(a, b).withColumn("v", F.col("v") * alpha)
    return from_entries(left.unionByName(c.select("i", "j", (F.col("v") * beta).alias("v"))))


def matvec(m: DataFrame, vector: DataFrame) -> DataFrame:
    """m times (j, x)."""
    return m.join(vector, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def gram(m: DataFrame) -> DataFrame:
    """Transposed m times m."""
    return matmul(transpose(m), m)


def masked_dot(pairs: DataFrame, x: DataFrame, w: DataFrame) -> DataFrame:
    """<x_i, w_label> of the given (i, label) only; x (i, j, v), w (label, j, w); no overlap gives 0."""
    hits = pairs.join(x, "i").join(w, ["label", "j"]).groupBy("i", "label").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return pairs.join(hits, ["i", "label"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def inner(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of products of entries in the same place."""
    other = b.select("i", "j", F.col("v").alias("_w"))
    return a.join(other, ["i", "j"]).agg(F.coalesce(F.sum(F.col("v") * F.col("_w")), F.lit(0.0)).alias("v"))


def trace_product(w: DataFrame, x: DataFrame, h: DataFrame) -> DataFrame:
    """tr(W' X H)."""
    return inner(w, matmul(x, h))


def diagonal_trace(w: DataFrame, d: DataFrame, h: DataFrame) -> DataFrame:
    """tr(W' D H) for a diagonal D given as (i, s)."""
    return inner(w, scale(h, rows=d))


def column_range(m: DataFrame) -> DataFrame:
    return m.groupBy("j").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def union_sum(ms: Sequence[DataFrame]) -> DataFrame:
    out = ms[0].select("i", "j", "v")
    for m in ms[1:]:
        out = out.unionByName(m.select("i", "j", "v"))
    return from_entries(out)


def union_max(ms: Sequence[DataFrame]) -> DataFrame:
    """Elementwise maximum, missing entries being 0."""
    out = None
    for m in ms:
        part = m.select("i", "j", "v")
        out = part if out is None else out.unionByName(part)
    g = out.groupBy("i", "j").agg(F.max("v").alias("v"), F.count("*").alias("_n"))
    return g.withColumn("v", F.when(F.col("_n") < len(ms), F.greatest("v", F.lit(0.0))).otherwise(F.col("v"))).drop("_n")


def permutation(ids: DataFrame, seed: int = 0) -> DataFrame:
    """(old, new): distinct whole-number ids in the order of a seeded hash, numbered from 0.

    Ranges of the hash are numbered apart and moved by the sizes of those before them, so no
    task holds all ids; the sizes are one row a range.
    """
    hashed = ids.select("old").withColumn("_h", hashed_unit(F.col("old"), seed))
    hashed = hashed.withColumn("_r", F.floor(F.col("_h") * 1024))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = hashed.groupBy("_r").agg(F.count("*").alias("_n")).withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("_r").orderBy("_h", "old"))
    return hashed.join(F.broadcast(sizes), "_r").select("old", (F.col("_at") + rank - 1).alias("new"))


def numbered(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``pos``, its place from 0 in the given order (of distinct rows).

    The sorted table is written with each row's task and place in it; tasks are moved by the
    sizes of those before them. So no task holds all rows; the sizes are one row a task.
    """
    held = cut(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    held = held.withColumn("_task", F.shiftright("_id", 33))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy("_task").agg(F.count("*").alias("_n")).select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    out = held.join(F.broadcast(sizes), "_task").withColumn("pos", F.col("_at") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop("_id", "_task", "_at")


def hashed_unit(key: Column, seed: int) -> Column:
    """A number in (0, 1) from a whole-number key: a linear congruence, the same in any engine and partition."""
    k = (key * 7919 + F.lit(seed * 104729 + 12345)) % 2147483647
    for _ in range(2):
        k = (k * 48271 + F.lit(11)) % 2147483647
    return (k + 0.5) / 2147483647.0


def random_matrix(spark, rows: int, columns: int, seed: int, normal: bool = False) -> DataFrame:
    """(i, j, v) of hash-derived values: uniform in (0, 1), or normal by the Box-Muller transform."""
    one = hashed_unit(F.col("id"), seed)
    value = F.sqrt(-2 * F.log(one)) * F.cos(2 * F.pi() * hashed_unit(F.col("id"), seed + 1)) if normal else one
    return spark.range(rows * columns).select(F.floor(F.col("id") / columns).alias("i"), (F.col("id") % columns).alias("j"), value.alias("v"))


def packed(m: DataFrame) -> DataFrame:
    """Row-packed form (i, idx, val), columns ascending."""
    g = m.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("_e"))
    return g.select("i", F.col("_e.j").alias("idx"), F.col("_e.v").alias("val"))


def packed_arrays(m: DataFrame, row: str, values: str, column: int | None = None, value: float = 1.0) -> DataFrame:
    """Row-packed form of an array column, as ``packed`` gives it for ``dense_cells``, without a row for each entry.

    ``column``, ``value``: a constant entry of each row. Rows without entries stay; arrays of one row are joined.
    """
    g = m.where(F.col(row).isNotNull()).groupBy(F.col(row).cast("long").alias("i")).agg(F.collect_list(values).alias("_a"))
    none = F.array().cast("array<long>")
    places = F.transform("_a", lambda a: F.when(F.size(a) > 0, F.sequence(F.lit(0).cast("long"), F.size(a).cast("long") - 1)).otherwise(none))
    idx, val = F.flatten(places), F.flatten("_a").cast("array<double>")
    if column is not None:
        idx, val = F.concat(idx, F.array(F.lit(column).cast("long"))), F.concat(val, F.array(F.lit(float(value))))
    return g.select("i", idx.alias("idx"), val.alias("val"))


def array_dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def axpy(alpha: float, x: str, y: str) -> Column:
    return F.zip_with(x, y, lambda a, b: a.cast("double") * alpha + b.cast("double"))
