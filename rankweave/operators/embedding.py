"""Label embeddings from instances: PIFA, HOMER, spectral scaling, pooled vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sparse
from .storage import cut


def pifa(y: DataFrame, x: DataFrame, normalise: bool = True) -> DataFrame:
    """(label, feature): normalised label rows of Y' X, where Y's rows have length 1."""
    out = sparse.matmul(sparse.transpose(sparse.row_l2(y)), x)
    return sparse.row_l2(out) if normalise else out


def homer(y: DataFrame) -> DataFrame:
    return sparse.transpose(y)


def bi_normalised(y: DataFrame) -> DataFrame:
    """Y' scaled by the inverse roots of its row and column sums."""
    t = sparse.transpose(y)
    row, col = F.sum("v").over(Window.partitionBy("i")), F.sum("v").over(Window.partitionBy("j"))
    return t.withColumn("_r", row).withColumn("_c", col).select("i", "j", (F.col("v") / F.sqrt(F.col("_r")) / F.sqrt(F.col("_c"))).alias("v"))


def spectral(y: DataFrame, dims: int, rounds: int = 8, more: int = 8) -> DataFrame:
    """(i, j, v): left singular vectors 2 to dims + 1 of the scaled matrix; signs are fixed so
    that each vector's largest entry is positive.

    Randomised subspace iteration (Halko et al. 2011): a label's row of the basis is one array
    of dims + 1 + ``more`` numbers; products with B B' are two grouped sums, and the driver
    sees only matrices as large as the basis is wide.
    """
    b = cut(bi_normalised(y).select("i", "j", "v"))
    width = dims + 1 + more
    key = F.crc32(F.col("i").cast("string").cast("binary"))
    start = [F.sqrt(-2 * F.log(sparse.hashed_unit(key, 2 * c))) * F.cos(2 * F.pi() * sparse.hashed_unit(key, 2 * c + 1)) for c in range(width)]
    q = cut(b.select("i").distinct().select("i", F.array(*start).alias("q")))

    def sums(m: DataFrame, by: str) -> DataFrame:
        return m.groupBy(by).agg(F.array(*[F.sum(F.col("v") * F.col("q")[c]) for c in range(width)]).alias("q"))

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def gram_of(left: str, right: str, m: DataFrame) -> np.ndarray:
        """A task adds up its rows; the driver gets one small matrix a task."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width, width))
            for batch in batches:
                total += matrix(batch.column(0)).T @ matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(range(width * width), pa.int32()), pa.array(total.ravel())], ["at", "g"])

        sums = m.select(F.col(left).alias("a"), F.col(right).alias("b")).mapInArrow(add, "at int, g double").groupBy("at").agg(F.sum("g").alias("g"))
        g = np.zeros(width * width)
        for r in sums.collect():
            g[r["at"]] = r["g"]
        g = g.reshape(width, width)
        return (g + g.T) / 2

    def turned(m: DataFrame, r: np.ndarray) -> DataFrame:
        def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = matrix(batch.column(1)) @ r
                ends = pa.array(np.arange(len(rows) + 1) * r.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))], ["i", "q"])

        return m.select("i", "q").mapInArrow(turn, T.StructType([m.schema["i"], T.StructField("q", T.ArrayType(T.DoubleType()))]))

    def whiten(m: DataFrame) -> DataFrame:
        value, base = np.linalg.eigh(gram_of("q", "q", m))
        scale = np.where(value > 1e-12 * max(value.max(), 1e-300), 1 / np.sqrt(np.maximum(value, 1e-300)), 0.0)
        return turned(m, base * scale)

    for _ in range(rounds):
        q = cut(whiten(q))
        q = cut(sums(b.join(sums(b.join(q, "i"), "j"), "j"), "i"))
    basis = cut(whiten(q))
    image = sums(b.join(sums(b.join(basis, "i"), "j"), "j"), "i").withColumnRenamed("q", "r")
    value, turn = np.linalg.eigh(gram_of("q", "r", basis.join(image, "i")))
    best = turn[:, np.argsort(-value, kind="stable")[: dims + 1]]
    e = cut(turned(basis, best).select("i", F.posexplode("q").alias("j", "v")).where("j > 0").withColumn("j", F.col("j") - 1))
    sign = e.groupBy("j").agg(F.signum(F.max_by("v", F.abs("v"))).alias("_s"))
    return e.join(F.broadcast(sign), "j").select("i", "j", (F.col("v") * F.col("_s")).alias("v"))  # a row a dimension


def pooled(vectors: DataFrame, label: str, values: str) -> DataFrame:
    """Mean of a label's vectors, to length 1."""
    e = sparse.dense_cells(vectors, label, values)
    return sparse.row_l2(e.groupBy("i", "j").agg(F.avg("v").alias("v")))


def create(y: DataFrame, x: DataFrame, method: str | None) -> DataFrame | None:
    """Label features by a method's name; "none" gives None, and a path (.npz, .npy, .parquet) is read."""
    if method is None or method.lower() == "none":
        return None
    if method.endswith((".npz", ".npy", ".parquet")):
        from ..sources.matrices import read_features

        return read_features(y.sparkSession, method)
    if method == "pifa":
        return pifa(y, x, normalise=False)
    if method == "homer":
        return homer(y)
    if method == "spectral":
        return spectral(y, 15)
    raise ValueError(f"unknown label embedding {method!r}")
