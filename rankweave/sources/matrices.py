"""Readers and writers of matrices, texts, codes and models, as DataFrames.

Large inputs are text or Parquet and are read by Spark. ``.npz``, ``.npy`` and the dense and
PETSc binaries are single files by format: each file is one task's work (``binaryFile``).
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = "i long, j long, v double"
#: Fixed values of the PETSc format: a matrix with counts of 32 or of 64 bits.
PETSC_32, PETSC_64 = 1211216, 1015


def _frame(i, j, v) -> pd.DataFrame:
    return pd.DataFrame({"i": np.asarray(i, np.int64), "j": np.asarray(j, np.int64), "v": np.asarray(v, np.float64)})


def _binary(spark: SparkSession, path: str, decode: Callable[[bytes], pd.DataFrame]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield decode(bytes(content))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ENTRIES)


def _from_npz(content: bytes) -> pd.DataFrame:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        part = {n[:-4]: np.load(io.BytesIO(z.read(n)), allow_pickle=False) for n in z.namelist()}
    kind = part["format"].item()
    kind = kind.decode() if isinstance(kind, bytes) else str(kind)
    if kind == "coo":
        return _frame(part["row"], part["col"], part["data"])
    major = np.repeat(np.arange(len(part["indptr"]) - 1), np.diff(part["indptr"]))
    if kind == "csr":
        return _frame(major, part["indices"], part["data"])
    if kind == "csc":
        return _frame(part["indices"], major, part["data"])
    raise ValueError(f"sparse format {kind!r} isn't supported")


def _from_dense(x: np.ndarray) -> pd.DataFrame:
    i, j = np.indices(x.shape)
    return _frame(i.ravel(), j.ravel(), x.ravel())


def _from_petsc(content: bytes) -> pd.DataFrame:
    (magic,) = struct.unpack_from("<i", content)
    if magic not in (PETSC_32, PETSC_64):
        raise ValueError(f"not a PETSc matrix: {magic}")
    rows, _ = struct.unpack_from("<ii", content, 4)
    n = struct.unpack_from("<i" if magic == PETSC_32 else "<q", content, 12)[0]
    at = 16 if magic == PETSC_32 else 20
    counts = np.frombuffer(content, "<i4", rows, at)
    at += 4 * rows
    columns = np.frombuffer(content, "<u4", n, at)
    return _frame(np.repeat(np.arange(rows), counts), columns, np.frombuffer(content, "<f8", n, at + 4 * n))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a ``.npz`` (sparse) or ``.npy`` (dense, zeros included) file, or of Parquet."""
    if path.endswith(".npz"):
        return _binary(spark, path, _from_npz)
    if path.endswith(".npy"):
        return _binary(spark, path, lambda c: _from_dense(np.load(io.BytesIO(c), allow_pickle=False)))
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"{path}: .npz, .npy or .parquet is needed")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(i, value): lines with their number, counted over the sorted file's blocks."""
    lines = spark.read.text(path).rdd.zipWithIndex()
    return lines.map(lambda x: (x[1], x[0][0])).toDF("i long, value string")


def read_texts(spark: SparkSession, path: str, column: int | None = None) -> DataFrame:
    """(i, text): a text a line, blanks trimmed; ``column``: only that tab-separated field."""
    d = _numbered(spark, path)
    text = F.col("value") if column is None else F.split("value", "\t").getItem(column)
    return d.select("i", F.trim(text).alias("text"))


def read_label_names(spark: SparkSession, path: str) -> DataFrame:
    """(label, name): a name a line, in ISO-8859-1."""
    lines = spark.read.option("encoding", "ISO-8859-1").option("sep", "\x01").option("quote", "").csv(path, schema="name string")
    return lines.rdd.zipWithIndex().map(lambda x: (x[1], x[0][0])).toDF("label long, name string")


def read_svmlight(spark: SparkSession, path: str, skip: int = 1, zero_based: bool = False, bias: float | None = None, bias_column: int | None = None) -> DataFrame:
    """Entries of ``index:value`` tokens after the first ``skip`` of each line; zeros are dropped."""
    d = _numbered(spark, path).select("i", F.split(F.trim("value"), r"\s+").alias("t"))
    pair = d.select("i", F.explode(F.slice("t", skip + 1, 1 << 30)).alias("p")).where(F.col("p").contains(":"))
    e = pair.select("i", (F.split("p", ":")[0].cast("long") - (0 if zero_based else 1)).alias("j"), F.split("p", ":")[1].cast("double").alias("v")).where("v <> 0")
    if bias is None:
        return e
    return e.unionByName(d.select("i", F.lit(bias_column).cast("long").alias("j"), F.lit(float(bias)).alias("v")))


def read_problem(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """LIBSVM file as ((i, y), entries)."""
    y = _numbered(spark, path).select("i", F.split(F.trim("value"), r"\s+")[0].cast("double").alias("y"))
    return y, read_svmlight(spark, path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``i j v`` with numbers from 1."""
    t = spark.read.csv(path, sep=" ", schema="i long, j long, v double")
    return t.select((F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), "v")


def read_petsc(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, _from_petsc)


def petsc_bytes(i: np.ndarray, j: np.ndarray, v: np.ndarray, rows: int, columns: int) -> bytes:
    """A matrix in the 64-bit PETSc form."""
    order = np.lexsort((j, i))
    counts = np.bincount(i, minlength=rows).astype("<i4")
    head = struct.pack("<iiiq", PETSC_64, rows, columns, len(v))
    return head + counts.tobytes() + j[order].astype("<u4").tobytes() + v[order].astype("<f8").tobytes()


def dense_bytes(x: np.ndarray) -> bytes:
    """A dense matrix as the dense binary: two 64-bit counts, then its rows in doubles."""
    return struct.pack("<QQ", *x.shape) + np.ascontiguousarray(x, "<f8").tobytes()


def _from_dense_binary(content: bytes) -> pd.DataFrame:
    rows, columns = struct.unpack_from("<QQ", content)
    if len(content) != 16 + 8 * rows * columns:
        raise ValueError(f"a dense matrix of {rows} x {columns} needs {16 + 8 * rows * columns} bytes, not {len(content)}")
    return _from_dense(np.frombuffer(content, "<f8", rows * columns, 16).reshape(rows, columns))


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a dense binary, zeros included."""
    return _binary(spark, path, _from_dense_binary)


def write_tokens(tokens: DataFrame, path: str) -> None:
    """Token sequences (i, input_ids, attention_mask, token_type_ids) as Parquet."""
    tokens.select("i", "input_ids", "attention_mask", "token_type_ids").write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str, length: int | None = None) -> DataFrame:
    """Token sequences; with ``length`` all must have it."""
    d = spark.read.parquet(path)
    if length is not None and not d.where(F.size("input_ids") != length).isEmpty():
        raise ValueError(f"{path}: sequences of other lengths than {length}")
    return d


def read_tree(spark: SparkSession, path: str, bias: float = 1.0) -> list[tuple[DataFrame, DataFrame | None]]:
    """A tree of label partitions with weights, as a chain of (weights, label-to-code).

    Head lines: features, labels, nodes. Then level by level, for each node: whether it is a
    leaf, its two children's numbers, its depth, its number of labels and the labels, the number
    of its weight lines, and these lines of ``feature:weight``: one a child, or one a label in a
    leaf. Without ``bias`` the last feature is left out.
    """
    lines = iter([r["value"].strip() for r in spark.read.option("wholetext", True).text(path).select(F.explode(F.split("value", "\n")).alias("value")).collect()])
    features, _, nodes = (int(next(lines)) for _ in range(3))
    features -= bias <= 0
    chain = []
    for depth in range((nodes + 1).bit_length() - 1):
        codes, weights = [], []
        for node in range(1 << depth):
            is_leaf = int(next(lines)) == 1
            children = [int(c) - (2 ** (depth + 1) - 1) for c in next(lines).split()]
            if int(next(lines)) != depth:
                raise ValueError(f"{path}: a node of level {depth} is out of place")
            labels = [int(c) for c in next(lines).split()[1:]]
            next(lines)  # how many lines of weights: one for each of the following
            for label in labels if is_leaf else children:
                codes.append((label, node))
                pairs = [p.split(":") for p in next(lines).split()]
                weights += [(label, int(j), float(v)) for j, v in pairs if int(j) < features]
        layer = spark.createDataFrame(weights, "label long, j long, w double")
        chain.append((layer, spark.createDataFrame(codes, "label long, code long") if depth else None))
    return chain


def read_predictions(spark: SparkSession, path: str, only_topk: int | None = None) -> DataFrame:
    """Lines ``label:score label:score ...`` after a head line, ranked by score."""
    from ..operators.ranking import top_k

    e = read_svmlight(spark, path, skip=0, zero_based=True).where("i > 0").withColumn("i", F.col("i") - 1)
    return e if only_topk is None else top_k(e, only_topk)


READERS: dict[str, Callable[..., DataFrame]] = {"text": read_triples, "petsc": read_petsc, "svmlight": read_svmlight, "features": read_features, "dense": read_dense}


def read_matrix(spark: SparkSession, path: str, format: str, **options) -> DataFrame:
    if format not in READERS:
        raise ValueError(f"unknown format {format!r}; there are {', '.join(READERS)}")
    return READERS[format](spark, path, **options)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


def save_chain(spark: SparkSession, chain: list[tuple[DataFrame, DataFrame | None]], path: str, **params) -> None:
    """Weights partitioned by level, label codes by level, parameters as JSON."""
    for d, (w, codes) in enumerate(chain):
        w.write.mode("overwrite").parquet(f"{path}/weights/level={d}")
        if codes is not None:
            codes.write.mode("overwrite").parquet(f"{path}/codes/level={d}")
    _write_text(spark, f"{path}/param", json.dumps({"model": "hierarchical", "depth": len(chain), "coded": [c is not None for _, c in chain], **params}))


def load_chain(spark: SparkSession, path: str) -> tuple[list[tuple[DataFrame, DataFrame | None]], dict]:
    param = json.loads(_read_text(spark, f"{path}/param"))
    if param["model"] != "hierarchical":
        raise ValueError(f"unknown model {param['model']!r}")
    chain = [
        (spark.read.parquet(f"{path}/weights/level={d}"), spark.read.parquet(f"{path}/codes/level={d}") if param["coded"][d] else None)
        for d in range(param["depth"])
    ]
    return chain, param


def model_size(chain: list[tuple[DataFrame, DataFrame | None]]) -> dict:
    """Number of labels, features and levels."""
    w = chain[-1][0].agg(F.max("label").alias("l"), F.max("j").alias("j")).first()
    return {"labels": (w["l"] if w["l"] is not None else -1) + 1, "features": (w["j"] if w["j"] is not None else -1) + 1, "depth": len(chain)}


def layer_size(w: DataFrame, codes: DataFrame) -> DataFrame:
    """One row: nr_labels, nr_codes, nr_features of a layer (weights, label-to-code)."""
    of_codes = codes.agg(F.countDistinct("code").alias("nr_codes"))
    sizes = w.agg(F.countDistinct("label").alias("nr_labels"), (F.max("j") + 1).alias("nr_features"))
    return sizes.crossJoin(of_codes).select("nr_labels", "nr_codes", "nr_features")  # one row each


def save_layer(spark: SparkSession, layer: tuple[DataFrame, DataFrame | None], path: str, **params) -> None:
    """A single layer as a chain of one."""
    save_chain(spark, [layer], path, **params)


def load_layer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    chain, _ = load_chain(spark, path)
    if len(chain) != 1:
        raise ValueError(f"{path} holds {len(chain)} layers")
    return chain[0]


def save_counts(model: DataFrame, path: str) -> None:
    """A count model (code i, label j, v)."""
    model.write.mode("overwrite").parquet(f"{path}/counts")
    _write_text(model.sparkSession, f"{path}/param", json.dumps({"model": "count"}))


def load_counts(spark: SparkSession, path: str) -> DataFrame:
    kind = json.loads(_read_text(spark, f"{path}/param"))["model"]
    if kind != "count":
        raise ValueError(f"{path} holds a {kind!r} model")
    return spark.read.parquet(f"{path}/counts")


def load_model(spark: SparkSession, path: str):
    """What is saved there: a chain of layers, or a count model."""
    kind = json.loads(_read_text(spark, f"{path}/param"))["model"]
    return load_counts(spark, path) if kind == "count" else load_chain(spark, path)[0]


def save_codes(codes: DataFrame, path: str, **config) -> None:
    codes.write.mode("overwrite").parquet(f"{path}/codes")
    _write_text(codes.sparkSession, f"{path}/config", json.dumps(config))


def load_codes(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/codes"), json.loads(_read_text(spark, f"{path}/config"))
