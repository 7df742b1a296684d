"""Shared plumbing of the corpus operators: shared storage, Arrow limits, components."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every corpus contract: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
#: Upper and lower case letters that the contracts fold; others stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: the cluster's ``spark.checkpoint.dir``.

    Only a local session (tests) may leave it unset: then it is a folder under the warehouse.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return named.rstrip("/")


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage.

    The files outlive lost executors. They go by ``forget``, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  at exit the session may be gone already
        pass


def forget(df: DataFrame) -> None:
    """Deletes the files of a ``stored`` frame that nothing will read any more."""
    _delete(df.sparkSession, df._stored_at)


#: Rows of an Arrow batch that a worker looks at together.
PIECE_ROWS = 512


def in_pieces(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over views of ``PIECE_ROWS`` rows of each batch, so what it makes of them stays small.

    Workers outlive their tasks: at a task's end, memory that it freed goes back to the system.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_ROWS):
                yield batch.slice(at, PIECE_ROWS)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(cut(batches))
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return whole


def fold(text):
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def crc_mod(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def held_out(doc_id: str, modulus: int):
    return F.coalesce(crc_mod(doc_id, modulus) == 2, F.lit(False))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components: returns (node, component), component being its smallest node.

    Alternates large-star and small-star contractions (Kiveris et al. 2014): each is a
    grouped minimum, which is written, and a join with it. Of a hub's neighbours each is a
    row of that join, never a list; as both sides come straight from a shuffle, Spark splits
    a hub's rows over tasks. Rounds grow with the logarithm of the number of nodes squared.
    Nodes without an edge are not returned. Empty input gives an empty result.
    """
    kind = edges.schema[a].dataType
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()

    seen = mark(now)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        # large star: every larger neighbour, and the node, go to the smallest neighbour
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        # edges are (larger, smaller): the smaller end is the hub that is looked up
        large = now.select(F.col("v").alias("hub"), "u").join(low.select(F.col("u").alias("hub"), "m"), "hub")
        large = stored(large.select("u", F.col("m").alias("v")).distinct(), "large")
        # small star: smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        more = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = stored(more.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        was, seen = seen, mark(following)
        for done in (now, low, large):
            forget(done)
        now = following
        if was == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("u")).distinct().join(nodes, "u", "left_anti").select("u", F.col("u").alias("component"))
    return nodes.union(roots).select(F.col("u").cast(kind).alias("node"), F.col("component").cast(kind).alias("component"))


#: Words of 64 bits of a key filter: 1 MB, whatever the number of keys.
FILTER_WORDS = 1 << 17


class KeyFilter:
    """Bloom filter of a column of keys, of a fixed size, built and asked in the JVM.

    A key sets three bits of one word. ``may_have`` is true for every key that was put in, and
    for a small share of others as long as keys are fewer than a tenth of the bits; with more
    keys it only lets more rows pass, up to all. So it thins what a shuffle moves, and what
    follows must be exact.
    """

    def __init__(self, keys: DataFrame, key: Column):
        h = F.xxhash64(key)
        words = keys.where(key.isNotNull()).groupBy(self._word(h).alias("w")).agg(F.bit_or(self._mask(h)).alias("b"))
        every = keys.sparkSession.range(FILTER_WORDS).select(F.col("id").cast("int").alias("w")).join(words, "w", "left").select("w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
        ordered = F.array_sort(F.collect_list(F.struct("w", "b")))
        self.bits = stored(every.agg(F.transform(ordered, lambda x: x["b"]).alias("bits")), "filter")

    @staticmethod
    def _word(h: Column) -> Column:
        return F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(FILTER_WORDS - 1)).cast("int")

    @staticmethod
    def _mask(h: Column) -> Column:
        one = F.lit(1).cast("long")
        a, b, c = (F.call_function("shiftleft", one, F.shiftrightunsigned(h, k).bitwiseAND(F.lit(63)).cast("int")) for k in (0, 10, 20))
        return a.bitwiseOR(b).bitwiseOR(c)

    def may_have(self, key: Column) -> Column:
        """Whether ``key`` may be among the keys; null is not."""
        h = F.xxhash64(key)
        mask = self._mask(h)
        return key.isNotNull() & (F.get(self.bits.scalar(), self._word(h)).bitwiseAND(mask) == mask)


def without_ids(docs: DataFrame, gone: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` less the rows whose id is in ``gone`` (column doc_id); rows without id stay.

    Rows that a filter of the ids excludes stay where they are; only the rest, about as many
    as go, meet the ids in a join.
    """
    gone = stored(gone.select(F.col("doc_id").alias("_gone")).where("_gone is not null").distinct(), "gone")
    maybe = KeyFilter(gone, F.col("_gone")).may_have(docs[doc_id])
    asked = docs.where(maybe)
    return docs.where(~maybe).unionByName(asked.join(gone, asked[doc_id] == gone["_gone"], "left_anti"))
