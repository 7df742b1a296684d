"""Operator 7. Sharding by vector bin packing of bytes, tokens and rows.

Documents with the same text are a group; a group with more than a quarter of a shard's bytes,
tokens or rows is cut into small pieces. Groups are placed from the largest on, each into the
shard where the dot product of its (bytes, tokens, rows) with the shard's residual capacity is
highest, among the shards that have room for its bytes; where none has, into the one with
the most room. The few large groups (each at least 1/256 of a shard, so at most 768 a shard)
are placed on the driver. The rest is dealt by hash into cells of bounded size; each cell gets
its part of what capacity is left and packs it in the same way, so cells work in parallel and
the law ``bytes`` holds. A document is never cut, so one larger than a shard stays as it is.

Results: a null text has no bytes, so size 8, and counts as equal to an empty one; a null id
is placed as any other; repeated rows are equal texts; an empty table gives an empty result.
Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .mixing import words_in

CELL_GROUPS = 20_000
SLOT_ROWS = 4_000
#: A group over 1 / SPLIT of a shard is cut into pieces of 1 / PIECES; one over 1 / LARGE is
#: placed on the driver.
SPLIT, PIECES, LARGE = 4, 32, 256


def pack(units: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Shard of each unit (rows of bytes, tokens, rows), placed in the given order.

    ``residual`` (shards x 3) is what each shard can still take; it is used up in place.
    """
    vectors = units / np.maximum(residual.clip(0).sum(axis=0), 1) ** 2
    shard = np.empty(len(units), np.int64)
    for i, unit in enumerate(units):
        fits = residual[:, 0] >= unit[0]
        s = int(np.argmax(np.where(fits, residual @ vectors[i], -np.inf) if fits.any() else residual[:, 0]))
        shard[i] = s
        residual[s] -= unit
    return shard


def shard_documents(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens) for each row."""
    spark = docs.sparkSession
    full = F.coalesce(F.col(text), F.lit(""))
    base = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"), (F.octet_length(full) + 8).cast("long").alias("size"), words_in(text).alias("tokens"),
            F.crc32(full.cast("binary")).alias("text_crc32"), F.sha2(full, 256).alias("group"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard",
    )
    sums = (F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    total = base.agg(*sums).first()
    everything = np.array([total["size"] or 0, total["tokens"] or 0, total["rows"]], float)
    share = np.maximum(everything / shards, 1e-9).tolist()
    groups = base.groupBy("group").agg(*sums)
    # a group's, or a piece's, greatest part of a shard
    part = F.greatest(*(F.col(c) / F.lit(whole) for c, whole in zip(("size", "tokens", "rows"), share, strict=True)))
    # groups over a quarter of a shard in bytes, tokens or rows: under twelve a shard, so the side is bounded
    huge = groups.where(part > 1 / SPLIT).select("group", F.ceil(part * PIECES).alias("pieces"))
    # rows without id are dealt by their number
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row")))
    piece = F.coalesce(F.pmod(F.xxhash64(name, F.lit(7)), F.col("pieces")), F.lit(0))
    base = base.join(F.broadcast(huge), "group", "left").withColumn("piece", piece).drop("pieces")
    units = stored(base.groupBy("group", "piece").agg(*sums).withColumn("part", part), "units")
    order = [F.desc("part"), "group", "piece"]
    is_large = F.col("part") >= 1 / LARGE
    large = units.where(is_large).orderBy(*order).collect()  # at most 3 * LARGE * shards units
    residual = np.tile(everything / shards, (shards, 1))
    chosen = pack(np.array([[u["size"], u["tokens"], u["rows"]] for u in large], float).reshape(-1, 3), residual)
    # an Arrow table, as a list of rows would start more Python workers on the executors, which stay
    placed = spark.createDataFrame(pa.table({"group": pa.array([u["group"] for u in large], pa.string()), "piece": pa.array([u["piece"] for u in large], pa.int64()), "shard": pa.array(chosen, pa.int64())}))
    small = units.where(~is_large)
    left = residual.clip(0).sum(axis=0)
    cells = max(1, -(-small.count() // CELL_GROUPS))

    def cell(table: pa.Table) -> pa.Table:
        rows = np.stack([table.column(c).to_numpy().astype(float) for c in ("size", "tokens", "rows")], axis=1)
        ids = np.array(table.column("group").to_pylist(), dtype=object)
        pieces = table.column("piece").to_numpy()
        at = np.lexsort((pieces, ids.astype(str), -table.column("part").to_numpy()))
        part = rows.sum(axis=0) / np.maximum(left, 1)
        s = pack(rows[at], residual * part)
        return pa.table({"group": pa.array(ids[at].tolist(), pa.string()), "piece": pa.array(pieces[at], pa.int64()), "shard": pa.array(s, pa.int64())})

    dealt = small.withColumn("cell", F.pmod(F.xxhash64("group"), F.lit(cells))).groupBy("cell").applyInArrow(cell, "group string, piece long, shard long")
    slot_cells = max(1, -(-int(everything[2]) // (SLOT_ROWS * shards)))
    out = base.join(dealt.unionByName(placed), ["group", "piece"]).withColumn("part", F.pmod(F.xxhash64(name, F.lit(11)), F.lit(slot_cells)))
    out = stored(out.select("doc_id", "size", "tokens", "text_crc32", "group", "shard", "part"), "placed")
    count = out.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = count.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "group"))
    out = out.withColumn("rank", rank).join(offset, ["shard", "part"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens",
    )
