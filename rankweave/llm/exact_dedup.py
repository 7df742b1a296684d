"""Operator 5. Exact dedup by a log-structured merge index.

Every worker puts (digest, id) pairs into a memtable. A full memtable is flushed as sorted
runs, one for each range of digests, each with a filter of its digests. Compaction merges a
range's runs pair by pair: the filter tells which digests can't be in the other run and pass
at once; those that may be are looked up; of equal digests the smallest id stays and counts
add up. Digests that several rows share are hits. Hits receive byte verification: all texts
under one digest must be the same bytes; where they aren't, texts decide, not the digest.

Ranges grow in number with the table, so a compaction's memory is bounded. A digest with a
third of all rows is one entry of each run. Verification reads the texts of hits only: a
filter of their ids, of a fixed size, tells which rows they are. It compares the least with
the greatest text of each digest, which each task does for its own rows first.

Results: null counts as empty text; a null id counts as larger than any other; repeated
rows belong to the same group and count each time; an empty table gives an empty result; ids
are whole numbers below 2^63 - 1 (text ids that are not raise an error); only doc_id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, KeyFilter, stored

MEMTABLE = 100_000
RANGE_ROWS = 400_000
NO_ID = np.iinfo(np.int64).max


class Run:
    """Sorted, distinct digests with smallest ids, counts and a filter of two bits a digest."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        order = np.lexsort((ids, keys))
        keys, ids, counts = keys[order], ids[order], counts[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.ids = keys[starts], ids[starts]
        self.counts = np.add.reduceat(counts, starts) if len(keys) else counts
        self.bits = max(64, 1 << int(np.ceil(np.log2(max(1, len(self.keys)) * 12))))
        self.filter = np.zeros(self.bits >> 3, np.uint8)
        for at in self.places(self.keys):
            np.bitwise_or.at(self.filter, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))

    def places(self, keys: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64(self.bits - 1)
        return [keys & mask, (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20) & mask]

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        one, two = (self.filter[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 for at in self.places(keys))
        return (one & two).astype(bool)

    def merge(self, other: Run) -> Run:
        maybe = self.may_have(other.keys)
        keys, ids, counts = other.keys[maybe], other.ids[maybe], other.counts[maybe]
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        there = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        np.minimum.at(self.ids, at[there], ids[there])
        np.add.at(self.counts, at[there], counts[there])
        new = ~maybe
        return Run(
            np.concatenate([self.keys, other.keys[new], keys[~there]]),
            np.concatenate([self.ids, other.ids[new], ids[~there]]),
            np.concatenate([self.counts, other.counts[new], counts[~there]]),
        )


def compacted(runs: list[Run]) -> Run:
    """Size-tiered: the two smallest runs merge until one is left."""
    runs = sorted(runs, key=lambda r: len(r.keys))
    while len(runs) > 1:
        small, large, *runs = runs
        runs = sorted([*runs, large.merge(small)], key=lambda r: len(r.keys))
    return runs[0]


def index_hits(keyed: DataFrame, ranges: int) -> DataFrame:
    """(digest, keep_id, group_size) of digests with several rows; keyed: (doc_id, digest as 16 hex digits)."""

    def flush(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, ids = (np.concatenate(x) for x in zip(*rows, strict=True))
        part = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        out: list[list] = [[], [], [], []]
        for p in np.unique(part):
            own = part == p
            run = Run(keys[own], ids[own], np.ones(int(own.sum()), np.int64))
            for held, x in zip(out, (int(p), run.keys.tobytes(), run.ids.tobytes(), run.counts.tobytes()), strict=True):
                held.append(x)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], ["part", "k", "i", "n"])

    def memtables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rows = [], 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            text = "".join(batch.column(1).to_pylist())
            keys = np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)
            ids = batch.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            table.append((keys, ids))
            rows += len(keys)
            if rows >= MEMTABLE:
                yield flush(table)
                table, rows = [], 0
        if table:
            yield flush(table)

    def compaction(table: pa.Table) -> pa.Table:
        raw = zip(*(table.column(c).to_pylist() for c in ("k", "i", "n")), strict=True)
        run = compacted([Run(np.frombuffer(k, np.uint64), np.frombuffer(i, np.int64), np.frombuffer(n, np.int64)) for k, i, n in raw])
        hit = run.counts > 1
        ids = run.ids[hit]
        return pa.table({
            "digest": pa.array([f"{k:016x}" for k in run.keys[hit].tolist()], pa.string()),
            "keep_id": pa.array(ids, pa.int64(), mask=ids == NO_ID),
            "group_size": pa.array(run.counts[hit], pa.int64()),
        })

    runs = keyed.select("doc_id", "digest").mapInArrow(memtables, "part long, k binary, i binary, n binary")
    return runs.groupBy("part").applyInArrow(compaction, "digest string, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_digits: int = 16) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``.

    ``digest_digits`` hex digits of the hash are the index's digest (fewer: more collisions,
    the same result).
    """
    kind = docs.schema[doc_id].dataType
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ").alias("norm"))
    digest = F.rpad(F.substring("text_sha256", 1, digest_digits), 16, "0")
    keyed = stored(named.select("doc_id", F.sha2("norm", 256).alias("text_sha256")), "digests").withColumn("digest", digest)
    hits = stored(index_hits(keyed, max(8, keyed.count() // RANGE_ROWS)), "hits")
    several = stored(keyed.join(hits.select("digest"), "digest", "left_semi").select("doc_id"), "several")
    asked = F.col("doc_id").isNull() | KeyFilter(several, F.col("doc_id")).may_have(F.col("doc_id"))
    # a row more that the filter lets through is alone under its digest, and so like itself
    found = named.where(asked).withColumn("text_sha256", F.sha2("norm", 256)).withColumn("digest", digest)
    unlike = stored(found.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).where("lo <> hi").select("digest"), "unlike")
    if unlike.isEmpty():
        out = keyed.join(hits, "digest", "left")
    else:
        apart = found.join(unlike, "digest", "left_semi")
        own = stored(apart.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "own")
        sure = hits.join(unlike, "digest", "left_anti")
        rest = keyed.join(unlike, "digest", "left_anti").join(sure, "digest", "left")
        out = rest.unionByName(apart.join(own, ["digest", "norm"]).drop("norm"))
    out = out.withColumn("_first", F.coalesce("keep_id", "doc_id"))
    return out.select(
        F.col("doc_id").cast(kind).alias("doc_id"), F.col("_first").cast(kind).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("_first")).alias("kept"), "text_sha256",
    )
