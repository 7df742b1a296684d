"""Operator 4. MinHash near-dedup with sequential Bayesian verification.

1. Every document's set of word shingles is hashed; its MinHash signature is cut into bands.
2. Documents that share a band value are candidates. A band value links its members to their
   least member only, and components of these links are candidate clusters.
3. In each cluster the banded pairs are verified. Signatures are compared batch by batch; a
   pair goes as soon as the posterior probability that its similarity reaches the threshold
   (uniform prior) is below ``MISS``. Survivors are verified exactly on the full sets. Pairs
   already in one component need no look.
4. Components of the verified links are the groups; the smallest id of a group stays.

Equal sets share one node, so copies never pair up. In a cluster over ``STAR`` sets each member is
first verified with the least member of its bands only, which is work in line with the cluster's
size, and cut at will. Of what this joins, pairs need no look any more; members stay in the
search only where the least member of one of their bands is not joined with all members of its
bands, and make new, smaller clusters. Clusters over ``CHUNK`` sets or ``CHUNK_SHINGLES`` shingles are cut into chunks, and
each pair of chunks is a task, so memory is bounded and no link is lost. The chance that a pair
at the threshold shares no band is (1 - 0.8**6)**56 < 1e-7. Texts that are in no cluster never
move: a fixed-size filter of the members' ids tells which rows are joined with the clusters.

Results: null texts and texts without words have an empty set and no links; equal ids are one
node; a row without id takes its equal texts' group, or is kept on its own; repeated rows are
each reported; an empty table gives an empty result; ids are whole numbers (text ids that are
not raise an error); only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, components, in_pieces, stored

BANDS, ROWS = 56, 6
HASHES = BANDS * ROWS
BATCH = 32
MISS = 1e-6
STAR, CHUNK, CHUNK_SHINGLES = 500, 2_000, 3_000_000
WORDS_KEPT = 300_000
_draw = np.random.default_rng(20240)
FACTOR = (_draw.integers(0, 2**31, HASHES, dtype=np.uint32) << 1) | np.uint32(1)
ADDEND = _draw.integers(0, 2**32, HASHES, dtype=np.uint32)
BAND_MIX = _draw.integers(0, 2**63, (ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_SALT = _draw.integers(0, 2**63, BANDS, dtype=np.uint64)
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hash of a word, kept; starts anew when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``n`` words."""
    words = (text or "").encode().translate(_FOLD).split()
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(w) == 0:
        return w
    size = min(n, len(w))
    acc = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        acc = _mixed(acc + w[k : len(w) - size + 1 + k])
    return np.unique(acc)


def signature(s: np.ndarray) -> np.ndarray:
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(out, (low[at : at + 2048, None] * FACTOR + ADDEND).min(axis=0), out=out)
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    """(documents x HASHES) -> (documents x BANDS) band values."""
    s = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return _mixed(_mixed((s @ BAND_MIX)[:, :, 0]) + BAND_SALT).view(np.int64)


def least_matches(threshold: float, miss: float) -> list[int]:
    """For n = BATCH, 2 BATCH, ...: matches below which P(J >= threshold | matches) < miss.

    With a uniform prior that probability is P(Binomial(n + 1, threshold) <= matches).
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def verify(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, miss: float = MISS, known: np.ndarray | None = None) -> np.ndarray:
    """Component number of each set, by links of ``percent`` similarity or more.

    ``side``: only pairs whose sides differ are looked at. ``known``: sets of one value are joined.
    """
    n = len(sets)
    component = np.arange(n) if known is None else np.unique(known, return_inverse=True)[1]
    if n < 2:
        return component
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, sets = sizes[order], [sets[i] for i in order]
    side = None if side is None else side[order]
    component = component if known is None else component[order]
    sig = np.stack([signature(s) for s in sets])
    band = bands(sig)
    least = least_matches(percent / 100, miss)
    for i in range(n - 1):
        to = int(np.searchsorted(sizes * percent, sizes[i] * 100, side="right"))  # larger sets have too many others
        js = np.arange(i + 1, to)
        js = js[component[js] != component[i]]
        if side is not None:
            js = js[side[js] != side[i]]
        if len(js) == 0:
            continue
        js = js[(band[js] == band[i]).any(axis=1)]
        matches = np.zeros(len(js), np.int64)
        for k, at in enumerate(range(0, HASHES - BATCH + 1, BATCH)):
            if len(js) == 0:
                break
            matches += (sig[js, at : at + BATCH] == sig[i, at : at + BATCH]).sum(axis=1)
            stays = matches >= least[k]
            js, matches = js[stays], matches[stays]
        js = js[np.argsort(-matches, kind="stable")]
        width = 4
        while len(js):
            part, js = js[:width], js[width:]
            flat = np.concatenate([sets[j] for j in part])
            at = np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)
            both = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.r_[0, np.cumsum(sizes[part])[:-1]])
            for j in part[both * 100 >= percent * (sizes[part] + sizes[i] - both)]:
                component[component == component[j]] = component[i]
            js = js[component[js] != component[i]]
            width = min(64, width * 2)
    # each component is named by its first set
    names, first, at = np.unique(component, return_index=True, return_inverse=True)
    out = np.empty(n, np.int64)
    out[order] = order[first[at]]
    return out


def _parts(most: int) -> Column:
    return F.ceil(F.greatest(F.count("*") / most, F.sum("size") / CHUNK_SHINGLES)).cast("int")


def _star_tasks(large: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tasks that hold some members and, as the other side, the least member of their bands."""
    low = pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    rays = large.join(low, "node").select("head", "known", "size", "low")
    rays = rays.join(rays.groupBy("low").agg(_parts(STAR).alias("parts")), "low")
    part = F.pmod(F.xxhash64("head"), F.col("parts")).cast("int")
    rays = rays.select("head", "known", F.lit(0).alias("chunk"), F.xxhash64("low", part).alias("task"), "low")
    hubs = large.select(F.col("node").alias("low"), "head", "known")
    hubs = rays.select("low", "task").distinct().join(hubs, "low").select("head", "known", F.lit(1).alias("chunk"), "task")
    return rays.drop("low").union(hubs).withColumn("across", F.lit(True))


def _pair_tasks(members: DataFrame) -> DataFrame:
    """Tasks that hold a cluster, or two chunks of one, or one chunk."""
    sizes = members.groupBy("component").agg(_parts(CHUNK).alias("chunks")).where("chunks > 1")
    members = members.join(sizes, "component", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    members = members.withColumn("chunk", F.pmod(F.xxhash64("head"), F.col("chunks")).cast("int"))
    other = F.sequence(F.lit(0), F.col("chunks") - 1)
    members = members.select("head", "known", "component", "chunk", F.explode(other).alias("other"))
    task = F.xxhash64("component", F.least("chunk", "other"), F.greatest("chunk", "other"))
    return members.select("head", "known", "chunk", task.alias("task"), (F.col("chunk") != F.col("other")).alias("across"))


def near_dedup(docs: DataFrame, shingle_words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``."""
    kind = docs.schema[doc_id].dataType
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, digest, signatures = [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), shingle_words, hashes)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    signatures.append(signature(s))
            value = bands(np.stack(signatures)) if signatures else np.zeros((0, BANDS), np.int64)
            ends = np.r_[0, np.cumsum((np.array(n) > 0) * BANDS)].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(value.ravel()))],
                ["doc_id", "n_shingles", "set_hash", "bands"],
            )

    table = stored(named.mapInArrow(in_pieces(describe), "doc_id long, n_shingles long, set_hash binary, bands array<long>"), "bands")
    node = F.xxhash64("set_hash").alias("node")
    banded = table.where("n_shingles > 0").select(F.explode("bands").alias("band"), node)
    shared = banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("band", "low")
    pairs = stored(banded.join(shared, "band").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), "pairs")
    clusters = components(pairs)

    sets = table.where("n_shingles > 0").groupBy("set_hash", node)
    heads = stored(sets.agg(F.min("doc_id").alias("head"), F.count("*").alias("copies"), F.max("n_shingles").alias("size")), "heads")
    members = heads.join(clusters, "node").where("head is not null").select("node", "head", "size", "component")
    members = stored(members.withColumn("known", F.col("head")), "members")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        now, rows = None, []

        def links() -> pa.RecordBatch:
            ids, _, chunk, known, sets = (list(x) for x in zip(*rows, strict=True))
            roots = verify(sets, percent, np.array(chunk) if rows[0][1] else None, known=np.array(known))
            pair = [(ids[i], ids[r]) for i, r in enumerate(roots) if ids[i] != ids[r]]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in pair], pa.int64()), pa.array([x[1] for x in pair], pa.int64())], ["a", "b"])

        for batch in batches:
            task, across, chunk, head, known, text_ = batch.columns
            for i in range(batch.num_rows):
                if rows and task[i].as_py() != now:
                    yield links()
                    rows = []
                now = task[i].as_py()
                s = shingles(text_[i].as_py(), shingle_words, hashes)
                if len(s):
                    rows.append((head[i].as_py(), across[i].as_py(), chunk[i].as_py(), known[i].as_py(), s))
        if rows:
            yield links()

    def links_in(tasks: DataFrame) -> DataFrame:
        tasks = stored(tasks.select("head", "known", "chunk", "task", "across"), "tasks")
        clustered = named.where(KeyFilter(tasks, F.col("head")).may_have(F.col("doc_id")))
        texts = clustered.join(tasks, clustered["doc_id"] == tasks["head"]).select("task", "across", "chunk", "head", "known", "text")
        return stored(texts.repartition("task").sortWithinPartitions("task").mapInArrow(in_pieces(link), "a long, b long"), "links")

    large = members.groupBy("component").agg(_parts(STAR).alias("parts")).where("parts > 1").select("component")
    large = stored(members.join(large, "component"), "large")
    links = None
    if not large.isEmpty():
        links = links_in(_star_tasks(large, pairs))
        joined = components(links).select(F.col("node").alias("head"), F.col("component").alias("now"))
        large = large.join(joined, "head", "left").withColumn("known", F.coalesce("now", "known"))
        large = stored(large.select("node", "head", "size", "known"), "large")
        # where all members of a band are joined with its least one, nothing is left to decide
        ends = pairs.join(large.select(F.col("node").alias("a"), F.col("known").alias("known_a")), "a")
        ends = ends.join(large.select(F.col("node").alias("b"), F.col("known").alias("known_b")), "b", "left")
        ends = stored(ends.select("a", "b", (~F.col("known_a").eqNullSafe(F.col("known_b"))).alias("open")), "ends")
        again = ends.join(ends.where("open").select("b").distinct(), "b").select("a", "b")
        rest = large.join(components(again), "node").select("head", "size", "component", "known")
        first = large.select("head").withColumnRenamed("head", "seen")
        members = members.join(first, members["head"] == first["seen"], "left_anti").select("head", "size", "component", "known").union(rest)
    found = links_in(_pair_tasks(members))
    links = found if links is None else links.union(found)
    groups = components(links)
    known = heads.join(groups, heads["head"] == groups["node"], "left").where("copies > 1 or component is not null")
    known = known.select("set_hash", F.coalesce("component", "head").alias("first"))
    out = table.select("doc_id", "n_shingles", "set_hash").join(known, "set_hash", "left")
    first = F.coalesce("first", "doc_id")
    return out.select(
        F.col("doc_id").cast(kind).alias("doc_id"), "n_shingles", first.cast(kind).alias("component_id"),
        F.col("doc_id").eqNullSafe(first).alias("kept"),
    )
