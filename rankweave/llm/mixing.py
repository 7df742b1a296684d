"""Operator 2. Mixing sources to target weights by Sainte-Lague apportionment.

Sources get targets (weights 1, 2, 3, repeating by code point, nulls last; at most three
times their size, the excess shared anew by weight). Equal-token blocks go to sources by the
highest quotients target / (2j - 1), then each source's blocks to its shards in the same way,
so that every (source, shard) has an integer quota. A shard holds its documents in a seeded
order; its blocks are taken from a seeded block on, round and round, until the quota is used.
So most documents are taken whole, and a run's first and last in part.

DataFrame functions only. Shards are cut by a hash of the id, so a source with a third of all
rows is dealt over all of them. A source's blocks reach its shards down a tree: each node
hands its blocks to at most ``FAN`` children by their highest quotients. So however many
shards there are, none of the rankings holds more than a few thousand quotients; only the
sources themselves, one row each, are ranked together.

Results: null or empty texts have size 0 and are taken 0 times; a null source is a source of
its own, last in order; repeated rows count each time; a table without words, or an empty
one, gives targets 0; only doc_id, text and source are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, stored

#: At most so many times is a document taken.
REPEATS = 3
SHARD_DOCS = 512
#: Children of a node in the tree of shards.
FAN = 256
MOST_BLOCK = 256


def words_of(text: str) -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), "")


def words_in(text: str) -> Column:
    return F.size(words_of(text)).cast("long")


def apportion(parties: DataFrame, group: str, party: str, weight: str, seats: str) -> DataFrame:
    """Adds ``quota``: of each group's ``seats`` (long, one value in a group) those that each
    party gets by the highest quotients weight / (2j - 1); ties go to the smaller party.

    Rounded shares miss the number of seats by some d, and each quota is within d of its
    rounded share; so only these seats' quotients are ranked, not all.
    """
    whole = Window.partitionBy(group)
    total = F.sum(weight).over(whole)
    near = F.when(total > 0, F.round(F.col(seats) * F.col(weight) / total)).otherwise(0).cast("long")
    a = parties.withColumn("_near", near)
    a = a.withColumn("_off", F.abs(F.col(seats) - F.sum("_near").over(whole)) + 1)
    a = a.withColumn("_sure", F.greatest(F.lit(0), F.col("_near") - F.col("_off")))
    a = a.withColumn("_open", F.col(seats) - F.sum("_sure").over(whole))
    seat = F.explode(F.sequence(F.col("_sure") + 1, F.col("_near") + F.col("_off")))
    q = a.where(F.col(weight) > 0).select(group, party, weight, "_open", seat.alias("_seat"))
    q = q.select(group, party, "_open", (F.col(weight) / (2 * F.col("_seat") - 1)).alias("_q"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_q"), party))
    won = q.withColumn("_rank", rank).where("_rank <= _open").groupBy(group, party).agg(F.count("*").alias("_won"))
    return (
        a.join(won, [group, party], "left")
        .withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0)))
        .drop("_near", "_off", "_sure", "_open", "_won")
    )


def to_shards(cells: DataFrame, plan: DataFrame, shards: int) -> DataFrame:
    """Adds ``quota`` to (key, shard, cell_size): the key's ``blocks`` of ``plan``, dealt down the tree.

    A node of a level is the run of ``FAN`` nodes of the level below with the same quotient of
    their numbers; the lowest level's nodes are the shards.
    """
    width = 1
    while width * FAN < shards:
        width *= FAN
    above = plan.select("key", F.lit(0).cast("long").alias("up"), "blocks")
    while width:
        level = cells.groupBy("key", F.floor(F.col("shard") / width).alias("node")).agg(F.sum("cell_size").alias("w"))
        level = level.withColumn("up", F.floor(F.col("node") / FAN) if width * FAN < shards else F.lit(0).cast("long"))
        level = level.join(above, ["key", "up"]).withColumn("group", F.struct("key", "up"))
        dealt = stored(apportion(level, "group", "node", "w", "blocks").select("key", "node", "quota"), "quotas")
        above = dealt.select("key", F.col("node").alias("up"), F.col("quota").alias("blocks"))
        width //= FAN
    return cells.join(dealt.withColumnRenamed("node", "shard"), ["key", "shard"])


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``target`` to (key, source_size, ...): shares by weight, filled up to the caps."""
    one = Window.partitionBy(F.lit(1))
    w = sources.withColumn("_n", F.row_number().over(one.orderBy("key")))
    w = w.withColumn("_w", ((F.col("_n") - 1) % 3 + 1).cast("double")).withColumn("_cap", (REPEATS * F.col("source_size")).cast("double"))
    before = one.orderBy(F.col("_cap") / F.col("_w"), "key").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(one) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    heavy = F.sum("_w").over(one) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    w = w.withColumn("_level", left / heavy)
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))
    level = F.coalesce(F.max(fits).over(one), F.lit(0.0))
    return w.withColumn("target", F.least(F.col("_cap"), F.col("_w") * level)).drop("_n", "_w", "_cap", "_level")


def mix(docs: DataFrame, seed: int = 42, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, and how:
    ``passes`` whole copies, then ``more`` words from word ``more_at`` on and the first ``head``.
    """
    key = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source)))
    base = stored(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), key.alias("key"), words_in(text).alias("size"), F.monotonically_increasing_id().alias("row")),
        "mix",
    )
    shards = max(1, -(-base.count() // SHARD_DOCS))
    # rows without id are dealt by their number
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row")))
    base = base.withColumn("shard", F.pmod(F.xxhash64(name, F.lit(seed)), F.lit(shards)))
    cells = stored(base.groupBy("key", "shard").agg(F.sum("size").alias("cell_size")), "cells")
    plan = targets(cells.groupBy("key").agg(F.sum("cell_size").alias("source_size")))
    one = Window.partitionBy(F.lit(1))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(one)
    block = F.coalesce(F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCK), F.floor(least / 256))), F.lit(1)).cast("long")
    plan = plan.withColumn("block", block).withColumn("all", F.lit(1))
    plan = plan.withColumn("seats", F.round(F.sum("target").over(one) / F.col("block")).cast("long"))
    plan = apportion(plan, "all", "key", "target", "seats").withColumnRenamed("quota", "blocks").drop("all", "seats")
    plan = stored(plan, "plan")
    cells = to_shards(cells, plan, shards).join(plan, "key")
    use = F.least(F.col("quota") * F.col("block"), REPEATS * F.col("cell_size"))
    size = F.greatest(F.col("cell_size"), F.lit(1))
    cells = cells.select(
        "key", "shard", "source_size", "target", "cell_size",
        F.floor(use / size).alias("passes"), (use % size).alias("rest"),
        (F.pmod(F.xxhash64("key", "shard", F.lit(seed)), F.ceil(size / F.col("block"))) * F.col("block")).alias("at"),
    )
    order = Window.partitionBy("key", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size", "row")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    d = base.withColumn("b", upto).withColumn("a", F.col("b") - F.col("size")).join(cells, ["key", "shard"])
    end = F.col("at") + F.col("rest")
    more = F.greatest(F.lit(0), F.least("b", end) - F.greatest("a", "at"))
    head = F.greatest(F.lit(0), F.least(F.col("b"), end - F.col("cell_size")) - F.col("a"))
    d = d.withColumn("more", F.when(F.col("rest") > 0, more).otherwise(0)).withColumn("head", F.when(F.col("rest") > 0, head).otherwise(0))
    return d.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("passes") * F.col("size") + F.col("more") + F.col("head")).cast("long").alias("taken"),
        F.col("passes").cast("long").alias("passes"), F.col("more").cast("long").alias("more"),
        F.greatest(F.lit(0), F.col("at") - F.col("a")).cast("long").alias("more_at"), F.col("head").cast("long").alias("head"),
    )


def mixed_documents(docs: DataFrame, seed: int = 42, doc_id: str = "doc_id", text: str = "text", source: str = "source", chars: str = "n_chars") -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each whole copy, and one for each
    run of words where a document is taken in part (``chars``, if there, is that part's length).

    Rows that share an id are each taken as the first of them is.
    """
    how = mix(docs, seed, doc_id, text, source).groupBy("doc_id").agg(F.min(F.struct("size", "passes", "more", "more_at", "head")).alias("_mix"))
    how = stored(how.select(F.col("doc_id").alias("_mix_id"), "_mix"), "mixed")
    # the row as one struct, so that no name of its columns meets ours
    d = docs.select(F.struct("*").alias("_doc")).join(how, F.col("_doc")[doc_id].eqNullSafe(F.col("_mix_id")))
    full, m = F.col("_doc")[text], F.col("_mix")
    words = F.array_remove(F.split(F.coalesce(full, F.lit("")), SPACE), "")

    def part(start: Column, n: Column) -> Column:
        cut = F.array_join(F.slice(words, start + 1, n), " ")
        return F.when(n == m["size"], F.array(full)).when(n > 0, F.array(cut)).otherwise(F.array().cast("array<string>"))

    start, more, head = (m[c].cast("int") for c in ("more_at", "more", "head"))
    copies = F.concat(F.array_repeat(full, m["passes"].cast("int")), part(start, more), part(F.lit(0), head))
    d = d.where(m["passes"] + m["more"] + m["head"] > 0).select("_doc", F.explode(copies).alias("_copy"))
    now = {text: F.col("_copy")}
    if chars in docs.columns:
        now[chars] = F.length("_copy").cast(docs.schema[chars].dataType)
    return d.select(*[now.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])
