"""Operator 9. Benchmark decontamination as a prefix-filtered set join.

Every item gives its windows of ten consecutive words (a shorter item is one window). Words
are counted over all documents, and each window's rarest word is its prefix: a document can
hold the window only where it holds that word, so these words alone are joined. The word's
place in the window fixes where the window would begin, which gives the positional and length
bounds; what is left is verified by comparing the whole window with the words there.

DataFrame functions only. Documents are taken apart once, and their words stored with a number
for each row. Two passes read them: one counts the benchmark's words, one finds prefix words. In
both a filter of a fixed size lets only words through that may matter, so what meets the
windows is a few words with the words around them, however large the benchmark is; no side is
broadcast unless Spark finds it small. Shuffled otherwise are one row a document, one a hit.

Results: null and empty texts, and items without words, have no hits; rows with a null id or
a repeated one are each reported; an item without id marks words but isn't counted; without
items nothing is hit; an empty documents table gives an empty result. Only ids and texts are
read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, fold, stored

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def tokens(text: str) -> Column:
    """Runs of letters and digits, and of all beyond ASCII; A-Z folded.

    Splitting is many times faster than extracting all matches, which copies the text for each.
    """
    return F.array_remove(F.split(fold(F.coalesce(F.col(text), F.lit(""))), BETWEEN), "")


def windows(items: DataFrame, size: int, item_id: str, text: str) -> DataFrame:
    w = items.select(F.col(item_id).cast("string").alias("item"), tokens(text).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - size))
    return w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("window")).distinct()


def prefixed(wins: DataFrame, words: DataFrame) -> DataFrame:
    """(window, id, word, at, len): each distinct window's rarest word and that word's place.

    ``words``: (row, w) of all documents.
    """
    places = wins.select("window").distinct().select("window", F.posexplode("window").alias("at", "word"))
    wanted = KeyFilter(places, F.col("word"))
    seen = words.select(F.explode("w").alias("word")).where(wanted.may_have(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))
    seen = stored(seen, "seen")  # both sides of the join come from a shuffle, so Spark can split a word's rows
    least = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at"))
    best = places.join(seen, "word", "left").groupBy("window").agg(least.alias("p"))
    out = best.select("window", F.monotonically_increasing_id().alias("id"), F.col("p.word").alias("word"), F.col("p.at").alias("at"), F.size("window").alias("len"))
    return stored(out, "prefixes")


def verified(words: DataFrame, prefixes: DataFrame, window: int) -> DataFrame:
    """(row, id, start, len): all places where a document's row holds a window."""
    wanted = KeyFilter(prefixes, F.col("word"))
    first = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    met = words.select("row", "n", "w", F.posexplode("w").alias("pos", "word")).where(wanted.may_have(F.col("word")))
    met = met.select("row", "n", "pos", "word", first.alias("first"), F.slice("w", first + 1, 2 * window - 1).alias("near"))
    start = F.col("pos") - F.col("at")
    there = F.slice("near", F.greatest(start - F.col("first"), F.lit(0)) + 1, F.col("len")) == F.col("window")
    return met.join(prefixes, "word").where((start >= 0) & (start + F.col("len") <= F.col("n")) & there).select("row", "id", start.alias("start"), "len")


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) for each row of ``docs``.

    ``spans`` are the (start, len) of verified windows, in words.
    """
    wins = stored(windows(items, window, item_id, item_text), "windows")
    w = tokens(text)
    words = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.size(w).alias("n"), w.alias("w")), "words")
    prefixes = prefixed(wins, words)
    hits = stored(verified(words.where("n > 0"), prefixes, window), "hits")
    spans = hits.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "len"))).alias("spans"))
    of = prefixes.join(wins, "window").select("id", "item")
    named = hits.select("row", "id").distinct().join(of, "id").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    g = words.select("row", "doc_id", F.col("n").alias("n_words")).join(spans.join(named, "row", "left"), "row", "left")
    none = F.array().cast("array<struct<start:int,len:int>>")
    g = g.withColumn("spans", F.coalesce("spans", none)).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))

    def cover(acc: Column, x: Column) -> Column:
        end = x["start"] + x["len"]
        return F.struct(F.greatest(acc["upto"], end).alias("upto"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["upto"], x["start"]))).alias("n"))

    n_hit = F.aggregate("spans", zero, cover, lambda a: a["n"])
    g = g.withColumn("n_hit", n_hit.cast("long"))
    return g.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans",
    )
