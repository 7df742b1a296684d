"""Operator 6. Line dedup by site-relative frequency.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it
divided by all pages of the host; lines over the boilerplate ratio (and on three pages at
least) are dropped from every page of that host.

DataFrame functions only. A page is taken apart once and its lines stored. Lines are counted
by a 64-bit hash, per task before they are shuffled, so a host or a line with a third of all
rows is one row a task. Lines with a frequent hash are counted again as they are, so that two
lines with one hash are told apart. A host's dropped lines are fewer than its lines a page
divided by the ratio, so they travel as one short list; where Spark doesn't broadcast the
lists, it splits a large host's pages over tasks.

Results: a null url or one without host is the host ''; a null or empty page has no lines; a
line repeated in a page counts once for its ratio and is dropped or kept as a whole; repeated
rows count as pages of their own; an empty table gives an empty result; only page_id, url and
html are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BLOCK_TAGS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul"


def host_of(url: str) -> Column:
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(found)


def lines_of_html(html: str) -> Column:
    """Visible text, a line for each block element; white space collapsed, no empty lines."""
    t = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>)", "")
    t = F.regexp_replace(t, rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", ""), r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")
    return F.array_remove(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), "")


def drop_boilerplate(pages: DataFrame, lines: Column, host: Column, page_id: str = "page_id", ratio: float = 0.3, min_pages: int = 3) -> DataFrame:
    """(page_id, host, n_lines, n_dropped, text) for each row; ``lines`` is an array column."""
    base = stored(pages.select(F.col(page_id).alias("page_id"), host.alias("host"), lines.alias("lines")), "lines")
    whole = base.groupBy("host").agg(F.count("*").alias("of"))
    hashes = F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))
    frequent = base.select("host", F.explode(hashes).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    frequent = frequent.join(whole, "host").where(F.col("n") / F.col("of") > ratio)
    maybe = stored(frequent.groupBy("host").agg(F.max("of").alias("of"), F.collect_set("h").alias("maybe")), "maybe")
    same = F.array_distinct(F.filter("lines", lambda x: F.array_contains("maybe", F.xxhash64(x))))
    exact = base.join(maybe, "host").select("host", "of", F.explode(same).alias("line")).groupBy("host", "of", "line").agg(F.count("*").alias("n"))
    exact = exact.where((F.col("n") >= min_pages) & (F.col("n") / F.col("of") > ratio))
    dropped = stored(exact.groupBy("host").agg(F.collect_list("line").alias("gone")), "dropped")
    out = base.join(dropped, "host", "left")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("gone", x)))
    out = out.withColumn("kept", kept)
    return out.select(
        "page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )


def dedup_page_lines(pages: DataFrame, ratio: float = 0.3, min_pages: int = 3) -> DataFrame:
    return drop_boilerplate(pages, lines_of_html("html"), host_of("url"), "page_id", ratio, min_pages)
