"""Text to features: cleaning, word tokens, TF-IDF, fixed-length id sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import sparse


def clean(text: str) -> Column:
    """One line: outer blanks off, line breaks to spaces."""
    return F.regexp_replace(F.trim(F.col(text)), "[\\r\\n]+", " ")


def truncate(text: str, chars: int = 4096) -> Column:
    return F.substring(F.col(text), 1, chars)


def words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}]+"), "")


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("i"), F.explode(words(text)).alias("j")).groupBy("i", "j").agg(F.count("*").alias("tf"))


def tfidf(docs: DataFrame, key: str, text: str, normalise: bool = True) -> DataFrame:
    """(i, j, v): tf * ln(N / df), rows to length 1."""
    tf = term_counts(docs, key, text)
    df = tf.groupBy("j").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    m = tf.join(df, "j").crossJoin(F.broadcast(n)).select("i", "j", (F.col("tf") * F.log(F.col("n") / F.col("df"))).alias("v"))
    return sparse.row_l2(m) if normalise else m


def vocabulary(docs: DataFrame, key: str, text: str, size: int, reserved: int = 4) -> DataFrame:
    """(token, id) of the most frequent words; ids from ``reserved`` on, ties alphabetical."""
    n = term_counts(docs, key, text).groupBy("j").agg(F.sum("tf").alias("n")).orderBy(F.desc("n"), "j").limit(size)
    return n.select(F.col("j").alias("token"), (F.row_number().over(Window.orderBy(F.desc("n"), "j")) - 1 + reserved).cast("int").alias("id"))


def pad(ids: str, length: int, pad_id: int = 0, left: bool = False) -> tuple[Column, Column]:
    """Fixed-length ids and the mask of real ones."""
    cut = F.slice(F.col(ids), 1, length)
    fill = F.greatest(F.lit(length) - F.size(cut), F.lit(0))
    pads, zeros, ones = F.array_repeat(F.lit(pad_id), fill), F.array_repeat(F.lit(0), fill), F.array_repeat(F.lit(1), F.size(cut))
    return (F.concat(pads, cut), F.concat(zeros, ones)) if left else (F.concat(cut, pads), F.concat(ones, zeros))


def segments(ids: str, length: int, left: bool = False, pad_segment: int | None = None) -> Column:
    """Segment numbers of one sequence: 0, and for padding 4 on the left and 0 on the right unless given."""
    other = (4 if left else 0) if pad_segment is None else pad_segment
    return pad_of(F.transform(F.slice(F.col(ids), 1, length), lambda _: F.lit(0)), length, other, left)


def pad_of(values: Column, length: int, fill: int, left: bool) -> Column:
    more = F.array_repeat(F.lit(fill), F.greatest(F.lit(length) - F.size(values), F.lit(0)))
    return F.concat(more, values) if left else F.concat(values, more)


def encode(docs: DataFrame, vocab: DataFrame, key: str, text: str, length: int, unknown: int = 1, begin: int = 2, end: int = 3, left: bool = False) -> DataFrame:
    """(i, input_ids, attention_mask, token_type_ids): begin, words, end, padding."""
    t = docs.select(F.col(key).alias("i"), F.posexplode_outer(F.slice(words(text), 1, length - 2)).alias("p", "token"))
    t = t.join(vocab, "token", "left").withColumn("id", F.when(F.col("token").isNotNull(), F.coalesce("id", F.lit(unknown))))
    seq = t.groupBy("i").agg(F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("p", "id")))).alias("e"))
    seq = seq.withColumn("ids", F.concat(F.array(F.lit(begin)), F.col("e.id"), F.array(F.lit(end))))
    ids, mask = pad("ids", length, 0, left)
    return seq.select("i", ids.alias("input_ids"), mask.alias("attention_mask"), segments("ids", length, left).alias("token_type_ids"))
