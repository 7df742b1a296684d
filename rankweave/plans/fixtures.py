"""Relations that the queries derive from the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as words
from ..operators import sparse


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def order_parts(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j")).distinct().withColumn("v", F.lit(1.0))


def quantities(spark, sf):
    """With repeated places."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").cast("double").alias("v"))


def brand_codes(spark, sf):
    part = table(spark, sf, "part")
    codes = part.select("p_brand").distinct().withColumn("code", (F.row_number().over(Window.orderBy("p_brand")) - 1).cast("long"))
    return part.join(F.broadcast(codes), "p_brand").select(F.col("p_partkey").alias("label"), "code")  # one row a brand


def vectors(spark, sf):
    e = sparse.dense_cells(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return e.select("i", F.col("j").cast("long").alias("j"), "v")


def packed_vectors(spark, sf, where: str = "true"):
    """Packed rows of the vectors where ``where`` holds (of their id i), with a constant of 1 in column 64."""
    e = table(spark, sf, "embeddings").withColumn("i", F.col("vec_id")).where(where)
    return sparse.packed_arrays(e, "i", "embedding", 64)


def classes(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").cast("long").alias("j"), F.lit(1.0).alias("v"))


def order_features(spark, sf):
    o = table(spark, sf, "orders")
    js = F.array(
        F.substring("o_orderpriority", 1, 1).cast("long"),
        F.when(F.col("o_orderstatus") == "F", 10).when(F.col("o_orderstatus") == "O", 11).otherwise(12).cast("long"),
        (F.month("o_orderdate") + 20).cast("long"),
    )
    return o.select(F.col("o_orderkey").alias("i"), F.explode(js).alias("j")).withColumn("v", F.lit(1.0))


def document_labels(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    one = d.select(F.col("doc_id").alias("i"), F.explode(F.array(
        F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"), F.concat(F.lit("len:"), F.least(F.lit(4), F.floor(F.col("n_chars") / 2000)).cast("string"))
    )).alias("j"))
    two = lab.select(F.col("doc_id").alias("i"), F.explode(F.array(F.concat(F.lit("quality:"), F.col("quality").cast("string")), F.concat(F.lit("toxic:"), F.col("toxic").cast("string")))).alias("j"))
    return one.union(two).withColumn("v", F.lit(1.0))


def tfidf(spark, sf):
    return words.tfidf(table(spark, sf, "documents"), "doc_id", "text")


def matched_codes(spark, sf):
    """Three brand codes of each order by a closed form, with a score."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"))
    c = brand_codes(spark, sf).select("code").distinct()
    s = o.crossJoin(F.broadcast(c)).withColumn("v", ((F.col("i") * 31 + F.col("code") * 17) % 101) / 101.0)
    w = Window.partitionBy("i").orderBy(F.desc("v"), "code")
    return s.withColumn("r", F.row_number().over(w)).where("r <= 3").select("i", F.col("code").alias("j"), "v")


def class_predictions(spark, sf, lo: int, hi: int):
    """Dot products of vectors with class means on dims lo to hi."""
    x = vectors(spark, sf).where((F.col("j") >= lo) & (F.col("j") < hi))
    y = classes(spark, sf)
    means = x.join(y.select("i", F.col("j").alias("label")), "i").groupBy("label", "j").agg(F.avg("v").alias("w"))
    s = x.join(F.broadcast(means), "j").groupBy("i", "label").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return s.select("i", F.col("label").alias("j"), (F.round("v", 6) + 0.0).alias("v"))


SQL = {
    "yo": "yo AS (SELECT DISTINCT l_orderkey AS i, l_partkey AS j, CAST(1 AS DOUBLE) AS v FROM lineitem)",
    "lq": "lq AS (SELECT l_orderkey AS i, l_partkey AS j, CAST(l_quantity AS DOUBLE) AS v FROM lineitem)",
    "cb": "cb AS (SELECT p_partkey AS label, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part)",
    "xd": "xd AS (SELECT vec_id AS i, unnest(range(len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)",
    "yc": "yc AS (SELECT vec_id AS i, CAST(label AS BIGINT) AS j, CAST(1 AS DOUBLE) AS v FROM embeddings)",
    "xo": """xo AS (SELECT o_orderkey AS i, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS j, CAST(1 AS DOUBLE) AS v FROM orders
      UNION ALL SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 10 WHEN 'O' THEN 11 ELSE 12 END, 1 FROM orders
      UNION ALL SELECT o_orderkey, month(o_orderdate) + 20, 1 FROM orders)""",
    "yd": """yd AS (SELECT i, j, CAST(1 AS DOUBLE) AS v FROM (SELECT doc_id AS i, 'lang:' || lang AS j FROM documents
      UNION ALL SELECT doc_id, 'source:' || source FROM documents
      UNION ALL SELECT doc_id, 'len:' || CAST(least(4, n_chars // 2000) AS VARCHAR) FROM documents
      UNION ALL SELECT doc_id, 'quality:' || CAST(quality AS VARCHAR) FROM labels
      UNION ALL SELECT doc_id, 'toxic:' || CAST(toxic AS VARCHAR) FROM labels))""",
    "tf": r"tf AS (SELECT i, j, count(*) AS tf FROM (SELECT doc_id AS i, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS j FROM documents) WHERE j <> '' GROUP BY i, j)",
    "xt": """xw AS (SELECT tf.i, tf.j, tf.tf * ln((SELECT count(*) FROM documents)::DOUBLE / d.df) AS v FROM tf JOIN (SELECT j, count(*) AS df FROM tf GROUP BY j) d ON d.j = tf.j),
      xt AS (SELECT i, j, coalesce(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY i)), 0), v) AS v FROM xw)""",
    "zp": """zp AS (SELECT i, code AS j, s AS v FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, code) AS r FROM
      (SELECT o_orderkey AS i, code, ((o_orderkey * 31 + code * 17) % 101) / 101.0::DOUBLE AS s FROM orders, (SELECT DISTINCT code FROM cb))) WHERE r <= 3)""",
}


def class_sql(name: str, lo: int, hi: int) -> str:
    return f"""{name} AS (SELECT x.i, m.j, round(sum(x.v * m.w), 6) + 0.0 AS v FROM xd x JOIN
      (SELECT yc.j, xd.j AS f, avg(xd.v) AS w FROM xd JOIN yc ON yc.i = xd.i WHERE xd.j >= {lo} AND xd.j < {hi} GROUP BY yc.j, xd.j) m ON m.f = x.j GROUP BY x.i, m.j)"""


def with_(*names: str) -> str:
    return "WITH " + ", ".join(SQL.get(n, n) for n in names) + " "
