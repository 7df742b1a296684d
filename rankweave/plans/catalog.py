"""Registered queries: each operator over the driver's whole tables, with the SQL it must match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions import text as words
from ..operators import clustering, embedding, ranking, sparse, training
from . import fixtures as fx
from .fixtures import class_sql, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns or ("v",):
        df = df.withColumn(c, F.round(c, 6) + F.lit(0.0))
    return df


def unit_sql(key: str, seed: int) -> str:
    """The number in (0, 1) that the engine derives from a whole-number key."""
    k = f"(({key}) * 7919 + {seed * 104729 + 12345}) % 2147483647"
    for _ in range(2):
        k = f"(({k}) * 48271 + 11) % 2147483647"
    return f"(({k}) + 0.5) / 2147483647.0::DOUBLE"


LQ = "SELECT i, j, sum(v) AS v FROM lq GROUP BY i, j"


# --- columns, scaling -------------------------------------------------------------------
@query(with_("lq") + f"SELECT i, j, round(v / sqrt(sum(v * v) OVER (PARTITION BY i)), 6) + 0.0 AS v FROM ({LQ})")
def p1_row_l2(spark, sf):
    return r6(sparse.row_l2(sparse.from_entries(fx.quantities(spark, sf))))


@query(with_("lq") + f"SELECT i, j, round(v / sum(abs(v)) OVER (PARTITION BY i), 6) + 0.0 AS v FROM ({LQ})")
def p2_row_l1(spark, sf):
    return r6(sparse.row_l1(sparse.from_entries(fx.quantities(spark, sf))))


NORM = "SELECT i, j, coalesce(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY i)), 0), v) AS v FROM "


@query(with_("xd", "yc", f"a AS ({NORM} xd)", f"b AS ({NORM} yc)") + f"SELECT i, j, round(v, 6) + 0.0 AS v FROM ({NORM} (SELECT * FROM a UNION ALL SELECT i, j + 64, v FROM b))")
def p3_concat_columns(spark, sf):
    return r6(sparse.concat_columns(fx.vectors(spark, sf), fx.classes(spark, sf), 64))


@query(with_("xo") + "SELECT i, j, v FROM xo UNION ALL SELECT o_orderkey, 99, 0.5 FROM orders")
def p4_append_constant(spark, sf):
    rows = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"))
    return sparse.append_constant(fx.order_features(spark, sf), rows, 99, 0.5)


SIZES = "sz AS (SELECT code AS i, CAST(p_size AS BIGINT) AS j, CAST(count(*) AS DOUBLE) AS v FROM cb JOIN part ON p_partkey = label GROUP BY code, p_size)"


def brand_sizes(spark, sf):
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("label"), F.col("p_size").cast("long").alias("j"))
    return fx.brand_codes(spark, sf).join(p, "label").groupBy(F.col("code").alias("i"), "j").agg(F.count("*").cast("double").alias("v"))


@query(with_("cb", SIZES) + "SELECT a.i, b.j, coalesce(sz.v, 0.0) AS v FROM (SELECT DISTINCT i FROM sz) a CROSS JOIN (SELECT DISTINCT j FROM sz) b LEFT JOIN sz ON sz.i = a.i AND sz.j = b.j")
def p5_densify(spark, sf):
    m = brand_sizes(spark, sf)
    return sparse.densify(m, m.select("i").distinct(), m.select("j").distinct()).select("i", "j", "v")


@query(with_("xd") + "SELECT i, j, v FROM xd")
def p5_dense_cells(spark, sf):
    return fx.vectors(spark, sf)


@query(with_("yo") + "SELECT i, j, round(v * (i % 7 + 1) / (j % 5 + 1), 6) + 0.0 AS v FROM yo")
def p7_scale(spark, sf):
    y = fx.order_parts(spark, sf)
    rows = y.select("i").distinct().withColumn("s", (F.col("i") % 7 + 1).cast("double"))
    cols = y.select("j").distinct().withColumn("s", 1 / (F.col("j") % 5 + 1))
    return r6(sparse.scale(y, rows, cols)).select("i", "j", "v")


@query(with_("cb", SIZES) + "SELECT 24 - i AS i, (j * 7) % 53 AS j, v FROM sz")
def p8_permute(spark, sf):
    m = brand_sizes(spark, sf)
    rows = m.select(F.col("i").alias("old")).distinct().withColumn("new", 24 - F.col("old"))
    cols = m.select(F.col("j").alias("old")).distinct().withColumn("new", (F.col("old") * 7) % 53)
    return sparse.permute(m, rows, cols).select("i", "j", "v")


@query(with_("lq") + "SELECT i, j, round(v - (SELECT avg(v) FROM lq), 6) + 0.0 AS v FROM lq")
def p9_subtract_mean(spark, sf):
    return r6(sparse.subtract_mean(fx.quantities(spark, sf)))


@query(with_("yo") + "SELECT j AS i, i AS j, v FROM yo")
def p10_transpose(spark, sf):
    return sparse.transpose(fx.order_parts(spark, sf))


@query(with_("lq") + LQ)
def p11_sum_duplicates(spark, sf):
    return sparse.from_entries(fx.quantities(spark, sf))


@query(with_("lq") + "SELECT i, string_agg(j || ':' || CAST(CAST(v AS BIGINT) AS VARCHAR), ' ' ORDER BY j) AS packed FROM (" + LQ + ") GROUP BY i")
def p11_packed_rows(spark, sf):
    p = sparse.packed(sparse.from_entries(fx.quantities(spark, sf)))
    return p.select("i", F.concat_ws(" ", F.zip_with("idx", "val", lambda a, b: F.concat_ws(":", a.cast("string"), b.cast("long").cast("string")))).alias("packed"))


@query(with_("xd") + "SELECT i, j, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM xd")
def p12_cast(spark, sf):
    return sparse.cast(fx.vectors(spark, sf), "float").withColumn("v", F.col("v").cast("double"))


_CELLS = "(SELECT range AS id FROM range(3200))"


@query(f"SELECT id // 16 AS i, id % 16 AS j, round(u, 6) + 0.0 AS v FROM (SELECT id, {unit_sql('id', 1)} AS u FROM {_CELLS}) UNION ALL "
       f"SELECT id // 16, id % 16, round(sqrt(-2 * ln(u)) * cos(2 * pi() * w), 6) + 0.0 FROM (SELECT id, {unit_sql('id', 1)} AS u, {unit_sql('id', 2)} AS w FROM {_CELLS})")  # fmt: skip
def p13_random_matrix(spark, sf):
    return r6(sparse.random_matrix(spark, 200, 16, seed=1).unionByName(sparse.random_matrix(spark, 200, 16, seed=1, normal=True)))


@query(with_("xd") + "SELECT i * 64 + j AS idx, v FROM xd")
def p14_flatten(spark, sf):
    return sparse.flatten(fx.vectors(spark, sf), 64)


@query("SELECT r.range AS i, CAST(p_size AS BIGINT) AS j, CAST(count(*) AS DOUBLE) AS v FROM part, range(8) r GROUP BY ALL")
def p15_replicate(spark, sf):
    v = fx.table(spark, sf, "part").groupBy(F.col("p_size").cast("long").alias("j")).agg(F.count("*").cast("double").alias("v"))
    return sparse.replicate(v, 8)


@query("SELECT a.range AS i, b.range AS j, CASE WHEN a.range = b.range THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM range(25) a, range(25) b")
def p16_identity_dense(spark, sf):
    one = sparse.identity(spark, 25)
    return sparse.densify(one, one.select("i"), one.select("j")).select("i", "j", "v")


# --- filters ------------------------------------------------------------------------------
@query(with_("xd") + "SELECT i, j, v FROM xd WHERE abs(v) >= 0.1")
def f1_threshold(spark, sf):
    return sparse.threshold(fx.vectors(spark, sf), 0.1)


@query(with_("yo") + "SELECT i, j, v FROM yo WHERE i IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND j IN (SELECT p_partkey FROM part WHERE p_size <= 10)")
def f2_subset(spark, sf):
    rows = fx.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("i"))
    cols = fx.table(spark, sf, "part").where("p_size <= 10").select(F.col("p_partkey").alias("j"))
    return sparse.subset(fx.order_parts(spark, sf), rows, cols).select("i", "j", "v")


@query(with_("lq") + "SELECT i, j, sum(v - 25) AS v FROM lq GROUP BY i, j HAVING sum(v - 25) <> 0")
def f3_drop_zeros(spark, sf):
    return sparse.drop_zeros(fx.quantities(spark, sf).withColumn("v", F.col("v") - 25))


@query("SELECT doc_id, substr(text, 1, 4096) AS text FROM documents")
def f4_truncate(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", words.truncate("text").alias("text"))


@query(with_("cb") + "SELECT code, string_agg(CAST(label AS VARCHAR), ',' ORDER BY label) AS labels FROM cb GROUP BY code")
def f6_code_members(spark, sf):
    m = clustering.members(fx.brand_codes(spark, sf).withColumnRenamed("label", "i"))
    return m.select("code", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@query(with_("yo") + "SELECT i, count(*) AS n, max(count(*)) OVER () AS most FROM yo GROUP BY i")
def f7_row_counts(spark, sf):
    n = sparse.nnz(fx.order_parts(spark, sf))
    return n.crossJoin(F.broadcast(n.agg(F.max("n").alias("most"))))


@query(with_("xd") + "SELECT i, j, v FROM xd WHERE abs(v) >= 1e-12")
def f8_sparsify(spark, sf):
    return sparse.threshold(fx.vectors(spark, sf), 1e-12)


# --- products -----------------------------------------------------------------------------
@query(with_("yo", "ps AS (SELECT p_partkey AS i, CAST(p_size AS BIGINT) AS j, p_retailprice AS v FROM part)") + "SELECT yo.i, ps.j, round(sum(yo.v * ps.v), 6) + 0.0 AS v FROM yo JOIN ps ON ps.i = yo.j GROUP BY yo.i, ps.j")
def j1_sparse_product(spark, sf):
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("long").alias("j"), F.col("p_retailprice").alias("v"))
    return r6(sparse.matmul(fx.order_parts(spark, sf), p))


Z = "z AS (SELECT yo.i, cb.code AS j, sum(yo.v) AS v FROM yo JOIN cb ON cb.label = yo.j GROUP BY yo.i, cb.code)"


def order_codes(spark, sf):
    c = fx.brand_codes(spark, sf).select(F.col("label").alias("i"), F.col("code").alias("j"), F.lit(1.0).alias("v"))
    return sparse.matmul(fx.order_parts(spark, sf), c)


@query(with_("yo", "cb", Z) + "SELECT * FROM z")
def j2_instance_codes(spark, sf):
    return order_codes(spark, sf)


@query(with_("cb", "zp") + "SELECT zp.i, cb.label, round(sum(zp.v), 6) + 0.0 AS parent FROM zp JOIN cb ON cb.code = zp.j GROUP BY zp.i, cb.label")
def j3_expand_codes(spark, sf):
    codes = fx.matched_codes(spark, sf).select("i", F.col("j").alias("code"), "v")
    return ranking.expand_codes(codes, fx.brand_codes(spark, sf), lambda v: F.round(v, 6) + F.lit(0.0))


@query(with_("yo", "cb", Z, "zp") + """SELECT 0 AS scheme, i, j, round(sum(v), 6) + 0.0 AS v FROM (SELECT * FROM z UNION ALL SELECT * FROM zp) GROUP BY i, j
  UNION ALL SELECT 1, i, j, v FROM z UNION ALL SELECT 2, i, j, round(v, 6) + 0.0 FROM zp""")
def j4_negative_sampling(spark, sf):
    z, zp = order_codes(spark, sf), fx.matched_codes(spark, sf)
    out = None
    for s in range(3):
        part = ranking.negative_codes(z, zp, s).select(F.lit(s).alias("scheme"), "i", "j", "v")
        out = part if out is None else out.unionByName(part)
    return r6(out)


# the closed-form weights: each class's mean vector
WM = "wm AS (SELECT yc.j AS label, xd.j, avg(xd.v) AS w FROM xd JOIN yc ON yc.i = xd.i GROUP BY yc.j, xd.j)"


def mean_weights(spark, sf):
    y = fx.classes(spark, sf).select("i", F.col("j").alias("label"))
    return fx.vectors(spark, sf).join(y, "i").groupBy("label", "j").agg(F.avg("v").alias("w"))


PAIRS = "pr AS (SELECT vec_id AS i, CAST((label + k.range) % 12 AS BIGINT) AS label FROM embeddings, range(3) k)"


def class_pairs(spark, sf):
    k = spark.range(3).select(F.col("id").alias("k"))
    return fx.table(spark, sf, "embeddings").crossJoin(k).select(F.col("vec_id").alias("i"), ((F.col("label") + F.col("k")) % 12).cast("long").alias("label"))


@query(with_("xd", "yc", WM, PAIRS) + "SELECT pr.i, pr.label, round(coalesce(sum(xd.v * wm.w), 0), 6) + 0.0 AS v FROM pr LEFT JOIN xd ON xd.i = pr.i LEFT JOIN wm ON wm.label = pr.label AND wm.j = xd.j GROUP BY pr.i, pr.label")
def j5_masked_products(spark, sf):
    return r6(sparse.masked_dot(class_pairs(spark, sf), fx.vectors(spark, sf), mean_weights(spark, sf)))


@query(with_("cb", SIZES) + """SELECT i, j, round(sum(v), 6) + 0.0 AS v FROM (
  SELECT a.i, b.i AS j, 2 * sum(a.v * b.v) AS v FROM sz a JOIN sz b ON a.j = b.j GROUP BY a.i, b.i
  UNION ALL SELECT i, j, -0.5 * v FROM sz) GROUP BY i, j""")
def j7_gemm(spark, sf):
    m = brand_sizes(spark, sf)
    return r6(sparse.gemm(2.0, m, sparse.transpose(m), -0.5, m))


@query(with_("lq") + "SELECT i, round(sum(lq.v * p_retailprice), 4) + 0.0 AS v FROM lq JOIN part ON p_partkey = j GROUP BY i")
def j8_matrix_vector(spark, sf):
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("j"), F.col("p_retailprice").alias("x"))
    return sparse.matvec(fx.quantities(spark, sf), p).withColumn("v", F.round("v", 4) + 0.0)


@query(with_("xd", "yc", WM) + "SELECT xd.i, wm.label, round(sum(xd.v * wm.w), 6) + 0.0 AS v FROM xd JOIN wm ON wm.j = xd.j GROUP BY xd.i, wm.label")
def j9_score_all(spark, sf):
    x, w = fx.vectors(spark, sf), mean_weights(spark, sf)
    return r6(sparse.matmul(x, w.select(F.col("j").alias("i"), F.col("label").alias("j"), F.col("w").alias("v")))).select("i", F.col("j").alias("label"), "v")


@query(with_("xd", "yc", WM, PAIRS) + """SELECT i, label AS j, v, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, label) AS r FROM
  (SELECT pr.i, pr.label, round(coalesce(sum(xd.v * wm.w), 0), 6) + 0.0 AS v FROM pr LEFT JOIN xd ON xd.i = pr.i LEFT JOIN wm ON wm.label = pr.label AND wm.j = xd.j GROUP BY pr.i, pr.label)) WHERE r <= 2""")
def j10_label_candidates(spark, sf):
    c = class_pairs(spark, sf).withColumn("parent", F.lit(1.0))
    return r6(ranking.score_labels(fx.vectors(spark, sf), mean_weights(spark, sf), c, None, "noop", 2))


@query(with_("xd") + "SELECT a.j AS i, b.j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM xd a JOIN xd b ON a.i = b.i GROUP BY a.j, b.j")
def j12_gram(spark, sf):
    return r6(sparse.gram(fx.vectors(spark, sf)))


# --- aggregates ---------------------------------------------------------------------------
EV = "ev AS (SELECT user_id AS i, event_type AS j, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY ALL)"


@query(with_(EV, "cd AS (SELECT i, CAST(i % 8 AS BIGINT) AS code FROM (SELECT DISTINCT i FROM ev))", "c AS (SELECT cd.code AS i, ev.j, sum(ev.v) AS v FROM ev JOIN cd ON cd.i = ev.i GROUP BY ALL)") + "SELECT i, j, round(v / sum(v) OVER (PARTITION BY i), 6) + 0.0 AS v FROM c")
def a2_count_model(spark, sf):
    y = fx.table(spark, sf, "events").groupBy(F.col("user_id").alias("i"), F.col("event_type").alias("j")).agg(F.count("*").cast("double").alias("v"))
    z = y.select("i").distinct().select("i", (F.col("i") % 8).cast("long").alias("j"), F.lit(1.0).alias("v"))
    return r6(ranking.count_model(z, y))


@query(with_("yo", "cb", Z, "k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) AS r FROM z) WHERE r <= 2)") + "SELECT i, j, round(v / sum(v) OVER (PARTITION BY i), 6) + 0.0 AS v FROM k")
def a3_optimal_codes(spark, sf):
    return r6(ranking.optimal_codes(order_codes(spark, sf), 2))


@query(with_("xd") + "SELECT j, min(v) AS lo, max(v) AS hi FROM xd GROUP BY j")
def a5_column_range(spark, sf):
    return sparse.column_range(fx.vectors(spark, sf))


@query(with_("tf") + "SELECT min(n) AS lo, max(n) AS hi, round(avg(n), 6) + 0.0 AS mean, CAST(median(n) AS DOUBLE) AS median FROM (SELECT d.doc_id, CAST(coalesce(sum(tf), 0) AS BIGINT) AS n FROM documents d LEFT JOIN tf ON tf.i = d.doc_id GROUP BY d.doc_id)")
def a6_length_stats(spark, sf):
    n = fx.table(spark, sf, "documents").select(F.size(words.words("text")).cast("long").alias("n"))
    return r6(n.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.avg("n").alias("mean"), F.median("n").alias("median")), "mean")


@query(with_("cb", SIZES) + "SELECT round(sum(a.v * b.v * c.v * d.v), 2) + 0.0 AS v FROM sz a JOIN sz b ON a.i = b.i JOIN sz c ON c.j = b.j JOIN sz d ON d.i = c.i AND d.j = a.j")
def a7_trace(spark, sf):
    m = brand_sizes(spark, sf)
    return sparse.trace_product(m, sparse.matmul(m, sparse.transpose(m)), m).select((F.round("v", 2) + 0.0).alias("v"))


@query(with_("lq", "yo") + f"SELECT sum(a.v * yo.v) AS v FROM ({LQ}) a JOIN yo ON yo.i = a.i AND yo.j = a.j")
def a8_inner_product(spark, sf):
    return sparse.inner(sparse.from_entries(fx.quantities(spark, sf)), fx.order_parts(spark, sf))


# --- top-k, ensembles, metrics ------------------------------------------------------------
@query(with_("lq") + f"SELECT i, j, v, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) AS r FROM ({LQ})) WHERE r <= 3")
def o1_top_k_rows(spark, sf):
    return ranking.top_k(sparse.from_entries(fx.quantities(spark, sf)), 3)


@query(with_("lq") + f"SELECT i, j, v, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY v DESC, i) AS r FROM ({LQ})) WHERE r <= 3")
def o2_top_k_columns(spark, sf):
    return ranking.top_k(sparse.from_entries(fx.quantities(spark, sf)), 3, by="j", tie="i")


ABC = ("xd", "yc", class_sql("pa", 0, 64), class_sql("pb", 0, 32), class_sql("pc", 32, 64))
REL = "SELECT i, j, CAST((SELECT max(n) FROM (SELECT count(*) AS n FROM pa GROUP BY i)) - row_number() OVER (PARTITION BY i ORDER BY v DESC, j) + 1 AS DOUBLE) AS v FROM "


def abc(spark, sf):
    return [fx.class_predictions(spark, sf, *r) for r in ((0, 64), (0, 32), (32, 64))]


@query(with_(*ABC) + REL + "pa")
def o3_relevance(spark, sf):
    return ranking.relevance(abc(spark, sf)[:1])[0]


@query(with_(*ABC, "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) AS k FROM pa) WHERE k <= 5)") + """SELECT yc.i, CAST(k.range AS INTEGER) AS k,
  sum(CASE WHEN t.j = yc.j THEN 1 ELSE 0 END) OVER (PARTITION BY yc.i ORDER BY k.range)::BIGINT AS hits, CAST(1 AS BIGINT) AS n_truth FROM yc CROSS JOIN range(1, 6) k LEFT JOIN t ON t.i = yc.i AND t.k = k.range""")
def o4_running_hits(spark, sf):
    return ranking.hit_counts(fx.classes(spark, sf), abc(spark, sf)[0], 5)


@query(f"SELECT p_partkey AS old, row_number() OVER (ORDER BY {unit_sql('p_partkey', 1)}, p_partkey) - 1 AS new FROM part")
def o9_permutation(spark, sf):
    return sparse.permutation(fx.table(spark, sf, "part").select(F.col("p_partkey").alias("old")), seed=1)


ALL3 = "(SELECT * FROM pa UNION ALL SELECT * FROM pb UNION ALL SELECT * FROM pc)"


@query(with_(*ABC) + f"SELECT i, j, round(sum(v) / 3, 6) + 0.0 AS v FROM {ALL3} GROUP BY i, j")
def e1_average(spark, sf):
    return r6(ranking.average(abc(spark, sf)))


RELS = ("ra AS (" + REL + "pa)", "rb AS (" + REL + "pb)", "rc AS (" + REL + "pc)")


@query(with_(*ABC, *RELS) + "SELECT i, j, round(sum(v) / 3, 6) + 0.0 AS v FROM (SELECT * FROM ra UNION ALL SELECT * FROM rb UNION ALL SELECT * FROM rc) GROUP BY i, j")
def e2_rank_average(spark, sf):
    return r6(ranking.rank_average(abc(spark, sf)))


@query(with_(*ABC, *RELS) + "SELECT i, j, round(max(v) / 3, 6) + 0.0 AS v FROM (SELECT i, j, v + 3 / 4.0 AS v FROM ra UNION ALL SELECT i, j, v + 2 / 4.0 FROM rb UNION ALL SELECT i, j, v + 1 / 4.0 FROM rc) GROUP BY i, j")
def e3_round_robin(spark, sf):
    return r6(ranking.round_robin(abc(spark, sf)))


def pr_sql(run: str, source: str) -> str:
    """Precision and recall at 1 to 5; each vector has one true class."""
    return f"""SELECT '{run}' AS run, CAST(k.range AS INTEGER) AS k, round(count(h.i) / ((SELECT count(*) FROM yc) * k.range)::DOUBLE, 6) + 0.0 AS precision,
      round(count(h.i) / (SELECT count(*) FROM yc)::DOUBLE, 6) + 0.0 AS recall FROM range(1, 6) k
      LEFT JOIN (SELECT t.i, t.r FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) AS r FROM {source}) t JOIN yc ON yc.i = t.i AND yc.j = t.j) h ON h.r <= k.range GROUP BY k.range"""


AVG3 = f"av AS (SELECT i, j, round(sum(v) / 3, 6) + 0.0 AS v FROM {ALL3} GROUP BY i, j)"


@query(with_(*ABC, AVG3) + " UNION ALL ".join(pr_sql(n, s) for n, s in (("a", "pa"), ("b", "pb"), ("c", "pc"), ("average", "av"))))
def e5_report(spark, sf):
    truth, preds = fx.classes(spark, sf), abc(spark, sf)
    out = None
    for name, p in zip(("a", "b", "c", "average"), [*preds, r6(ranking.average(preds))], strict=True):
        part = ranking.precision_recall(truth, p, 5).select(F.lit(name).alias("run"), "k", "precision", "recall")
        out = part if out is None else out.unionByName(part)
    return r6(out, "precision", "recall")


@query(with_("yo", "cb", Z, "zp") + "SELECT i, j, round(CASE WHEN count(*) < 2 THEN greatest(max(v), 0) ELSE max(v) END, 6) + 0.0 AS v FROM (SELECT * FROM z UNION ALL SELECT * FROM zp) GROUP BY i, j")
def e6_union_max(spark, sf):
    return r6(sparse.union_max([order_codes(spark, sf), fx.matched_codes(spark, sf)]))


@query(with_(*ABC) + pr_sql("a", "pa"))
def m1_precision_recall(spark, sf):
    return r6(ranking.precision_recall(fx.classes(spark, sf), abc(spark, sf)[0], 5), "precision", "recall").select(F.lit("a").alias("run"), "k", "precision", "recall")


@query(with_(*ABC) + "SELECT k, printf('%.2f', 100 * precision) AS precision, printf('%.2f', 100 * recall) AS recall FROM (" + pr_sql("a", "pa") + ")")
def m2_formatted(spark, sf):
    m = ranking.precision_recall(fx.classes(spark, sf), abc(spark, sf)[0], 5)
    return ranking.formatted(r6(m, "precision", "recall"))


# --- scores -------------------------------------------------------------------------------
def _post_sql() -> str:
    val = {"noop": "v", "sigmoid": "1 / (1 + exp(-v))", "log-sigmoid": "ln(1 / (1 + exp(-v)))"}
    joint = {"noop": "f", "sigmoid": "f * p", "log-sigmoid": "f + p"}
    for n in range(1, 7):
        h = f"-pow(greatest(1 - v, 0), {n})"
        val |= {f"l{n}-hinge": f"exp({h})", f"log-l{n}-hinge": h, f"l{n}-hinge-noisyor": f"exp({h})"}
        joint |= {f"l{n}-hinge": "f * p", f"log-l{n}-hinge": "f + p", f"l{n}-hinge-noisyor": "1 - (1 - f) * (1 - p)"}
    return " UNION ALL ".join(f"SELECT '{n}' AS post, event_id, round({joint[n]}, 6) + 0.0 AS v FROM (SELECT event_id, p, {val[n]} AS f FROM e)" for n in val)


EVT = "e AS (SELECT event_id, value / 100.0 - 0.5 AS v, (event_id % 10) / 10.0::DOUBLE AS p FROM events)"


@query(with_(EVT) + _post_sql())
def x8_post_processors(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", (F.col("value") / 100.0 - 0.5).alias("v"), ((F.col("event_id") % 10) / 10.0).alias("p"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("post"), scoring.combine(n)(scoring.transform(n)(F.col("v")), F.col("p")).alias("v")) for n in scoring.POST]))
    return r6(e.select("event_id", each.alias("x")).select("x.post", "event_id", "x.v"))


@query(with_(EVT) + "SELECT event_id, round(v, 6) + 0.0 AS noop, round(v + p, 6) + 0.0 AS add, round(v * p, 6) + 0.0 AS mul, round(greatest(v, p), 6) + 0.0 AS max, round(1 - (1 - v) * (1 - p), 6) + 0.0 AS noisyor FROM e")
def x7_combiners(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", (F.col("value") / 100.0 - 0.5).alias("v"), ((F.col("event_id") % 10) / 10.0).alias("p"))
    out = e.select("event_id", *[f(F.col("v"), F.col("p")).alias(n) for n, f in scoring.COMBINERS.items()])
    return r6(out, *scoring.COMBINERS)


@query(with_(EVT) + "SELECT event_id, round(1 / (1 + exp(-v)), 6) + 0.0 AS sigmoid, round(exp(-pow(greatest(1 - v, 0), 2)), 6) + 0.0 AS l2, round(exp(-pow(greatest(1 - v, 0), 3)), 6) + 0.0 AS l3 FROM e")
def x9_matcher_transforms(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", (F.col("value") / 100.0 - 0.5).alias("v"))
    names = {"sigmoid": "sigmoid", "l2": "lpsvm-l2", "l3": "lpsvm-l3"}
    return r6(e.select("event_id", *[scoring.MATCHER[m](F.col("v")).alias(n) for n, m in names.items()]), *names)


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) + 0.0 AS v FROM embeddings")
def x10_array_dot(spark, sf):
    e = fx.table(spark, sf, "embeddings").withColumn("back", F.reverse("embedding"))
    return r6(e.select("vec_id", sparse.array_dot("embedding", "back").alias("v")))


@query("SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda k: 2.5 * embedding[k]::DOUBLE + embedding[len(embedding) + 1 - k]::DOUBLE)), 6) + 0.0 AS v FROM embeddings")
def x11_axpy(spark, sf):
    e = fx.table(spark, sf, "embeddings").withColumn("back", F.reverse("embedding")).withColumn("y", sparse.axpy(2.5, "embedding", "back"))
    return r6(e.select("vec_id", F.aggregate("y", F.lit(0.0), lambda s, x: s + x).alias("v")))


@query(with_(*ABC) + "SELECT round(avg(pow(greatest(1 - (2 * y - 1) * v, 0), 2) * (2 * y + 0.5 * (1 - y))), 6) + 0.0 AS loss FROM (SELECT pa.v, CASE WHEN yc.j IS NULL THEN 0 ELSE 1 END AS y FROM pa LEFT JOIN yc ON yc.i = pa.i AND yc.j = pa.j)")
def x12_hinge_loss(spark, sf):
    y = fx.classes(spark, sf).select("i", "j", F.lit(1).alias("y"))
    p = abc(spark, sf)[0].join(y, ["i", "j"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    return r6(p.agg(F.avg(scoring.hinge_loss(F.col("v"), F.col("y"), 1.0, True, 2.0, 0.5)).alias("loss")), "loss")


@query("SELECT doc_id, regexp_replace(trim(text, ' '), '[\\r\\n]+', ' ', 'g') AS text FROM documents")
def x15_clean_text(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", words.clean("text").alias("text"))


# --- text ---------------------------------------------------------------------------------
VOC = "voc AS (SELECT j AS token, CAST(row_number() OVER (ORDER BY sum(tf) DESC, j) + 3 AS INTEGER) AS id FROM tf GROUP BY j QUALIFY row_number() OVER (ORDER BY sum(tf) DESC, j) <= 5000)"
ENC = (
    VOC,
    r"tk AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda x: x <> '')[1:62] AS w FROM documents)",
    "ids AS (SELECT doc_id, coalesce(list(coalesce(voc.id, 1) ORDER BY p) FILTER (WHERE t IS NOT NULL), []) AS ids FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS t, unnest(range(greatest(len(w), 1))) AS p FROM tk) LEFT JOIN voc ON voc.token = t GROUP BY doc_id)",
)


@query(with_("tf", *ENC) + "SELECT doc_id AS i, array_to_string(list_concat([2], ids, [3], list_transform(range(62 - len(ids)), lambda x: 0)), ' ') AS input_ids, CAST(len(ids) + 2 AS INTEGER) AS n FROM ids")
def n1_encode(spark, sf):
    d = fx.table(spark, sf, "documents")
    e = words.encode(d, words.vocabulary(d, "doc_id", "text", 5000), "doc_id", "text", 64)
    return e.select("i", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"), F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).alias("n"))


@query(with_("tf", "xt") + "SELECT i, j, round(v, 6) + 0.0 AS v FROM xt")
def n2_tfidf(spark, sf):
    return r6(fx.tfidf(spark, sf))


# --- label embedding ----------------------------------------------------------------------
PIFA = f"yn AS ({NORM} yd), pf AS (SELECT yn.j AS i, xt.j, sum(yn.v * xt.v) AS v FROM yn JOIN xt ON xt.i = yn.i GROUP BY yn.j, xt.j)"


@query(with_("tf", "xt", "yd", PIFA) + f"SELECT i, j, round(v, 6) + 0.0 AS v FROM ({NORM} pf)")
def l1_pifa(spark, sf):
    return r6(embedding.pifa(fx.document_labels(spark, sf), fx.tfidf(spark, sf)))


@query(with_("tf", "xt", "yd", PIFA) + "SELECT i, j, round(v, 6) + 0.0 AS v FROM pf")
def l2_pifa_raw(spark, sf):
    return r6(embedding.create(fx.document_labels(spark, sf), fx.tfidf(spark, sf), "pifa"))


@query(with_("yd") + "SELECT j AS i, i AS j, v FROM yd")
def l3_homer(spark, sf):
    return embedding.create(fx.document_labels(spark, sf), None, "homer")


@query(with_("xd", "yc", f"mn AS (SELECT yc.j AS i, xd.j, avg(xd.v) AS v FROM xd JOIN yc ON yc.i = xd.i GROUP BY yc.j, xd.j)") + f"SELECT i, j, round(v, 6) + 0.0 AS v FROM ({NORM} mn)")
def l4_pooled(spark, sf):
    p = embedding.pooled(fx.table(spark, sf, "embeddings"), "label", "embedding")
    return r6(p.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v"))


@query(with_("yd") + "SELECT j AS i, i AS j, round(v / sqrt(sum(v) OVER (PARTITION BY j)) / sqrt(sum(v) OVER (PARTITION BY i)), 6) + 0.0 AS v FROM yd")
def l5_bi_normalised(spark, sf):
    return r6(embedding.bi_normalised(fx.document_labels(spark, sf)))


# --- clustering ---------------------------------------------------------------------------
def kd_sql(source: str, features: list[int]) -> str:
    """Median splits, one CTE a level."""
    out = [f"n0 AS (SELECT DISTINCT i, CAST(1 AS BIGINT) AS node FROM {source})"]
    for d, f in enumerate(features):
        out.append(f"s{d} AS (SELECT n.i, n.node, coalesce(x.v, 0) AS s FROM n{d} n LEFT JOIN {source} x ON x.i = n.i AND x.j = {f})")
        out.append(f"n{d + 1} AS (SELECT i, node * 2 + CASE WHEN c > 1 AND r > c // 2 THEN 1 ELSE 0 END AS node FROM (SELECT i, node, row_number() OVER (PARTITION BY node ORDER BY s, i) AS r, count(*) OVER (PARTITION BY node) AS c FROM s{d}))")
    return ", ".join(out)


@query(with_("xd", kd_sql("xd", [0, 1, 2, 3])) + "SELECT i, node - 16 AS code FROM n4")
def i3_kd_tree(spark, sf):
    return clustering.generate(fx.vectors(spark, sf), 2, 4, clustering.KD, dims=64)


@query(with_("xd", kd_sql("xd", [0, 0, 1, 1])) + "SELECT i, node - 16 AS code FROM n4")
def i4_kd_tree_cyclic(spark, sf):
    return clustering.generate(fx.vectors(spark, sf), 2, 4, clustering.KD_CYCLIC, dims=2)


def proj_sql(dims: int) -> str:
    return f"pj AS (SELECT x.i, d.range AS j, round(sum(x.v * (((x.j * 7919 + d.range * 104729) * 48271 % 2147483647) % 101 - 50)), 9) AS v FROM xi x, range({dims}) d GROUP BY x.i, d.range)"


# values on a grid of 1/1024, so that sums are exact in any order
XI = "xi AS (SELECT i, j, round(v * 1024) / 1024 AS v FROM xd)"


def gridded(spark, sf):
    return fx.vectors(spark, sf).withColumn("v", F.round(F.col("v") * 1024) / 1024)


@query(with_("xd", XI, proj_sql(3)) + "SELECT i, CAST(sum(floor((r - 1) / ceil(c / 4.0)) * pow(4, j)) AS BIGINT) AS code FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY v, i) AS r, count(*) OVER (PARTITION BY j) AS c FROM pj) GROUP BY i")
def i6_ordinal_codes(spark, sf):
    return clustering.generate(gridded(spark, sf), 4, 3, clustering.RANDOM_ORDINAL)


@query(with_("xd", XI, proj_sql(3)) + "SELECT i, CAST(sum(CASE WHEN v >= hi THEN 3 ELSE floor((v - lo) / ((hi - lo) / 3)) END * pow(4, j)) AS BIGINT) AS code FROM (SELECT *, min(v) OVER (PARTITION BY j) AS lo, max(v) OVER (PARTITION BY j) AS hi FROM pj) GROUP BY i")
def i7_uniform_codes(spark, sf):
    return clustering.generate(gridded(spark, sf), 4, 3, clustering.RANDOM_UNIFORM)


@query(with_("xd", XI, proj_sql(3), kd_sql("pj", [0, 1, 2])) + "SELECT i, node - 8 AS code FROM n3")
def i8_balanced_ordinal(spark, sf):
    return clustering.generate(gridded(spark, sf), 2, 3, clustering.ORDINAL)


def two_means_sql(depth: int, rounds: int, spherical: bool) -> str:
    """The level and round loop, unrolled: a CTE for each step."""
    x = f"x AS MATERIALIZED ({NORM} xd)" if spherical else "x AS MATERIALIZED (SELECT * FROM xd)"
    out = [x, "n0 AS MATERIALIZED (SELECT DISTINCT i, CAST(1 AS BIGINT) AS node FROM x)"]
    for d in range(depth):
        out.append(f"""c{d}_0 AS MATERIALIZED (SELECT e.node, x.j, sum(CASE WHEN x.i = e.hi THEN x.v ELSE -x.v END) AS d
          FROM (SELECT node, min(i) AS lo, max(i) AS hi FROM n{d} GROUP BY node) e JOIN x ON x.i = e.lo OR x.i = e.hi WHERE e.lo < e.hi GROUP BY e.node, x.j)""")
        for t in range(rounds):
            out.append(f"""h{d}_{t} AS MATERIALIZED (SELECT i, node * 2 + CASE WHEN c > 1 AND r > c // 2 THEN 1 ELSE 0 END AS node FROM (
              SELECT i, node, row_number() OVER (PARTITION BY node ORDER BY s, i) AS r, count(*) OVER (PARTITION BY node) AS c FROM (
                SELECT n.i, n.node, round(coalesce(sum(x.v * c.d), 0), 9) AS s FROM n{d} n JOIN x ON x.i = n.i LEFT JOIN c{d}_{t} c ON c.node = n.node AND c.j = x.j GROUP BY n.i, n.node)))""")
            mean = f"SELECT h.node, x.j, sum(x.v) AS v, count(*) AS n FROM h{d}_{t} h JOIN x ON x.i = h.i GROUP BY h.node, x.j"
            unit = f"SELECT node, j, v / nullif(sqrt(sum(v * v) OVER (PARTITION BY node)), 0) AS v FROM ({mean})" if spherical else f"SELECT node, j, v / n AS v FROM ({mean})"
            out.append(f"c{d}_{t + 1} AS MATERIALIZED (SELECT node // 2 AS node, j, sum(CASE WHEN node % 2 = 1 THEN v ELSE -v END) AS d FROM ({unit}) GROUP BY node // 2, j)")
        out.append(f"n{d + 1} AS MATERIALIZED (SELECT * FROM h{d}_{rounds - 1})")
    return ", ".join(out)


@query(with_("xd", two_means_sql(2, 3, False)) + "SELECT i, node - 4 AS code FROM n2")
def i1_balanced_two_means(spark, sf):
    return clustering.generate(fx.vectors(spark, sf), 2, 2, clustering.KMEANS, max_iter=3)


@query(with_("xd", two_means_sql(2, 3, True)) + "SELECT i, node - 4 AS code FROM n2")
def i2_spherical_two_means(spark, sf):
    return clustering.generate(fx.vectors(spark, sf), 2, 2, clustering.SKMEANS, max_iter=3)


@query(f"SELECT vec_id AS i, CAST(floor(({unit_sql('vec_id', 3)}) * 16) AS BIGINT) AS code FROM embeddings")
def i9_random_codes(spark, sf):
    return clustering.generate(fx.vectors(spark, sf), 2, 4, clustering.RANDOM, seed=3)


@query(with_("cb") + "SELECT label AS i, code AS j, CAST(1 AS DOUBLE) AS v FROM cb")
def i13_one_hot(spark, sf):
    return clustering.one_hot(fx.brand_codes(spark, sf).withColumnRenamed("label", "i"))


# --- training -----------------------------------------------------------------------------
@query(with_("yo", "cb", Z) + "SELECT z.j AS code, cb.label, z.i, CASE WHEN yo.v IS NULL THEN -1 ELSE 1 END AS sign FROM z JOIN cb ON cb.code = z.j LEFT JOIN yo ON yo.i = z.i AND yo.j = cb.label")
def t2_training_jobs(spark, sf):
    return training.jobs(fx.order_parts(spark, sf), order_codes(spark, sf), fx.brand_codes(spark, sf))


CHAIN = "SELECT 0 AS level, label, code FROM cb" + "".join(f" UNION ALL SELECT DISTINCT {d}, code // {2 ** (d - 1)}, code // {2**d} FROM cb" for d in range(1, 5))


@query(with_("cb") + CHAIN)
def t8_code_chain(spark, sf):
    out = None
    for d, c in enumerate(training.chain_codes(fx.brand_codes(spark, sf))):
        part = c.select(F.lit(d).alias("level"), "label", "code")
        out = part if out is None else out.unionByName(part)
    return out


def _one_layer(spark, sf, solver: int, max_iter: int):
    x, y = fx.vectors(spark, sf), fx.classes(spark, sf)
    codes = y.select(F.col("j").alias("label")).distinct().withColumn("code", F.lit(0).cast("long"))
    return training.train_layer(x, y, codes, None, 64, training.Options(solver=solver, max_iter=max_iter, threshold=0.01), rows=training.cut(fx.packed_vectors(spark, sf)))


@query()
def t3_dual_svc(spark, sf):
    return _one_layer(spark, sf, training.L2_SVC_L1, 20)


@query()
def t3_dual_svc_squared(spark, sf):
    return _one_layer(spark, sf, training.L2_SVC_L2, 20)


@query()
def t4_logistic(spark, sf):
    return _one_layer(spark, sf, training.L2_LOGISTIC, 20)


@query()
def t5_l1_svc(spark, sf):
    return _one_layer(spark, sf, training.L1_SVC_L2, 10)


@query(with_("yc") + "SELECT DISTINCT j AS label, true AS optimal FROM yc")
def t3_optimality(spark, sf):
    """Whether each label's weights are the optimum: the gradient of the squared-hinge objective there, against that at 0."""
    x, y = fx.vectors(spark, sf), fx.classes(spark, sf)
    codes = y.select(F.col("j").alias("label")).distinct().withColumn("code", F.lit(0).cast("long"))
    z = y.select("i", F.lit(0).cast("long").alias("j"), "v")
    full = sparse.append_constant(x, x.select("i").distinct(), 64)
    w = training.train_layer(x, y, codes, z, 64, training.Options(solver=training.L2_SVC_L2, max_iter=400, eps=1e-4, threshold=0.0))
    return training.optimality(training.jobs(y, z, codes).select("i", "label", "sign"), full, w).select("label", (F.col("ratio") < 1e-3).alias("optimal"))


TRAIN, TEST = "i % 5 <> 0", "i % 5 = 0"


def _chain(spark, sf, side_by_side: int = 1):
    """Trained on four fifths of the vectors; the features of the rest come along."""
    x, y = fx.vectors(spark, sf), fx.classes(spark, sf)
    codes = y.select(F.col("j").alias("label")).distinct().withColumn("code", F.floor(F.col("label") / 2))
    test, o = x.where(TEST), training.Options(max_iter=20, threshold=0.01)
    rows = fx.packed_vectors(spark, sf, f"{TRAIN} and size(embedding) > 0")  # as in x, where an empty vector has no entry
    return sparse.append_constant(test, test.select("i").distinct(), 64), training.train_hierarchical(x.where(TRAIN), y.where(TRAIN), codes, 64, o, rows=rows, side_by_side=side_by_side)


@query()
def t8_hierarchical(spark, sf):
    _, chain = _chain(spark, sf, side_by_side=2)
    out = None
    for d, (w, _) in enumerate(chain):
        part = w.withColumn("level", F.lit(d))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def h7_trained_ranking(spark, sf):
    """Train a chain, predict held-out rows by beam search, report precision and recall."""
    x, chain = _chain(spark, sf)
    found = ranking.beam_search(x, chain, "l3-hinge", 10, 5)
    return ranking.precision_recall(fx.classes(spark, sf).where(TEST), found, 5)


# --- prediction ---------------------------------------------------------------------------
HINGE = "exp(-pow(greatest(1 - s, 0), 3))"
H1 = (WM, f"h1 AS (SELECT xd.i, wm.label AS j, sum(xd.v * wm.w) AS s FROM xd JOIN wm ON wm.j = xd.j GROUP BY xd.i, wm.label), t1 AS (SELECT i, j, round({HINGE}, 6) + 0.0 AS v FROM h1)")


@query(with_("xd", "yc", *H1) + "SELECT i, j, v, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) AS r FROM t1) WHERE r <= 3")
def h1_predict_flat(spark, sf):
    w = mean_weights(spark, sf)
    return r6(ranking.score_labels(fx.vectors(spark, sf), w, None, w.select("label").distinct(), "l3-hinge", 3))


# two layers: classes 0-9 in parents label // 2; a parent's weights are the mean of its vectors
WP = "wp AS (SELECT yc.j // 2 AS label, xd.j, avg(xd.v) AS w FROM xd JOIN yc ON yc.i = xd.i GROUP BY yc.j // 2, xd.j)"
BEAM = (
    WM, WP, f"b1 AS (SELECT i, label, round({HINGE}, 6) + 0.0 AS v FROM (SELECT xd.i, wp.label, sum(xd.v * wp.w) AS s FROM xd JOIN wp ON wp.j = xd.j GROUP BY xd.i, wp.label))",
    "k1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, label) AS r FROM b1) WHERE r <= 2)",
    f"b2 AS (SELECT i, label AS j, round({HINGE} * p, 6) + 0.0 AS v FROM (SELECT k1.i, wm.label, k1.v AS p, sum(xd.v * wm.w) AS s FROM k1 JOIN wm ON wm.label // 2 = k1.label JOIN xd ON xd.i = k1.i AND xd.j = wm.j GROUP BY k1.i, wm.label, k1.v))",
)


@query(with_("xd", "yc", *BEAM) + "SELECT i, j, v, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) AS r FROM b2) WHERE r <= 3")
def h3_beam_search(spark, sf):
    w, x = mean_weights(spark, sf), fx.vectors(spark, sf)
    y = fx.classes(spark, sf).select("i", F.floor(F.col("j") / 2).alias("label"))
    up = x.join(y, "i").groupBy("label", "j").agg(F.avg("v").alias("w"))
    codes = w.select("label").distinct().withColumn("code", F.floor(F.col("label") / 2))
    return r6(ranking.beam_search(x, [(up, None), (w, codes)], "l3-hinge", 2, 3))


CM = (EV, "cm AS (SELECT i % 8 AS code, j, sum(v) AS v FROM ev GROUP BY ALL)", "pm AS (SELECT code, j, v / sum(v) OVER (PARTITION BY code) AS v FROM cm)")


@query(with_(*CM) + "SELECT i, j, v, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) AS r FROM (SELECT u.i, pm.j, round(pm.v, 6) + 0.0 AS v FROM (SELECT DISTINCT i FROM ev) u JOIN pm ON pm.code = u.i % 8)) WHERE r <= 2")
def h5_count_predict(spark, sf):
    y = fx.table(spark, sf, "events").groupBy(F.col("user_id").alias("i"), F.col("event_type").alias("j")).agg(F.count("*").cast("double").alias("v"))
    z = y.select("i").distinct().select("i", (F.col("i") % 8).cast("long").alias("j"), F.lit(1.0).alias("v"))
    return ranking.count_predict(ranking.count_model(z, y), z, 2)


@query("SELECT doc_id AS i, CAST(unnest([1, 2, 3]) AS BIGINT) AS slot, CAST(unnest([doc_id % 7, (doc_id * 3) % 11, (doc_id * 5) % 13]) AS BIGINT) AS label, CAST(1 AS DOUBLE) AS v FROM documents")
def h10_repack(spark, sf):
    """A row's label slots as entries of value 1."""
    ids = F.array(F.col("doc_id") % 7, (F.col("doc_id") * 3) % 11, (F.col("doc_id") * 5) % 13)
    return ranking.repacked(fx.table(spark, sf, "documents").select("doc_id", ids.alias("ids")), "doc_id", "ids")


@query()
def l5_spectral(spark, sf):
    return embedding.create(fx.document_labels(spark, sf).withColumn("j", F.pmod(F.xxhash64("j"), F.lit(1 << 31))), None, "spectral")


# --- flagship -----------------------------------------------------------------------------
FLAG = (
    "yt AS (SELECT * FROM yd WHERE i % 5 <> 0)", f"yn AS ({NORM} yt)",
    "le AS (SELECT yn.j AS label, xt.j, sum(yn.v * xt.v) AS v FROM yn JOIN xt ON xt.i = yn.i GROUP BY yn.j, xt.j)",
    "ln AS (SELECT label, j, v / nullif(sqrt(sum(v * v) OVER (PARTITION BY label)), 0) AS v FROM le)",
    "te AS (SELECT * FROM xt WHERE i % 5 = 0)", "fr AS (SELECT * FROM (SELECT DISTINCT i FROM te), (SELECT DISTINCT label FROM ln))",
    "sc AS (SELECT fr.i, fr.label AS j, round(coalesce(s.v, 0), 6) + 0.0 AS v FROM fr LEFT JOIN (SELECT te.i, ln.label, sum(te.v * ln.v) AS v FROM te JOIN ln ON ln.j = te.j GROUP BY te.i, ln.label) s ON s.i = fr.i AND s.label = fr.label)",
)


@query(with_("tf", "xt", "yd", *FLAG) + "SELECT i, j, v, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) AS r FROM sc) WHERE r <= 10")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Top-10 labels of held-out documents by similarity to PIFA label embeddings."""
    x, y = fx.tfidf(spark, sf), fx.document_labels(spark, sf)
    labels = embedding.pifa(y.where("i % 5 <> 0"), x).select(F.col("i").alias("label"), "j", F.col("v").alias("w"))
    return r6(ranking.score_labels(x.where("i % 5 = 0"), labels, None, labels.select("label").distinct(), "noop", 10))
