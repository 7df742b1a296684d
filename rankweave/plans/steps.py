"""Registered queries of single steps that the catalog's queries hold inside larger plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions import text as words
from ..operators import clustering, dense, ranking, sparse, training
from ..sources import matrices
from . import fixtures as fx
from . import model
from .catalog import ABC, EVT, H1, HINGE, NORM, RELS, SIZES, WM, XI, Z, TEST, TRAIN, abc, brand_sizes, gridded, mean_weights, order_codes, pr_sql, proj_sql, r6
from .fixtures import with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def stacked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- features -----------------------------------------------------------------------------
_BOTH = "SELECT * FROM {a} UNION ALL SELECT i, j + 64, v FROM {b}"
_FORMS = [f"{NORM} ({_BOTH.format(a='a', b='b')})", "SELECT * FROM a", "SELECT * FROM b", _BOTH.format(a="a", b="b"), "SELECT * FROM xd", "SELECT * FROM yc"]


@query(with_("xd", "yc", f"a AS ({NORM} xd)", f"b AS ({NORM} yc)") + " UNION ALL ".join(f"SELECT {n} AS form, i, j, round(v, 6) + 0.0 AS v FROM ({s})" for n, s in enumerate(_FORMS)))
def s2_composite_features(spark, sf):
    x1, x2 = fx.vectors(spark, sf), fx.classes(spark, sf)
    return r6(stacked([sparse.composite_features(x1, x2, 64, n).select(F.lit(n).alias("form"), "i", "j", "v") for n in range(6)]))


@query(with_("yo", "cb", Z) + "SELECT i, j AS code FROM z WHERE j < 3")
def f5_cluster_rows(spark, sf):
    """The rows that train the first three clusters."""
    wanted = fx.brand_codes(spark, sf).where("code < 3").select(F.col("code").alias("j")).distinct()
    return sparse.subset(order_codes(spark, sf), columns=wanted).select("i", F.col("j").alias("code"))


# --- a layer with matched codes -----------------------------------------------------------
CANDIDATES = (
    WM, "mc AS (SELECT vec_id AS i, CAST((vec_id + k.range * 2) % 5 AS BIGINT) AS code, (vec_id % 10 + 1) / 10.0::DOUBLE AS p FROM embeddings, range(2) k)",
    "cd AS (SELECT DISTINCT label, label // 2 AS code FROM wm)",
    "ca AS (SELECT mc.i, cd.label, sum(mc.p) AS parent FROM mc JOIN cd ON cd.code = mc.code GROUP BY mc.i, cd.label)",
    "dt AS (SELECT ca.i, ca.label, ca.parent, coalesce(sum(xd.v * wm.w), 0) AS s FROM ca LEFT JOIN xd ON xd.i = ca.i LEFT JOIN wm ON wm.label = ca.label AND wm.j = xd.j GROUP BY ca.i, ca.label, ca.parent)",
)


def candidates(spark, sf, w: DataFrame, scored: bool = True) -> DataFrame:
    """Labels of two matched codes of each vector, with the codes' score or 1."""
    k = spark.range(2).select((F.col("id") * 2).alias("k"))
    e = fx.table(spark, sf, "embeddings").crossJoin(F.broadcast(k))
    score = ((F.col("vec_id") % 10 + 1) / 10.0) if scored else F.lit(1.0)
    codes = e.select(F.col("vec_id").alias("i"), ((F.col("vec_id") + F.col("k")) % 5).cast("long").alias("code"), score.alias("v"))
    return ranking.expand_codes(codes, w.select("label").distinct().withColumn("code", F.floor(F.col("label") / 2)))


def ranked_sql(value: str, k: int) -> str:
    return f"SELECT i, label AS j, v, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, label) AS r FROM (SELECT i, label, round({value}, 6) + 0.0 AS v FROM dt)) WHERE r <= {k}"


@query(with_("xd", "yc", *CANDIDATES) + "SELECT i, label, round(parent, 6) + 0.0 AS parent, round(s, 6) + 0.0 AS v FROM dt")
def j6_fused_scores(spark, sf):
    w = mean_weights(spark, sf)
    c = candidates(spark, sf, w)
    return r6(sparse.masked_dot(c, fx.vectors(spark, sf), w).select("i", "label", "parent", "v"), "parent", "v")


@query(with_("xd", "yc", *CANDIDATES) + ranked_sql("s", 2))
def j11_code_candidates(spark, sf):
    w = mean_weights(spark, sf)
    return r6(ranking.score_labels(fx.vectors(spark, sf), w, candidates(spark, sf, w, scored=False), None, "noop", 2))


@query(with_("xd", "yc", *CANDIDATES) + ranked_sql(f"{HINGE} * parent", 3))
def h2_predict_candidates(spark, sf):
    w = mean_weights(spark, sf)
    return r6(ranking.score_labels(fx.vectors(spark, sf), w, candidates(spark, sf, w), None, "l3-hinge", 3))


@query(with_("xd", "yc", WM) + "SELECT count(DISTINCT label) AS nr_labels, count(DISTINCT label // 2) AS nr_codes, max(j) + 1 AS nr_features FROM wm")
def h8_layer_size(spark, sf):
    w = mean_weights(spark, sf)
    codes = w.select("label").distinct().withColumn("code", F.floor(F.col("label") / 2))
    return matrices.layer_size(w, codes)


# --- aggregates, ranks, ensembles ---------------------------------------------------------
_SUMS = "sm AS (SELECT i % 4 AS node, j, sum(v) AS v, count(*) AS n FROM xd GROUP BY i % 4, j)"


@query(with_("xd", _SUMS) + "SELECT 'mean' AS kind, node, j, round(v / n, 6) + 0.0 AS v FROM sm UNION ALL SELECT 'unit', node, j, round(v / sqrt(sum(v * v) OVER (PARTITION BY node)), 6) + 0.0 FROM sm")
def a4_centroids(spark, sf):
    m = fx.vectors(spark, sf)
    nodes = m.select("i").distinct().withColumn("node", F.col("i") % 4)
    return r6(stacked([clustering.centroids(nodes, m, s).select(F.lit(kind).alias("kind"), "node", "j", "v") for kind, s in (("mean", False), ("unit", True))]))


@query(with_("xd", "yc", *H1, "sg AS (SELECT h1.j, h1.s, CASE WHEN yc.j IS NULL THEN -1 ELSE 1 END AS y FROM h1 LEFT JOIN yc ON yc.i = h1.i AND yc.j = h1.j)")
       + "SELECT l.j AS label, round(w.q / 2 + l.l, 4) + 0.0 AS v FROM (SELECT j, sum(CASE WHEN y > 0 THEN 2 ELSE 0.5 END * pow(greatest(1 - y * s, 0), 2)) AS l FROM sg GROUP BY j) l JOIN (SELECT label, sum(w * w) AS q FROM wm GROUP BY label) w ON w.label = l.j")
def a9_objective(spark, sf):
    y, w = fx.classes(spark, sf), mean_weights(spark, sf)
    codes = w.select("label").distinct().withColumn("code", F.lit(0).cast("long"))
    rows = training.jobs(y, y.select("i", F.lit(0).cast("long").alias("j")), codes)
    o = training.Options(solver=training.L2_SVC_L2, c_pos=2.0, c_neg=0.5)
    return training.objectives(rows, fx.vectors(spark, sf), w, o).select("label", (F.round("v", 4) + 0.0).alias("v"))


@query("SELECT i, CAST(node * 2 + CASE WHEN c > 1 AND r > c // 2 THEN 1 ELSE 0 END AS BIGINT) AS node FROM (SELECT p_partkey AS i, p_size % 7 AS node, row_number() OVER (PARTITION BY p_size % 7 ORDER BY p_retailprice, p_partkey) AS r, count(*) OVER (PARTITION BY p_size % 7) AS c FROM part)")
def o5_median_split(spark, sf):
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("i"), (F.col("p_size") % 7).cast("long").alias("node"), F.col("p_retailprice").alias("score"))
    return clustering.split(p)


@query(with_("xd", XI, proj_sql(3)) + "SELECT i, j, CAST(floor((r - 1) / ceil(c / 5.0)) AS BIGINT) AS q FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY v, i) AS r, count(*) OVER (PARTITION BY j) AS c FROM pj)")
def o6_ordinal_bins(spark, sf):
    return clustering.ordinal_bins(clustering.projected(gridded(spark, sf), 3, 0), 5).select("i", "j", "q")


@query(with_("xd", XI, proj_sql(3)) + "SELECT i, j, CAST(CASE WHEN v >= hi THEN 4 ELSE floor((v - lo) / ((hi - lo) / 4)) END AS INTEGER) AS q FROM (SELECT *, min(v) OVER (PARTITION BY j) AS lo, max(v) OVER (PARTITION BY j) AS hi FROM pj)")
def x14_uniform_bins(spark, sf):
    return clustering.uniform_bins(clustering.projected(gridded(spark, sf), 3, 0), 5).select("i", "j", "q")


@query(with_("xd") + "SELECT i * 8 + j // 8 AS i, CAST(sum((i + j * 3) % 4 * pow(4, j % 8)) AS BIGINT) AS code FROM xd GROUP BY i * 8 + j // 8")
def x13_hash_code(spark, sf):
    """A code for each run of eight dimensions of each vector."""
    q = fx.vectors(spark, sf).withColumn("q", (F.col("i") + F.col("j") * 3) % 4)
    return clustering.hash_code(q.select((F.col("i") * 8 + F.floor(F.col("j") / 8)).alias("i"), (F.col("j") % 8).alias("j"), "q"), 4)


@query(with_("xd") + "SELECT i, j, v, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) AS r FROM xd) WHERE r <= 5")
def o7_logit_top_k(spark, sf):
    return ranking.top_k(fx.vectors(spark, sf), 5)


_RANKED = ("k3 AS (SELECT i, j, round(sum(v) / 3, 6) AS v FROM (SELECT * FROM ra UNION ALL SELECT * FROM rb UNION ALL SELECT * FROM rc) GROUP BY i, j)",
           "r3 AS (SELECT i, j, round(max(v) / 3, 6) AS v FROM (SELECT i, j, v + 3 / 4.0 AS v FROM ra UNION ALL SELECT i, j, v + 2 / 4.0 FROM rb UNION ALL SELECT i, j, v + 1 / 4.0 FROM rc) GROUP BY i, j)")


@query(with_(*ABC, *RELS, *_RANKED) + pr_sql("rank_average", "k3") + " UNION ALL " + pr_sql("round_robin", "r3"))
def e5_ensemble_report(spark, sf):
    a, b, c = abc(spark, sf)
    report = model.evaluate(fx.classes(spark, sf), {"a": a, "b": b, "c": c}, 5)
    return r6(report.where("run in ('rank_average', 'round_robin')"), "precision", "recall")


# --- scalar functions ---------------------------------------------------------------------
@query(with_(EVT) + """SELECT event_id, round(v, 6) + 0.0 AS identity, round(1 / (1 + exp(-v)), 6) + 0.0 AS sigmoid, round(ln(1 / (1 + exp(-v))), 6) + 0.0 AS log_sigmoid,
  round(-pow(greatest(1 - v, 0), 2), 6) + 0.0 AS log_hinge, round(exp(-pow(greatest(1 - v, 0), 2)), 6) + 0.0 AS hinge FROM e""")
def x1_transforms(spark, sf):
    v = F.col("value") / 100.0 - 0.5
    each = {"identity": scoring.transform("noop"), "sigmoid": scoring.sigmoid, "log_sigmoid": scoring.log_sigmoid, "log_hinge": scoring.log_hinge(2), "hinge": scoring.hinge(2)}
    return r6(fx.table(spark, sf, "events").select("event_id", *[f(v).alias(n) for n, f in each.items()]), *each)


_IDS = "(SELECT doc_id, range(1, least(doc_id % 24, 16) + 1) AS x, 16 - least(doc_id % 24, 16) AS n FROM documents)"


@query(f"""SELECT doc_id, array_to_string(list_concat(x, list_transform(range(n), lambda k: 0)), ' ') AS right_ids, array_to_string(list_concat(list_transform(range(n), lambda k: 9), x), ' ') AS left_ids,
  array_to_string(list_concat(list_transform(x, lambda k: 1), list_transform(range(n), lambda k: 0)), ' ') AS right_mask,
  array_to_string(list_concat(list_transform(range(n), lambda k: 0), list_transform(x, lambda k: 1)), ' ') AS left_mask FROM {_IDS}""")
def x18_padding(spark, sf):
    """Sequences of 0 to 23 ids, cut or filled to 16 on the right, then on the left."""
    ids = F.transform(F.array_repeat(F.lit(1), (F.col("doc_id") % 24).cast("int")), lambda _, k: k + 1)
    d = fx.table(spark, sf, "documents").select("doc_id", ids.alias("ids"))
    right, left = words.pad("ids", 16), words.pad("ids", 16, pad_id=9, left=True)
    named = {"right_ids": right[0], "left_ids": left[0], "right_mask": right[1], "left_mask": left[1]}
    return d.select("doc_id", *[F.array_join(c.cast("array<string>"), " ").alias(n) for n, c in named.items()])


# --- index, training ----------------------------------------------------------------------
@query(with_("yd", "lb AS (SELECT count(DISTINCT j) AS n FROM yd)", "dp AS (SELECT n, CAST(floor(log2(n // 4 + 1)) AS BIGINT) + 1 AS depth FROM lb)")
       .replace("WITH ", "WITH RECURSIVE ", 1)[:-1] + """, tr AS (SELECT 0 AS d, CAST(0 AS BIGINT) AS code, n FROM lb UNION ALL
  SELECT d + 1, code * 2 + side.range, CASE WHEN n <= 1 THEN CASE WHEN side.range = 0 THEN n ELSE 0 END WHEN side.range = 0 THEN n // 2 ELSE n - n // 2 END FROM tr, range(2) side WHERE d < (SELECT depth FROM dp))
  SELECT code, n AS n_labels FROM tr WHERE d = (SELECT depth FROM dp) AND n > 0""")  # fmt: skip
def i12_index_labels(spark, sf):
    """Label embedding, depth from the cluster size, balanced clustering: the sizes of the clusters."""
    codes = model.index_labels(fx.document_labels(spark, sf), fx.tfidf(spark, sf), size=4, max_iter=4)
    return codes.groupBy("code").agg(F.count("*").alias("n_labels"))


@query()
def t12_grid_search(spark, sf):
    x, y = fx.vectors(spark, sf), fx.classes(spark, sf)
    codes = y.select(F.col("j").alias("label")).distinct().withColumn("code", F.floor(F.col("label") / 2))
    p = model.Problem(x.where(TRAIN), y.where(TRAIN), codes)
    return model.grid_search(p, {"c_pos": [0.5, 1.0], "max_iter": [10]}, (x.where(TEST), y.where(TEST)))


# --- dense factorisations, checked by their round trips -----------------------------------
@query(with_("xd") + "SELECT j AS i, round(sum(v), 4) + 0.0 AS v FROM xd GROUP BY j")
def g1_cholesky(spark, sf):
    """A x for the x that solves A x = b: A is the Gram matrix plus the identity, b the column sums."""
    m = fx.vectors(spark, sf)
    key = F.lit(0).cast("long").alias("key")
    a = sparse.union_sum([sparse.gram(m), sparse.identity(spark, 64)])
    b = m.groupBy(F.col("j").alias("i")).agg(F.sum("v").alias("v")).select(key, "i", F.lit(0).cast("long").alias("j"), "v")
    x = dense.cholesky_solve(a.select(key, "i", "j", "v"), b)
    return sparse.matvec(a, x.select(F.col("i").alias("j"), F.col("v").alias("x"))).select("i", (F.round("v", 4) + 0.0).alias("v"))


@query(with_("cb", SIZES) + "SELECT a.i, b.j, coalesce(sz.v, 0.0) AS v FROM (SELECT DISTINCT i FROM sz) a CROSS JOIN (SELECT DISTINCT j FROM sz) b LEFT JOIN sz ON sz.i = a.i AND sz.j = b.j")
def g2_svd(spark, sf):
    """U S V' of the brand by size counts."""
    f = dense.svd(brand_sizes(spark, sf).withColumn("key", F.lit(0).cast("long")))
    u, s, v = (f.where(F.col("part") == p).select("i", "j", "v") for p in "USV")
    return r6(sparse.matmul(sparse.matmul(u, s), sparse.transpose(v)))
