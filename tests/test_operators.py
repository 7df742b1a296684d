import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.functions import scoring
from rankweave.functions import text as words
from rankweave.operators import clustering, dense, embedding, ranking, sparse, training

M = "i long, j long, v double"


def entries(df):
    return {(r["i"], r["j"]): r["v"] for r in df.collect()}


def test_products_and_norms(spark):
    a = spark.createDataFrame([(0, 0, 3.0), (0, 1, 4.0), (1, 1, 2.0)], M)
    assert entries(sparse.row_l2(a)) == {(0, 0): 0.6, (0, 1): 0.8, (1, 1): 1.0}
    assert entries(sparse.matmul(a, sparse.transpose(a))) == {(0, 0): 25.0, (0, 1): 8.0, (1, 0): 8.0, (1, 1): 4.0}
    assert entries(sparse.from_entries(a.union(a)))[(1, 1)] == 4.0
    assert entries(sparse.append_constant(a, spark.createDataFrame([(0,), (7,)], "i long"), 9))[(7, 9)] == 1.0


def test_zero_rows_and_zero_overlap(spark):
    z = spark.createDataFrame([(0, 0, 0.0)], M)
    assert entries(sparse.row_l2(z)) == {(0, 0): 0.0}
    x = spark.createDataFrame([(0, 0, 1.0)], M)
    w = spark.createDataFrame([(5, 1, 1.0)], "label long, j long, w double")
    pairs = spark.createDataFrame([(0, 5)], "i long, label long")
    assert [r["v"] for r in sparse.masked_dot(pairs, x, w).collect()] == [0.0]


def test_top_k_ties_and_limits(spark):
    m = spark.createDataFrame([(0, 2, 0.5), (0, 1, 0.5)], M)
    assert [(r["j"], r["rank"]) for r in ranking.top_k(m, 1).collect()] == [(1, 1)]
    with pytest.raises(ValueError):
        ranking.top_k(m, 0)


def test_precision_recall_of_short_and_empty_predictions(spark):
    truth = spark.createDataFrame([(0, 1, 1.0), (0, 3, 1.0), (0, 4, 1.0)], M)
    pred = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.8)], M)
    got = {r["k"]: (r["precision"], r["recall"]) for r in ranking.precision_recall(truth, pred, 3).collect()}
    assert got == {1: (1.0, pytest.approx(1 / 3)), 2: (0.5, pytest.approx(1 / 3)), 3: (pytest.approx(1 / 3), pytest.approx(1 / 3))}
    rows = spark.createDataFrame([(0,), (8,)], "i long")  # row 8 has no label: it counts, with recall 0
    with_empty = {r["k"]: (r["precision"], r["recall"]) for r in ranking.precision_recall(truth, pred, 1, rows).collect()}
    assert with_empty == {1: (0.5, pytest.approx(1 / 6))}
    none = ranking.precision_recall(truth, pred.limit(0), 1).first()
    assert (none["precision"], none["recall"]) == (0.0, 0.0)


def test_ensembles(spark):
    a = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.8)], M)
    b = spark.createDataFrame([(0, 1, 0.7)], M)
    assert entries(ranking.rank_average([a, b])) == {(0, 0): 1.0, (0, 1): 1.5}
    assert entries(ranking.round_robin([a, b])) == {(0, 0): pytest.approx(4 / 3), (0, 1): pytest.approx(7 / 6)}


def test_post_processors(spark):
    assert len(scoring.POST) == 21
    row = spark.range(1).select(*[scoring.transform("l3-hinge")(F.lit(v)).alias(f"h{int(v)}") for v in (0.0, 1.0, 2.0)], scoring.noisy_or(F.lit(0.5), F.lit(0.5)).alias("n")).first()
    assert (row["h0"], row["h1"], row["h2"], row["n"]) == (pytest.approx(math.exp(-1)), 1.0, 1.0, 0.75)
    with pytest.raises(ValueError):
        scoring.transform("none")


def test_negative_sampling_needs_matches(spark):
    z = spark.createDataFrame([(0, 0, 1.0)], M)
    with pytest.raises(ValueError):
        ranking.negative_codes(z, None, 2)
    assert entries(ranking.negative_codes(z, z, 0)) == {(0, 0): 2.0}


@pytest.mark.parametrize("algorithm", [clustering.KMEANS, clustering.SKMEANS, clustering.KD])
def test_clusters_are_balanced(spark, algorithm):
    rng = np.random.default_rng(0)
    m = spark.createDataFrame([(i, j, float(rng.normal())) for i in range(21) for j in range(3)], M)
    sizes = [r["count"] for r in clustering.generate(m, 2, 2, algorithm, max_iter=3, dims=3).groupBy("code").count().collect()]
    assert sum(sizes) == 21 and len(sizes) == 4 and max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("solver", [1, 3, 5, 7])
def test_solvers_separate_and_are_near_optimal(solver):
    rng = np.random.default_rng(1)
    y = np.r_[np.ones(40), -np.ones(40)]
    x = np.c_[rng.normal(size=(80, 3)) + y[:, None] * 2, np.ones(80)]
    o = training.Options(solver=solver, max_iter=300, eps=0.001)
    other = np.where(x[:, 0] > 1, 1.0, -1.0)  # a second label, solved alongside
    both = training.solve(training.Rows.dense(x), np.stack([y, other], axis=1), o)
    assert (np.sign(x @ both[:, 0]) == y).mean() > 0.95
    for w, sign in zip(both.T, (y, other)):
        best = training.objective(w, x, sign, o)
        assert all(best <= training.objective(w + rng.normal(size=4) * s, x, sign, o) + 1e-2 for s in (0.01, 0.1, 0.5) for _ in range(20))


def test_block_changes_add_up_to_the_optimum_of_the_hinge_loss():
    rng = np.random.default_rng(3)
    x = np.c_[rng.normal(size=(120, 3)), np.ones(120)]
    sign = np.stack([np.where(x[:, 0] > 0, 1.0, -1.0), np.where(x[:, 1] > 0.3, 1.0, -1.0)], axis=1)
    o = training.Options(solver=3, eps=1e-3, max_iter=500)
    whole = training.solve(training.Rows.dense(x), sign, o)
    blocks = np.array_split(rng.permutation(120), 4)
    w, alpha = np.zeros((4, 2)), [None] * 4
    for _ in range(training.ROUNDS):
        after = []
        for k, p in enumerate(blocks):
            alpha[k], one, _ = training.Dual(training.Rows.dense(x[p]), sign[p], o, 4).run(training.SWEEPS, alpha[k], w)
            after.append(one)
        w = w + sum((one - w) / 4 for one in after)
    for k in range(2):
        assert training.objective(w[:, k], x, sign[:, k], o) == pytest.approx(training.objective(whole[:, k], x, sign[:, k], o), rel=0.01)


@pytest.mark.parametrize("solver", [1, 7])
def test_blocks_reach_the_same_optimum_in_rounds(spark, monkeypatch, solver):
    rng = np.random.default_rng(3)
    x = np.c_[rng.normal(size=(120, 3)), np.ones(120)]
    truth = {i: {int(x[i, 0] > 0), 2 + int(x[i, 1] > 0.3)} for i in range(120)}
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(120) for j in range(3)], M)
    y = spark.createDataFrame([(i, label, 1.0) for i in truth for label in truth[i]], M)
    codes = spark.createDataFrame([(label, 0) for label in range(5)], "label long, code long")  # label 4 holds nowhere
    z = cells.select("i").distinct().select("i", F.lit(0).cast("long").alias("j"), F.lit(1.0).alias("v"))
    o = training.Options(solver=solver, eps=1e-2, max_iter=500, threshold=0.0)
    objective = {}
    for cells_a_block in (10_000, 150):
        monkeypatch.setattr(training, "BLOCK_CELLS", cells_a_block)
        found = np.zeros((4, 5))
        for r in training.train_layer(cells, y, codes, z, 3, o, split=3).collect():
            found[r["j"], r["label"]] = r["w"]
        objective[cells_a_block] = [training.objective(found[:, k], x, np.array([1.0 if k in truth[i] else -1.0 for i in range(120)]), o) for k in range(5)]
    assert objective[150] == pytest.approx(objective[10_000], rel=0.01, abs=0.02)


def test_matcher_codes_are_divided_from_the_labels_up(spark):
    labels = spark.createDataFrame([(k,) for k in range(9)], "label long")
    layers = training.chain_codes(None, 2, 2, labels)
    assert [sorted((r["label"], r["code"]) for r in c.collect()) for c in layers] == [[(k, k // 2) for k in range(9)], [(k, k // 2) for k in range(5)], [(k, k // 2) for k in range(3)]]
    assert training.chain_codes(None, 3, 9, labels) == [] and training.chain_codes(None, 2, 0, labels) == []


def test_full_beam_prunes_nothing(spark):
    rng = np.random.default_rng(2)
    x = spark.createDataFrame([(i, j, float(rng.normal())) for i in range(6) for j in range(3)], M)
    weights = lambda n: spark.createDataFrame([(a, j, float(rng.normal())) for a in range(n) for j in range(3)], "label long, j long, w double")
    top, leaf = weights(3), weights(6)
    codes = spark.createDataFrame([(a, a // 2) for a in range(6)], "label long, code long")
    found = ranking.beam_search(x, [(top, None), (leaf, codes)], "sigmoid", 3, 6)
    assert found.groupBy("i").count().where("count <> 6").isEmpty()


def test_text_features(spark):
    d = spark.createDataFrame([(1, "Red fish, red!"), (2, "blue fish"), (3, None), (4, "")], "k long, text string")
    v = entries(words.tfidf(d, "k", "text"))
    assert set(v) == {(1, "red"), (1, "fish"), (2, "blue"), (2, "fish")}
    e = {r["i"]: r for r in words.encode(d, words.vocabulary(d, "k", "text", 2), "k", "text", 5).collect()}
    assert e[3]["input_ids"] == [2, 3, 0, 0, 0] and e[1]["attention_mask"] == [1, 1, 1, 1, 1] and len(e[2]["input_ids"]) == 5


def test_permutation_numbers_every_id_once(spark):
    ids = spark.range(500).select(F.col("id").alias("old"))
    new = {r["old"]: r["new"] for r in sparse.permutation(ids, 3).collect()}
    assert sorted(new.values()) == list(range(500)) and [new[k] for k in range(500)] != list(range(500))
    assert new == {r["old"]: r["new"] for r in sparse.permutation(ids.repartition(7), 3).collect()}
    assert sparse.permutation(ids.limit(0)).isEmpty()


def test_objectives_match_the_solver_side(spark):
    rng = np.random.default_rng(5)
    x, w = rng.normal(size=(6, 3)), rng.normal(size=3)
    sign = [1, -1, 1, 1, -1, -1]
    rows = spark.createDataFrame([(4, i, s) for i, s in enumerate(sign)], "label long, i long, sign int")
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(6) for j in range(3)], M)
    weights = spark.createDataFrame([(4, j, float(w[j])) for j in range(3)], "label long, j long, w double")
    for solver in (1, 3):
        o = training.Options(solver=solver, c_pos=2.0)
        assert training.objectives(rows, cells, weights, o).first()["v"] == pytest.approx(training.objective(w, x, np.array(sign), o))


def test_dense_factorisations(spark):
    a = spark.createDataFrame([(0, 0, 0, 4.0), (0, 0, 1, 2.0), (0, 1, 0, 2.0), (0, 1, 1, 3.0), (1, 5, 5, 2.0)], "key long, i long, j long, v double")
    b = spark.createDataFrame([(0, 0, 0, 2.0), (0, 1, 0, 5.0), (1, 5, 0, 8.0)], "key long, i long, j long, v double")
    got = {(r["key"], r["i"]): r["v"] for r in dense.cholesky_solve(a, b).collect()}
    assert got == {(0, 0): pytest.approx(-0.5), (0, 1): pytest.approx(2.0), (1, 5): pytest.approx(4.0)}
    parts = {(r["key"], r["part"], r["i"], r["j"]): r["v"] for r in dense.svd(a).collect()}
    assert parts[(1, "S", 0, 0)] == pytest.approx(2.0) and abs(parts[(1, "U", 5, 0)]) == pytest.approx(1.0)


def test_composite_features_need_a_known_form(spark):
    m = spark.createDataFrame([(0, 0, 2.0)], M)
    assert entries(sparse.composite_features(m, m, 8, 3)) == {(0, 0): 1.0, (0, 8): 1.0}  # each part has length 1, the whole hasn't
    assert entries(sparse.composite_features(m, m, 8, 4)) == {(0, 0): 2.0}
    with pytest.raises(ValueError):
        sparse.composite_features(m, m, 8, 6)


@pytest.mark.parametrize("most", [100, 1])
def test_ranks_by_window_and_by_sort_agree(spark, monkeypatch, most):
    monkeypatch.setattr(clustering, "RANK_ROWS", most)
    rows = [(i, i % 3, float(i % 5)) for i in range(40)]
    got = {r["i"]: (r["rank"], r["n"]) for r in clustering.ranked(spark.createDataFrame(rows, "i long, node long, score double").repartition(7), "node", ["score", "i"], 14).collect()}
    for node in range(3):
        own = sorted((s, i) for i, n, s in rows if n == node)
        assert [got[i] for _, i in own] == [(k + 1, len(own)) for k in range(len(own))]


def test_best_of_all_labels_without_their_pairs(spark):
    x = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (2, 7, 1.0)], M)  # row 2 overlaps no label
    w = spark.createDataFrame([(5, 0, -1.0), (6, 0, 2.0), (7, 1, 0.5), (8, 1, -0.5), (9, 3, 1.0)], "label long, j long, w double")
    found = ranking.score_labels(x, w, None, w.select("label").distinct(), "noop", 3).collect()
    got = {i: [(r["j"], r["v"]) for r in sorted(found, key=lambda r: r["rank"]) if r["i"] == i] for i in range(3)}
    assert got == {0: [(6, 2.0), (7, 0.0), (8, 0.0)], 1: [(7, 0.5), (5, 0.0), (6, 0.0)], 2: [(5, 0.0), (6, 0.0), (7, 0.0)]}


def test_beam_search_depth_start_and_normalising(spark):
    x = spark.createDataFrame([(0, 0, 1.0)], M)
    top = spark.createDataFrame([(0, 0, 1.0), (1, 0, 0.5)], "label long, j long, w double")
    leaf = spark.createDataFrame([(k, 0, 1.0 + k) for k in range(4)], "label long, j long, w double")
    codes = spark.createDataFrame([(k, k // 2) for k in range(4)], "label long, code long")
    chain = [(top, None), (leaf, codes)]
    assert entries(ranking.beam_search(x, chain, None, 2, 2, max_depth=1)) == {(0, 0): 1.0, (0, 1): 0.5}
    assert entries(ranking.beam_search(x, chain, None, 2, 4)) == {(0, k): 1.0 + k for k in range(4)}
    start = spark.createDataFrame([(0, 1, 0.5)], M)
    assert entries(ranking.beam_search(x, chain[1:], None, 2, 4, start=start, normalised=True)) == {(0, 2): pytest.approx(3 / 7), (0, 3): pytest.approx(4 / 7)}
    with pytest.raises(ValueError):
        ranking.beam_search(x, chain, None, 2, 4, start=start)


def test_count_model_predictions(spark):
    model = spark.createDataFrame([(0, 1, 0.75), (0, 2, 0.25), (1, 2, 1.0)], M)
    codes = spark.createDataFrame([(9, 0, 0.4), (9, 1, 0.1)], M)
    assert entries(ranking.count_predict(model, codes, 2)) == {(9, 1): 0.3, (9, 2): 0.2}
    assert entries(ranking.count_predict(model, codes, 2, weighted=False)) == {(9, 1): 0.75, (9, 2): 1.25}
    assert entries(ranking.count_predict(model, codes, 1, normalised=True)) == {(9, 1): 1.0}


def test_spectral_is_the_singular_vectors(spark):
    rng = np.random.default_rng(6)
    dense = (rng.random((12, 30)) < 0.3) * 1.0
    dense[:, 0], dense[0] = 1.0, 1.0
    y = spark.createDataFrame([(n, label, 1.0) for label in range(12) for n in range(30) if dense[label, n]], M)
    got = np.zeros((12, 3))
    for r in embedding.spectral(y, 3, rounds=12).collect():
        got[r["i"], r["j"]] = r["v"]
    u = np.linalg.svd(dense / np.sqrt(dense.sum(axis=1, keepdims=True)) / np.sqrt(dense.sum(axis=0, keepdims=True)))[0][:, 1:4]
    assert np.abs((got * u).sum(axis=0)) == pytest.approx(np.ones(3), abs=1e-3)


def test_padding_segments(spark):
    d = spark.range(1).select(F.array(F.lit(7), F.lit(8)).alias("ids"))
    row = d.select(words.segments("ids", 4, left=True).alias("a"), words.segments("ids", 4).alias("b"), words.segments("ids", 1, True).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == ([4, 4, 0, 0], [0, 0, 0, 0], [0])


def test_uniform_bins_on_edges(spark):
    # values to nine decimals on an edge between bins fall where the SQL's quotient puts them
    values = [0.0, 0.1, 0.2, 0.3, 0.7, 0.9, 1.1, 1.3, 2.1, 2.9, 3.3, *(round(k * 5 / 1024, 9) for k in range(1, 400, 3))]
    for k in (2, 4, 5, 8):
        for top in (0.9, 2.1, 3.3, round(1365 / 1024, 9)):
            own = [v for v in values if v < top] + [top]
            rows = spark.createDataFrame([(i, 0, v) for i, v in enumerate(own)], M)
            got = {r["i"]: r["q"] for r in clustering.uniform_bins(rows, k).collect()}
            assert got == {i: k - 1 if v >= top else math.floor(v / (top / (k - 1))) for i, v in enumerate(own)}
    one = spark.createDataFrame([(0, 0, 0.5), (1, 0, 0.5)], M)
    assert [r["q"] for r in clustering.uniform_bins(one, 4).collect()] == [3, 3]
    features = spark.createDataFrame([(i, 0, i / 1024) for i in range(9)], M)
    assert all(r["v"] == round(r["v"], 9) for r in clustering.projected(features, 3, 0).collect())


def read_first(df):
    """The joins and aggregates of the optimised plan, from the top."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [line for line in lines if any(word in line for word in ("Join ", "Aggregate "))]


def test_training_pairs_are_made_last(spark):
    y = spark.createDataFrame([(0, 5, 1.0), (0, 5, 1.0), (0, 7, 1.0), (1, 6, 1.0), (2, 9, 1.0)], M)
    z = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0), (1, 0, 1.0), (3, 1, 1.0)], M)
    codes = spark.createDataFrame([(5, 0), (6, 0), (7, 1), (5, 1)], "label long, code long")
    got = training.jobs(y, z, codes)
    want = []
    for i, code, _ in z.collect():
        for label, c in codes.collect():
            if c == code:
                held = sum((r["i"], r["j"]) == (i, label) for r in y.collect())
                want += [(code, label, i, 1 if held else -1)] * max(1, held)
    assert got.columns == ["code", "label", "i", "sign"] and sorted(map(tuple, got.collect())) == sorted(want)
    # the cluster's labels are no input of the join with the instances' own labels
    assert "(code" in read_first(got)[0] and "label" not in read_first(got)[0].split("Join")[1]


def test_expanded_codes_are_summed_before_the_labels_come_in(spark):
    codes = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.25), (0, 1, 1.0), (1, 1, 2.0), (2, 9, 1.0)], "i long, code long, v double")
    of = spark.createDataFrame([(5, 0), (6, 0), (6, 1), (7, 1), (8, 1), (8, 1)], "label long, code long")
    got = ranking.expand_codes(codes, of)
    assert {(r["i"], r["label"]): r["parent"] for r in got.collect()} == {(0, 5): 0.5, (0, 6): 1.75, (0, 7): 1.25, (0, 8): 2.5, (1, 6): 2.0, (1, 7): 2.0, (1, 8): 4.0}
    assert got.count() == 7 and "Join" in read_first(got)[0]


def test_parents_are_finished_before_the_labels_come_in(spark):
    """As rounded after the join, each of many rows was rounded again; an unnamed label is one, too."""
    codes = spark.createDataFrame([(0, 0, 0.26), (0, 1, 0.25), (1, 1, 2.04), (2, 9, 1.0)], "i long, code long, v double")
    of = spark.createDataFrame([(5, 0), (6, 0), (6, 1), (None, 1), (7, None)], "label long, code long")
    got = ranking.expand_codes(codes, of, lambda v: F.round(v, 1))
    want = {(0, 5): 0.3, (0, 6): 0.5, (0, None): 0.3, (1, 6): 2.0, (1, None): 2.0}
    assert {(r["i"], r["label"]): r["parent"] for r in got.collect()} == want and got.count() == 5
    lines = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    top = next(k for k, line in enumerate(lines) if "Join " in line)
    assert any("round(" in line for line in lines[top:]) and not any("round(" in line for line in lines[:top])
    assert any("explode(_labels" in line for line in lines[:top])


def test_files_of_training_pairs_are_small(spark, tmp_path):
    """As each instance came with all labels in turn, a file's pages held few of them twice: over a byte a pair."""
    z = spark.range(800).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("j"))
    y = z.select("i", ((F.col("i") * 37) % 4001).alias("j"))
    codes = spark.range(4001).select(F.col("id").alias("label"), F.lit(0).cast("long").alias("code"))
    training.jobs(y, z, codes).write.parquet(str(tmp_path / "pairs"))
    got = spark.read.parquet(str(tmp_path / "pairs"))
    assert {r["sign"]: r["count"] for r in got.groupBy("sign").count().collect()} == {1: 800, -1: 800 * 4000}
    assert got.distinct().count() == 800 * 4001
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.6 * 800 * 4001


def labelled_rows(n, seed=4):
    """Rows of features and a constant, and the signs of two labels that overlap."""
    rng = np.random.default_rng(seed)
    x = np.c_[rng.normal(size=(n, 5)) / 2, np.ones(n)]
    noisy = x[:, :2] + rng.normal(size=(n, 2)) / 2
    return x, np.where(noisy > 0.2, 1, -1).astype(np.int8)


def gradient_ratio(w, x, sign, o):
    p = training.Primal(training.Rows.dense(x), sign, o)
    return (np.abs(w + p.gradient(w)).max(axis=0) / np.abs(p.gradient(0 * w)).max(axis=0)).max()


@pytest.mark.parametrize("solver", [1, 7])
def test_smooth_losses_take_few_passes(monkeypatch, solver):
    """The work is a few dozen matrix products, not steps row by row."""
    x, sign = labelled_rows(5000)
    passes, times = [], training.Rows.times
    monkeypatch.setattr(training.Rows, "times", lambda self, w, *a: passes.append(1) or times(self, w, *a))
    o = training.Options(solver=solver, max_iter=20, eps=1e-3)
    w = training.solve(training.Rows.dense(x), sign, o)
    assert 0 < len(passes) < 150 and gradient_ratio(w, x, sign, o) < 1e-4


def test_products_of_sparse_rows():
    rng = np.random.default_rng(8)
    x = (rng.random((60, 200)) < 0.05) * rng.normal(size=(60, 200))
    x[:, 0] = 1
    rows = training.Rows([np.flatnonzero(r) for r in x], [r[np.flatnonzero(r)] for r in x])
    v = rng.normal(size=(60, 3))
    assert rows.full is None and np.allclose(rows.back(v), x[:, rows.columns].T @ v) and np.allclose(rows.times(rows.back(v)), x @ (x.T @ v))
    twice = training.Rows([[3, 3, 9], [3, 9, 9]], [[1.0, 2.0, 4.0], [1.0, 5.0, 6.0]])  # entries of one place are summed
    assert twice.full.tolist() == [[3.0, 4.0], [1.0, 11.0]]


@pytest.mark.parametrize("solver", [1, 7])
def test_several_blocks_are_at_the_optimum_in_few_rounds(spark, monkeypatch, solver):
    monkeypatch.setattr(training, "BLOCK_CELLS", 800)
    monkeypatch.setattr(training, "ROUNDS", 12)
    x, sign = labelled_rows(400)
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(400) for j in range(5)], M)
    y = spark.createDataFrame([(i, k, 1.0) for i in range(400) for k in range(2) if sign[i, k] > 0], M)
    codes = spark.createDataFrame([(0, 0), (1, 0)], "label long, code long")
    z = cells.select("i").distinct().select("i", F.lit(0).cast("long").alias("j"))
    o = training.Options(solver=solver, eps=1e-3, threshold=0.0)
    w = np.zeros((6, 2))
    for r in training.train_layer(cells, y, codes, z, 5, o).collect():
        w[r["j"], r["label"]] = r["w"]
    assert gradient_ratio(w, x, sign, o) < 1e-4


def test_chain_of_several_blocks_is_that_of_one(spark, monkeypatch):
    x, _ = labelled_rows(300)
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(300) for j in range(5)], M)
    y = spark.createDataFrame([(i, int(2 * (x[i, 0] > 0) + (x[i, 1] > 0)), 1.0) for i in range(300)], M)
    codes = spark.createDataFrame([(k, k // 2) for k in range(4)], "label long, code long")
    monkeypatch.setattr(training, "ROUNDS", 12)
    found = []
    for size in (10_000, 900):
        monkeypatch.setattr(training, "BLOCK_CELLS", size)
        chain = training.train_hierarchical(cells, y, codes, 5, training.Options(eps=1e-3, threshold=0.0))
        found.append([{(r["label"], r["j"]): r["w"] for r in w.collect()} for w, _ in chain])
    assert len(found[0]) == 2 and found[1] == [pytest.approx(w, abs=1e-3) for w in found[0]]



def test_optimality_of_given_weights(spark):
    """Also of pairs that share no feature with the weights."""
    x = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0), (1, 0, -1.0), (2, 3, 1.0)], M)
    rows = spark.createDataFrame([(0, 7, 1), (1, 7, -1), (2, 7, -1)], "i long, label long, sign int")
    w = spark.createDataFrame([(7, 0, 0.25), (7, 1, 0.5)], "label long, j long, w double")
    found = training.optimality(rows, x, w)
    a = np.array([[2.0, 1, 0], [-1, 0, 0], [0, 0, 1]])
    sign, v = np.array([1.0, -1, -1]), np.array([0.25, 0.5, 0])
    g = v - 2 * a.T @ (sign * np.maximum(1 - sign * (a @ v), 0))
    assert found.collect()[0]["ratio"] == pytest.approx(np.abs(g).max() / np.abs(2 * a.T @ sign).max())



def test_blocks_are_packed_once(spark, monkeypatch):
    """Jobs of the rounds read packed blocks: instances' rows are written only before them."""
    monkeypatch.setattr(training, "BLOCK_CELLS", 900)
    written, write = [], training.cut
    monkeypatch.setattr(training, "cut", lambda df: written.append(df.columns) or write(df))
    x, sign = labelled_rows(300)
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(300) for j in range(5)], M)
    y = spark.createDataFrame([(i, k, 1.0) for i in range(300) for k in range(2) if sign[i, k] > 0], M)
    codes = spark.createDataFrame([(0, 0), (1, 0)], "label long, code long")
    z = cells.select("i").distinct().select("i", F.lit(0).cast("long").alias("j"))
    training.train_layer(cells, y, codes, z, 5, training.Options(solver=7, eps=1e-2))
    assert sum("idx" in c for c in written) == 1 and sum("bytes" in c for c in written) == 1



@pytest.mark.parametrize("flat", [[5, 2, 5, 0], [10**12, 3, 3], [-4, 7, -4], []])
def test_places_of_numbers(flat):
    columns, at = training._places(np.array(flat, np.int64))
    assert columns.tolist() == sorted(set(flat)) and columns[at].tolist() == flat



def test_layers_are_written_once_for_several_options(spark, monkeypatch):
    x, _ = labelled_rows(60)
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(60) for j in range(5)], M)
    y = spark.createDataFrame([(i, int(2 * (x[i, 0] > 0) + (x[i, 1] > 0)), 1.0) for i in range(60)], M)
    codes = spark.createDataFrame([(k, k // 2) for k in range(4)], "label long, code long")
    calls, write, kept = [], training.cut, {}
    monkeypatch.setattr(training, "cut", lambda df: calls.append(df.columns) or write(df))
    training.train_hierarchical(cells, y, codes, 5, training.Options(c_pos=0.5), written=kept)
    first = len(calls)
    chains = [training.train_hierarchical(cells, y, codes, 5, training.Options(c_pos=2.0), written=k) for k in (kept, {})]
    assert len(calls) - first - first == 2  # only the two layers' weights with kept tables
    one, other = ([{(r["label"], r["j"]): r["w"] for r in w.collect()} for w, _ in c] for c in chains)
    assert one == [pytest.approx(w) for w in other]


@pytest.mark.parametrize("solver", [1, 7])
def test_rounds_held_by_the_driver_are_those_of_tables(spark, monkeypatch, solver):
    """Two codes of several blocks, and one label that no row has; held, only blocks and the plan are written."""
    monkeypatch.setattr(training, "BLOCK_CELLS", 500)
    x, sign = labelled_rows(300)
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(300) for j in range(5)], M)
    y = spark.createDataFrame([(i, 2 * k + i % 2, 1.0) for i in range(300) for k in range(2) if sign[i, k] > 0], M)
    codes = spark.createDataFrame([(0, 0), (2, 0), (1, 1), (3, 1), (9, 1)], "label long, code long")
    z = cells.select("i").distinct().select("i", (F.col("i") % 2).alias("j"))
    found, writes, write = [], [], training.cut
    monkeypatch.setattr(training, "cut", lambda df: writes.append(1) or write(df))
    for held in (200_000, 0):
        monkeypatch.setattr(training, "HELD", held)
        writes.append(0)
        w = training.train_layer(cells, y, codes, z, 5, training.Options(solver=solver, eps=1e-3, threshold=0.0))
        found.append({(r["label"], r["j"]): r["w"] for r in w.collect()})
    assert found[0] == pytest.approx(found[1], abs=1e-6) and len(found[0]) == 30
    assert writes.index(0, 1) == 4  # rows, plan, blocks
    w = np.array([[found[0][k, j] for k in (0, 2)] for j in range(6)])
    assert gradient_ratio(w, x[::2], sign[::2], training.Options(solver=solver)) < 1e-4


def test_packed_arrays_are_packed_cells(spark):
    """Null and empty arrays, and one id twice; a null id is no row."""
    rows = [(3, [1.0, 0.0, 2.0]), (1, None), (4, []), (2, [5.0]), (2, [7.0, 8.0]), (None, [1.0])]
    m = spark.createDataFrame(rows, "id long, a array<float>")
    cells = sparse.dense_cells(m.where("id is not null"), "id", "a").withColumn("j", F.col("j").cast("long"))
    ids = m.where("id is not null").select(F.col("id").alias("i")).distinct()
    for direct, longer in ((sparse.packed_arrays(m, "id", "a", 64), sparse.append_constant(cells, ids, 64)), (sparse.packed_arrays(m.where("size(a) > 0"), "id", "a"), cells)):
        got, expected = ({r["i"]: sorted(zip(r["idx"], r["val"], strict=True)) for r in d.collect()} for d in (direct, sparse.packed(longer)))
        assert got == expected and [t for _, t in direct.dtypes] == [t for _, t in sparse.packed(longer).dtypes]


def test_all_rows_are_of_one_code_without_clusters(spark, monkeypatch):
    x, sign = labelled_rows(200)
    m = spark.createDataFrame([(i, [float(v) for v in x[i, :5]]) for i in range(200)], "i long, a array<float>")
    cells = sparse.dense_cells(m, "i", "a")
    y = spark.createDataFrame([(i, k, 1.0) for i in range(200) for k in range(2) if sign[i, k] > 0], M)
    codes = spark.createDataFrame([(0, 0), (1, 0)], "label long, code long")
    z = cells.select("i").distinct().select("i", F.lit(0).cast("long").alias("j"))
    o, rows = training.Options(solver=7, eps=1e-3, threshold=0.0), sparse.packed_arrays(m, "i", "a", 5)
    monkeypatch.setattr(training, "packed_rows", None)
    got = [training.train_layer(cells, y, codes, c, 5, o, rows=rows).collect() for c in (None, z)]
    one, other = ({(r["label"], r["j"]): r["w"] for r in g} for g in got)
    assert len(one) == 12 and one == pytest.approx(other, abs=1e-6)


def test_blocks_of_a_smooth_loss_are_smaller_where_there_are_several(spark, monkeypatch):
    monkeypatch.setattr(training, "BLOCK_CELLS", 100)
    monkeypatch.setattr(training, "SHARE_CELLS", 25)
    rows = spark.createDataFrame([(i, [0, 1], [1.0, 1.0]) for i in range(90)], "i long, idx array<long>, val array<double>")
    z = rows.select("i", F.when(F.col("i") < 50, 1).otherwise(F.when(F.col("i") < 51, 2).otherwise(3)).cast("long").alias("j"))
    codes = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "label long, code long")
    blocks = {s: {r["code"]: r["blocks"] for r in training.layer_plan(rows, codes, z, training.Options(solver=s)).collect()} for s in (1, 3, 5)}
    assert blocks == {1: {1: 1, 2: 1, 3: 1}, 3: {1: 1, 2: 1, 3: 1}, 5: {1: 1, 2: 1, 3: 1}}
    one = training.layer_plan(rows, codes.where("code = 1"), None, training.Options(), 64).collect()
    assert one == []  # all rows are of code 0, which has no label
    whole = codes.withColumn("code", F.lit(0).cast("long"))
    assert [training.layer_plan(rows, whole, None, training.Options(solver=s)).first()["blocks"] for s in (1, 7, 3, 5)] == [8, 8, 2, 1]


def test_layers_of_a_chain_are_trained_side_by_side(spark, monkeypatch):
    """Two layers wait for each other; their weights are those of one after the other, from given rows too."""
    x, sign = labelled_rows(200)
    m = spark.createDataFrame([(i, [float(v) for v in x[i, :5]]) for i in range(200)], "i long, a array<float>")
    cells = sparse.dense_cells(m, "i", "a").withColumn("j", F.col("j").cast("long"))
    y = spark.createDataFrame([(i, k, 1.0) for i in range(200) for k in range(2) if sign[i, k] > 0], M)
    codes = spark.createDataFrame([(0, 0), (1, 1)], "label long, code long")
    o = training.Options(eps=1e-3, threshold=0.0)

    def weights(**more):
        chain = training.train_hierarchical(cells, y, codes, 5, o, **more)
        return [{(r["label"], r["j"]): r["w"] for r in w.collect()} for w, _ in chain], [c is None for _, c in chain]

    one, roots = weights()
    meet, train = threading.Barrier(2), training.train_layer
    monkeypatch.setattr(training, "packed_rows", None)
    monkeypatch.setattr(training, "train_layer", lambda *a, **k: meet.wait(60) >= 0 and train(*a, **k))
    both, again = weights(rows=sparse.packed_arrays(m, "i", "a", 5), side_by_side=2)
    assert roots == again == [True, False] and [len(w) for w in one] == [12, 12]
    assert both == [pytest.approx(w, abs=1e-6) for w in one]
