import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.operators import training
from rankweave.plans import model

M = "i long, j long, v double"


@pytest.fixture(scope="module")
def problem(spark):
    """Eight labels, each shown by a feature of its own."""
    rng = np.random.default_rng(0)
    x, y = [], []
    for i in range(64):
        x += [(i, i % 8, 1.0), (i, 8 + int(rng.integers(4)), 0.2)]
        y.append((i, i % 8, 1.0))
    x, y = spark.createDataFrame(x, M), spark.createDataFrame(y, M)
    codes = model.index_labels(y, x, depth=2, max_iter=3)
    return model.Problem(x, y, codes.cache())


def first_is_right(problem, found):
    best = found.where("rank = 1").join(problem.y.select("i", F.col("j").alias("want")), "i")
    return best.where("j = want").count() / 64


def test_full_model_and_command_line(spark, problem, tmp_path):
    o = training.Options(max_iter=50)
    chain = model.train(problem, options=o)
    assert first_is_right(problem, model.predict(chain, problem.x, problem.bias_column(), k=3)) > 0.9
    problem.x.write.parquet(str(tmp_path / "x.parquet"))
    problem.y.write.parquet(str(tmp_path / "y.parquet"))
    args = ["--x", str(tmp_path / "x.parquet"), "--y", str(tmp_path / "y.parquet")]
    model.main(["index", *args, "--out", str(tmp_path / "codes")])
    model.main(["train", *args, "--codes", str(tmp_path / "codes"), "--out", str(tmp_path / "model")])
    model.main(["predict", *args[:2], "--model", str(tmp_path / "model"), "--out", str(tmp_path / "pred")])
    assert first_is_right(problem, spark.read.parquet(str(tmp_path / "pred"))) > 0.9


def test_matcher_then_ranker(problem):
    o = training.Options(max_iter=50)
    bias = problem.bias_column()
    matcher = model.train(problem, "matcher", o)
    matched = model.predict(matcher, problem.x, bias, k=2).select("i", "j", "v").cache()
    both = model.Problem(problem.x, problem.y, problem.codes, matched, 0)
    ranker = model.train(both, "ranker", o)
    assert first_is_right(problem, model.predict(ranker, problem.x, bias, matched=matched, k=3)) > 0.9


def test_wrong_input(spark, problem):
    with pytest.raises(ValueError):
        model.train(problem, "other")
    with pytest.raises(ValueError):
        model.instance_codes(problem.y, problem.codes.limit(1))
    with pytest.raises(ValueError):
        model.check_ensemble([problem.codes])


def test_grid_search_shares_tables_and_keeps_the_bias(spark, monkeypatch):
    """Labels that only the constant tells apart from none: the rows tested must have the constant of training."""
    x = spark.createDataFrame([(i, i % 2, 1.0) for i in range(40)], M)
    y = spark.createDataFrame([(i, i % 2, 1.0) for i in range(40)], M)
    codes = spark.createDataFrame([(0, 0), (1, 0)], "label long, code long")
    packed, pack, seen, search = [], training.packed_rows, [], model.ranking.beam_search
    monkeypatch.setattr(training, "packed_rows", lambda *a: packed.append(1) or pack(*a))
    monkeypatch.setattr(model.ranking, "beam_search", lambda f, *a: seen.append(f.where("j = 2").agg(F.max("v")).first()[0]) or search(f, *a))
    grid = {"c_pos": [0.5, 1.0], "bias": [1.0, 3.0]}
    found = model.grid_search(model.Problem(x, y, codes), grid, (x, y), k=1).collect()
    assert len(found) == 4 and all(r["precision"] == 1.0 for r in found)
    assert len(packed) == 2 and seen == [1.0, 3.0, 1.0, 3.0]  # the rows of one constant are packed once
