"""Facade: index labels, train, predict, evaluate; over DataFrames or Parquet paths."""

from __future__ import annotations

import argparse
from collections.abc import Iterable
from dataclasses import dataclass, fields, replace
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import clustering, embedding, ranking, sparse, training
from ..sources import matrices

MODES = ("full-model", "matcher", "ranker")
Chain = list[tuple[DataFrame, DataFrame | None]]


@dataclass(frozen=True)
class Problem:
    """Instances x (i, j, v), labels y (i, j, v), label codes (label, code), matched codes (i, j, v)."""

    x: DataFrame
    y: DataFrame
    codes: DataFrame
    matched: DataFrame | None = None
    scheme: int = 1

    def bias_column(self) -> int:
        return (self.x.agg(F.max("j")).first()[0] or 0) + 1


def index_labels(y: DataFrame, x: DataFrame, method: str = "pifa", algorithm: int = clustering.SKMEANS, depth: int | None = None, size: int = 100, seed: int = 0, max_iter: int = 20) -> DataFrame:
    """(label, code): label embeddings clustered; depth from the cluster size plus one unless given."""
    features = embedding.create(y, x, method)
    if depth is None:
        depth = clustering.depth_for(features.select("i").distinct().count(), size) + 1
    return clustering.generate(features, 2, depth, algorithm, seed, max_iter).select(F.col("i").alias("label"), "code")


def instance_codes(y: DataFrame, codes: DataFrame) -> DataFrame:
    """Y C; every label must have a code."""
    if not y.select(F.col("j").alias("label")).join(codes, "label", "left_anti").isEmpty():
        raise ValueError("labels without a code")
    return sparse.matmul(y, codes.select(F.col("label").alias("i"), F.col("code").alias("j"), F.lit(1.0).alias("v")))


def train(p: Problem, mode: str = "full-model", options: training.Options = training.Options(), shallow: bool = False, min_labels: int = 2, nr_splits: int = 2, written: dict | None = None) -> Chain:
    """A chain from the root to the labels (full model) or to the codes (matcher), or the last layer only (ranker).

    ``shallow``: above the codes there is the root only, and the matcher is one layer.
    ``written``: see ``train_hierarchical``; for a full model.
    """
    bias = p.bias_column()
    least = 0 if shallow else min_labels  # 0: nothing is divided
    if mode == "full-model":
        return training.train_hierarchical(p.x, p.y, p.codes, bias, options, p.matched, p.scheme, least, nr_splits, written)
    z = instance_codes(p.y, p.codes)
    if mode == "matcher":
        return training.train_hierarchical(p.x, z, None, bias, options, min_labels=least, nr_splits=nr_splits)
    if mode == "ranker":
        rows = ranking.negative_codes(z, p.matched, p.scheme)
        return [(training.cut(training.train_layer(p.x, p.y, p.codes, rows, bias, options)), p.codes)]
    raise ValueError(f"unknown mode {mode!r}; there are {', '.join(MODES)}")


def joined(upper: Chain, lower: Chain) -> Chain:
    """Two chains as one; the upper one's labels must be the lower one's codes."""
    codes = lower[0][1]
    if codes is None:
        raise ValueError("the lower chain begins with a root")
    labels = upper[-1][0].agg(F.max("label")).first()[0]
    most = codes.agg(F.max("code")).first()[0]
    if labels != most:
        raise ValueError(f"the upper chain ends in labels to {labels}, the lower begins with codes to {most}")
    return [*upper, *lower]


def predict(
    chain: Chain, x: DataFrame, bias_column: int, bias: float = 1.0, matched: DataFrame | None = None, post: str | None = "l3-hinge", beam: int = 10, k: int = 10,
    max_depth: int | None = None, normalised: bool = False,
) -> DataFrame:
    """Ranked labels; with ``matched`` (i, j, v) only the last layer scores, on those codes' labels."""
    full = sparse.append_constant(x, x.select("i").distinct(), bias_column, bias) if bias > 0 else x
    if matched is None:
        return ranking.beam_search(full, chain, post, beam, k, max_depth, normalised)
    return ranking.beam_search(full, chain[-1:], post, beam, k, None, normalised, start=matched.select("i", "j", "v"))


def codes_for(spark: SparkSession, where: str | None, features: DataFrame | None) -> DataFrame | None:
    """(label, code): by a method's name over label ``features``, from a ``.npz`` file, or from saved codes."""
    if where is None or where.lower() in clustering.METHODS:
        return None if features is None else clustering.codes_by_name(features, where).select(F.col("i").alias("label"), "code")
    if where.endswith(".npz"):
        return matrices.read_features(spark, where).select(F.col("i").alias("label"), F.col("j").alias("code"))
    return matrices.load_codes(spark, where)[0]


def load_bundle(spark: SparkSession, folder: str, kind: str = "npz") -> dict[str, DataFrame]:
    """Features X and labels Y of a data folder: X.trn and Y.trn, and tst and val where they are there."""
    out = {}
    for name in (f"{m}.{part}" for part in ("trn", "tst", "val") for m in "XY"):
        if name.endswith("trn") or _exists(spark, f"{folder}/{name}.{kind}"):
            out[name] = matrices.read_features(spark, f"{folder}/{name}.{kind}")
    return out


def cached_codes(folder: str, features: DataFrame, embedding_name: str, kdim: int = 2, depth: int = 6, algorithm: int = clustering.KMEANS, seed: int = 0, max_iter: int = 20) -> DataFrame:
    """(label, code): clustered once for each set of parameters and kept under ``folder``."""
    spark = features.sparkSession
    config = {"algorithm": algorithm, "depth": depth, "embedding": embedding_name, "kdim": kdim, "max_iter": max_iter, "seed": seed}
    path = f"{folder}/codes-" + "-".join(f"{k}_{v}" for k, v in config.items())
    if not _exists(spark, f"{path}/config/_SUCCESS"):
        codes = clustering.generate(features, kdim, depth, algorithm, seed, max_iter).select(F.col("i").alias("label"), "code")
        matrices.save_codes(codes, path, **config)
    return matrices.load_codes(spark, path)[0]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def check_ensemble(preds: Iterable[DataFrame], rows: DataFrame | None = None) -> None:
    """Predictions must be entries (i, j, v); with ``rows`` (i), of these rows only."""
    for p in preds:
        if not {"i", "j", "v"} <= set(p.columns):
            raise ValueError(f"a prediction has columns i, j and v, not {p.columns}")
        if rows is not None and not p.join(rows, "i", "left_anti").isEmpty():
            raise ValueError("a prediction has rows that are not among those evaluated")


def evaluate(truth: DataFrame, runs: dict[str, DataFrame], k: int = 10, rows: DataFrame | None = None, ensembles: bool = True) -> DataFrame:
    """(run, k, precision, recall) of each run and of the three ensembles, over ``rows`` (else the truth's)."""
    check_ensemble(runs.values(), rows)
    preds = list(runs.values())
    every = dict(runs)
    if ensembles and len(preds) > 1:
        every |= {"average": ranking.average(preds), "rank_average": ranking.rank_average(preds), "round_robin": ranking.round_robin(preds)}
    out = None
    for name, p in every.items():
        part = ranking.precision_recall(truth, p, k, rows).select(F.lit(name).alias("run"), "k", "precision", "recall")
        out = part if out is None else out.unionByName(part)
    return out


def grid_search(p: Problem, grid: dict[str, list], test: tuple[DataFrame, DataFrame], k: int = 5) -> DataFrame:
    """Metrics of every combination of options, each trained as a full model.

    ``grid`` names options of training, of the index (``depth``, ``algorithm``, ``seed``: the
    labels are clustered anew) and of prediction (``post``, ``beam``).
    """
    out = None
    options, index, search = {f.name for f in fields(training.Options)}, ("depth", "algorithm", "seed"), ("post", "beam")
    if wrong := set(grid) - options - {*index, *search}:
        raise ValueError(f"unknown settings {sorted(wrong)}")
    written: dict = {}
    bias_column, tested = p.bias_column(), {}
    for values in product(*grid.values()):
        setting = dict(zip(grid, values, strict=True))
        own, kept = p, written
        if clustered := {n: v for n, v in setting.items() if n in index}:
            own, kept = replace(p, codes=training.cut(index_labels(p.y, p.x, **clustered))), {}
        o = replace(training.Options(), **{n: v for n, v in setting.items() if n in options})
        chain = train(own, options=o, written=kept)
        if o.bias not in tested:  # the constant's column as in training; written once, for all layers and settings
            tested[o.bias] = training.cut(sparse.append_constant(test[0], test[0].select("i").distinct(), bias_column, o.bias) if o.bias > 0 else test[0])
        found = predict(chain, tested[o.bias], bias_column, 0.0, k=k, **{n: v for n, v in setting.items() if n in search})
        m = ranking.precision_recall(test[1], found, k)
        part = m.select(F.lit(str(setting)).alias("setting"), "k", "precision", "recall")
        out = part if out is None else out.unionByName(part)
    return out


SOLVERS = {"L2R_L2LOSS_SVC_DUAL": training.L2_SVC_L2, "L2R_L1LOSS_SVC_DUAL": training.L2_SVC_L1, "L1R_L2LOSS_SVC": training.L1_SVC_L2, "L2R_LR_DUAL": training.L2_LOGISTIC}


def features_of(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """One or two feature files, put together by ``--format`` (see ``sparse.composite_features``)."""
    one = matrices.read_features(spark, a.x)
    two = matrices.read_features(spark, a.x2) if a.x2 else None
    if a.format % 3 == 0 and two is None:
        return sparse.row_l2(one) if a.format < 3 else one
    width = 0 if a.format % 3 else (one.agg(F.max("j")).first()[0] or 0) + 1
    return sparse.composite_features(one, one if two is None else two, width, a.format)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Index labels, train, predict and evaluate over entries (i, j, v) in Parquet, .npz or .npy.")
    parser.add_argument("step", choices=["index", "train", "predict", "evaluate"])
    for name in ("x", "x2", "y", "codes", "matched", "model", "out"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--format", type=int, default=4, help="0 to 5: how feature files are put together; 4: the first as it is")
    parser.add_argument("--mode", choices=MODES, default="full-model")
    parser.add_argument("--shallow", action="store_true")
    parser.add_argument("--min-labels", type=int, default=2)
    parser.add_argument("--nr-splits", type=int, default=2)
    parser.add_argument("--scheme", type=int, choices=[0, 1, 2], default=1)
    parser.add_argument("--solver", choices=[*SOLVERS, *map(str, SOLVERS.values())], default="L2R_L2LOSS_SVC_DUAL")
    parser.add_argument("--Cp", type=float, default=1.0)
    parser.add_argument("--Cn", type=float, default=1.0)
    parser.add_argument("--bias", type=float, default=1.0)
    parser.add_argument("--threshold", type=float, default=0.1)
    parser.add_argument("--max-iter", type=int)
    parser.add_argument("--method", default="pifa", help="label embedding of the index, or a file of one")
    parser.add_argument("--algorithm", type=int, default=clustering.SKMEANS)
    parser.add_argument("--depth", type=int)
    parser.add_argument("--seed", type=int, default=0)
    parser.add_argument("--post", default="l3-hinge")
    parser.add_argument("--beam", type=int, default=10)
    parser.add_argument("--topk", type=int, default=10)
    parser.add_argument("--pred", nargs="+", default=[], help="predictions to evaluate")
    parser.add_argument("--ensemble", action="store_true")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    y = matrices.read_features(spark, a.y) if a.y else None
    if a.step == "evaluate":
        # scores of the runs are compared after the logistic function, as an ensemble needs one scale
        sigmoid = scoring.transform("sigmoid")
        runs = {path: spark.read.parquet(path).withColumn("v", sigmoid(F.col("v"))) for path in a.pred}
        report = evaluate(y, runs, a.topk, ensembles=a.ensemble)
        report.write.mode("overwrite").parquet(a.out) if a.out else report.orderBy("run", "k").show(1000, truncate=False)
        return
    x = features_of(spark, a)
    matched = spark.read.parquet(a.matched) if a.matched else None
    if a.step == "predict":
        chain, param = matrices.load_chain(spark, a.model)
        found = training.cut(predict(chain, x, param["bias_column"], param["bias"], matched, a.post, a.beam, a.topk))
        found.write.mode("overwrite").parquet(a.out)
        if y is not None:
            ranking.formatted(ranking.precision_recall(y, found, a.topk, x.select("i").distinct())).orderBy("k").show()
        return
    if a.step == "index":
        codes = index_labels(y, x, a.method, a.algorithm, a.depth, seed=a.seed, max_iter=a.max_iter or 20)
        matrices.save_codes(codes, a.out, algorithm=a.algorithm, method=a.method, depth=a.depth, seed=a.seed)
        return
    codes = codes_for(spark, a.codes, embedding.create(y, x, a.method) if a.codes in clustering.METHODS else None)
    p = Problem(x, y, codes, matched, a.scheme)
    solver = SOLVERS.get(a.solver) or int(a.solver)
    o = training.Options(solver, a.Cp, a.Cn, a.max_iter or 100, bias=a.bias, threshold=a.threshold)
    chain = train(p, a.mode, o, a.shallow, a.min_labels, a.nr_splits)
    matrices.save_chain(spark, chain, a.out, bias=o.bias, bias_column=p.bias_column())


if __name__ == "__main__":
    main()
