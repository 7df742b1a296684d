import json

import numpy as np
import pytest

from rankweave.sources import matrices as m

X = np.array([[0.0, 1.5, 0.0], [2.0, 0.0, -3.0]])
WANT = {(0, 1): 1.5, (1, 0): 2.0, (1, 2): -3.0}


def entries(df, zeros=False):
    return {(r["i"], r["j"]): r["v"] for r in df.collect() if zeros or r["v"] != 0}


def test_numpy_files(spark, tmp_path):
    np.save(tmp_path / "x.npy", X)
    np.savez(tmp_path / "x.npz", format=np.array(b"csr"), indptr=np.array([0, 1, 3]), indices=np.array([1, 0, 2]), data=np.array([1.5, 2.0, -3.0]), shape=np.array([2, 3]))
    dense = entries(m.read_features(spark, str(tmp_path / "x.npy")), zeros=True)
    assert len(dense) == 6 and {k: v for k, v in dense.items() if v} == WANT
    assert entries(m.read_features(spark, str(tmp_path / "x.npz"))) == WANT
    with pytest.raises(ValueError):
        m.read_features(spark, "x.txt")


def test_text_formats(spark, tmp_path):
    (tmp_path / "x.svm").write_text("1 2:1.5 1:0\n-1 1:2 3:-3\n")
    (tmp_path / "x.ijv").write_text("1 2 1.5\n2 1 2\n2 3 -3\n")
    y, x = m.read_problem(spark, str(tmp_path / "x.svm"))
    assert entries(x) == WANT and {r["i"]: r["y"] for r in y.collect()} == {0: 1.0, 1: -1.0}
    assert entries(m.read_matrix(spark, str(tmp_path / "x.ijv"), "text")) == WANT
    biased = m.read_svmlight(spark, str(tmp_path / "x.svm"), bias=0.5, bias_column=9)
    assert entries(biased) == WANT | {(0, 9): 0.5, (1, 9): 0.5}
    with pytest.raises(ValueError):
        m.read_matrix(spark, "x", "binary")


def test_petsc_round_trip(spark, tmp_path):
    i, j = np.nonzero(X)
    (tmp_path / "x.petsc").write_bytes(m.petsc_bytes(i, j, X[i, j], 2, 3))
    assert entries(m.read_petsc(spark, str(tmp_path / "x.petsc"))) == WANT


def test_texts_names_and_predictions(spark, tmp_path):
    (tmp_path / "t.txt").write_text(" one\ttwo \nthree\tfour\n")
    assert [r["text"] for r in m.read_texts(spark, str(tmp_path / "t.txt"), 0).orderBy("i").collect()] == ["one", "three"]
    (tmp_path / "names.txt").write_bytes("café\n\"b, c\n".encode("latin-1"))
    assert [r["name"] for r in m.read_label_names(spark, str(tmp_path / "names.txt")).orderBy("label").collect()] == ["café", '"b, c']
    (tmp_path / "p.txt").write_text("2 5\n3:0.5 1:0.9\n4:0.1\n")
    assert {(r["i"], r["j"], r["rank"]) for r in m.read_predictions(spark, str(tmp_path / "p.txt"), 1).collect()} == {(0, 1, 1), (1, 4, 1)}


def test_models_and_codes_round_trip(spark, tmp_path):
    w = spark.createDataFrame([(0, 1, 0.5), (3, 2, -1.0)], "label long, j long, w double")
    c = spark.createDataFrame([(0, 0), (3, 1)], "label long, code long")
    m.save_chain(spark, [(w, None), (w, c)], str(tmp_path / "model"), bias=1.0)
    chain, param = m.load_chain(spark, str(tmp_path / "model"))
    assert param["bias"] == 1.0 and chain[0][1] is None and sorted(map(tuple, chain[1][1].collect())) == [(0, 0), (3, 1)]
    assert m.model_size(chain) == {"labels": 4, "features": 3, "depth": 2}
    m.save_codes(c, str(tmp_path / "codes"), algorithm=5)
    codes, config = m.load_codes(spark, str(tmp_path / "codes"))
    assert config == json.loads('{"algorithm": 5}') and codes.count() == 2
