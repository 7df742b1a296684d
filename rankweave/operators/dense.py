"""Factorisations of many small dense matrices, each a group (key, i, j, v) solved in one task.

A group is one matrix, so its memory is rows x columns; large matrices belong in ``sparse``
and ``embedding.spectral``. Missing cells are 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _filled(m: pd.DataFrame, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(columns)))
    np.add.at(out, (np.searchsorted(rows, m["i"]), np.searchsorted(columns, m["j"])), m["v"].to_numpy(float))
    return out


def cholesky_solve(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, i, j, v) with A X = B; ``a`` symmetric positive definite, ``b`` of one or more columns j.

    A matrix that is not positive definite is an error.
    """

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"key": [], "i": [], "j": [], "v": []})
        at = np.unique(np.r_[left["i"], left["j"]])
        columns = np.unique(right["j"])
        lower = np.linalg.cholesky(_filled(left, at, at))
        x = np.linalg.solve(lower.T, np.linalg.solve(lower, _filled(right, at, columns)))
        i, j = np.divmod(np.arange(x.size), len(columns))
        return pd.DataFrame({"key": left["key"].iloc[0], "i": at[i], "j": columns[j], "v": x.ravel()})

    return a.groupBy("key").cogroup(b.groupBy("key")).applyInPandas(one, "key long, i long, j long, v double")


def svd(m: DataFrame) -> DataFrame:
    """(key, part, i, j, v): U (row, factor), S (factor, factor) and V (column, factor) of each matrix."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        rows, columns = np.unique(g["i"]), np.unique(g["j"])
        u, s, vt = np.linalg.svd(_filled(g, rows, columns), full_matrices=False)
        factor = np.arange(len(s))
        parts = []
        for name, ids, x in (("U", rows, u), ("S", factor, np.diag(s)), ("V", columns, vt.T)):
            parts.append(pd.DataFrame({"part": name, "i": np.repeat(ids, len(s)), "j": np.tile(factor, len(ids)), "v": x.ravel()}))
        out = pd.concat(parts)
        out.insert(0, "key", g["key"].iloc[0])
        return out

    return m.groupBy("key").applyInPandas(one, "key long, part string, i long, j long, v double")
