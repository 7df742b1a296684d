"""A sample of the registered queries against their SQL; the driver runs them all."""

import os

import duckdb
import pytest

from rankweave.plans import catalog, steps

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rounded(rows):
    return sorted(repr(tuple(round(x, 5) + 0.0 if isinstance(x, float) else x for x in r)) for r in rows)


QUERIES, ORACLE_SQL = catalog.QUERIES | steps.QUERIES, catalog.ORACLE_SQL | steps.ORACLE_SQL


@pytest.mark.parametrize("name", ["flagship", "s2_composite_features", "h2_predict_candidates", "a9_objective", "o5_median_split", "x18_padding", "g1_cholesky", "g2_svd", "p1_row_l2", "j4_negative_sampling", "o1_top_k_rows", "e3_round_robin", "x8_post_processors", "i3_kd_tree", "h3_beam_search", "n1_encode", "m1_precision_recall"])
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = rounded(tuple(r[c] for c in columns) for r in df.collect())
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == rounded(tuple(r[i] for i in at) for r in want.fetchall())


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert len(QUERIES) == len(catalog.QUERIES) + len(steps.QUERIES)


@pytest.mark.parametrize("name", ["j3_expand_codes", "t2_training_jobs"])
def test_large_results_match_sql_and_their_columns_are_made_before_them(spark, con, name):
    df = QUERIES[name](spark, SF)
    want, columns = con.sql(ORACLE_SQL[name]), ", ".join(df.columns)
    got = df.toArrow()  # noqa: F841  read by name
    assert len(got) == len(want) and con.sql(f"SELECT {columns} FROM got EXCEPT ALL SELECT {columns} FROM want").fetchall() == []
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan.split("Join ")[0]
