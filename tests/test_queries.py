"""Every registered query of the engine against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from tessera import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(p: pd.DataFrame) -> list:
    p = p[sorted(p.columns)]

    def one(v):
        if pd.isna(v):
            return None
        return v if isinstance(v, str) else round(float(v) + 0.0, 5)

    return sorted((tuple(one(v) for v in r) for r in p.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    expected = duck.execute(catalogue.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_other_queries_have_tests_of_their_own():
    """Queries that SQL can't express are held against numpy in test_models.py and test_depth.py."""
    from tests import test_depth, test_models

    without = set(catalogue.queries()) - set(catalogue.oracle_sql())
    assert {f"test_{n}" for n in without} <= set(dir(test_models)) | set(dir(test_depth))


def test_harmonic_capped_equals_sql_to_the_last_digit(spark, tmp_path):
    """Energies that end on half a unit of the last digit, and values half a box from the centre."""
    con = duckdb.connect()
    con.execute("create table events as select i::bigint event_id, timestamp '2024-01-01' ts, (i % 977)::bigint user_id, 'a' event_type, round(i / 100, 2) value, '' props from range(100000) r(i)")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = catalogue.queries()["harmonic_capped"](spark, str(tmp_path)).toPandas().sort_values("event_id").reset_index(drop=True)
    expected = con.execute(catalogue.oracle_sql()["harmonic_capped"]).fetchdf().sort_values("event_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[["event_id", "e"]], expected[["event_id", "e"]], check_exact=True)
    assert (got["g0"] - expected["g0"].astype(float)).abs().max() < 1e-9
