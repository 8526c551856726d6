"""Driver contract: entry(), queries() and oracle_sql() agree with DuckDB."""

import tempfile

import duckdb
import pytest

import __spark_entry__ as entry_mod
from rota.plans import catalog
from rota.sources.tables import TABLES
from tests.conftest import SF_SMALL
from tools.check_oracle import digest

REPORT_COLUMNS = [
    "EmpCode", "ed_Salutation", "ed_firstname", "ed_MiddleName", "ed_lastname", "ed_empid",
    "ED_Status", "ESM_EmpStatusDesc", "IPCheckEnabled", "LocationCheckEnabled",
    "IPCheckEnabledOnMobile", "PunchIn", "PunchOut", "ShiftDetails", "LocationDetails", "IPRange",
]


def test_entry_runs_with_stable_schema(spark):
    df = entry_mod.entry(spark)
    assert df.columns == REPORT_COLUMNS
    rows = df.collect()
    assert 0 < len(rows) <= 10
    assert [r.EmpCode for r in rows] == sorted(r.EmpCode for r in rows)


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) <= set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"SET temp_directory='{tempfile.mkdtemp(prefix='duck-', dir='/tmp')}'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(entry_mod.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = entry_mod.queries()[name](spark, SF_SMALL)
    res = duck.execute(entry_mod.oracle_sql()[name])
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    s_rows = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert digest(df.columns, s_rows)[0] == digest(d_cols, d_rows)[0]
