"""Registered queries against their SQL twins on the smallest tables (the trainers have their own tests)."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, normal
from topicspark.queries.base import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TRAINERS = ("vb_", "cvb0_", "scvb0_", "adlda_", "gibbs_fit", "stream_fit", "training_metrics", "doc_topics")

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
LIBRARY = sorted(n for n in ORACLES if not n.startswith(TRAINERS))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", LIBRARY)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(normal(r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    res = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    assert got == sorted(normal([r[names.index(c)] for c in cols]) for r in res.fetchall())


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_library_query_has_an_sql_twin():
    assert set(QUERIES) == set(ORACLES)


def test_results_of_one_session_do_not_disturb_each_other(spark):
    first = entry.queries()["cvb0_sweep"](spark, SF)
    second = entry.queries()["cvb0_sweep_docs"](spark, SF)
    assert second.count() > 0 and first.count() > 0
