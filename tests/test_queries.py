"""Every registered query of the engine gives the rows of its SQL, and not trivially."""

from __future__ import annotations

import pytest
from conftest import DATA
from harness import connection, rows

from corvane.plans import queries as _  # noqa: F401
from corvane.plans.catalog import ORACLES, QUERIES

MAY_BE_EMPTY = {"orphans"}


@pytest.fixture(scope="module")
def con():
    return connection(DATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got) or name in MAY_BE_EMPTY


def test_extraction_obeys_its_caps(spark):
    e = QUERIES["deterministic_extraction"](spark, DATA).toPandas()
    assert len(e) and (e.groupby("doc_id").size() <= 20).all()
    assert not e.duplicated(["doc_id", "category", "snippet"]).all()
    assert e.overall_score.between(1, 5).all()


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
