"""Every registered query of the library runs; those with SQL give what DuckDB gives."""

from __future__ import annotations

import compare
import pytest

from glyphmill.plans import queries


@pytest.fixture(scope="module")
def duck(small):
    return compare.connection(small)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, small, duck, name):
    if name not in queries.ORACLE:
        assert queries.QUERIES[name](spark, small).count() >= 0
        return
    mine, theirs = compare.both(spark, duck, queries.QUERIES[name], queries.ORACLE[name], small)
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    assert mine[1] == theirs[1]


def test_entry(spark, small):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert queries.QUERIES["lint_stats_by_lang_rule"](spark, small).count() > 0
