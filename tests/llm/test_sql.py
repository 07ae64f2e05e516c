"""The operators that SQL can express give what DuckDB gives."""

from __future__ import annotations

import compare
import pytest

from glyphmill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, small, name):
    mine, theirs = compare.both(spark, compare.connection(small), queries.QUERIES[name], queries.ORACLE[name], small)
    assert mine[0] == theirs[0] and len(mine[1]) == len(theirs[1])
    assert mine[1] == theirs[1]
