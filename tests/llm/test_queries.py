"""Every query of the subpackage that SQL can express gives the rows of its oracle."""

import pytest

from sheetwright.llm import queries

from ..test_queries import duck, plain  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf_dir, duck, name):  # noqa: F811
    df = queries.QUERIES[name](spark, sf_dir)
    rel = duck.sql(queries.ORACLES[name])
    order = sorted(rel.columns)
    assert order == sorted(df.columns)
    want = sorted(repr(tuple(plain(r[rel.columns.index(c)]) for c in order)) for r in rel.fetchall())
    assert want and sorted(repr(tuple(plain(r[c]) for c in order)) for r in df.collect()) == want
