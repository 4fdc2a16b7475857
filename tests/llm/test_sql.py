"""Queries of the subpackage against their SQL on the given tables."""

import pytest
from compare import TABLES, _bag, connect

from cobaltmill.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, name):
    assert set(TABLES) >= {"documents", "embeddings", "pages"}
    df = QUERIES[name](spark, sf)
    ours = _bag(df.columns, df.collect())
    result = connect(sf).execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert ours == _bag(names, result.fetchall())
