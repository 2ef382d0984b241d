"""The registered queries of the add-on against their SQL on the same tables."""

import duckdb
import pytest

from corpusmill.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    result = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    shown = lambda rows, columns: sorted(str([r[c] for c in sorted(columns)]) for r in rows)
    assert shown(df.collect(), names) == shown([dict(zip(names, r, strict=True)) for r in result.fetchall()], names)
