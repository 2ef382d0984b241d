"""Queries against their SQL on tables of many rows, where classes fill up and rare values of scores occur."""

from collections import Counter

import duckdb
import pytest

from corpusmill.plans import catalogue


def differences(spark, folder, name):
    """Rows of the query that its SQL lacks, and the other way round; every value as it is."""
    df = catalogue.QUERIES[name](spark, str(folder))
    names = sorted(df.columns)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    result = duck.execute(f"SELECT {', '.join(names)} FROM ({catalogue.ORACLES[name]})")
    want, got = {repr(r) for r in result.fetchall()}, {repr(tuple(r)) for r in df.select(*names).collect()}
    assert want
    return sorted(got - want), sorted(want - got)


def numbered(spark, folder, ids):
    spark.createDataFrame([(i, "s", "") for i in ids], "doc_id long, source string, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_fuse_all_has_the_shares_of_its_sql(spark, tmp_path):
    folder = numbered(spark, tmp_path, [*range(300), 8820, 34532])  # a half at the sixth place, no vote at all
    assert differences(spark, folder, "fuse_all") == ([], [])


def test_record_fusion_has_the_scores_of_its_sql(spark, tmp_path):
    folder = numbered(spark, tmp_path, [*range(300), 6853, 14457, 23140, 36173])  # halves, and shares below a thousandth
    assert differences(spark, folder, "record_fusion") == ([], [])


@pytest.mark.parametrize("name", ["refill_fusion", "refill_override"])
def test_refill_chooses_from_the_whole_table(spark, tmp_path, name):
    folder = numbered(spark, tmp_path, range(50000))
    assert differences(spark, folder, name) == ([], [])


def test_refill_override_with_gaps_between_keys(spark, tmp_path):
    folder = numbered(spark, tmp_path, [*range(25000), *range(1_000_000, 1_024_000), 2**40])  # rows beyond 68 chunks of 14,500 compete as well
    assert differences(spark, folder, "refill_override") == ([], [])


@pytest.mark.parametrize("name", ["refill_override", "refill_fusion", "local_balance_tiered"])
def test_rows_of_a_repeated_key_all_count(spark, tmp_path, name):
    folder = numbered(spark, tmp_path, [*range(1000), *range(0, 1000, 7), *[50] * 600])  # more of one key than the start takes
    df = catalogue.QUERIES[name](spark, str(folder))
    names = sorted(df.columns)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = duck.execute(f"SELECT {', '.join(names)} FROM ({catalogue.ORACLES[name]})").fetchall()
    assert Counter(tuple(r) for r in df.select(*names).collect()) == Counter(want)
