"""Every registered query of the engine against its SQL on the same tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from corpusmill.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = ["documents", "conversations", "pages", "benchmark", "labels", "embeddings"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def cell(x):
    return round(float(x), 5) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    if name not in catalogue.ORACLES:
        assert got
        return
    result = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=lambda k: names[k])
    want = [tuple(r[k] for k in order) for r in result.fetchall()]
    key = lambda r: tuple((x is None, str(cell(x))) for x in r)
    assert sorted(map(lambda r: tuple(map(cell, r)), got), key=key) == sorted(map(lambda r: tuple(map(cell, r)), want), key=key)


def test_networks_score_every_row(spark, duck):
    got = {r.row_id: r.n_scores for r in catalogue.QUERIES["cnn_forward_numpy"](spark, str(DATA)).collect()}
    assert got == {i: 3 * (i % 9 > 0) for (i,) in duck.execute("SELECT doc_id FROM documents").fetchall()}


def test_ocr_narrows_whole_captions(spark, duck):
    got = {r.doc_id: r for r in catalogue.QUERIES["ocr_narrowed_captions"](spark, str(DATA)).collect()}
    whole = {i: len(t or "") for i, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}
    plain = [i for i in whole if not got[i].ocr_used and whole[i] > 300]
    assert plain and all(len(got[i].text) >= whole[i] for i in plain)


@pytest.mark.parametrize(("name", "per_class"), [("refill_override", 5000), ("refill_fusion", 1000)])
def test_refill_reads_until_classes_are_full(spark, tmp_path, name, per_class):
    spark.range(16000).selectExpr("id AS doc_id", "'s' AS source").write.parquet(str(tmp_path / "documents.parquet"))
    rows = catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    count = Counter(r.final_label for r in rows)
    assert len(rows) == len({r.row_id for r in rows}) and len(count) == 7
    if name == "refill_override":  # a ninth of the rows each, but for the filtered ones: no class is full, so all are read
        assert all(1600 < n < per_class for n in count.values()) and max(r.row_id for r in rows) > 14500
    else:
        assert all(n == per_class for n in count.values())


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "label_share" in e.queries()
