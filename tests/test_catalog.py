"""Every catalog query against its SQL, on the smallest tables."""

import glob
import os
import threading

import duckdb
import pandas as pd
import pytest

from pagewright.plans import catalog


@pytest.fixture(scope="module")
def db(folder):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return c


def rows(df):
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return None
        return f"{v:.6g}" if isinstance(v, float) and not v.is_integer() else str(int(v)) if isinstance(v, float) else str(v)

    return sorted((tuple(text(v) for v in r) for r in df[sorted(df.columns)].astype(object).values), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, folder, db, name):
    got = catalog.QUERIES[name](spark, folder).toPandas()
    if name not in catalog.ORACLE:
        assert len(got.columns)
        return
    want = db.sql(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["etc16_corrected", "txt18_merge_pages"])
def test_long_document(spark, tmp_path, name):
    """A document of very many pages, with gaps, takes seconds; pages without a document or number change nothing."""
    n = 40_000
    c = duckdb.connect()
    c.sql(f"CREATE TABLE pdf_page_readings AS SELECT i AS id, CASE WHEN i % 50 = 0 THEN NULL WHEN i < 20 THEN 'kort' ELSE 'lång' END AS pdf_stem, CASE WHEN i % 70 = 0 THEN NULL ELSE i // 2 + i // 1000 END::INT AS page_num, CASE WHEN i % 7 > 0 THEN 'sida å ' || i END AS text FROM range({2 * n}) t(i)")
    c.sql("CREATE TABLE quality_pages AS SELECT pdf_stem, page_num, 40.0 + id % 40 AS score, CASE WHEN id % 3 = 0 THEN 1 END AS image_page, 5 AS chars FROM pdf_page_readings")
    for t in ("pdf_page_readings", "quality_pages"):
        c.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()
    finally:
        late.cancel()
    want = c.sql(catalog.ORACLE[name]).df()
    assert len(want) >= 2 and rows(got) == rows(want)
