"""Every registered query of the library against its SQL, on the smallest data folder."""

import math
import os

import duckdb
import pytest

from quillstream.plans import oracle, queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    return repr(value) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    frame = queries.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    result = duck.execute(oracle.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert mine and mine == theirs


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracle.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert queries.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark, monkeypatch):
    import __spark_entry__ as entry

    assert set(oracle.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


CUT = ["ado&amp;&amp;&amp", "x&copy", "&lt", "&quot;a&quot", "b&middot c", "&ampamp;", "&amp;lt", "&am", "&", "&amp;quot;"]


@pytest.mark.parametrize("name", ["html_to_text_compat", "html_to_text"])
def test_references_that_are_cut_short_equal_sql(spark, tmp_path, name):
    """Titles end within a reference in larger tables of pages; those of the smallest folder don't."""
    pages = [(2 * k + odd, "http://a/", f'<html><head><meta charset="utf-8"><title>{t}</title></head><body><h1>{t}</h1><p>{t} <b>{t}</b></p></body></html>') for k, t in enumerate(CUT) for odd in (0, 1)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    theirs = dict(con.execute(f"SELECT page_id, text FROM ({oracle.oracle_sql()[name]})").fetchall())
    mine = {r["page_id"]: r["text"] for r in queries.queries()[name](spark, str(tmp_path)).collect()}
    assert mine == theirs and len(mine) == 2 * len(CUT)
