"""Every registered query that has SQL gives the same rows as the SQL on the smallest tables."""

import os

import duckdb
import pytest

from quorumlens.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(r) for r in frame.where(frame.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, DATA).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def sql(name, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return con.execute(catalog.oracle_sql()[name]).df()


@pytest.mark.parametrize("name", ["html_headings", "html_text", "snapshot_copy"])
def test_references_are_read_as_the_sql_reads_them(spark, tmp_path, name):
    """Cut off before the semicolon, or of a name that the SQL does not know: they stay as they are written."""
    titles = ["Cut off &amp", "All of it &amp; &lt;b&gt; &amp;lt;", "Quoted &quot;word&quot;", "Plain & &copy; &amp;quot; &am"]
    page = "<html><body><nav>menu</nav><article><h1>{0}</h1><p>{0} text &middot; &copy; &quot;x&quot;</p></article></body></html>"
    spark.createDataFrame([(i, f"https://a.example.org/en/{i}", page.format(t)) for i, t in zip((1, 2, 4, 5), titles, strict=True)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got, want = catalog.queries()[name](spark, str(tmp_path)).toPandas(), sql(name, tmp_path, "pages")
    assert len(got) == len(titles) and rows(got) == rows(want)
