import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from quire import catalog, catalog_files, catalog_layout  # noqa: F401

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    ours = catalog.QUERIES[name](spark, SF).toPandas().convert_dtypes()
    theirs = con.sql(catalog.ORACLE_SQL[name]).df().convert_dtypes()
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    rows = lambda df: sorted(str([None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in r]) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None))
    assert rows(ours) == rows(theirs)


def test_titles_as_their_sql_has_them(spark, tmp_path):
    titles = ["a&amp", "b&am", "&amp;&quot;&quo", "&amp;lt;", "&#39;&nbsp;&LT;", " \u00a0c\u3000 ", "\nd  e\t", "", "x&gt;y&lt;z"]
    html = [f"<html><head><title>{t}</title><title>other</title></head><body><h1>h</h1></body>" for t in titles]
    html += ["<h1>only</h1>", "<TITLE>loud</TITLE>", "<title lang=en>told</title>", "<title>a<b></title>", "", None]
    spark.createDataFrame([(k - 3, h) for k, h in enumerate(html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    ours = [tuple(r) for r in catalog.QUERIES["html_title"](spark, str(tmp_path)).select("page_id", "title").collect()]
    assert sorted(ours) == sorted(con.sql(catalog.ORACLE_SQL["html_title"]).fetchall()) and len(ours) == len(html)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 50


def test_the_rest_stands_without_the_training_data_folders(tmp_path):
    for name in ("quire", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "quire" / "llm")
    (tmp_path / "quire" / "llm" / "__pycache__").mkdir(parents=True)  # what a deletion may leave
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') or k == 'pipeline' for k in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
    assert done.stdout.split() == [str(len(catalog.QUERIES)), "False"]
