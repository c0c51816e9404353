"""Conversions against their SQL where documents have several labels: a row for each, as in the SQL."""

import duckdb
import pytest
from test_catalog import cell

from quadrille import catalog

REPEATED = ["convert_tib", "convert_ese", "convert_abm", "convert_v2"]


@pytest.fixture(scope="module")
def repeated_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("repeated"))
    rows = [(i, f"title {i}\nmore", "de", f"src{i % 3}") for i in range(1, 7)] + [(2, "same number", "fr", "src1"), (None, "no number", "nl", "src1")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 0, 1), (3, 1, 0), (3, 0, 1), (3, 1, 1), (None, 1, 0), (None, 1, 0), (99, 1, 0), (99, 0, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("name", REPEATED)
def test_repeated_labels(spark, repeated_dir, name):
    df = catalog.QUERIES[name](spark, repeated_dir)
    columns = sorted(df.columns)
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{repeated_dir}/{t}.parquet/*.parquet'")
    rel = c.sql(catalog.ORACLE_SQL[name])
    want = sorted([cell(r[rel.columns.index(k)]) for k in columns] for r in rel.fetchall())
    assert sorted([cell(r[k]) for k in columns] for r in df.collect()) == want and want
