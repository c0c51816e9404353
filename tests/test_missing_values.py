"""Conversions against their SQL where documents lack a text, a language or a source."""

import duckdb
import pytest
from test_catalog import cell

from quadrille import catalog

MISSING = ["convert_icn", "convert_tib", "convert_ese", "convert_abm", "convert_v2"]


@pytest.fixture(scope="module")
def missing_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("missing"))
    rows = [
        (1, None, "de", "src1"),
        (2, "", "fr", "src2"),
        (3, "no language\nmore", None, "src3"),
        (4, "no source", "en", None),
        (5, "neither", None, None),
        (6, None, None, None),
        (7, "\nempty first line", "", ""),
        (8, "a|b", "d|e", "src|8"),
        (9, "whole\nrecord", "nl", "src1"),
        (None, "no number", "de", "src1"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("name", MISSING)
def test_missing_values(spark, missing_dir, name):
    df = catalog.QUERIES[name](spark, missing_dir)
    columns = sorted(df.columns)
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{missing_dir}/{t}.parquet/*.parquet'")
    rel = c.sql(catalog.ORACLE_SQL[name])
    want = sorted([cell(r[rel.columns.index(k)]) for k in columns] for r in rel.fetchall())
    assert sorted([cell(r[k]) for k in columns] for r in df.collect()) == want and want
