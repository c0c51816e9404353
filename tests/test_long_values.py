"""Queries over documents against their SQL where first lines are longer than an index value and have quotes."""

import duckdb
import pytest
from test_catalog import cell

from quadrille import catalog
from quadrille.operators import convert, documents
from quadrille.schemas import QUAD

CUT = ["more_like_this_fields", "exported_results", "convert_defaults", "convert_icn", "convert_tib", "convert_ese", "convert_abm", "convert_v2"]


@pytest.fixture(scope="module")
def long_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("long"))
    first = {
        1: "boat " * 7000 + "harbour",  # the last word is past any cut
        2: "harbour boat",
        3: 'the "red" harbour',
        4: "x" * 32765,
        5: "x" * 32766,
        6: '"' + "y" * 40000 + '" harbour',
        7: "\U0001f6a2" * 33000,
        8: "harbour",
    }
    rows = [(i, f"{t}\nsecond line {i}", "de" if i % 2 else "fr", f"src{i % 3}", 0) for i, t in first.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("name", CUT)
def test_values_are_whole(spark, long_dir, name):
    df = catalog.QUERIES[name](spark, long_dir)
    columns = sorted(df.columns)
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{long_dir}/{t}.parquet/*.parquet'")
    rel = c.sql(catalog.ORACLE_SQL[name])
    want = sorted([cell(r[rel.columns.index(k)]) for k in columns] for r in rel.fetchall())
    assert sorted([cell(r[k]) for k in columns] for r in df.collect()) == want and want


def test_records_convert_whole_values_of_their_graphs(spark):
    title = "http://purl.org/dc/elements/1.1/title"
    rows = [("http://x/s/1/graph", "http://x/s/1", "URIRef", title, "t" * 40000 + end, "Literal", None, None) for end in "ab"]
    quads = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in QUAD))
    sizes = lambda docs: [len(v) for x in convert.convert(docs, "ese").first().flat if x.key == "dc_title" for v in x["values"]]
    assert sizes(documents.build_records(quads, "demo", whole=True)) == [40001, 40001]
