"""Fielded queries and phrases."""

import pytest

from quadrille.operators import search

ROWS = {
    "a": {"dc_title": ["The Night Watch"], "dc_type": ["painting"]},
    "b": {"dc_title": ["watch the night"], "dc_type": ["book"]},
    "c": {"dc_title": ["night", "watch"], "dc_type": ["painting", "night-watch"]},
    "d": {"dc_title": ["a painting"], "dc_type": ["book"]},
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(h, f"s{i % 2}", {f: [(v, v) for v in vs] for f, vs in fields.items()}) for i, (h, fields) in enumerate(ROWS.items())]
    return spark.createDataFrame(rows, "hub_id string, spec string, fields map<string,array<struct<raw:string,value:string>>>")


@pytest.mark.parametrize(
    ("query", "found"),
    [
        ('"night watch"', "ac"), ('dc_title:"night watch"', "a"), ("dc_title:night-watch", "ab"), ("night", "abc"), ("NIGHT AND watch", "abc"), ("dc_title.value:(night AND watch)", "abc"), ('dc_title:"watch night"', ""),
        ("night -book", "ac"), ("night NOT dc_type:book", "ac"), ("NOT night", "d"), ('-"night watch"', "bd"), ("dc_type.raw:painting OR dc_type.raw:book", "abcd"), ("dc_type:(book OR nothing)", "bd"), ("system.spec.raw:s1", "bd"),
        ("night AND", "abc"), ("AND night", "abc"), ("(night", "abc"), ("night)", "abc"), ("()", "abcd"), ("", "abcd"), ("NOT", "abcd"), ("dc_title:(", "abcd"), ("night AND (", "abc"), ('"', "abcd"), (") OR (", "abcd"), ("-", "abcd"), ('dc_title:""', "abcd"), ("absent:x", ""),
    ],
)
def test_fielded(docs, query, found):
    assert "".join(sorted(r.hub_id for r in search.match_fielded(docs, query).collect())) == found


def test_phrases_in_text(spark):
    df = spark.createDataFrame([("a", "of the, of  the"), ("b", "the of"), ("c", "soft the of-the"), ("d", None)], "hub_id string, text string")
    from pyspark.sql import functions as F

    got = {r.hub_id: r.score for r in search.match_text(df, '"Of the"', F.col("text")).collect()}
    assert set(got) == {"a", "c"} and got["a"] > got["c"] > 0
    assert search.match_text(df, '"', F.col("text")).count() == 0
