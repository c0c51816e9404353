"""Known cases of scalar functions."""

import pytest
from pyspark.sql import functions as F

from quadrille.functions import geo, ids, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("query", "fielded", "rewritten"), [("dc_subject_facet:bloem", True, "dc_subject.raw:bloem"), ("dc_subject_text:bloem", True, "dc_subject.value:bloem"), ("one AND two", True, "one AND two"), ("A query", False, "A query")])
def test_fielded_queries(spark, query, fielded, rewritten):
    assert value(spark, text.is_fielded(F.lit(query))) is fielded
    assert value(spark, text.rewrite_query(F.lit(query))) == rewritten


def test_filters(spark):
    got = value(spark, text.parse_filters(F.array(F.lit("gemeente:best"), F.lit("gemeente:son en breugel"), F.lit("(a OR b)"), F.lit('x:"y"'))))
    assert [(r.field, r.value) for r in got] == [("gemeente", "best"), ("gemeente", "son en breugel"), ("query", "(a OR b)"), ("x", "'y'")]


def test_points(spark):
    assert value(spark, geo.parse_point(F.lit("3,447957107"))) is None
    assert value(spark, geo.parse_point(F.lit("3,44,7"))) is None
    p = value(spark, geo.parse_point(F.lit("51.2729816364,3.447957107")))
    assert (p.lat, p.lon) == (51.2729816364, 3.447957107)


def test_grid(spark):
    p = value(spark, geo.rd_to_wgs84(F.lit(85530.0), F.lit(446100.0)))
    assert abs(p.lon - 4.375585) < 1e-5 and abs(p.lat - 51.998928) < 1e-5


def test_geohash_contains_its_point(spark):
    rows = spark.createDataFrame([(52.37, 4.9), (-33.9, 18.4), (0.0, 0.0), (90.0, 180.0), (-90.0, -180.0), (45.0, -90.0)], "lat double, lon double")
    for n in (1, 3, 5, 8):
        cell = geo.geohash_encode(F.col("lat"), F.col("lon"), n)
        for r in rows.withColumn("c", cell).withColumn("d", geo.geohash_decode_exactly(F.col("c"), n)).collect():
            assert len(r.c) == n and abs(r.d.lat - r.lat) <= r.d.lat_err + 1e-12 and abs(r.d.lon - r.lon) <= r.d.lon_err + 1e-12
    assert value(spark, geo.geohash_encode(F.lit(57.64911), F.lit(10.40744), 8)) == "u4pruydq"


def test_media_hash(spark):
    assert value(spark, ids.media_hash(F.lit("urn:test-spec/123.jpg"))).startswith("d23a")


def test_proxy_field_uri(spark):
    assert value(spark, ids.proxy_field_uri(F.lit("http://x/dataset/afrikamuseum"), F.lit("Sjoerd, Siebinga"), F.lit("nl"))) == "http://x/dataset/afrikamuseum/nl/Sjoerd,_Siebinga"


def test_token(spark):
    t = text.encode_token(F.lit("edm"), F.lit(None), F.lit(None), F.lit("x"), F.lit(100), F.lit(4432))
    got = value(spark, text.decode_token(t))
    assert got == {"prefix": "edm", "from": "", "until": "", "set": "x", "cursor": "100", "list_size": "4432"}


def test_params(spark):
    got = value(spark, text.clean_params(F.lit("qf=gemeente:best&qf[]=plaats%3Abest&facet.field=x_facet&_=7")))
    assert [(r.key, r.value) for r in got] == [("qf", "gemeente:best"), ("qf", "plaats:best"), ("facet", "x.raw")]


@pytest.mark.parametrize(("c", "kind"), [("org_type__1", "typed"), ("org_spec_1", "hub"), ("nothing", "invalid")])
def test_id_kind(spark, c, kind):
    assert value(spark, ids.id_kind(F.lit(c))) == kind


def test_a_sites_vocabulary(spark, tmp_path):
    from pyspark.sql import functions as F

    from quadrille.functions.namespaces import QTERM, read_vocabulary, translate_quads, translated

    (tmp_path / "own.json").write_text('{"%s": "http://site.org/terms#", "qterm_": "own_", "%sx/": "http://x.org/"}' % (QTERM, QTERM))
    own = read_vocabulary(str(tmp_path / "own.json"))
    quads = spark.createDataFrame([("g", QTERM + "place", QTERM + "x/1", "URIRef", None), ("g", QTERM + "spec", QTERM, "Literal", QTERM + "t")], "graph string, p string, o string, o_kind string, datatype string")
    there = translate_quads(quads, own)
    assert sorted(map(tuple, there.collect())) == [("g", "http://site.org/terms#place", "http://x.org/1", "URIRef", None), ("g", "http://site.org/terms#spec", QTERM, "Literal", "http://site.org/terms#t")]
    assert sorted(map(tuple, translate_quads(there, own, back=True).collect())) == sorted(map(tuple, quads.collect()))
    assert [r[0] for r in spark.createDataFrame([("qterm_place",), ("dc_title",), (None,)], "k string").select(translated(F.col("k"), own)).collect()] == ["own_place", "dc_title", None]
