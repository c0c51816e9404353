"""Readers and sinks on small files; streams."""

import json

import pytest
from pyspark.sql import functions as F

from quadrille.operators import convert
from quadrille.sources import rdf, readers, writers
from quadrille.streaming import ingest


def action(i, **more):
    return json.dumps({"hubId": f"o_s_{i}", "dataset": "s", "graphUri": f"http://x/s/{i}/graph", "action": "index", "contentHash": f"h{i}", "modification_date": "2024-01-01 00:00:00"} | more)


def test_bulk_actions(spark, tmp_path):
    (tmp_path / "a.json").write_text(action(1) + "\nnot json\n" + action(2) + "\n")
    actions, errors = readers.read_bulk_actions(spark, str(tmp_path))
    assert actions.count() == 2 and [r.line for r in errors.collect()] == ["not json"]


def test_index_items(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<indexRequest><indexItem itemId="1" itemType="Book" delete="false"><field name="dc:title" fieldType="text">T</field><field name="place" fieldType="location">52.1,4.5</field><systemField name="spec">s</systemField></indexItem><indexItem itemId="2" itemType="Book" delete="true"/></indexRequest>')
    (tmp_path / "b.json").write_text(json.dumps({"indexRequest": {"indexItem": {"@itemId": "1", "@itemType": "Book", "@delete": "false", "field": [{"@name": "dc:title", "@fieldType": "text", "#text": "T"}, {"@name": "place", "@fieldType": "location", "#text": "52.1,4.5"}], "systemField": [{"@name": "spec", "#text": "s"}]}}}))
    for name, fmt, n in (("a.xml", "xml", 2), ("b.json", "json", 1)):
        items = readers.read_index_items(spark, str(tmp_path / name), fmt)
        assert items.count() == n
        quads, invalid = readers.index_items_to_quads(items, "org", "http://x")
        assert sorted(r.p.split("/")[-1] for r in quads.collect()) == ["22-rdf-syntax-ns#type", "geoHash", "place", "spec", "title"]
        assert invalid.count() == n - 1


def test_marked_records(spark, tmp_path):
    (tmp_path / "myspec.xml").write_text("<rdf:RDF>a</rdf:RDF>\n<!--<http://x/1/graph__abc>-->\n<rdf:RDF>b</rdf:RDF>\n<!--<http://x/2/graph__def>-->\n")
    rows = readers.read_marked_records(spark, str(tmp_path)).orderBy("graph").collect()
    assert [(r.spec, r.graph, r.hash, r.rdf_text) for r in rows] == [("myspec", "http://x/1/graph", "abc", "<rdf:RDF>a</rdf:RDF>"), ("myspec", "http://x/2/graph", "def", "<rdf:RDF>b</rdf:RDF>")]


def test_nquads_round_trip(spark, tmp_path):
    lines = ['<http://x/a> <http://x/p> "q\\"uo\\\\te\\nline"@en <http://x/g> .', '_:b1 <http://x/p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> <http://x/g> .', "<http://x/a> <http://x/p> _:b1 <http://x/g> .", "# a comment"]
    (tmp_path / "a.nq").write_text("\n".join(lines))
    quads = readers.read_nquads(spark, str(tmp_path / "a.nq"))
    assert quads.count() == 3
    assert quads.filter("lang = 'en'").first().o == 'q"uo\\te\nline'
    writers.write_nquads(quads, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(lines[:3])


def test_payloads(spark):
    xml = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/"><rdf:Description rdf:about="http://x/1"><e:title xml:lang="nl">T</e:title><e:place><e:Place rdf:about="http://x/p"><e:lat rdf:datatype="http://d">5</e:lat></e:Place></e:place><e:see rdf:resource="http://x/2"/></rdf:Description></rdf:RDF>'
    rows = [("g1", xml), ("g2", '<http://x/1> <http://e/p> "v" .'), ("g3", '[{"@id": "_:n", "@type": ["http://e/T"], "http://e/p": [{"@value": true}, {"@id": "http://x/2"}]}]'), ("g4", "<rdf:RDF broken"), ("g5", None)]
    quads, errors = rdf.parse_rdf_payload(spark.createDataFrame(rows, "graph string, rdf string"), "rdf", "graph")
    n = {r.graph: r.n for r in quads.groupBy("graph").agg(F.count("*").alias("n")).collect()}
    assert n == {"g1": 5, "g2": 1, "g3": 3} and [r.graph for r in errors.collect()] == ["g4"]
    assert quads.filter("lang = 'nl'").count() == 1 and quads.filter("o = 'true'").count() == 1


RDFNS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def xml(body, root=""):
    found = rdf.xml_triples(f'<rdf:RDF xmlns:rdf="{RDFNS}" xmlns:e="http://e/" {root}>{body}</rdf:RDF>')
    return {(s, p.replace(RDFNS, "rdf:"), o.replace(RDFNS, "rdf:"), (d or lang or "").replace(RDFNS, "rdf:")) for s, _, p, o, _, d, lang in found}


def test_rdf_xml_forms():
    about = 'rdf:about="http://x/1"'
    assert xml(f'<rdf:Description {about} e:t="T" rdf:type="http://e/C"/>', 'xml:lang="nl"') == {("http://x/1", "http://e/t", "T", "nl"), ("http://x/1", "rdf:type", "http://e/C", "")}
    assert xml(f'<e:C {about} xml:lang="nl"><e:t>a</e:t><e:t xml:lang="">b</e:t><e:t xml:lang="fr">c</e:t></e:C>') == {("http://x/1", "rdf:type", "http://e/C", ""), ("http://x/1", "http://e/t", "a", "nl"), ("http://x/1", "http://e/t", "b", ""), ("http://x/1", "http://e/t", "c", "fr")}
    assert xml('<rdf:Description rdf:ID="n"><e:p rdf:resource="../m"/></rdf:Description>', 'xml:base="http://x/a/b"') == {("http://x/a/b#n", "http://e/p", "http://x/m", "")}
    assert xml(f'<rdf:Seq {about}><rdf:li>a</rdf:li><rdf:li rdf:nodeID="b1"/><rdf:_9>c</rdf:_9></rdf:Seq>') == {("http://x/1", "rdf:type", "rdf:Seq", ""), ("http://x/1", "rdf:_1", "a", ""), ("http://x/1", "rdf:_2", "b1", ""), ("http://x/1", "rdf:_9", "c", "")}
    assert xml(f'<rdf:Description {about}><e:p rdf:parseType="Collection"><e:C rdf:nodeID="b1"/><rdf:Description rdf:about="http://x/2"/></e:p></rdf:Description>') == {
        ("b1", "rdf:type", "http://e/C", ""), ("http://x/1", "http://e/p", "b2", ""), ("b2", "rdf:first", "b1", ""), ("b2", "rdf:rest", "b3", ""), ("b3", "rdf:first", "http://x/2", ""), ("b3", "rdf:rest", "rdf:nil", "")}
    assert xml(f'<rdf:Description {about}><e:p rdf:parseType="Literal">a <b>c</b></e:p><e:q rdf:parseType="Resource"><e:r>1</e:r></e:q><e:s e:t="v"/><e:u/></rdf:Description>') == {
        ("http://x/1", "http://e/p", "a <b>c</b>", "rdf:XMLLiteral"), ("http://x/1", "http://e/q", "b1", ""), ("b1", "http://e/r", "1", ""), ("http://x/1", "http://e/s", "b2", ""), ("b2", "http://e/t", "v", ""), ("http://x/1", "http://e/u", "", "")}
    assert len(xml(f'<rdf:Description {about}><e:p rdf:ID="r">v</e:p></rdf:Description>', 'xml:base="http://x/"')) == 5
    # a language on a property whose object is a node counts for what is inside
    assert xml(f'<rdf:Description {about}><e:p xml:lang="nl"><rdf:Description rdf:about="http://x/2"><e:t>v</e:t></rdf:Description></e:p></rdf:Description>') == {("http://x/1", "http://e/p", "http://x/2", ""), ("http://x/2", "http://e/t", "v", "nl")}


@pytest.mark.parametrize("body", ["<rdf:Description><e:p><e:C/><e:D/></e:p></rdf:Description>", "<rdf:Description><e:p>text<e:C/></e:p></rdf:Description>", "<rdf:Description>text</rdf:Description>", '<rdf:Description rdf:about="a" rdf:nodeID="b"/>', "<rdf:li/>", '<rdf:Description rdf:aboutEach="x"/>', '<rdf:Description><e:p rdf:parseType="Resource" rdf:resource="x"/></rdf:Description>', '<rdf:Description plain="x"/>', "<rdf:Description><rdf:Description/></rdf:Description>"])
def test_broken_rdf_xml(body):
    with pytest.raises(ValueError):
        xml(body)


def jsonld(text):
    return {(s, p.replace(RDFNS, "rdf:"), o.replace(RDFNS, "rdf:"), (d or lang or "").replace("http://www.w3.org/2001/XMLSchema#", "xsd:")) for s, _, p, o, _, d, lang in rdf.jsonld_triples(text)}


def test_jsonld_forms():
    assert jsonld('{"@id": "http://x/1", "@type": "http://e/C", "http://e/p": "v", "http://e/q": {"@id": "http://x/2", "http://e/r": 5}}') == {("http://x/1", "rdf:type", "http://e/C", ""), ("http://x/1", "http://e/p", "v", ""), ("http://x/1", "http://e/q", "http://x/2", ""), ("http://x/2", "http://e/r", "5", "xsd:integer")}
    assert jsonld('[{"@id": "_:b1", "http://e/p": {"@list": [true, {"@value": "w", "@language": "nl"}]}, "http://e/q": {"@set": [1.5, null]}, "http://e/l": [{"@list": []}]}]') == {
        ("b1", "http://e/p", "b2", ""), ("b2", "rdf:first", "true", "xsd:boolean"), ("b2", "rdf:rest", "b3", ""), ("b3", "rdf:first", "w", "nl"), ("b3", "rdf:rest", "rdf:nil", ""), ("b1", "http://e/q", "1.5E0", "xsd:double"), ("b1", "http://e/l", "rdf:nil", "")}
    context = '{"e": "http://e/", "@vocab": "http://v/", "@language": "en", "@base": "http://x/", "see": {"@id": "e:see", "@type": "@id"}, "when": {"@id": "e:when", "@type": "e:date"}, "of": {"@reverse": "e:has"}, "l": {"@id": "e:l", "@container": "@list"}, "n": {"@id": "e:n", "@container": "@language"}, "no": null}'
    assert jsonld(f'{{"@context": {context}, "@graph": [{{"@id": "1", "@type": "C", "see": "2", "when": "1900", "of": {{"@id": "3"}}, "l": ["a"], "n": {{"nl": ["x", "y"]}}, "title": "T", "no": "gone", "e:d": {{"@value": "z", "@type": "e:t"}}}}]}}') == {
        ("http://x/1", "rdf:type", "http://v/C", ""), ("http://x/1", "http://e/see", "http://x/2", ""), ("http://x/1", "http://e/when", "1900", "http://e/date"), ("http://x/3", "http://e/has", "http://x/1", ""),
        ("http://x/1", "http://e/l", "b1", ""), ("b1", "rdf:first", "a", "en"), ("b1", "rdf:rest", "rdf:nil", ""), ("http://x/1", "http://e/n", "x", "nl"), ("http://x/1", "http://e/n", "y", "nl"), ("http://x/1", "http://v/title", "T", "en"), ("http://x/1", "http://e/d", "z", "http://e/t")}


@pytest.mark.parametrize("text", ['{"@context": "http://elsewhere/", "a": "b"}', '"text"', '[1]', '{"@id": "http://x/1", "http://e/p": [[1]]}', '{"@id": "http://x/1", "@nest": {}}', '{"@id": "http://x/1", "http://e/p": {"@value": 1, "@id": "x"}}', "{"])
def test_broken_jsonld(text):
    with pytest.raises((ValueError, AttributeError)):
        rdf.jsonld_triples(text)


def test_long_literals(spark):
    """No recursion for each character or escape."""
    text = "word " * 50_000 + '\\"\\u00e9' * 5_000
    row = readers.parse_statements(spark.createDataFrame([(f'<http://x/1> <http://e/p> "{text}"@nl .',)], "value string"), "value").first()
    assert row.o == "word " * 50_000 + '"é' * 5_000 and row.lang == "nl"


def test_no_triple_is_lost_without_an_error(spark):
    rows = [("g1", '<http://x/1> <http://e/p> "v" .\n# comment\n\n<http://x/1> no statement\n'), ("g2", '{"@context": "http://elsewhere/"}')]
    quads, errors = rdf.parse_rdf_payload(spark.createDataFrame(rows, "graph string, rdf string"), "rdf", "graph")
    assert quads.count() == 1 and sorted(r.graph for r in errors.collect()) == ["g1", "g2"]


def test_other_readers(spark, tmp_path):
    (tmp_path / "actions").write_text('{"_op_type": "index", "_id": "1"}\nnoise\n')
    assert readers.read_index_actions(spark, str(tmp_path / "actions")).count() == 1
    (tmp_path / "oai.xml").write_text('<x><record><header/>1</record><record>2</record><resumptionToken cursor="0" completeListSize="9">abc</resumptionToken></x>')
    rows = readers.read_oai_pages(spark, str(tmp_path / "oai.xml")).collect()
    assert len(rows) == 2 and {(r.token, r.cursor, r.list_size) for r in rows} == {("abc", 0, 9)}
    media = tmp_path / "media" / "s1" / "source"
    media.mkdir(parents=True)
    (media / "a.tif").write_bytes(b"x")
    r = readers.read_media_manifest(spark, str(tmp_path / "media")).first()
    assert (r.spec, r.kind, r.stem, r.ext) == ("s1", "source", "a", "tif")


def test_export_and_registry(spark, tmp_path):
    docs = spark.createDataFrame([("h1", {"dc_title": [("Literal", None, "T", "T", None)], "qsync_x": [("Literal", None, "n", "n", None)]})], "hub_id string, fields map<string,array<struct<type:string,id:string,value:string,raw:string,lang:string>>>")
    writers.export_results(docs, convert.CONVERTERS["v2"], str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).select("fields.dc_title").first()[0] == ["T"]
    convert.register_converter("mine", lambda d: convert.convert_v2(d).limit(0))
    assert convert.CONVERTERS["mine"](docs).count() == 0
    assert convert.apply_hooks(docs, [lambda d: d.withColumn("a", F.lit(1)), lambda d: d.withColumn("b", F.col("a") + 1)]).first().b == 2


def test_bulk_stream(spark, tmp_path):
    source, snapshot, ckpt = (str(tmp_path / x) for x in ("in", "snap", "ckpt"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(action(i) for i in range(5)))
    ingest.stream_bulk(spark, source, snapshot, ckpt).awaitTermination()
    assert ingest.Snapshot(spark, snapshot).read().count() == 5
    newer = {"modification_date": "2024-02-01 00:00:00"}
    (tmp_path / "in" / "2.json").write_text("\n".join([action(0, contentHash="new", **newer), action(7, **newer), json.dumps({"dataset": "s", "action": "clear_orphans", "modification_date": "2024-01-15 00:00:00"})]))
    ingest.stream_bulk(spark, source, snapshot, ckpt).awaitTermination()
    rows = {r.hub_id: r.content_hash for r in ingest.Snapshot(spark, snapshot).read().collect()}
    assert rows == {"o_s_0": "new", "o_s_7": "h7"}  # the rest was older than the purge
    ingest.stream_bulk(spark, source, snapshot, ckpt).awaitTermination()
    assert ingest.Snapshot(spark, snapshot).read().count() == 2


def test_a_batch_that_drops_and_indexes_again(spark):
    empty = spark.createDataFrame([], ingest.SNAPSHOT)
    batch = lambda rows: spark.createDataFrame([(h, s, a, g, c, None, m) for h, s, a, g, c, m in rows], "hubId string, dataset string, action string, graphUri string, contentHash string, acceptanceMode string, modification_date string")
    old = ingest.apply_bulk_batch(empty, batch([(f"h{i}", "s", "index", "g", f"c{i}", "2024-01-01 00:00:00") for i in range(4)]))
    new = ingest.apply_bulk_batch(old, batch([("h1", "s", "index", "g", "c1", "2024-02-01 00:00:00"), (None, "s", "drop_dataset", None, None, None), ("h9", "s", "index", "g", "x", "2024-02-01 00:00:00"), ("h9", "s", "index", "g", "y", "2024-02-01 00:00:00")]))
    assert sorted((r.hub_id, r.content_hash) for r in new.collect()) == [("h1", "c1"), ("h9", "y")]


def test_bad_lines_order_of_files_and_new_bases(spark, tmp_path):
    import os

    source, snapshot, ckpt = (str(tmp_path / x) for x in ("in", "snap", "ckpt"))
    (tmp_path / "in").mkdir()
    for n, (name, hashes) in enumerate((("z.json", ["a", "b"]), ("a.json", ["c", "d"]))):
        (tmp_path / "in" / name).write_text("\n".join([action(0, contentHash=h) for h in hashes] + ["{no json", ""]))
        os.utime(tmp_path / "in" / name, (1_700_000_000 + n, 1_700_000_000 + n))
    ingest.stream_bulk(spark, source, snapshot, ckpt).awaitTermination()
    assert [r.content_hash for r in ingest.Snapshot(spark, snapshot).read().collect()] == ["d"]
    assert spark.read.parquet(snapshot + "/errors-0").count() == 2
    store = ingest.Snapshot(spark, snapshot, compact=3)
    change = lambda i, gone: spark.createDataFrame([(f"n{i}", "s", "h", "g", None, gone)], ingest.SNAPSHOT + ", deleted boolean")
    for i in range(1, 9):
        store.write(change(i, False), i)
    store.write(change(2, True), 9)
    store.write(change(2, True), 9)  # repeated
    assert sorted(r.hub_id for r in store.read().collect()) == ["n1", "n3", "n4", "n5", "n6", "n7", "n8", "o_s_0"]
    assert len(os.listdir(snapshot)) < 12 and store.read(before=9).count() == 9


def test_index_and_log_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    item = lambda i, d: json.dumps({"@itemId": str(i), "@itemType": "Book", "@delete": d, "field": [{"@name": "dc:title", "#text": "T"}]})
    (tmp_path / "in" / "1.json").write_text(item(1, "false") + "\n" + item(2, "false"))
    run = lambda: ingest.stream_index_items(spark, str(tmp_path / "in"), str(tmp_path / "snap"), str(tmp_path / "c1"), "org").awaitTermination()
    run()
    (tmp_path / "in" / "2.json").write_text(item(1, "true"))
    run()
    assert [r.hub_id for r in ingest.Snapshot(spark, str(tmp_path / "snap")).read().collect()] == ["org_book_2"]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.json").write_text(json.dumps({"created_at": "2024-01-01T00:00:00Z", "raw_query": "q=a&qf[]=x:y&qf=z:w"}))
    ingest.stream_query_log(spark, str(tmp_path / "log"), str(tmp_path / "sink"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "sink")).first().query_params == {"q": ["a"], "qf": ["x:y", "z:w"]}


@pytest.mark.parametrize("fmt", ["xml"])
def test_empty_request(spark, tmp_path, fmt):
    (tmp_path / "a.xml").write_text("<indexRequest/>")
    assert readers.read_index_items(spark, str(tmp_path / "a.xml"), fmt).count() == 0


def test_escapes_and_odd_statements(spark):
    lines = [
        r'<http://a/s> <http://a/p> "café 😀 \U0001F600 \\u00E9 \"q\"\t\b" <http://a/g> .',
        '_:b1 <http://a/p\\u00e9> "one\u0001two"@nl _:g1 .',
        "<http://a/s> <http://a/p> _:b2.",
        '<http://a/s> "no statement" .',
    ]
    got = [(r.graph, r.s, r.p, r.o, r.lang) for r in readers.parse_statements(spark.createDataFrame([(x,) for x in lines], "value string"), "value").collect()]
    assert got == [
        ("http://a/g", "http://a/s", "http://a/p", 'café 😀 😀 \\u00E9 "q"\t\b', None),
        ("g1", "b1", "http://a/pé", "one\u0001two", "nl"),
        (None, "http://a/s", "http://a/p", "b2", None),
    ]


def test_distance_across_the_date_line_and_at_the_poles(spark):
    import itertools
    import random

    from pyspark.sql import functions as F

    from quadrille.functions.geo import haversine_km
    from quadrille.operators.search import within_distance

    rng = random.Random(2)
    near = [(0, 179.99), (0, -179.99), (0, 180), (0, -180), (89.99, 10), (89.9, -170), (-89.95, 0), (-90, 50), (90, 0), (89.6, 100), (60, 179.7), (60, -179.7)]
    points = [(i, float(a), float(o)) for i, (a, o) in enumerate(near + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(250)])]
    df = spark.createDataFrame(points, "id int, lat double, lon double")
    pairs = spark.createDataFrame([(*a, *b) for a, b in itertools.product(points, points)], "a int, alat double, alon double, b int, blat double, blon double")
    far = pairs.withColumn("km", haversine_km(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))).select("a", "b", "km").collect()
    for km in (3.0, 50.0, 900.0, 21000.0):
        got = within_distance(df.withColumnRenamed("id", "hub_id"), df.withColumnRenamed("id", "centre"), km).collect()
        assert sorted((r.centre, r.hub_id) for r in got) == sorted((r.a, r.b) for r in far if r.km <= km)


def test_summaries_are_those_of_the_single_operators(spark, sf_dir):
    from pyspark.sql import functions as F

    from quadrille.operators import documents, graph
    from quadrille.plans.bridge import table

    quads = table(spark, sf_dir, "quads")
    odd = quads.filter(F.col("p").endswith("#lat") & F.col("graph").endswith("8/graph")).withColumn("o", F.lit("no number"))
    quads = quads.unionByName(odd.withColumn("s", F.lit("x"))).unionByName(odd.withColumn("s", F.lit("x")).withColumn("p", F.regexp_replace("p", "#lat", "#long")))
    got = {r.graph: r for r in documents.record_summaries(quads).collect()}
    for df, name in ((graph.captions(quads), "captions"), (graph.geo_points(quads), "points"), (graph.pick_thumbnail(quads), "thumbnail")):
        want = {r.graph: r[name] for r in df.collect()}
        assert want and all(got[g][name] == want.get(g) for g in got), name


def test_payloads_are_made_and_parsed_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def made(batches):
        for b in batches:
            asked.add(len(b))
            yield b

    texts = spark.createDataFrame([("g1", '{"@id": "urn:a", "urn:p": "x"}'), ("g2", "[broken"), ("g3", '<urn:a> <urn:p> "y" .\nno statement')], "graph string, rdf string").mapInPandas(made, "graph string, rdf string")
    quads, errors = rdf.parse_rdf_payload(texts, "rdf", "graph")
    both = quads.select("graph", F.lit("quad").alias("kind")).unionByName(errors.select("graph", F.lit("error").alias("kind")))
    assert sorted(map(tuple, both.collect())) == [("g1", "quad"), ("g2", "error"), ("g3", "error"), ("g3", "quad")]
    assert asked.value == 3
    assert "MapInPandas" not in both._jdf.queryExecution().executedPlan().toString()
