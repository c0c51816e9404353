"""Collections, views, orphans, identifiers and tags on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quadrille.functions.namespaces import EDM, ORE, QTERM, SKOS, TYPE
from quadrille.operators import documents, graph, harvest, search, sync, thesaurus
from quadrille.schemas import QUAD
from quadrille.streaming import ingest

FIELDS = "hub_id string, spec string, fields map<string,array<struct<raw:string,value:string>>>"


def docs_of(spark, rows):
    return spark.createDataFrame([(h, "s", {f: [(v, v) for v in vs] for f, vs in fields.items()}) for h, fields in rows.items()], FIELDS)


@pytest.mark.parametrize("depth", [None, 1, 3, 5, 40])
def test_broader_closure_doubles_its_reach(spark, monkeypatch, depth):
    n, rounds = 150, []
    monkeypatch.setattr(thesaurus, "cut", lambda df, real=thesaurus.cut: rounds.append(1) or real(df))
    rows = [(f"c{i:03}", SKOS + "broader", f"c{i + 1:03}") for i in range(n)] + [("c005", SKOS + "broader", "c009"), (None, SKOS + "broader", "c001"), ("c001", SKOS + "broader", None), ("x", SKOS + "broader", "x")]
    got = {(r.s, r.ancestor) for r in thesaurus.broader_closure(spark.createDataFrame(rows, "s string, p string, o string"), depth).collect()}

    def steps(i, j):
        return j - i - (3 if i <= 5 and j >= 9 else 0)

    assert got == {(f"c{i:03}", f"c{j:03}") for i in range(n) for j in range(i + 1, n + 1) if depth is None or steps(i, j) <= depth}
    assert len(rounds) <= 10


def test_collections_of_groups(spark):
    docs = docs_of(spark, {"a": {"t": ["x", "y"], "u": ["1"]}, "b": {"t": ["x"], "u": ["2"]}, "c": {"t": ["z"]}, "d": {}})
    collections = {
        "and": ([("t", "x"), ("t", "z"), ("u", "1")], None, "a"),
        "or": ([("t", "x"), ("u", "1")], [("t", "z"), ("t", "z")], "ac"),
        "both": ([("t", "x")], [("u", "1")], "ab"),
        "not": ([("t", "x"), ("-u.raw", "2")], [], "a"),
        "only-not": ([("-t", "x"), ("-t", "y")], None, "cd"),
        "not-or": ([("t", "none")], [("-t", "z")], "abd"),
        "null": (None, None, "abcd"),
        "empty": ([], [("t", "x")], "abcd"),
        "none": ([("t", "none")], None, ""),
    }
    made = spark.createDataFrame([(s, f, o) for s, (f, o, _) in collections.items()], "slug string, filters array<struct<field:string,value:string>>, or_filters array<struct<field:string,value:string>>")
    got = {(r.slug, r.hub_id) for r in search.collection_members(docs, made).collect()}
    assert got == {(s, h) for s, (_, _, hubs) in collections.items() for h in hubs}
    assert search.collection_members(docs, made.limit(0)).count() == 0 == search.collection_members(docs.limit(0), made).count()


def quads_of(spark, rows):
    full = [(g, s, "URIRef", p, o, "URIRef", None, None) for g, s, p, o in rows]
    return spark.createDataFrame(full, ", ".join(f"{c} string" for c in ("graph", "s", "s_kind", "p", "o", "o_kind", "datatype", "lang"))).select(*QUAD)


def test_views_follow_the_order_of_media(spark):
    view, web = EDM + "hasView", EDM + "WebResource"
    rows = [("r/graph", "r", TYPE, ORE + "Aggregation"), ("r/graph", "r", view, "gone"), ("r/graph", "m1", TYPE, web), ("r/graph", "m2", TYPE, web), ("r/graph", "m1", QTERM + "resourceSortOrder", "2")]
    rows += [("q/graph", "q", view, "w"), ("q/graph", "w", TYPE, web), ("q/graph", "other", view, "kept")]
    rows += [("n/graph", "n", TYPE, ORE + "Aggregation"), ("n/graph", "n", view, "v")]
    made = graph.views_in_order(quads_of(spark, rows))
    got = {(r.graph, r.s, r.o, r.place) for r in made.filter(F.col("p") == view).collect()}
    assert got == {("r/graph", "r", "m2", 1), ("r/graph", "r", "m1", 2), ("q/graph", "q", "w", 1), ("q/graph", "other", "kept", None)}
    assert made.filter(F.col("p") != view).count() == len([r for r in rows if r[2] != view])


def test_tags_of_merged_resources(spark):
    tag = "http://t/source"
    rows = [("g1", "a", TYPE, "T"), ("g2", "b", TYPE, "T"), ("g2", "c", TYPE, "U"), ("g1", "a", "name", "N"), ("g2", "b", "name", "N"), ("g2", "c", "name", "N"), ("g2", "b", "name", "M")]
    rows += [("g1", "a", tag, "x"), ("g2", "b", tag, "x"), ("g2", "b", tag, "y"), ("g2", "c", tag, "z"), ("g1", "a", tag, "")]
    got = {r.value: (r.resources, r.graphs, r.tags) for r in graph.resources_by_type(quads_of(spark, rows), "T", "name", tag).collect()}
    assert got == {"N": (2, 2, ["x", "y"]), "M": (1, 1, ["x", "y"])}
    assert all(r.tags == [] for r in graph.resources_by_type(quads_of(spark, rows), "T", "name").collect())


def test_counts_of_orphans(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    docs = spark.createDataFrame([("a", "s1", t(1)), ("b", "s1", t(3)), ("c", "s1", None), ("d", "s2", t(1)), ("e", None, t(1))], "hub_id string, spec string, modified_at timestamp")
    purges = spark.createDataFrame([("s1", t(2)), ("s1", t(1)), ("s3", t(9))], "spec string, purged_at timestamp")
    assert {tuple(r) for r in sync.count_orphans(docs, purges).collect()} == {("s1", 1), ("s3", 0)}
    assert sync.remove_orphans(docs, purges).count() == 4
    assert {tuple(r) for r in sync.count_orphans(docs, purges, enabled=False).collect()} == {("s1", 0), ("s3", 0)}


def test_saved_queries_and_identifiers(spark):
    docs = docs_of(spark, {"a": {"dc_title": ["The Watch"], "dc_identifier": ["I1", "i2"]}, "b": {"dc_title": ["a book"], "dc_identifier": ["I3"]}, "c": {}})
    assert [r.hub_id for r in harvest.harvest_select(docs, query="dc_title:watch", filters={"dc_identifier.raw": ["i2", "I3"]}).collect()] == ["a"]
    ids = spark.createDataFrame([("i1",), ("i2",), ("i3",), (None,)], "id string")
    found = lambda **k: sorted(r.hub_id for r in search.find_items(docs, ids, by="dc_identifier", **k).collect())
    assert found() == ["a"] and found(ignore_case=True) == ["a", "b"]


def test_more_like_this_of_fields_with_a_condition(spark):
    docs = docs_of(spark, {"a": {"t": ["red boat"], "u": ["hidden sail"]}, "b": {"t": ["red sail"]}, "c": {"t": ["boat red"]}, "d": {"u": ["red boat"]}})
    got = {(r.hub_id, r.related) for r in search.more_like_this(docs, ["t.value"], 5, where=F.col("hub_id") != "b").collect()}
    assert got == {("a", "c"), ("c", "a"), ("b", "a"), ("b", "c")}


def test_records_have_their_times(spark):
    rows = [("http://x/s/1/graph", "http://x/s/1", "http://purl.org/dc/elements/1.1/title", "T")]
    at = F.lit("2024-02-03 04:05:06").cast("timestamp")
    system = documents.build_records(quads_of(spark, rows), "demo", at=at).first().system
    assert system.created_at == system.modified_at and system.modified_at.strftime("%j %H:%M") == "034 04:05" and system.graph_name.endswith("/graph")
    now = documents.build_records(quads_of(spark, rows), "demo").first().system
    assert now.modified_at is not None and now.content_hash == system.content_hash


def test_a_batch_reads_a_fraction_of_the_snapshot(spark, tmp_path):
    columns = [c.split(" ")[0] for c in ingest.SNAPSHOT.split(", ")]
    rows = lambda ids: [(f"h{i:05}", f"s{i % 40}", f"c{i}", None, dt.datetime(2024, 1, 1), False) for i in ids]
    store = ingest.Snapshot(spark, str(tmp_path / "s"), compact=1, buckets=64)
    store.write(spark.createDataFrame(rows(range(4000)), f"{ingest.SNAPSHOT}, deleted boolean"), 0)
    store.compact = 9
    store.write(spark.createDataFrame([("h00007", "s9", "moved", None, None, False), ("h00003", "s3", "c3", None, None, True)], f"{ingest.SNAPSHOT}, deleted boolean"), 1)
    assert store.read().count() == 3999

    ids, none = spark.createDataFrame([("h00001",), ("h00007",), ("h00003",), ("new",), (None,)], "hub_id string"), spark.createDataFrame([], "spec string")
    part = store.read_for(ids, none)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    got = {r.hub_id: r.content_hash for r in part.collect()}
    assert got["h00001"] == "c1" and got["h00007"] == "moved" and "h00003" not in got
    assert len(got) < 400  # four of 64 buckets
    of_spec = store.read_for(ids, spark.createDataFrame([("s5",), (None,)], "spec string"))
    assert len({r.hub_id for r in of_spec.filter("spec = 's5'").collect()}) == 100 and of_spec.count() < 500
    assert store.read_for(ids, spark.createDataFrame([(f"x{i}",) for i in range(ingest.SPECS + 1)], "spec string")).count() == 3999
    assert store.read_for(ids, none, before=0).columns == columns and store.read_for(ids, none, before=0).count() == 0


def test_a_stream_with_bases_in_buckets(spark, tmp_path, monkeypatch):
    """Batches of index actions, drops and purges over compacted bases give what single batches in turn give."""
    import json

    monkeypatch.setattr(ingest.Snapshot.__init__, "__defaults__", (2, 8))
    at, state = tmp_path / "in", spark.createDataFrame([], ingest.SNAPSHOT)
    at.mkdir()
    for b in range(5):
        acts = [{"hubId": f"h{(7 * b + i) % 30}", "dataset": f"s{(7 * b + i) % 30 % 4}", "graphUri": "g", "action": "index", "contentHash": f"{b}-{i % 3}", "modification_date": f"2024-01-0{b + 1} 00:00:00"} for i in range(12)]
        acts += [{"dataset": f"s{b % 4}", "action": "clear_orphans", "modification_date": f"2024-01-0{b} 12:00:00"}] if b % 2 else [{"dataset": f"s{(b + 1) % 4}", "action": "drop_dataset"}]
        (at / f"{b}.json").write_text("\n".join(map(json.dumps, acts)))
        ingest.stream_bulk(spark, str(at), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
        batch = spark.createDataFrame([tuple(a.get(c) for c in ("hubId", "dataset", "graphUri", "action", "contentHash", "modification_date")) + (None, i) for i, a in enumerate(acts)], "hubId string, dataset string, graphUri string, action string, contentHash string, modification_date string, acceptanceMode string, seq long")
        state = spark.createDataFrame(ingest.apply_bulk_batch(state, batch).collect(), ingest.SNAPSHOT)
    want = {(r.hub_id, r.content_hash) for r in state.collect()}
    assert {(r.hub_id, r.content_hash) for r in ingest.Snapshot(spark, str(tmp_path / "out")).read().collect()} == want and want
    assert list((tmp_path / "out").glob("b-*/buckets=8/bucket=*"))
