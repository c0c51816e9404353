"""Queries of the parsers of inputs, over texts derived from the given tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..operators import convert
from ..operators import exports as X
from ..operators import thesaurus as T
from ..operators.documents import attach_user_content
from ..operators.tables import shared_folder
from ..registry import query
from ..sources import rdf
from ..sources import readers as R
from ..sources import writers as W
from ..streaming import ingest
from .bridge import BASE, DC, EDM, QSYNC, QTERM, RDF_TYPE, SKOS, plain, table


def _q(sql: str):
    return query(plain(sql))


@_q("SELECT graph, s, p, o, o_kind, lang, datatype FROM {quads}")
def nquads_round_trip(spark, d):
    lines = X.nquad_lines(table(spark, d, "quads"))
    return R.parse_statements(lines, "value").select("graph", "s", "p", "o", "o_kind", "lang", "datatype")


@_q("SELECT DISTINCT graph, s, p, o, lang FROM {quads}")
def embedded_ntriples(spark, d):
    q = table(spark, d, "quads")
    texts = q.groupBy("graph").agg(F.array_join(F.collect_set(X.statement(False)), "\n").alias("rdf"))
    return R.parse_ntriples(texts, "rdf", "graph").select("graph", "s", "p", "o", "lang")


_TEXT = "regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g')"
_NULL = "CAST(NULL AS VARCHAR)"


def _triple(k: int, s: str, p: str, o: str, kind: str = "Literal", lang: str = _NULL, datatype: str = _NULL, s_kind: str = "URIRef") -> str:
    return f"SELECT graph, {s} AS s, '{s_kind}' AS s_kind, '{p}' AS p, {o} AS o, '{kind}' AS o_kind, {lang} AS lang, {datatype} AS datatype, {_NULL} AS error FROM d WHERE k = {k}"


_RDFNS = RDF_TYPE.removesuffix("type")
_PAYLOADS = [
    *[_triple(k, "s", RDF_TYPE, f"'{EDM}Place'", "URIRef") for k in (0, 1, 2, 4, 5, 6)],
    *[_triple(k, "s", DC + "title", "t", lang=lang) for k, lang in ((0, "'nl'"), (1, _NULL), (2, _NULL), (4, _NULL), (5, _NULL), (6, "'nl'"))],
    # a member of a container, numbered; an inner node with properties; a collection of two
    _triple(4, "s", _RDFNS + "_1", "'b1'", "BNode"),
    _triple(4, "'b1'", DC + "title", "t", s_kind="BNode"),
    _triple(4, "s", _RDFNS + "_2", "concat(s, '/2')", "URIRef"),
    _triple(5, "s", DC + "relation", "'b1'", "BNode"),
    *[_triple(k, "'b1'", _RDFNS + "first", "concat(s, '/1')", "URIRef", s_kind="BNode") for k in (5, 6)],
    *[_triple(k, "'b1'", _RDFNS + "rest", "'b2'", "BNode", s_kind="BNode") for k in (5, 6)],
    *[_triple(k, "'b2'", _RDFNS + "rest", f"'{_RDFNS}nil'", "URIRef", s_kind="BNode") for k in (5, 6)],
    _triple(5, "'b2'", _RDFNS + "first", "concat(s, '/2')", "URIRef", s_kind="BNode"),
    _triple(5, "concat(s, '/2')", DC + "title", "t"),
    _triple(6, "s", DC + "relation", "'b1'", "BNode"),
    _triple(6, "'b2'", _RDFNS + "first", "'7'", datatype="'http://www.w3.org/2001/XMLSchema#integer'", s_kind="BNode"),
    "SELECT graph, " + ", ".join([_NULL] * 7) + ", 'JSONDecodeError: Expecting value: line 1 column 2 (char 1)' FROM d WHERE k = 3",
    "SELECT graph, " + ", ".join([_NULL] * 7) + ", 'ValueError: a property has two objects' FROM d WHERE k = 7",
]


@_q(f"WITH d AS (SELECT doc_id % 8 AS k, concat(source_uri, '/graph') AS graph, source_uri AS s, {_TEXT} AS t FROM {{docs}}) " + " UNION ALL ".join(_PAYLOADS))
def rdf_payloads(spark, d):
    """Whole texts as RDF/XML (nodes, property attributes, inherited base and language, containers, collections), N-Triples and JSON-LD (expanded, or with a context, single values and lists); what breaks the grammar becomes an error."""
    clean = F.regexp_replace("text", "[^A-Za-z0-9 ]", "")
    s = F.col("source_uri")

    def filled(text: str):
        parts = F.split(F.lit(text), "@S@|@T@")
        names = re.findall("@S@|@T@", text)
        return F.concat(parts[0], *[x for k, n in enumerate(names) for x in (s if n == "@S@" else clean, parts[k + 1])])

    root = f'<rdf:RDF xmlns:rdf="{_RDFNS}" xmlns:edm="{EDM}" xmlns:dc="{DC}"'
    forms = [
        filled(f'{root} xml:lang="nl"><edm:Place rdf:about="@S@"><dc:title>@T@</dc:title></edm:Place></rdf:RDF>'),
        filled(f'<@S@> <{DC}title> "@T@" .\n<@S@> <{RDF_TYPE}> <{EDM}Place> .'),
        filled(f'[{{"@id": "@S@", "@type": ["{EDM}Place"], "{DC}title": [{{"@value": "@T@"}}]}}]'),
        F.lit("[broken"),
        filled(f'{root}><rdf:Description rdf:about="@S@" rdf:type="{EDM}Place" dc:title="@T@"><rdf:li rdf:parseType="Resource"><dc:title>@T@</dc:title></rdf:li><rdf:li rdf:resource="@S@/2"/></rdf:Description></rdf:RDF>'),
        filled(f'{root} xml:base="@S@"><edm:Place rdf:about=""><dc:title>@T@</dc:title><dc:relation rdf:parseType="Collection"><rdf:Description rdf:about="@S@/1"/><rdf:Description rdf:about="@S@/2" dc:title="@T@"/></dc:relation></edm:Place></rdf:RDF>'),
        filled(f'{{"@context": {{"dc": "{DC}", "title": {{"@id": "dc:title", "@language": "nl"}}}}, "@id": "@S@", "@type": "{EDM}Place", "title": "@T@", "dc:relation": {{"@list": [{{"@id": "@S@/1"}}, 7]}}}}'),
        filled(f'{root}><edm:Place rdf:about="@S@"><dc:relation><edm:Place/><edm:Place/></dc:relation></edm:Place></rdf:RDF>'),
    ]
    k = F.col("doc_id") % 8
    text = F.when(k == 0, forms[0])
    for n, form in enumerate(forms[1:], 1):
        text = text.when(k == n, form)
    docs = table(spark, d, "docs").select(F.concat(s, F.lit("/graph")).alias("graph"), text.alias("rdf"))
    quads, errors = rdf.parse_rdf_payload(docs, "rdf", "graph")
    return quads.unionByName(errors, allowMissingColumns=True).select("graph", "s", "s_kind", "p", "o", "o_kind", "lang", "datatype", "error")


@_q("SELECT concat(source_uri, '/graph') AS graph, content_hash AS hash, title AS rdf_text FROM {docs} WHERE title = trim(title) AND title NOT LIKE '%' || chr(10) || '%'")
def marked_records(spark, d):
    docs = table(spark, d, "docs").filter("title = trim(title) and instr(title, '\n') = 0")
    text = F.concat("title", F.lit("\n<!--<"), F.concat("source_uri", F.lit("/graph")), F.lit("__"), "content_hash", F.lit(">-->"))
    # as the reader splits them: at the end of each comment
    rows = docs.select(F.concat(F.regexp_replace(text, ">-->$", ""), F.lit(">")).alias("value"))
    return R.parse_marked(rows)


@_q(f"SELECT s, p, o, 'URIRef' AS o_kind FROM (SELECT DISTINCT s, p, o FROM {{concepts}} WHERE s LIKE '{BASE}/place/%' AND p = '{SKOS}broader' UNION SELECT DISTINCT s, p, o FROM {{concepts}} WHERE s LIKE '{BASE}/region/%' AND p = '{SKOS}broader')")
def bindings(spark, d):
    c = table(spark, d, "concepts").filter(F.col("p") == SKOS + "broader").select("s", "p", "o")
    j = c.alias("a").join(c.alias("b"), F.col("a.o") == F.col("b.s"))
    term = lambda v: F.struct(F.lit("uri").alias("type"), v.alias("value"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("datatype"))
    b = F.create_map(F.lit("s"), term(F.col("a.s")), F.lit("p"), term(F.col("a.p")), F.lit("o"), term(F.col("a.o")), F.lit("p2"), term(F.col("b.p")), F.lit("o2"), term(F.col("b.o")))
    return R.bindings_to_triples(j.select(F.array(*[F.lit(v) for v in ("s", "p", "o", "p2", "o2")]).alias("vars"), b.alias("binding"))).select("s", "p", "o", "o_kind")


@_q("SELECT concat('s', spec, '-', doc_id) AS record, '42' AS token, 0 AS \"cursor\", 4432 AS list_size FROM {docs}")
def oai_pages(spark, d):
    page = F.concat(F.lit("<ListRecords><record><header/>"), F.concat(F.lit("s"), "spec", F.lit("-"), "doc_id"), F.lit('<openskos:status>x</openskos:status></record><resumptionToken cursor="0" completeListSize="4432">42</resumptionToken></ListRecords>'))
    pages = R.parse_oai_pages(table(spark, d, "docs").select(page.alias("value")))
    return pages.select(F.regexp_extract("record", "<header/>(.*)</record>", 1).alias("record"), "token", "cursor", "list_size")


@_q("SELECT n_name AS name, n_nationkey % 2 = 0 AS featured FROM {nation} WHERE n_regionkey = 1")
def gazetteer(spark, d):
    line = F.concat(F.lit('<?xml version="1.0"?><gn:name>'), "n_name", F.lit('</gn:name><c r="http://x/'), "n_regionkey", F.lit('/"/>'), F.when(F.col("n_nationkey") % 2 == 0, "#P.PPL").otherwise(""))
    places, featured = R.filter_gazetteer(table(spark, d, "nation").select(line.alias("value")), "http://x/1/", ["#P.PPL"])
    name = F.regexp_extract("value", "<gn:name>([^<]*)<", 1).alias("name")
    known = featured.select(name).withColumn("featured", F.lit(True))
    return places.select(name).join(known, "name", "left").select("name", F.coalesce("featured", F.lit(False)).alias("featured"))


@_q(
    f"""WITH p AS (SELECT p_partkey, concat('{BASE}/resource/part/', p_partkey) AS s, p_name, p_brand, p_partkey % 10 = 0 AS bad FROM {{part}})
SELECT s, '{RDF_TYPE}' AS p, '{QTERM}IndexItem' AS o, 'URIRef' AS o_kind FROM p WHERE NOT bad UNION ALL SELECT s, '{DC}title', p_name, 'Literal' FROM p WHERE NOT bad
UNION ALL SELECT s, '{QTERM}geoHash', '52.1,4.5', 'Literal' FROM p WHERE NOT bad UNION ALL SELECT s, '{QTERM}place', '52.1,4.5', 'Literal' FROM p WHERE NOT bad
UNION ALL SELECT s, 'http://schemas.example.org/custom/colour', p_brand, 'Literal' FROM p WHERE NOT bad UNION ALL SELECT s, 'http://schemas.example.org/qsite/spec', 'demo', 'Literal' FROM p WHERE NOT bad"""
)
def index_items(spark, d):
    part = table(spark, d, "part")
    f = lambda name, kind, text: F.struct(F.lit(name).alias("@name"), F.lit(kind).alias("@fieldType"), F.lit(None).cast("string").alias("@facet"), text.alias("#text"))
    fields = F.array(f("dc:title", "text", F.col("p_name")), f("qterm:place", "location", F.lit("52.1,4.5")), f("colour", "string", F.col("p_brand")), f("dc:subject", "string", F.lit(" ")))
    system = F.array(F.struct(F.lit("spec").alias("@name"), F.lit("demo").alias("#text")))
    items = part.select(F.col("p_partkey").cast("string").alias("@itemId"), F.lit("Part").alias("@itemType"), F.lit("false").alias("@delete"), F.when(F.col("p_partkey") % 10 != 0, fields).alias("field"), system.alias("systemField"))
    quads, _ = R.index_items_to_quads(items, "demo", BASE)
    return quads.select("s", "p", "o", "o_kind")


@_q("SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), '-') AS page, CASE WHEN url LIKE '%utm_source=feed%' THEN 'feed' ELSE '-' END AS source FROM {pages}")
def query_logs(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.regexp_extract("url", r"\?([^#]*)", 1).alias("raw_query"))
    made = W.query_log(pages.withColumn("raw_query", F.concat("raw_query", F.lit("&id="), "page_id")))
    value = lambda k: F.coalesce(F.try_element_at(F.try_element_at("query_params", F.lit(k)), F.lit(1)), F.lit("-"))
    return made.select(value("id").cast("long").alias("page_id"), value("page").alias("page"), value("utm_source").alias("source"))


_TWO_BATCHES = """WITH a AS (SELECT * FROM {actions}), cut AS (SELECT max(seq) // 2 AS mid FROM a),
s1 AS (SELECT hub_id, arg_max(content_hash, seq) AS content_hash, arg_max(spec, seq) AS spec, arg_max(modified_at, seq) AS modified_at FROM a, cut WHERE action = 'index' AND seq <= mid GROUP BY hub_id),
b2 AS (SELECT a.* FROM a, cut WHERE seq > mid), gone AS (SELECT DISTINCT spec FROM b2 WHERE action = 'disable_index'),
purge AS (SELECT spec, max(modified_at) AS purged FROM b2 WHERE action = 'clear_orphans' GROUP BY spec),
held AS (SELECT s1.* FROM s1 LEFT JOIN gone ON s1.spec = gone.spec LEFT JOIN purge ON s1.spec = purge.spec WHERE gone.spec IS NULL AND (purge.purged IS NULL OR s1.modified_at > purge.purged)),
late AS (SELECT hub_id, arg_max(content_hash, seq) AS content_hash FROM b2 WHERE action = 'index' GROUP BY hub_id)
SELECT hub_id, content_hash FROM late UNION ALL SELECT hub_id, content_hash FROM held WHERE hub_id NOT IN (SELECT hub_id FROM late)"""


@_q(_TWO_BATCHES)
def bulk_batch(spark, d):
    """The first half of all actions as a batch on an empty snapshot, then the second half, with its drops and purges."""
    a = table(spark, d, "actions")
    half = a.agg((F.max("seq") / 2).cast("long").alias("_at"))
    rows = a.crossJoin(half).select(F.col("hub_id").alias("hubId"), F.col("spec").alias("dataset"), "action", F.col("graph").alias("graphUri"), F.col("content_hash").alias("contentHash"), F.col("acceptance").alias("acceptanceMode"), F.col("modified_at").cast("string").alias("modification_date"), "seq", (F.col("seq") <= F.col("_at")).alias("_first"))
    first = ingest.apply_bulk_batch(spark.createDataFrame([], ingest.SNAPSHOT), rows.filter("_first").drop("_first"))
    return ingest.apply_bulk_batch(first, rows.filter("not _first").drop("_first")).select("hub_id", "content_hash")


_ABOUT_PROXIES = [(RDF_TYPE, f"'{SKOS}Concept'"), (RDF_TYPE, f"'{QSYNC}ProxyResource'"), (QSYNC + "proxyLiteralField", "p"), (QSYNC + "proxyLiteralValue", "label"), (QSYNC + "belongsTo", "dataset"), (SKOS + "prefLabel", "label"), (SKOS + "exactMatch", "concept")]


@_q(
    f"""WITH q AS (SELECT *, regexp_extract(graph, 'aggregation/(n[0-9]+)/', 1) AS spec FROM {{quads}}), x AS (SELECT * FROM {{proxies}}), v AS (SELECT graph, s, o FROM q WHERE p = '{EDM}hasView')
SELECT q.graph, s, q.p, coalesce(x.proxy, o) AS o FROM q LEFT JOIN x ON q.p = x.p AND q.spec = x.spec AND q.o = x.label
UNION """
    + " UNION ".join(f"SELECT concat(proxy, '/graph'), proxy, '{p}', {o} FROM x WHERE {o} IS NOT NULL" for p, o in _ABOUT_PROXIES)
    + f""" UNION SELECT graph, o, concat('{QTERM}', k), concat('http://img.example.org/api/webresource?docType=', t, '&uri=', o, '&spec=', regexp_extract(o, '^urn:([^/]+)/', 1), z) FROM v, (VALUES ('thumbSmall', 'thumbnail', '&width=220&height=220'), ('thumbLarge', 'thumbnail', '&width=500&height=500'), ('deepZoomUrl', 'deepzoom', '')) w(k, t, z)
UNION SELECT graph, s, '{EDM}isShownBy', concat('http://img.example.org/api/webresource?docType=thumbnail&uri=', min(o), '&spec=', regexp_extract(min(o), '^urn:([^/]+)/', 1), '&width=500&height=500') FROM v GROUP BY graph, s"""
)
def record_contexts(spark, d):
    """Record graphs with their proxies, media and thumbnails; the triples of media come from a table of their own."""
    q = table(spark, d, "quads").withColumn("spec", F.regexp_extract("graph", "aggregation/(n[0-9]+)/", 1))
    of_media = F.col("s").startswith("urn:")
    proxies = table(spark, d, "proxies")
    fields = proxies.select("spec", "p", "field", "dataset").distinct()
    mappings = proxies.filter("concept is not null").select("proxy", "concept")
    media = q.filter(of_media).drop("spec").withColumn("graph", F.lit("media"))
    made = T.record_context(q.filter(~of_media), fields, mappings, table(spark, d, "concepts"), [DC + "subject"], 5, media, "http://img.example.org")
    return made.select("graph", "s", "p", "o")


# ---- inputs read from files, which are first written from the given tables ----


def _scratch(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _action_lines(spark, d):
    """(seq, line): bulk actions as JSON lines; those of errors are broken."""
    a = table(spark, d, "actions")
    fields = F.struct(F.col("hub_id").alias("hubId"), F.col("spec").alias("dataset"), F.col("graph").alias("graphUri"), "action", F.col("content_hash").alias("contentHash"), F.col("acceptance").alias("acceptanceMode"), F.date_format("modified_at", "yyyy-MM-dd HH:mm:ss").alias("modification_date"))
    return a.select("seq", F.when(F.col("action") == "disable_index", F.concat(F.lit("{broken "), "seq")).otherwise(F.to_json(fields)).alias("line"))


@_q("SELECT CASE WHEN action <> 'disable_index' THEN hub_id END AS hub_id, CASE WHEN action <> 'disable_index' THEN spec END AS spec, CASE WHEN action <> 'disable_index' THEN content_hash END AS content_hash, CASE WHEN action = 'disable_index' THEN concat(chr(123), 'broken ', seq) END AS line FROM {actions}")
def bulk_action_files(spark, d):
    path = _scratch(spark)
    _action_lines(spark, d).select("line").write.text(path)
    actions, errors = R.read_bulk_actions(spark, path)
    return actions.select(F.col("hubId").alias("hub_id"), F.col("dataset").alias("spec"), F.col("contentHash").alias("content_hash"), F.lit(None).cast("string").alias("line")).unionByName(errors, allowMissingColumns=True)


@_q("SELECT concat('i', doc_id) AS id, lang AS kind, source AS value, concat('s', doc_id % 5) AS system FROM {documents}")
def index_item_files(spark, d):
    path = _scratch(spark)
    item = F.concat(F.lit('<indexItem itemId="i'), "doc_id", F.lit('" itemType="'), "lang", F.lit('"><field name="dc:source" fieldType="string">'), "source", F.lit('</field><systemField name="spec">s'), F.col("doc_id") % 5, F.lit("</systemField></indexItem>"))
    # a request of up to a thousand items to a file
    requests = table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 1000).alias("_request")).agg(F.array_join(F.collect_list(item), "").alias("_items"))
    requests.select(F.concat(F.lit("<indexRequest>"), "_items", F.lit("</indexRequest>"))).write.option("maxRecordsPerFile", 1).text(path)
    items = R.read_index_items(spark, path)
    return items.select(F.col("`@itemId`").alias("id"), F.col("`@itemType`").alias("kind"), F.col("field")[0]["#text"].alias("value"), F.col("systemField")[0]["#text"].alias("system"))


@_q("SELECT hub_id AS id, spec, lang FROM {docs}")
def index_action_files(spark, d):
    """Written as lines of index actions, with other lines between them, and read again."""
    path = _scratch(spark)
    docs = table(spark, d, "docs")
    source = F.to_json(F.struct("spec", "lang"))
    line = F.concat(F.lit('{"_op_type":"index","_index":"docs","_type":"void","_id":'), F.to_json(F.array("hub_id")).substr(F.lit(2), F.length(F.to_json(F.array("hub_id"))) - 2), F.lit(',"_source":'), source, F.lit("}"))
    docs.select(F.explode(F.array(line, F.lit("# a comment")))).write.text(path)
    return R.read_index_actions(spark, path).select(F.col("_id").alias("id"), F.get_json_object("_source", "$.spec").alias("spec"), F.get_json_object("_source", "$.lang").alias("lang"))


@_q(_TWO_BATCHES)
def bulk_stream(spark, d):
    """All actions as lines of files that a stream applies to an empty snapshot: the first half, then the second with its drops and purges."""
    path = _scratch(spark)
    a = table(spark, d, "actions")
    rows = a.crossJoin(a.agg((F.max("seq") / 2).cast("long").alias("_at")))  # one row
    fields = F.struct(F.col("hub_id").alias("hubId"), F.col("spec").alias("dataset"), F.col("graph").alias("graphUri"), "action", F.col("content_hash").alias("contentHash"), F.col("acceptance").alias("acceptanceMode"), F.date_format("modified_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("modification_date"))
    for which in (F.col("seq") <= F.col("_at"), F.col("seq") > F.col("_at")):
        # the lines of a record stand in one file, in order
        rows.filter(which).repartition("hub_id").sortWithinPartitions("seq").select(F.to_json(fields)).write.mode("append").text(f"{path}/in")
        ingest.stream_bulk(spark, f"{path}/in", f"{path}/out", f"{path}/log").awaitTermination()
    return ingest.Snapshot(spark, f"{path}/out").read().select("hub_id", "content_hash")


@_q("SELECT concat('demo_', lang, '_', doc_id // 2) AS hub_id, lang AS spec FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, doc_id // 2 ORDER BY doc_id DESC) AS r FROM {documents}) WHERE r = 1 AND doc_id % 3 <> 0")
def index_item_stream(spark, d):
    """Items of which every second replaces or deletes the one before, as a stream on an empty snapshot."""
    path = _scratch(spark)
    docs = table(spark, d, "documents")
    half = F.floor(F.col("doc_id") / 2).cast("string").alias("@itemId")
    field = F.array(F.struct(F.lit("dc:source").alias("@name"), F.col("doc_id").cast("string").alias("#text"))).alias("field")
    line = F.to_json(F.struct(half, F.col("lang").alias("@itemType"), (F.col("doc_id") % 3 == 0).cast("string").alias("@delete"), field))
    docs.repartition(F.floor(F.col("doc_id") / 2), "lang").sortWithinPartitions("doc_id").select(line).write.text(f"{path}/in")
    ingest.stream_index_items(spark, f"{path}/in", f"{path}/out", f"{path}/log", "demo").awaitTermination()
    return ingest.Snapshot(spark, f"{path}/out").read().select("hub_id", "spec")


@_q("SELECT p_partkey, p_brand AS brand, upper(p_type) AS kind, length(p_name) AS n FROM {part}")
def converters_and_hooks(spark, d):
    """A converter of the caller's own by name, and hooks on its output."""
    convert.register_converter("brands", lambda docs: docs.select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), "p_name"))
    hooks = [lambda df: df.withColumn("kind", F.upper("kind")), lambda df: df.withColumn("n", F.length("p_name")).drop("p_name")]
    return convert.apply_hooks(convert.CONVERTERS["brands"](table(spark, d, "part")), hooks)


@_q(
    f"""WITH u AS (SELECT concat('{BASE}/resource/aggregation/', source, '/', doc_id) AS uri, concat('http://links.example.org/', role) AS link, c.text AS name, turn FROM {{conversations}} c JOIN {{documents}} ON conv_id = doc_id),
l AS (SELECT uri, link, arg_max(name, turn) AS name FROM u GROUP BY uri, link)
SELECT hub_id, count(link) AS links, coalesce(string_agg(l.name, '|' ORDER BY link), '') AS names FROM {{docs}} d LEFT JOIN l ON d.source_uri = l.uri GROUP BY hub_id"""
)
def user_content(spark, d):
    """Turns of conversations as contributions to records, on their page, data and resource under another host of ours."""
    c, docs = table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("name")), table(spark, d, "documents").select("doc_id", "source")
    joined = c.join(docs, F.col("conv_id") == F.col("doc_id"))
    kind = F.element_at(F.array(F.lit("page"), F.lit("data"), F.lit("resource")), (F.col("turn") % 3 + 1).cast("int"))
    content = joined.select(F.concat(F.lit("http://acc.example.org/"), kind, F.lit("/aggregation/"), "source", F.lit("/"), "doc_id").alias("source_uri"), F.concat(F.lit("http://links.example.org/"), "role").alias("link"), "name", F.col("turn").alias("seq"))
    made = attach_user_content(table(spark, d, "docs"), content, ["acc.example.org"], BASE)
    return made.select("hub_id", F.size("user_content").cast("long").alias("links"), F.array_join(F.transform("user_content", lambda x: x["name"]), "|").alias("names"))


@_q("SELECT spec, kind, ext, count(*) AS files FROM (SELECT DISTINCT concat('n', n_regionkey) AS spec, kind, 'txt' AS ext, n_nationkey FROM {nation}, (VALUES ('source'), ('thumbnail')) v(kind)) GROUP BY spec, kind, ext")
def media_manifest(spark, d):
    """Files of one row for each nation, by spec and kind, listed again without their contents."""
    path = _scratch(spark)
    # a row to a file; 25 nations in five specs
    rows = table(spark, d, "nation").select("n_regionkey", "n_name")
    for key in range(5):
        for kind in ("source", "thumbnail"):
            rows.filter(F.col("n_regionkey") == key).select("n_name").write.option("maxRecordsPerFile", 1).text(f"{path}/n{key}/{kind}")
    return R.read_media_manifest(spark, path).filter(F.col("ext") == "txt").groupBy("spec", "kind", "ext").agg(F.count(F.lit(1)).alias("files"))


@_q("SELECT hub_id, spec, replace(title, chr(34), chr(39)) AS title FROM {docs}")
def exported_results(spark, d):
    """All records written as JSON through a converter that has " as ', as raw values do, and read again."""
    from .search_queries import text_docs

    path = _scratch(spark)
    flat = lambda docs: docs.select("hub_id", F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("key"), F.transform(e["value"], lambda x: F.translate(x["value"], '"', "'")).alias("values"))).alias("flat"))
    W.export_results(text_docs(spark, d), flat, path)
    back = spark.read.schema("hub_id string, fields map<string,array<string>>").json(path)
    return back.select("hub_id", F.col("fields")["edm_dataProvider"][0].alias("spec"), F.col("fields")["dc_title"][0].alias("title"))


@_q("SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), '-') AS page, CASE WHEN url LIKE '%utm_source=feed%' THEN 'feed' ELSE '-' END AS source FROM {pages}")
def query_log_stream(spark, d):
    """Requests as files that a stream appends to a log, in two runs."""
    path = _scratch(spark)
    pages = table(spark, d, "pages").select("page_id", F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.concat(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit("&id="), "page_id").alias("raw_query"))
    for which in (F.col("page_id") % 2 == 0, F.col("page_id") % 2 == 1):
        pages.filter(which).select("created_at", "raw_query").write.mode("append").json(f"{path}/in")
        ingest.stream_query_log(spark, f"{path}/in", f"{path}/out", f"{path}/log").awaitTermination()
    value = lambda k: F.coalesce(F.try_element_at(F.try_element_at("query_params", F.lit(k)), F.lit(1)), F.lit("-"))
    return spark.read.parquet(f"{path}/out").select(value("id").cast("long").alias("page_id"), value("page").alias("page"), value("utm_source").alias("source"))
