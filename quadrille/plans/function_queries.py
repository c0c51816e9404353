"""Queries of the scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import ids as I
from ..functions import namespaces as N
from ..functions import text as T
from ..registry import query
from .bridge import BASE, plain, table


def _q(sql: str):
    return query(plain(sql))



@_q("SELECT doc_id, regexp_replace(translate(translate(title, ': +/', '----'), '_', '-'), '-{2,10}', '-', 'g') AS local_id, regexp_replace(translate(hub_id, ': +/', '----'), '-{2,10}', '-', 'g') AS hub_id FROM {docs}")
def clean_local_ids(spark, d):
    return table(spark, d, "docs").select("doc_id", I.clean_local_id(F.col("title")).alias("local_id"), I.clean_local_id(F.col("hub_id"), is_hub_id=True).alias("hub_id"))


@_q(f"SELECT doc_id, hub_id AS from_uri, hub_id AS from_graph, concat('demo_', lower(spec), '_', doc_id) AS item_id, concat('{BASE}/resource/', spec, '/', doc_id) AS item_uri FROM {{docs}}")
def hub_ids(spark, d):
    docs = table(spark, d, "docs")
    graph = I.named_graph(F.col("source_uri"))
    return docs.select("doc_id", I.hub_id_from_uri(F.col("source_uri"), "demo").alias("from_uri"), I.hub_id_from_graph(graph, "demo", F.col("spec")).alias("from_graph"), I.index_item_hub_id("demo", F.upper("spec"), F.col("doc_id").cast("string")).alias("item_id"), I.index_item_uri(BASE, F.upper("spec"), F.col("doc_id").cast("string")).alias("item_uri"))


@_q(f"SELECT doc_id, concat(source_uri, '/graph') AS graph, concat(source_uri, '/about') AS about, source_uri AS source, spec, concat('{BASE}/resource/dataset/', spec) AS dataset FROM {{docs}}")
def graph_uris(spark, d):
    docs = table(spark, d, "docs")
    graph = I.named_graph(F.concat("source_uri", F.lit("//")))
    return docs.select("doc_id", graph.alias("graph"), I.about_uri(F.col("source_uri")).alias("about"), I.source_uri(graph).alias("source"), I.spec_from_uri(F.col("source_uri")).alias("spec"), I.dataset_uri(BASE, F.col("spec")).alias("dataset"))


@_q("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'typed' WHEN doc_id % 3 = 1 THEN 'hub' ELSE 'invalid' END AS kind FROM {docs}")
def id_kinds(spark, d):
    c = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("demo_void__"), "doc_id")).when(F.col("doc_id") % 3 == 1, F.col("hub_id")).otherwise(F.col("doc_id").cast("string"))
    return table(spark, d, "docs").select("doc_id", I.id_kind(c).alias("kind"))


@_q("SELECT doc_id, sha1(text) AS content_hash, sha256(source_uri) AS media_hash, concat('thumbnail/', substring(sha256(source_uri), 1, 3), '/', substring(sha256(source_uri), 4, 3), '/', substring(sha256(source_uri), 7, 3), '/', sha256(source_uri)) AS path FROM {docs}")
def hashes(spark, d):
    return table(spark, d, "docs").select("doc_id", I.content_hash(F.col("text")).alias("content_hash"), I.media_hash(F.col("source_uri")).alias("media_hash"), I.media_path(F.lit("thumbnail"), F.col("source_uri")).alias("path"))


@_q("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'urn' ELSE 'cached' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 's1' END AS spec, CAST(o_orderkey AS STRING) AS object_number FROM {orders}")
def media_uris(spark, d):
    uri = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("urn:s1/"), "o_orderkey", F.lit("__2.jpg"))).otherwise(F.concat(F.lit("http://x.example.org/s1/"), "o_orderkey", F.lit(".jpg")))
    p = I.media_uri_parts(uri)
    return table(spark, d, "orders").select("o_orderkey", p["kind"].alias("kind"), p["spec"].alias("spec"), p["object_number"].alias("object_number"))


@_q("SELECT page_id, nullif(regexp_extract(url, 'utm_source=([^&#]*)', 1), '') AS source, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM {pages}")
def media_params(spark, d):
    p = I.media_api_params(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")))
    return table(spark, d, "pages").select("page_id", F.try_element_at(p, F.lit("utm_source")).alias("source"), F.try_element_at(p, F.lit("ref")).alias("ref"))


@_q("SELECT o_orderkey, concat('http://m/api/webresource?docType=thumbnail&uri=urn:s1/', o_orderkey, '&spec=s1&width=220&height=220') AS thumb, concat('http://m/api/webresource?docType=deepzoom&uri=urn:s1/', o_orderkey, '&spec=s1') AS deep, 4 AS n FROM {orders}")
def derivatives(spark, d):
    u = I.derivative_urls(F.concat(F.lit("urn:s1/"), "o_orderkey"), F.lit("s1"), "http://m")
    return table(spark, d, "orders").select("o_orderkey", u[0].alias("thumb"), u[2].alias("deep"), F.size(u).alias("n"))


@_q(f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat('http://new.example.org/resource/a b/', page_id) ELSE url END AS uri, CASE WHEN page_id % 2 = 0 THEN concat('{BASE}/resource/cache/old.example.org/resource/a%20b/', page_id) ELSE concat('{BASE}/resource/cache/', regexp_replace(url, '^https?://', '')) END AS cached FROM {{pages}}")
def rebased_uris(spark, d):
    u = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("http://old.example.org/resource/a%20b/"), "page_id")).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", I.rebase_uri(u, ["old.example.org"], "http://new.example.org").alias("uri"), I.cache_url(u, BASE).alias("cached"))


_LOCAL = "regexp_replace(p, '^(.*#|[^#]*/)', '')"
_PFX = "CASE WHEN p LIKE 'http://purl.org/dc/elements%' THEN 'dc' WHEN p LIKE '%schemas/edm%' THEN 'edm' WHEN p LIKE '%example.org/qterm%' THEN 'qterm' WHEN p LIKE '%skos%' THEN 'skos' WHEN p LIKE '%dc/terms%' THEN 'dcterms' WHEN p LIKE '%wgs84%' THEN 'wgs84_pos' WHEN p LIKE '%rdf-syntax%' THEN 'rdf' END"


@_q(f"SELECT DISTINCT p, concat({_PFX}, ':', {_LOCAL}) AS qname, concat({_PFX}, '_', {_LOCAL}) AS search_label, p AS back, concat('{{', regexp_extract(p, '^(.*#|[^#]*/)', 1), '}}', {_LOCAL}) AS tag FROM {{quads}}".replace("{{quads}}", "{quads}").replace("'{{'", "'{'").replace("'}}'", "'}'"))
def qnames(spark, d):
    p = F.col("p")
    return table(spark, d, "quads").select("p").distinct().select("p", N.to_qname(p).alias("qname"), N.search_label(p).alias("search_label"), N.label_to_iri(N.search_label(p)).alias("back"), N.namespaced_tag(p).alias("tag"))


@_q("SELECT doc_id, concat('qterm_', lang) AS a, concat('edm_', lang) AS b, 'system.spec.raw' AS c, concat('legacy.qsite_', lang) AS d, 'qsite_year.raw' AS e FROM {docs}")
def field_keys(spark, d):
    k = lambda s, t="": F.concat(F.lit(s), "lang", F.lit(t))
    return table(spark, d, "docs").select("doc_id", T.normalise_field(k("icn_", "_facet")).alias("a"), T.normalise_field(k("europeana_", "_text")).alias("b"), T.facet_key(F.lit("qsite_spec")).alias("c"), T.facet_key(k("qsite_")).alias("d"), T.facet_key(F.lit("-qsite_year")).alias("e"))


@_q("SELECT doc_id, doc_id % 4 <> 3 AS fielded, CASE doc_id % 4 WHEN 0 THEN concat('dc_subject.raw:', lang) WHEN 1 THEN concat('legacy.qsite_owner.value:', lang) WHEN 2 THEN concat('system.spec.raw:', spec, ' AND b') ELSE concat('plain ', lang) END AS query FROM {docs}")
def rewritten_queries(spark, d):
    i = F.col("doc_id") % 4
    q = F.when(i == 0, F.concat(F.lit("dc_subject_facet:"), "lang")).when(i == 1, F.concat(F.lit("qsite_owner:"), "lang")).when(i == 2, F.concat(F.lit("qsite_spec:"), "spec", F.lit(" AND b"))).otherwise(F.concat(F.lit("plain "), "lang"))
    return table(spark, d, "docs").select("doc_id", T.is_fielded(q).alias("fielded"), T.rewrite_query(q).alias("query"))


@_q("SELECT doc_id, concat('dc_subject=', lang, '|dc_subject=', spec, '|legacy.qsite_owner=a:b', '|query=x OR y') AS filters FROM {docs}")
def parsed_filters(spark, d):
    f = F.array(F.concat(F.lit("dc_subject_facet:"), "spec"), F.concat(F.lit("dc_subject:"), "lang"), F.lit("qsite_owner:a:b"), F.lit("x OR y"), F.lit(""), F.concat(F.lit("dc_subject:"), "lang"))
    p = T.parse_filters(f)
    return table(spark, d, "docs").select("doc_id", F.array_join(F.transform(p, lambda x: F.concat_ws("=", x["field"], x["value"])), "|").alias("filters"))


@_q("SELECT page_id, concat('qf=lang:', page_id, '|facet=dc_subject.raw|page=', nullif(regexp_extract(url, 'page=([0-9]+)', 1), ''), '|ref=x') AS params, concat('lang:', page_id) AS filters FROM {pages} WHERE url LIKE '%page=%ref=x'")
def query_params(spark, d):
    q = F.concat(F.lit("qf[]=lang%3A"), "page_id", F.lit("&facet.field[]=dc_subject_facet&_=1&"), F.regexp_extract("url", r"\?(.*)$", 1))
    p = T.clean_params(q)
    rows = table(spark, d, "pages").filter("url like '%page=%ref=x'")
    return rows.select("page_id", F.array_join(F.transform(p, lambda x: F.concat_ws("=", x["key"], x["value"])), "|").alias("params"), F.array_join(T.parse_collection_query(F.concat(F.lit("http://x/?"), q)), "|").alias("filters"))


@_q("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type = 'click' END AS b, CASE WHEN event_id % 3 = 1 THEN event_id END AS i, CASE WHEN event_id % 3 = 2 THEN props END AS t FROM {events}")
def typed_literals(spark, d):
    k = F.col("event_id") % 3
    o = F.when(k == 0, F.when(F.col("event_type") == "click", "TRUE").otherwise("no")).when(k == 1, F.col("event_id").cast("string")).otherwise(F.col("props"))
    t = T.typed_literal(o, F.when(k == 0, T.XSD + "boolean").when(k == 1, T.XSD + "integer"))
    return table(spark, d, "events").select("event_id", t["bool"].alias("b"), t["int"].alias("i"), t["text"].alias("t"))


@_q("SELECT doc_id, CASE WHEN length(text) > 32765 THEN 32700 ELSE length(text) END AS n, translate(left(text, 256), '\"', '''') AS raw FROM {docs}")
def index_entries(spark, d):
    e = T.index_entry(F.col("text"), F.lit("Literal"), F.col("lang"))
    return table(spark, d, "docs").select("doc_id", F.length(e["value"]).cast("long").alias("n"), e["raw"].alias("raw"))


@_q("SELECT doc_id, replace(title, chr(10), '') AS clean FROM {docs}")
def control_chars(spark, d):
    return table(spark, d, "docs").select("doc_id", T.strip_control_chars(F.concat("title", F.lit("\u0007"))).alias("clean"))


@_q("SELECT p_partkey, concat('part ', lpad(CAST(p_partkey AS STRING), 20, '0'), '-b', lpad(CAST(p_size AS STRING), 20, '0')) AS k FROM {part}")
def natural_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", T.natural_key(F.concat(F.lit("Part "), "p_partkey", F.lit("-B"), "p_size")).alias("k"))


@_q(f"SELECT p_partkey, lower(replace(p_name, ' ', '-')) || '@en' AS slug, concat('{BASE}/d/nl/', replace(p_name, ' ', '_')) AS field_uri FROM {{part}}")
def proxy_uris(spark, d):
    return table(spark, d, "part").select("p_partkey", I.proxy_slug(F.concat(F.lit("("), F.replace(F.col("p_name"), F.lit(" "), F.lit(" - ")), F.lit(")")), F.lit("en")).alias("slug"), I.proxy_field_uri(F.lit(f"{BASE}/d"), F.col("p_name"), F.lit("nl")).alias("field_uri"))


@_q("SELECT proxy, spec, field AS search_label, concat(lower(label), '@en') AS label FROM {proxies}")
def split_proxies(spark, d):
    s = I.split_proxy_uri(F.col("proxy"))
    return table(spark, d, "proxies").select("proxy", s["spec"].alias("spec"), s["search_label"].alias("search_label"), s["label"].alias("label"))


@_q("SELECT hub_id, CASE WHEN hub_id NOT LIKE '%7' THEN round(lat, 2) END AS lat FROM {points}")
def parsed_points(spark, d):
    txt = F.when(F.col("hub_id").endswith("7"), "3,447957107 x").otherwise(F.concat_ws(",", F.round("lat", 2), F.round("lon", 2)))
    return table(spark, d, "points").select("hub_id", G.parse_point(txt)["lat"].alias("lat"))



def _bits():
    """SQL of a geohash of 5 characters from its two cell numbers."""
    out = []
    for k in range(5):
        terms = []
        for j, b in enumerate(range(5 * k, 5 * k + 5)):
            src, shift = (("x", 12 - b // 2), ("y", 11 - b // 2))[b % 2]
            terms.append(f"(({src} // {1 << shift}) % 2) * {16 >> j}")
        out.append(f"substring('{G.ALPHABET}', CAST({' + '.join(terms)} + 1 AS INTEGER), 1)")
    return "concat(" + ", ".join(out) + ")"


@_q(f"SELECT hub_id, {_bits()} AS cell, round((y + 0.5) * 180 / 4096 - 90, 6) AS lat, round((x + 0.5) * 360 / 8192 - 180, 6) AS lon FROM (SELECT hub_id, CAST(greatest(ceil((lon + 180) / 360 * 8192) - 1, 0) AS BIGINT) AS x, CAST(greatest(ceil((lat + 90) / 180 * 4096) - 1, 0) AS BIGINT) AS y FROM {{points}})")
def geohashes(spark, d):
    p = table(spark, d, "points").withColumn("cell", G.geohash_encode(F.col("lat"), F.col("lon"), 5))
    e = G.geohash_decode_exactly(F.col("cell"), 5)
    return p.select("hub_id", "cell", F.round(e["lat"], 6).alias("lat"), F.round(e["lon"], 6).alias("lon"))


def _rd_sql(terms, start):
    s = " + ".join(f"({c}) * pow(dx, {p}) * pow(dy, {q})" for (p, q), c in terms.items())
    return f"round(ceil(({start} + ({s}) / 3600) * 1e6) / 1e6, 5)"


@_q(f"SELECT o_orderkey, {_rd_sql(G._LON, 5.38720621)} AS lon, {_rd_sql(G._LAT, 52.1551744)} AS lat FROM (SELECT o_orderkey, (o_orderkey % 200000 + 20000.0 - 155000.0) / 100000.0 AS dx, (o_custkey % 200000 + 350000.0 - 463000.0) / 100000.0 AS dy FROM {{orders}})")
def grid_points(spark, d):
    w = G.rd_to_wgs84(F.col("o_orderkey") % 200000 + F.lit(20000.0), F.col("o_custkey") % 200000 + F.lit(350000.0))
    return table(spark, d, "orders").select("o_orderkey", F.round(w["lon"], 5).alias("lon"), F.round(w["lat"], 5).alias("lat"))


@_q("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'degrees' WHEN 1 THEN 'grid' ELSE 'none' END AS kind FROM {part}")
def bounding_boxes(spark, d):
    k = F.col("p_partkey") % 3
    one = lambda deg, grid, mix: F.when(k == 0, deg).when(k == 1, grid).otherwise(mix)
    box = G.parse_bbox(one("51.5", "85530", "51.5"), one("4.1", "446100", "446100"), one("52.5", "86530", "52.5"), one("5.1", "447100", "5"))
    return table(spark, d, "part").select("p_partkey", F.when(box.isNull(), "none").when(k == 0, "degrees").otherwise("grid").alias("kind"))


@_q("SELECT doc_id, base64(encode(concat('prefix=edm::from=2024-01-01::until=::set=', spec, '::cursor=', doc_id, '::list_size=4432'))) AS token, spec AS set_spec, CAST(doc_id AS STRING) AS \"cursor\" FROM {docs}")
def tokens(spark, d):
    t = T.encode_token(F.lit("edm"), F.lit("2024-01-01"), F.lit(None), F.col("spec"), F.col("doc_id"), F.lit(4432))
    back = T.decode_token(F.col("token"))
    return table(spark, d, "docs").select("doc_id", t.alias("token"), "spec").select("doc_id", "token", back["set"].alias("set_spec"), back["cursor"].alias("cursor"))


@_q("SELECT event_id, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '+0000') AS full, concat(strftime(ts, '%Y-%m-%d'), 'T00:00:00+0000') AS day FROM {events}")
def request_dates(spark, d):
    return table(spark, d, "events").select("event_id", T.fmt_date(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("full"), T.fmt_date(F.date_format("ts", "yyyy-MM-dd")).alias("day"))


@_q("SELECT event_id, event_id % 3 = 0 AS flag, concat(chr(123), '\"dc_title\":\"', event_type, '\"', chr(125)) AS preview FROM {events}")
def flags_and_previews(spark, d):
    o = F.when(F.col("event_id") % 3 == 0, "True").when(F.col("event_id") % 3 == 1, "false")
    return table(spark, d, "events").select("event_id", I.edm_boolean(o).alias("flag"), T.inline_preview_json(F.create_map(F.lit("dc_title"), "event_type")).alias("preview"))
