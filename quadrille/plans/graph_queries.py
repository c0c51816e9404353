"""Queries on record graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import graph as G
from ..operators import thesaurus as T
from ..registry import query
from .bridge import BASE, DC, DCT, EDM, QSYNC, QTERM, ORE, RDF_TYPE, SKOS, WGS, plain, table


def _q(sql: str):
    return query(plain(sql))


_ALL = "graph, s, p, o, o_kind, lang"
_LABEL_RANK = f"CASE p WHEN '{SKOS}prefLabel' THEN 1 WHEN '{DC}title' THEN 6 END"
_OWN = f"WITH q AS MATERIALIZED (SELECT * FROM {{quads}}), c AS (SELECT * FROM {{concepts}}) "


@_q(_OWN + f"SELECT {_ALL} FROM q WHERE p <> '{RDF_TYPE}' AND p NOT LIKE '{QSYNC}%'")
def filter_properties(spark, d):
    return G.filter_properties(table(spark, d, "quads")).select(*_ALL.split(", "))


@_q(_OWN + "SELECT graph, p, string_agg(DISTINCT o, '|' ORDER BY o) AS vals FROM q WHERE o_kind = 'Literal' AND (lang IS NULL OR lang = 'nl') GROUP BY graph, p")
def filter_languages(spark, d):
    return G.filter_languages(table(spark, d, "quads"), ["nl"]).select("graph", "p", F.array_join("values", "|").alias("vals"))


@_q(_OWN + f"SELECT {_ALL} FROM q WHERE s = '{BASE}/place/3' OR graph = '{BASE}/resource/aggregation/n3/1/graph'")
def select_subject(spark, d):
    q = table(spark, d, "quads")
    return G.select_subject(q, f"{BASE}/place/3").unionByName(G.select_subject(q, f"{BASE}/resource/aggregation/n3/1/about")).select(*_ALL.split(", "))


@_q(_OWN + f"SELECT graph, coalesce(bool_and(CASE WHEN p = '{QTERM}allowLinkedOpenData' THEN lower(o) = 'true' END), TRUE) AS lod FROM q GROUP BY graph")
def lod_allowed(spark, d):
    return G.lod_allowed(table(spark, d, "quads"))


@_q(_OWN + f"SELECT {_ALL} FROM (SELECT DISTINCT * FROM q) UNION ALL SELECT DISTINCT graph, replace(graph, '/graph', ''), '{ORE}aggregates', s, 'BNode', CAST(NULL AS STRING) FROM q WHERE p = '{RDF_TYPE}' AND o = '{EDM}Place'")
def aggregate_bnodes(spark, d):
    q = table(spark, d, "quads")
    # places as blank nodes typed in the record terms
    place = (F.col("p") == RDF_TYPE) & (F.col("o") == f"{EDM}Place")
    marked = q.withColumn("s_kind", F.when(place, "BNode").otherwise(F.col("s_kind"))).withColumn("o", F.when(place, F.lit(QTERM + "Place")).otherwise(F.col("o")))
    about = q.select("graph", F.regexp_replace("graph", "/graph$", "").alias("about")).distinct()
    return G.aggregate_bnodes(marked, about).withColumn("o", F.when(F.col("o") == QTERM + "Place", F.lit(EDM + "Place")).otherwise(F.col("o"))).select(*_ALL.split(", "))


@_q(_OWN + f"SELECT graph, CASE WHEN p = '{EDM}hasView' THEN o ELSE s END AS s, CASE WHEN p = '{EDM}hasView' THEN '{ORE}aggregates' ELSE p END AS p, CASE WHEN p = '{EDM}hasView' THEN s ELSE o END AS o FROM q")
def invert_aggregated_by(spark, d):
    q = table(spark, d, "quads").withColumn("p", F.when(F.col("p") == EDM + "hasView", F.lit(ORE + "isAggregatedBy")).otherwise(F.col("p")))
    return G.invert_aggregated_by(q).select("graph", "s", "p", "o")


@_q(
    f"""WITH r AS (SELECT concat('{BASE}/part/', p_partkey) AS uri, p_name, p_brand, concat('http://img.example.org/', p_partkey) AS img, p_type FROM {{part}})
SELECT concat(uri, '/graph') AS graph, s, p, o, CASE WHEN o LIKE 'http%' THEN 'URIRef' ELSE 'Literal' END AS o_kind FROM (
 SELECT uri, uri AS s, '{DC}title' AS p, p_name AS o FROM r UNION ALL SELECT uri, uri, '{DC}subject', p_brand FROM r UNION ALL SELECT uri, uri, '{DC}subject', p_type FROM r
 UNION ALL SELECT uri, uri, '{EDM}hasView', img FROM r UNION ALL SELECT uri, img, '{RDF_TYPE}', '{EDM}WebResource' FROM r)"""
)
def rows_to_quads(spark, d):
    part = table(spark, d, "part").select(F.concat(F.lit(f"{BASE}/part/"), "p_partkey").alias("uri"), "p_name", F.array("p_brand", "p_type").alias("subjects"), F.concat(F.lit("http://img.example.org/"), "p_partkey").alias("img"))
    return G.rows_to_quads(part, {"p_name": DC + "title", "subjects": DC + "subject", "img": EDM + "hasView"}).select("graph", "s", "p", "o", "o_kind")


_ABOUT = [("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "'http://xmlns.com/foaf/0.1/Document'"), ("http://xmlns.com/foaf/0.1/primaryTopic", "source_uri"), (DCT + "created", "'2024-01-01'"), (DCT + "modified", "strftime(modified_at, '%Y-%m-%d')"), ("http://creativecommons.org/ns#license", "'http://creativecommons.org/publicdomain/zero/1.0/'"), ("http://creativecommons.org/ns#attributionName", "spec"), ("http://creativecommons.org/ns#attributionURL", "source_uri"), (QTERM + "hubId", "hub_id"), (QTERM + "spec", "spec"), (QTERM + "allowLinkedOpenData", "'true'")]


@_q("WITH d AS (SELECT * FROM {docs}) " + " UNION ALL ".join(f"SELECT concat(source_uri, '/graph') AS graph, concat(source_uri, '/about') AS s, '{p}' AS p, {o} AS o FROM d" for p, o in _ABOUT))
def add_about_triples(spark, d):
    docs = table(spark, d, "docs").select("source_uri", "hub_id", "spec", F.lit("2024-01-01").alias("created"), F.date_format("modified_at", "yyyy-MM-dd").alias("modified"), F.lit("http://creativecommons.org/publicdomain/zero/1.0/").alias("licence"), F.col("spec").alias("attribution"), F.lit("true").alias("lod"))
    return G.add_about_triples(docs).select("graph", "s", "p", "o")


@_q(
    _OWN + f""", best AS (SELECT graph, s, arg_min(o, {_LABEL_RANK}) AS label, arg_min(coalesce(lang, '-'), {_LABEL_RANK}) AS ll FROM q WHERE o_kind = 'Literal' AND p IN ('{SKOS}prefLabel', '{DC}title') GROUP BY graph, s)
SELECT q.graph, q.s, q.p, q.o, coalesce(label, q.o) AS label, coalesce(nullif(ll, '-'), q.lang) AS label_lang FROM q LEFT JOIN best b ON q.graph = b.graph AND q.o = b.s AND q.o_kind <> 'Literal'"""
)
def resolve_labels(spark, d):
    return G.resolve_labels(table(spark, d, "quads")).select("graph", "s", "p", "o", "label", "label_lang")


_PROXIED = f"""
SELECT concat('{BASE}/rec/', c_custkey, '/graph') AS graph, concat('{BASE}/rec/', c_custkey) AS s, concat('n', c_nationkey) AS spec, c_mktsegment AS label FROM {{customer}}"""


def _proxied(spark, d):
    """Records that refer to proxies, whose triples are in the record's graph."""
    recs = spark.sql(_PROXIED, customer=table(spark, d, "customer"))
    p = table(spark, d, "proxies")
    j = recs.join(p, ["spec", "label"])
    null = F.lit(None).cast("string")
    row = lambda s, pr, o, k: F.struct(s.alias("s"), F.lit(pr).alias("p"), o.alias("o"), F.lit(k).alias("o_kind"))
    rows = F.array(
        row(F.col("s"), DC + "subject", F.col("proxy"), "URIRef"),
        row(F.col("proxy"), RDF_TYPE, F.lit(QSYNC + "ProxyResource"), "URIRef"),
        row(F.col("proxy"), QSYNC + "proxyLiteralValue", F.col("label"), "Literal"),
        row(F.col("proxy"), SKOS + "exactMatch", F.col("concept"), "URIRef"),
    )
    return j.select("graph", F.explode(rows).alias("t")).filter("t.o is not null").select("graph", "t.s", F.lit("URIRef").alias("s_kind"), "t.p", "t.o", "t.o_kind", null.alias("datatype"), null.alias("lang"))


@_q(f"SELECT graph, s, '{DC}subject' AS p, coalesce(concept, r.label) AS o, CASE WHEN concept IS NULL THEN 'Literal' ELSE 'URIRef' END AS o_kind FROM ({_PROXIED}) r JOIN {{proxies}} p ON r.spec = p.spec AND r.label = p.label")
def inline_enrichments(spark, d):
    return G.inline_enrichments(_proxied(spark, d)).select("graph", "s", "p", "o", "o_kind")


@_q(_OWN + f"SELECT graph, s, p, o FROM q WHERE s IN (SELECT concat('{BASE}/place/', n_nationkey) FROM {{nation}} WHERE n_regionkey = 1)")
def describe(spark, d):
    targets = table(spark, d, "nation").filter("n_regionkey = 1").select(F.concat(F.lit(f"{BASE}/place/"), "n_nationkey").alias("uri"))
    return G.describe(table(spark, d, "quads"), targets).select("graph", "s", "p", "o")


@_q(
    _OWN + f""", d AS (SELECT DISTINCT s, p, o FROM c)
SELECT a.s, a.p, a.o, b.p AS p2, b.o AS o2 FROM d a LEFT JOIN d b ON a.o = b.s AND a.p <> '{RDF_TYPE}' WHERE a.s LIKE '{BASE}/place/%'"""
)
def context_one_hop(spark, d):
    c = table(spark, d, "concepts")
    return G.context_one_hop(c, c.filter(F.col("s").startswith(f"{BASE}/place/")).select(F.col("s").alias("uri")))


@_q(
    f"""WITH p AS (SELECT * FROM {{proxies}}), r AS ({_PROXIED}),
l1 AS (SELECT DISTINCT s, '{DC}subject' AS p, proxy AS o FROM r JOIN p ON r.spec = p.spec AND r.label = p.label),
l2 AS (SELECT DISTINCT proxy AS s, '{RDF_TYPE}' AS p, '{QSYNC}ProxyResource' AS o FROM p WHERE proxy IN (SELECT o FROM l1)
 UNION SELECT DISTINCT proxy, '{QSYNC}proxyLiteralValue', label FROM p WHERE proxy IN (SELECT o FROM l1)
 UNION SELECT DISTINCT proxy, '{SKOS}exactMatch', concept FROM p WHERE concept IS NOT NULL AND proxy IN (SELECT o FROM l1))
SELECT 1 AS level, * FROM l1 UNION ALL SELECT 2, * FROM l2"""
)
def context_graph(spark, d):
    q = _proxied(spark, d)
    targets = q.filter(F.col("p") == DC + "subject").select(F.col("s").alias("uri"))
    return G.context_graph(q, targets).select("level", "s", "p", "o")


@_q(
    _OWN + f""", own AS (SELECT DISTINCT s, p, o FROM c WHERE s LIKE '{BASE}/place/%')
SELECT * FROM own UNION SELECT s, p, o FROM c WHERE p = '{SKOS}prefLabel' AND s IN (SELECT o FROM own)"""
)
def concept_context(spark, d):
    c = table(spark, d, "concepts")
    return G.concept_context(c, c.filter(F.col("s").startswith(f"{BASE}/place/")).select(F.col("s").alias("uri")))


@_q(_OWN + f"SELECT q.graph, s, p, o FROM q JOIN (SELECT DISTINCT graph FROM q WHERE p = '{EDM}hasView') v ON q.graph = v.graph")
def media_context(spark, d):
    return G.media_context(table(spark, d, "quads")).select("graph", "s", "p", "o")


@_q(f"SELECT DISTINCT concept, concat('{BASE}/rec/', c_custkey) AS s, concat('{BASE}/rec/', c_custkey, '/graph') AS graph FROM {{customer}} JOIN (SELECT * FROM {{proxies}}) p ON concat('n', c_nationkey) = p.spec AND c_mktsegment = label WHERE concept IS NOT NULL")
def concept_links(spark, d):
    q = _proxied(spark, d)
    direct = G.inline_enrichments(q)
    return G.concept_links(direct.unionByName(q.filter(F.col("p") == SKOS + "exactMatch").withColumn("graph", F.lit("proxies"))))


@_q(_OWN + f"SELECT graph, s, p, o FROM q UNION SELECT graph, o AS s, '{QTERM}cacheUrl' AS p, concat('{BASE}/resource/cache/', regexp_replace(o, '^https?://', '')) AS o FROM q WHERE o_kind = 'URIRef' AND o LIKE 'http%'")
def cached_source(spark, d):
    return G.cached_source(table(spark, d, "quads"), BASE).select("graph", "s", "p", "o")


@_q(
    f"""SELECT concat('{BASE}/resource/aggregation/n', c.c_nationkey, '/', c.c_custkey, '/graph') AS graph, concat('{BASE}/resource/aggregation/n', n.c_nationkey, '/', n.c_custkey) AS o,
 concat(chr(123), '"dc_title":"', n.c_name, '"', chr(125)) AS preview FROM {{customer}} c JOIN (SELECT c_custkey - 1 AS before, c_name, c_nationkey, c_custkey FROM {{customer}}) n ON c.c_custkey = n.before"""
)
def inline_previews(spark, d):
    q = table(spark, d, "quads")
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit(f"{BASE}/resource/aggregation/n"), "c_nationkey", F.lit("/"), "c_custkey").alias("iri"))
    nxt = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("iri").alias("o"))
    null = F.lit(None).cast("string")
    rel = c.join(nxt, "c_custkey").select(F.concat("iri", F.lit("/graph")).alias("graph"), F.col("iri").alias("s"), F.lit("URIRef").alias("s_kind"), F.lit(DC + "relation").alias("p"), "o", F.lit("URIRef").alias("o_kind"), null.alias("datatype"), null.alias("lang"))
    return G.inline_previews(q.unionByName(rel), {DC + "title": "dc_title"}, f"{BASE}/resource/aggregation/").select("graph", "o", "preview")


@_q(_OWN + f"SELECT graph, s, p, o FROM (SELECT *, row_number() OVER (PARTITION BY graph, p ORDER BY s, o) AS r FROM q) WHERE p <> '{EDM}hasView' OR r <= 2 UNION ALL SELECT graph, 'removed', '', CAST(count(*) - 2 AS VARCHAR) FROM q WHERE p = '{EDM}hasView' GROUP BY graph HAVING count(*) > 2")
def reduce_duplicates(spark, d):
    """The triples that stay, and how many of each graph went."""
    kept, removed = G.reduce_duplicates(table(spark, d, "quads"), [EDM + "hasView"], 2)
    gone = removed.filter("removed > 0").select("graph", F.lit("removed").alias("s"), F.lit("").alias("p"), F.col("removed").cast("string").alias("o"))
    return kept.select("graph", "s", "p", "o").unionByName(gone)


@_q(
    _OWN + f"""SELECT graph, s, row_number() OVER (PARTITION BY graph ORDER BY coalesce(k, 0), s)::INTEGER AS place
FROM (SELECT graph, s, max(CASE WHEN p = '{QTERM}resourceSortOrder' THEN CAST(o AS INTEGER) END) AS k FROM q WHERE s LIKE 'urn:%' GROUP BY graph, s)"""
)
def order_media(spark, d):
    return G.order_media(table(spark, d, "quads"))


@_q(
    _OWN + f""", m AS (SELECT graph, o, row_number() OVER (PARTITION BY graph ORDER BY coalesce(k, 0), o)::INTEGER AS place
 FROM (SELECT graph, s AS o, max(CASE WHEN p = '{QTERM}resourceSortOrder' THEN CAST(o AS INTEGER) END) AS k FROM q WHERE s LIKE 'urn:%' GROUP BY graph, s))
SELECT graph, s, p, o, NULL::INTEGER AS place FROM q WHERE p <> '{EDM}hasView' UNION ALL SELECT graph, replace(graph, '/graph', ''), '{EDM}hasView', o, place FROM m"""
)
def views_in_order(spark, d):
    """Record graphs that don't tell about a third of their views."""
    q = table(spark, d, "quads")
    told = q.filter(~((F.col("p") == EDM + "hasView") & (F.crc32("o") % 3 == 0)))
    return G.views_in_order(told).select("graph", "s", "p", "o", "place")


@_q(_OWN + f"SELECT graph, min(o) AS thumbnail FROM q WHERE p = '{QTERM}thumbnail' GROUP BY graph")
def pick_thumbnail(spark, d):
    return G.pick_thumbnail(table(spark, d, "quads"))


@_q(
    _OWN + f""", k AS (SELECT 'language' AS kind, lang AS value FROM q WHERE lang IS NOT NULL UNION ALL SELECT 'class', o FROM q WHERE p = '{RDF_TYPE}' UNION ALL SELECT 'property', p FROM q)
SELECT kind, value, n FROM (SELECT kind, value, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, value) AS r FROM k GROUP BY kind, value) WHERE r <= 50"""
)
def graph_statistics(spark, d):
    return G.graph_statistics(table(spark, d, "quads"), by=None)


@_q(_OWN + f"SELECT graph, count(DISTINCT s) AS subjects, string_agg(DISTINCT CASE WHEN p = '{RDF_TYPE}' THEN o END, ' ' ORDER BY CASE WHEN p = '{RDF_TYPE}' THEN o END) AS classes, string_agg(DISTINCT lang, ' ' ORDER BY lang) AS languages, count(DISTINCT p) AS predicates FROM q GROUP BY graph")
def graph_profile(spark, d):
    g = G.graph_profile(table(spark, d, "quads"))
    return g.select("graph", F.size("subjects").cast("long").alias("subjects"), F.array_join("classes", " ").alias("classes"), F.array_join("languages", " ").alias("languages"), F.size("predicates").cast("long").alias("predicates"))


@_q(_OWN + f"SELECT graph, min(o) AS captions FROM q WHERE p = '{DC}title' GROUP BY graph")
def captions(spark, d):
    return G.captions(table(spark, d, "quads")).select("graph", F.array_join("captions", "|").alias("captions"))


@_q(_OWN + f"SELECT graph, min(CASE WHEN p = '{DC}title' THEN o END) AS dc_title, min(CASE WHEN p = '{EDM}dataProvider' THEN o END) AS \"edm_dataProvider\" FROM q WHERE p IN ('{DC}title', '{EDM}dataProvider') GROUP BY graph")
def first_literals(spark, d):
    return G.first_literals(table(spark, d, "quads"), [DC + "title", EDM + "dataProvider"])


@_q(
    _OWN + f""", ll AS (SELECT graph, s, min(CASE WHEN p = '{WGS}lat' THEN o END) AS la, min(CASE WHEN p = '{WGS}long' THEN o END) AS lo FROM q GROUP BY graph, s),
p1 AS (SELECT graph, concat(la, ',', lo) AS pt FROM ll WHERE la IS NOT NULL AND lo IS NOT NULL), p2 AS (SELECT graph, o AS pt FROM q WHERE p = '{QTERM}geoHash')
SELECT graph, pt AS points, FALSE AS only_geohash FROM p1 UNION ALL SELECT graph, pt, TRUE FROM p2 WHERE graph NOT IN (SELECT graph FROM p1)"""
)
def geo_points(spark, d):
    return G.geo_points(table(spark, d, "quads")).select("graph", F.array_join("points", "|").alias("points"), "only_geohash")


@_q(
    _OWN + f"""SELECT v.o AS value, count(DISTINCT v.s) AS resources, count(DISTINCT v.graph) AS graphs, coalesce(string_agg(DISTINCT x.o, '|' ORDER BY x.o), '') AS tags
FROM q v LEFT JOIN q x ON x.graph = v.graph AND x.s = v.s AND x.p = '{WGS}lat' WHERE v.p = '{SKOS}prefLabel' AND EXISTS (SELECT 1 FROM q t WHERE t.graph = v.graph AND t.s = v.s AND t.p = '{RDF_TYPE}' AND t.o = '{EDM}Place') GROUP BY v.o"""
)
def resources_by_type(spark, d):
    """Places by label, with their latitudes as tags."""
    return G.resources_by_type(table(spark, d, "quads"), EDM + "Place", SKOS + "prefLabel", WGS + "lat").withColumn("tags", F.array_join("tags", "|"))


@_q(_OWN + "SELECT graph, count(*) AS n FROM q GROUP BY graph")
def count_triples(spark, d):
    return G.count_triples(table(spark, d, "quads"))


@_q(_OWN + f"SELECT g.graph, q2.graph IS NOT NULL AS held FROM (SELECT concat('{BASE}/resource/aggregation/n', c_custkey % 25, '/', c_custkey, '/graph') AS graph FROM {{customer}}) g LEFT JOIN (SELECT DISTINCT graph FROM q) q2 ON g.graph = q2.graph")
def ask(spark, d):
    asked = table(spark, d, "customer").select(F.concat(F.lit(f"{BASE}/resource/aggregation/n"), F.col("c_custkey") % 25, F.lit("/"), "c_custkey", F.lit("/graph")).alias("graph"))
    return G.ask(table(spark, d, "quads"), asked)


_HALF = "CAST(regexp_extract(graph, '/([0-9]+)/graph', 1) AS BIGINT) % 2 = 0"


def _half(q):
    return q.filter(F.regexp_extract("graph", "/([0-9]+)/graph", 1).cast("long") % 2 == 0)


@_q(_OWN + f"SELECT graph, s, p, o FROM q WHERE NOT ({_HALF}) UNION ALL SELECT DISTINCT graph, s, p, concat(o, '!') FROM q WHERE {_HALF}")
def put_graphs(spark, d):
    q = table(spark, d, "quads")
    return G.put_graphs(q, _half(q).withColumn("o", F.concat("o", F.lit("!")))).select("graph", "s", "p", "o")


@_q(_OWN + f"SELECT graph, s, p, o FROM (SELECT DISTINCT * FROM q UNION SELECT graph, s, s_kind, '{DC}relation', o, o_kind, datatype, lang FROM q WHERE {_HALF})")
def post_graphs(spark, d):
    q = table(spark, d, "quads")
    return G.post_graphs(q, _half(q).withColumn("p", F.lit(DC + "relation"))).select("graph", "s", "p", "o")


@_q(_OWN + f"SELECT graph, s, p, o FROM q WHERE NOT ({_HALF})")
def drop_graphs(spark, d):
    q = table(spark, d, "quads")
    return G.drop_graphs(q, _half(q)).select("graph", "s", "p", "o")


def _belonging(spark, d):
    """Quads with the dataset each record belongs to and a sync flag."""
    q = table(spark, d, "quads")
    null = F.lit(None).cast("string")
    g = q.select("graph").distinct().select("graph", F.regexp_extract("graph", "aggregation/(n[0-9]+)/", 1).alias("spec"))
    said = F.array(F.struct(F.lit(QSYNC + "belongsTo").alias("p"), F.concat(F.lit(f"{BASE}/resource/dataset/"), "spec").alias("o")), F.struct(F.lit(QSYNC + "synced").alias("p"), F.lit("false").alias("o")))
    more = g.select("graph", F.explode(said).alias("t")).select("graph", F.col("graph").alias("s"), F.lit("URIRef").alias("s_kind"), "t.p", "t.o", F.lit("Literal").alias("o_kind"), null.alias("datatype"), null.alias("lang"))
    return q.unionByName(more)


@_q(_OWN + f"SELECT graph, CASE WHEN graph LIKE '%/aggregation/n3/%' THEN 'true' ELSE 'false' END AS o, n FROM (SELECT graph, count(*) + 2 AS n FROM q GROUP BY graph)")
def set_sync_flag(spark, d):
    done = G.set_sync_flag(_belonging(spark, d), f"{BASE}/resource/dataset/n3", True)
    return done.groupBy("graph").agg(F.min(F.when(F.col("p") == QSYNC + "synced", F.col("o"))).alias("o"), F.count(F.lit(1)).alias("n"))


@_q(_OWN + "SELECT graph, count(*) + 2 AS n FROM q WHERE graph NOT LIKE '%/aggregation/n3/%' GROUP BY graph")
def delete_dataset(spark, d):
    return G.count_triples(G.delete_dataset(_belonging(spark, d), f"{BASE}/resource/dataset/n3"))


@_q(_OWN + "SELECT graph, count(*) AS n FROM q WHERE graph NOT IN (SELECT graph FROM q WHERE s LIKE 'urn:n3/%') GROUP BY graph")
def delete_media_graphs(spark, d):
    return G.count_triples(G.delete_media_graphs(table(spark, d, "quads"), "n3"))


# ---- thesaurus ----


@_q(
    f"""WITH RECURSIVE b AS (SELECT s, o FROM {{concepts}} WHERE p = '{SKOS}broader'), up AS (SELECT s, o FROM b UNION SELECT up.s, b.o FROM up JOIN b ON up.o = b.s)
SELECT u.s, u.o AS ancestor, l.o AS label FROM (SELECT DISTINCT s, o FROM up WHERE s <> o) u LEFT JOIN (SELECT s, min(o) AS o FROM {{concepts}} WHERE p = '{SKOS}prefLabel' GROUP BY s) l ON u.o = l.s"""
)
def broader_closure(spark, d):
    return T.broader_closure(table(spark, d, "concepts"))


@_q(f"SELECT r.graph, coalesce(p.proxy, r.label) AS o FROM ({_PROXIED}) r LEFT JOIN {{proxies}} p ON r.spec = p.spec AND r.label = p.label AND p.spec IN ('n1', 'n2', 'n3')")
def apply_proxy_fields(spark, d):
    recs = spark.sql(_PROXIED, customer=table(spark, d, "customer"))
    null = F.lit(None).cast("string")
    q = recs.select("graph", "s", F.lit("URIRef").alias("s_kind"), F.lit(DC + "subject").alias("p"), F.col("label").alias("o"), F.lit("Literal").alias("o_kind"), null.alias("datatype"), F.lit("en").alias("lang"), "spec")
    fields = table(spark, d, "proxies").filter("spec in ('n1','n2','n3')").select("spec", "p", "field", "dataset").distinct()
    done, _ = T.apply_proxy_fields(q, fields, None)
    return done.select("graph", "o")


@_q(
    " UNION ALL ".join(f"SELECT proxy AS s, '{p}' AS p, {o} AS o FROM {{proxies}} WHERE {o} IS NOT NULL" for p, o in [(RDF_TYPE, f"'{SKOS}Concept'"), (RDF_TYPE, f"'{QSYNC}ProxyResource'"), (QSYNC + "proxyLiteralField", "p"), (QSYNC + "proxyLiteralValue", "label"), (QSYNC + "belongsTo", "dataset"), (SKOS + "prefLabel", "label"), (SKOS + "exactMatch", "concept")])
)
def proxy_graph(spark, d):
    p = table(spark, d, "proxies")
    return T.proxy_graph(p, p.filter("concept is not null").select("proxy", "concept")).select("s", "p", "o")


@_q(
    f"""SELECT s, p, o FROM (
 SELECT concat('{BASE}/place/', n_nationkey) AS s, '{SKOS}broader' AS p, concat('{BASE}/region/', n_regionkey) AS o FROM {{nation}} UNION SELECT concat('{BASE}/region/', n_regionkey), '{SKOS}narrower', concat('{BASE}/place/', n_nationkey) FROM {{nation}}
 UNION SELECT concat('{BASE}/region/', n_regionkey), '{SKOS}broader', '{BASE}/region/world' FROM {{nation}} UNION SELECT '{BASE}/region/world', '{SKOS}narrower', concat('{BASE}/region/', n_regionkey) FROM {{nation}})"""
)
def gazetteer_hierarchy(spark, d):
    gn = "http://www.geonames.org/ontology#"
    n = table(spark, d, "nation")
    iri = F.concat(F.lit(f"{BASE}/place/"), "n_nationkey")
    rows = F.array(F.struct(F.lit(gn + "parentADM1").alias("p"), F.concat(F.lit(f"{BASE}/region/"), "n_regionkey").alias("o")), F.struct(F.lit(gn + "parentCountry").alias("p"), F.lit(f"{BASE}/region/world").alias("o")))
    q = n.select(iri.alias("s"), F.explode(rows).alias("t")).select("s", "t.p", "t.o")
    return T.gazetteer_hierarchy(q)


@_q(_OWN + f"SELECT s, p, o FROM (SELECT s, CASE p WHEN '{DC}title' THEN '{SKOS}prefLabel' WHEN '{DC}subject' THEN '{SKOS}altLabel' ELSE p END AS p, o FROM q UNION ALL SELECT s, '{RDF_TYPE}', '{SKOS}Concept' FROM q WHERE p = '{RDF_TYPE}')")
def skosify(spark, d):
    gn = "http://www.geonames.org/ontology#"
    q = table(spark, d, "quads")
    q = q.withColumn("p", F.when(F.col("p") == DC + "title", F.lit(gn + "name")).when(F.col("p") == DC + "subject", F.lit(gn + "alternateName")).otherwise(F.col("p")))
    return T.skosify(q).select("s", "p", "o")


# ---- documents ----

_FIELD = f"CASE WHEN p LIKE '{DC}%' THEN concat('dc_', substring(p, {len(DC) + 1})) WHEN p LIKE '{EDM}%' THEN concat('edm_', substring(p, {len(EDM) + 1})) WHEN p LIKE '{QTERM}%' THEN concat('qterm_', substring(p, {len(QTERM) + 1})) WHEN p LIKE '{SKOS}%' THEN concat('skos_', substring(p, {len(SKOS) + 1})) WHEN p LIKE '{DCT}%' THEN concat('dcterms_', substring(p, {len(DCT) + 1})) WHEN p LIKE '{WGS}%' THEN concat('wgs84_pos_', substring(p, {len(WGS) + 1})) END"


@_q(
    _OWN + f""", l AS (SELECT graph, s, min(o) AS label FROM q WHERE p IN ('{SKOS}prefLabel') GROUP BY graph, s)
SELECT q.graph, {_FIELD.replace(' p ', ' q.p ').replace('(p,', '(q.p,')} AS field, count(DISTINCT (coalesce(label, q.o), q.o, q.lang)) AS n, min(coalesce(label, q.o)) AS least FROM q LEFT JOIN l ON q.graph = l.graph AND q.o = l.s AND q.o_kind <> 'Literal' WHERE q.p <> '{RDF_TYPE}' GROUP BY 1, 2"""
)
def flat_documents(spark, d):
    docs = D.to_flat_docs(table(spark, d, "quads"))
    return docs.select("graph", F.explode("fields").alias("field", "e")).select("graph", "field", F.size("e").cast("long").alias("n"), F.array_min(F.transform("e", lambda x: x["value"])).alias("least"))


@_q(
    _OWN + f"""SELECT a.graph, 'dcterms_spatial' AS field, concat('{BASE}/place/', regexp_extract(a.graph, 'aggregation/n([0-9]+)/', 1)) AS id, k.n AS inline_fields
FROM q a JOIN (SELECT graph, count(DISTINCT p) AS n FROM q WHERE s LIKE '{BASE}/place/%' AND p <> '{RDF_TYPE}' GROUP BY graph) k ON a.graph = k.graph WHERE a.p = '{DC}title'"""
)
def nested_documents(spark, d):
    docs = D.to_nested_docs(table(spark, d, "quads"))
    rows = docs.select("graph", F.explode("fields").alias("field", "e")).filter("field = 'dcterms_spatial'").select("graph", "field", F.explode("e").alias("e"))
    return rows.select("graph", "field", F.col("e.id").alias("id"), F.size("e.inline").cast("long").alias("inline_fields"))


@_q(
    _OWN + f"""SELECT concat('demo_n', regexp_extract(graph, 'aggregation/n([0-9]+)/', 1), '_', regexp_extract(graph, '/([0-9]+)/graph', 1)) AS hub_id, concat('n', regexp_extract(graph, 'aggregation/n([0-9]+)/', 1)) AS spec,
 min(CASE WHEN p = '{DC}title' THEN o END) AS caption, min(CASE WHEN p = '{QTERM}thumbnail' THEN o END) AS thumbnail, 'true' AS "hasGeoHash", CASE WHEN count(CASE WHEN p = '{QTERM}thumbnail' THEN 1 END) > 0 THEN 'true' ELSE 'false' END AS "hasDigitalObject" FROM q GROUP BY graph"""
)
def build_records(spark, d):
    r = D.build_records(table(spark, d, "quads"), org="demo")
    return r.select("hub_id", "spec", F.col("system.caption").alias("caption"), F.col("system.thumbnail").alias("thumbnail"), F.col("legacy.qsite_hasGeoHash").alias("hasGeoHash"), F.col("legacy.qsite_hasDigitalObject").alias("hasDigitalObject"))


@_q(_OWN + "SELECT concat('demo_', k) AS slug, concat('detail/foldout/mdr/demo_', k) AS preview, graph AS graph_name, replace(graph, '/graph', '') AS source_uri, TIMESTAMP '2024-05-01 10:00:00' AS created_at, TIMESTAMP '2024-05-01 10:00:00' AS modified_at FROM (SELECT DISTINCT graph, replace(regexp_extract(graph, 'aggregation/(n[0-9]+/[0-9]+)/graph', 1), '/', '_') AS k FROM q)")
def record_systems(spark, d):
    """The system block of records made at a given time."""
    r = D.build_records(table(spark, d, "quads"), org="demo", at=F.lit("2024-05-01 10:00:00").cast("timestamp"))
    return r.select("system.slug", "system.preview", "system.graph_name", "system.source_uri", "system.created_at", "system.modified_at")


@_q(_OWN + f"SELECT DISTINCT q.graph, q.s, q.p, q.o FROM q JOIN (SELECT DISTINCT graph, s FROM q WHERE p <> '{RDF_TYPE}') t ON q.graph = t.graph AND q.o = t.s WHERE o_kind = 'URIRef' AND q.o <> q.s AND concat(q.o, '/graph') <> q.graph")
def followed_objects(spark, d):
    return D.followed(table(spark, d, "quads")).select("graph", "s", "p", "o").distinct()


@_q(
    (_OWN + f"""SELECT v.graph, v.o AS id, l.o AS via, l.o AS label FROM q v JOIN q n ON v.graph = n.graph AND v.o = n.s AND n.p = '{DC}relation' JOIN q l ON n.graph = l.graph AND n.o = l.s AND l.p = '{SKOS}prefLabel'
WHERE v.p = '{EDM}hasView'""").replace("FROM {quads}", f"FROM (SELECT * FROM {{quads}} UNION ALL SELECT DISTINCT v.graph, v.o, 'URIRef', '{DC}relation', n.o, 'URIRef', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM {{quads}} v JOIN {{quads}} n ON v.graph = n.graph WHERE v.p = '{EDM}hasView' AND n.p = '{DCT}spatial')")
)
def deep_documents(spark, d):
    """Three levels: the record, its views, and the places that these are related to."""
    q = table(spark, d, "quads")
    places = q.filter(F.col("p") == DCT + "spatial").select("graph", F.col("o").alias("_place"))
    views = q.filter(F.col("p") == EDM + "hasView").select("graph", F.col("o").alias("s")).distinct().join(places, "graph")
    null = F.lit(None).cast("string")
    related = views.select("graph", "s", F.lit("URIRef").alias("s_kind"), F.lit(DC + "relation").alias("p"), F.col("_place").alias("o"), F.lit("URIRef").alias("o_kind"), null.alias("datatype"), null.alias("lang"))
    docs = D.to_nested_docs(q.unionByName(related.select(*q.columns)), depth=3)
    entries = docs.select("graph", F.explode(F.try_element_at("fields", F.lit("edm_hasView"))).alias("e")).select("graph", F.col("e.id").alias("id"), F.explode(F.try_element_at("e.inline", F.lit("dc_relation"))).alias("r"))
    return entries.select("graph", "id", F.col("r.raw").alias("via"), F.explode(F.try_element_at("r.inline", F.lit("skos_prefLabel"))).alias("label"))
