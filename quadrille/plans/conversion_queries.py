"""Queries of conversion, harvest and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import index_entry, rewrite_keys
from ..operators import convert as C
from ..operators import exports as X
from ..operators import harvest as H
from ..registry import query
from .bridge import DC, plain, table


def _q(sql: str):
    return query(plain(sql))


def records(spark, d):
    """Documents with fields of several schemas, a point, and a legacy block."""
    docs = table(spark, d, "docs")
    null = F.lit(None).cast("string")
    e = lambda *cs: F.array(*[index_entry(c, F.lit("Literal"), null, whole=True) for c in cs])
    landing = F.when(F.col("doc_id") % 3 == 0, F.lit("file:///opt/x")).otherwise(F.concat_ws("", F.lit("http://l/"), "doc_id"))
    fields = F.create_map(
        F.lit("dc_title"), e(F.col("title")), F.lit("qterm_material"), e(F.col("lang"), F.col("spec")), F.lit("edm_object"), e(F.concat_ws("", F.lit("http://img/"), "doc_id")),
        F.lit("custom_x"), e(F.col("spec")), F.lit("qterm_resourceUri"), e(F.lit("r")), F.lit("qsync_synced"), e(F.lit("true")), F.lit("edm_isShownAt"), e(landing),
    )
    point = F.when(F.col("doc_id") % 4 == 0, F.array(F.concat(F.lit("52."), (F.col("doc_id") % 90) + 10, F.lit(",4.5"))))
    legacy = F.create_map(F.lit("qsite_owner"), F.col("spec"), F.lit("qsite_creator"), F.lit("null"))
    return docs.select("doc_id", "hub_id", "spec", "source_uri", "modified_at", fields.alias("fields"), point.alias("point"), legacy.alias("legacy"))


def _rows(df):
    """(hub_id, key, vals): the values of each key; one that is missing keeps its place, and a key of that one value alone has none."""
    values = F.col("x.values")
    vals = F.when(F.size(values) == 1, values[0]).otherwise(F.array_join(values, "|", ""))
    return df.select("hub_id", F.explode("flat").alias("x")).select("hub_id", F.col("x.key").alias("key"), vals.alias("vals"))


_OBJ = "concat('http://img/', doc_id)"
_SHOWN = "CASE WHEN doc_id % 3 = 0 THEN 'file:///opt/x' ELSE concat('http://l/', doc_id) END"


def _flat(rows):
    return " UNION ALL ".join(f"SELECT hub_id, '{k}' AS key, {v} AS vals FROM {{docs}}" for k, v in rows)


_BASE_ROWS = [("dc_title", "title"), ("europeana_object", _OBJ), ("custom_x", "spec"), ("qsite_resourceUri", "'r'"), ("europeana_isShownAt", _SHOWN)]


@_q(_flat([*_BASE_ROWS, ("icn_material", "concat(lang, '|', spec)")]))
def convert_icn(spark, d):
    return _rows(C.convert(records(spark, d), "icn"))


@_q(_flat([*_BASE_ROWS, ("tib_material", "concat(lang, '|', spec)")]))
def convert_tib(spark, d):
    return _rows(C.convert(records(spark, d), "tib"))


@_q(_flat(_BASE_ROWS))
def convert_ese(spark, d):
    return _rows(C.convert(records(spark, d), "ese"))


@_q(_flat(_BASE_ROWS))
def convert_abm(spark, d):
    return _rows(C.convert(records(spark, d), "abm"))


_LOCAL = "concat(spec, '/', doc_id)"


@_q(
    _flat([("dc_title", "title"), ("custom_x", "spec"), ("qsite_resourceUri", "'r'"), ("qsite_recordType", "'mdr'"), ("qsite_hubId", "hub_id"), ("qsite_pmhId", "hub_id"), ("qsite_spec", "spec"), ("europeana_uri", _LOCAL), ("europeana_object", "'r'"), ("qsite_hasDigitalObject", "'true'"), ("qsite_thumbnail", "'r'"), ("qsite_hasGeoHash", "'false'"), ("qsite_title", "title"), ("europeana_collectionName", "spec"), ("qsite_orgId", "'demo'"), ("qsite_owner", "spec"), ("qsite_hasLandingPage", "CASE WHEN doc_id % 3 = 0 THEN 'false' ELSE 'true' END")])
    + " UNION ALL SELECT hub_id, 'europeana_isShownAt', concat('http://l/', doc_id) FROM {docs} WHERE doc_id % 3 <> 0"
)
def convert_defaults(spark, d):
    return _rows(C.add_defaults(C.convert(records(spark, d), "ese"), "demo"))


@_q(_flat([("dc_title", "title"), ("qterm_material", "concat(lang, '|', spec)"), ("edm_object", _OBJ), ("custom_x", "spec"), ("qterm_resourceUri", "'r'"), ("edm_isShownAt", _SHOWN)]))
def convert_v2(spark, d):
    return _rows(C.convert_v2(records(spark, d)))


@_q("SELECT hub_id, replace(replace(concat('q=icn_', title, '&europeana_', spec), 'icn_', 'qterm_'), 'europeana_', 'edm_') AS there, replace(replace(concat('qterm_', spec), 'qterm_', 'icn_'), 'edm_', 'europeana_') AS back FROM {docs}")
def rewrite_query_keys(spark, d):
    r = C.KEY_PREFIXES["icn"]
    return table(spark, d, "docs").select("hub_id", rewrite_keys(F.concat(F.lit("q=icn_"), "title", F.lit("&europeana_"), "spec"), r).alias("there"), rewrite_keys(F.concat(F.lit("qterm_"), "spec"), r, reverse=True).alias("back"))


@_q("SELECT graph, count(DISTINCT s) AS subjects, count(DISTINCT CASE WHEN p NOT LIKE '%#type' THEN concat(s, p) END) AS properties FROM {quads} GROUP BY graph")
def edm_json(spark, d):
    made = C.to_edm_json(table(spark, d, "quads"))
    shape = "array<struct<`@id`:string,properties:map<string,string>>>"
    nodes = F.from_json("json", shape)
    return made.select("graph", F.size(nodes).cast("long").alias("subjects"), F.aggregate(nodes, F.lit(0).cast("long"), lambda a, n: a + F.size(F.coalesce(n["properties"], F.create_map().cast("map<string,string>")))).alias("properties"))


@_q("SELECT graph, count(DISTINCT CASE WHEN p LIKE '%#type' AND o NOT LIKE '%WebResource' THEN s END) AS elements FROM {quads} GROUP BY graph")
def edm_xml(spark, d):
    made = C.to_edm_xml(table(spark, d, "quads"))
    return made.select("graph", F.size(F.xpath(F.col("xml"), F.lit("/*/*"))).cast("long").alias("elements"))


# ---- harvest ----


@_q("SELECT hub_id FROM {docs} WHERE spec IN (SELECT spec FROM {datasets} WHERE published AND NOT deleted)")
def public_only(spark, d):
    return H.public_only(table(spark, d, "docs"), table(spark, d, "datasets")).select("hub_id")


@_q("SELECT hub_id FROM {docs} WHERE spec = 'src3' AND modified_at >= TIMESTAMP '2024-01-01 01:00:00' AND modified_at <= TIMESTAMP '2024-01-01 12:00:00'")
def harvest_select(spark, d):
    t = lambda s: F.to_timestamp(F.lit(s))
    return H.harvest_select(table(spark, d, "docs"), "src3", t("2024-01-01 01:00:00"), t("2024-01-01 12:00:00")).select("hub_id")


@_q("SELECT hub_id FROM {docs} WHERE (lang = 'de' OR contains(' ' || array_to_string(list_filter(regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' ', ' the ')) AND spec IN ('src1', 'src2', 'src3') AND modified_at >= TIMESTAMP '2024-01-01 01:00:00'")
def harvest_saved_query(spark, d):
    """A harvest of a saved query with a filter."""
    from .search_queries import text_docs

    return H.harvest_select(text_docs(spark, d), start=F.to_timestamp(F.lit("2024-01-01 01:00:00")), query="dc_language.raw:de OR dc_title:the", filters={"edm_dataProvider.raw": ["src1", "src2", "src3"]}).select("hub_id")


@_q(
    """SELECT hub_id, pos AS position, pos // 100 AS page, pos // 100 * 100 AS "cursor", n AS list_size,
 CASE WHEN pos // 100 * 100 + 100 < n THEN base64(encode(concat('prefix=edm::from=::until=::set=::cursor=', pos // 100 * 100 + 100, '::list_size=', n))) END AS token
FROM (SELECT hub_id, row_number() OVER (ORDER BY modified_at, hub_id DESC) - 1 AS pos, count(*) OVER () AS n FROM {docs})"""
)
def harvest_pages(spark, d):
    return H.harvest_pages(table(spark, d, "docs"))


@_q("SELECT concat('oai:', replace(hub_id, '_', ':')) AS identifier, strftime(modified_at, '%Y-%m-%dT%H:%M:%SZ') AS datestamp, spec AS set_spec FROM {docs}")
def list_identifiers(spark, d):
    return H.list_identifiers(table(spark, d, "docs"))


@_q("SELECT concat('oai:', replace(hub_id, '_', ':')) AS identifier, 5 AS keys FROM {docs}")
def list_records(spark, d):
    return H.list_records(records(spark, d), "oai_dc", C.CONVERTERS).select("identifier", F.size("flat").alias("keys"))


@_q("SELECT spec, count(*) AS n FROM {docs} GROUP BY spec")
def list_sets(spark, d):
    return H.list_sets(table(spark, d, "docs"))


# ---- exports ----


@_q("SELECT hub_id, 4.5 AS lon, CAST(concat('52.', (doc_id % 90) + 10) AS DOUBLE) AS lat, title FROM {docs} WHERE doc_id % 4 = 0")
def geojson(spark, d):
    made = X.to_geojson(C.convert(records(spark, d), "ese"))
    j = F.from_json("feature", "geometry struct<coordinates:array<double>>, properties struct<dc_title:array<string>>")
    return made.select("hub_id", j["geometry"]["coordinates"][0].alias("lon"), j["geometry"]["coordinates"][1].alias("lat"), j["properties"]["dc_title"][0].alias("title"))


@_q("SELECT hub_id, concat('4.5,', CAST(CAST(concat('52.', (doc_id % 90) + 10) AS DOUBLE) AS STRING)) AS coordinates FROM {docs} WHERE doc_id % 4 = 0")
def kml(spark, d):
    made = X.to_kml(C.convert(records(spark, d), "ese"))
    return made.select("hub_id", F.xpath_string("placemark", F.lit("/Placemark/Point/coordinates")).alias("coordinates"))


@_q("SELECT hub_id, 6 AS elements, CAST(length(concat(spec)) AS INTEGER) AS custom FROM {docs}")
def record_xml(spark, d):
    made = X.to_record_xml(C.convert(records(spark, d), "tib"))
    opened = F.regexp_count("xml", F.lit("<[a-z]+:[A-Za-z]+>"))
    return made.select("hub_id", (opened - 1).alias("elements"), F.length(F.regexp_extract("xml", "<custom:x>([^<]*)</custom:x>", 1)).alias("custom"))


@_q(f"SELECT concat('<', s, '> <', p, '> ', CASE WHEN o_kind = 'Literal' THEN concat('\"', o, '\"', CASE WHEN lang IS NOT NULL THEN concat('@', lang) WHEN datatype IS NOT NULL THEN concat('^^<', datatype, '>') ELSE '' END) ELSE concat('<', o, '>') END, ' <', graph, '> .') AS value FROM {{quads}} WHERE p <> '{DC}nothing'")
def nquads(spark, d):
    return X.nquad_lines(table(spark, d, "quads"))


@_q("SELECT count(DISTINCT graph) AS graphs, count(*) AS statements FROM (SELECT DISTINCT graph, s, p, o, lang, datatype FROM {quads})")
def graph_update_script(spark, d):
    made = X.graph_update_script(table(spark, d, "quads"))
    return made.agg(F.sum("graphs").cast("long").alias("graphs"), F.sum(F.regexp_count("script", F.lit(r"(?m)^<.* \.$"))).cast("long").alias("statements"))


