"""Queries of search: text, fields, filters, facets, pages, related records, points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import index_entry
from ..operators import search as S
from ..registry import query
from .bridge import plain, table


def _q(sql: str):
    return query(plain(sql))


def _entries(*columns):
    null = F.lit(None).cast("string")
    return F.array(*[index_entry(c, F.lit("Literal"), null, whole=True) for c in columns])


def part_docs(spark, d):
    """Parts as search documents."""
    p = table(spark, d, "part")
    fields = F.create_map(F.lit("dc_type"), _entries(F.col("p_type")), F.lit("dc_subject"), _entries(F.col("p_name"), F.concat(F.lit("size "), "p_size")), F.lit("edm_dataProvider"), _entries(F.col("p_brand")))
    return p.select(F.concat(F.lit("part_"), "p_partkey").alias("hub_id"), F.concat(F.lit("s"), F.col("p_partkey") % 7).alias("spec"), fields.alias("fields"), "p_partkey", "p_type", "p_name", "p_brand", "p_size")


def text_docs(spark, d):
    """Documents as search documents."""
    docs = table(spark, d, "docs")
    fields = F.create_map(F.lit("dc_title"), _entries(F.col("title")), F.lit("dc_language"), _entries(F.col("lang")), F.lit("edm_dataProvider"), _entries(F.col("spec")))
    return docs.select("doc_id", "hub_id", "spec", "lang", "text", "title", "modified_at", fields.alias("fields"))


_P = "WITH p AS (SELECT *, concat('part_', p_partkey) AS hub_id, concat('s', p_partkey % 7) AS spec FROM {part}), t AS (SELECT p_type AS v, row_number() OVER (ORDER BY p_type) AS r FROM (SELECT DISTINCT p_type FROM {part})) "


def _types(spark, d, n):
    return [r[0] for r in table(spark, d, "part").select("p_type").distinct().orderBy("p_type").limit(n).collect()]  # a domain of six


@_q(
    _P + """, f AS (SELECT 'dc_type.raw' AS facet, hub_id, p_type AS value, TRUE AS m FROM p UNION ALL SELECT 'edm_dataProvider.raw', hub_id, p_brand, p_type IN (SELECT v FROM t WHERE r <= 2) FROM p UNION ALL
 SELECT DISTINCT 'dc_subject.raw', hub_id, v, p_type IN (SELECT v FROM t WHERE r <= 2) FROM p, LATERAL (SELECT unnest([p_name, concat('size ', p_size)]) AS v) u),
c AS (SELECT facet, value, count(*) AS n, row_number() OVER (PARTITION BY facet ORDER BY count(*) DESC, value) AS r FROM f WHERE m GROUP BY facet, value)
SELECT c.facet, value, n, (total - shown)::BIGINT AS other, total::BIGINT AS total, doc_count FROM c JOIN (SELECT facet, sum(n) AS total, sum(CASE WHEN r <= 50 THEN n END) AS shown FROM c GROUP BY facet) s ON c.facet = s.facet JOIN (SELECT facet, count(DISTINCT hub_id) AS doc_count FROM f WHERE m GROUP BY facet) k ON c.facet = k.facet WHERE r <= 50"""
)
def term_facets(spark, d):
    return S.term_facets(part_docs(spark, d), ["dc_type.raw", "edm_dataProvider.raw", "dc_subject.raw"], {"dc_type.raw": _types(spark, d, 2)})


@_q(_P + "SELECT 'dc_subject.raw' AS facet, value, count(*) AS n, 0::BIGINT AS other, (SELECT 2 * count(*) FROM p WHERE p_type IN (SELECT v FROM t WHERE r <= 2)) AS total, (SELECT count(*) FROM p WHERE p_type IN (SELECT v FROM t WHERE r <= 2)) AS doc_count FROM (SELECT unnest([p_name, concat('size ', p_size)]) AS value FROM p WHERE p_type IN (SELECT v FROM t WHERE r <= 2)) GROUP BY value")
def full_facet(spark, d):
    return S.full_facet(part_docs(spark, d), "dc_subject.raw", {"dc_type.raw": _types(spark, d, 2)})


@_q(_P + "SELECT 'edm_dataProvider.raw' AS facet, p_brand AS value, count(*) AS n, 1 AS place FROM p GROUP BY p_brand UNION ALL SELECT 'dc_type.raw', p_type, count(*), 2 FROM p GROUP BY p_type")
def order_facets(spark, d):
    f = S.term_facets(part_docs(spark, d), ["dc_type.raw", "edm_dataProvider.raw", "dc_subject.raw"], {})
    return S.order_facets(f, ["edm_dataProvider.raw", "dc_type.raw"]).select("facet", "value", "n", "place")


@_q(_P + "SELECT hub_id FROM p WHERE p_type IN (SELECT v FROM t WHERE r <= 2) AND p_size <> 7")
def filter_docs(spark, d):
    return S.filter_docs(part_docs(spark, d), {"dc_type.raw": _types(spark, d, 2), "-dc_subject.raw": ["size 7"]}).select("hub_id")


@_q(_P + "SELECT hub_id FROM p WHERE p_type IN (SELECT v FROM t WHERE r <= 2) AND (p_size IN (1, 2, 3) OR spec IN ('s1'))")
def hidden_filter(spark, d):
    return S.hidden_filter(part_docs(spark, d), {"dc_type.raw": _types(spark, d, 2), "edm_dataProvider.raw": ["none"]}, [{"dc_subject.raw": ["size 1", "size 2", "size 3"], "system.spec.raw": ["s1"]}], exclude=["edm_dataProvider.raw"]).select("hub_id")


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@_q(f"WITH w AS (SELECT hub_id, {_WORDS} AS w FROM {{docs}}) SELECT hub_id FROM w WHERE (CASE WHEN list_contains(w, 'the') THEN 1 ELSE 0 END) + (CASE WHEN list_contains(w, 'thing') THEN 1 ELSE 0 END) + (CASE WHEN list_contains(w, 'license') THEN 1 ELSE 0 END) >= 2")
def match_text(spark, d):
    return S.match_text(table(spark, d, "docs"), "The thing, license", F.col("text")).select("hub_id")


@_q(
    f"""WITH w AS (SELECT hub_id, {_WORDS} AS w FROM {{docs}}), c AS (SELECT hub_id, len(w) AS l, len(list_filter(w, lambda x: x = 'license')) AS a, len(list_filter(w, lambda x: x = 'the')) AS b FROM w),
s AS (SELECT count(*) AS n, avg(l) AS av, count(CASE WHEN a > 0 THEN 1 END) AS da, count(CASE WHEN b > 0 THEN 1 END) AS db FROM c)
SELECT hub_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / av)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / av)), 4) AS score FROM c, s WHERE a > 0 AND b > 0"""
)
def match_text_score(spark, d):
    return S.match_text(table(spark, d, "docs"), "the license", F.col("text")).select("hub_id", F.round("score", 4).alias("score"))


@_q("SELECT hub_id FROM {docs} WHERE (lang = 'de' OR lang = 'fr') AND NOT spec = 'src0'")
def match_fielded(spark, d):
    return S.match_fielded(text_docs(spark, d), "(dc_language.raw:de OR dc_language.raw:fr) AND NOT system.spec.raw:src0").select("hub_id")


_TITLE_WORDS = "' ' || array_to_string(list_filter(regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' '"


@_q(f"WITH w AS (SELECT hub_id, spec, {_TITLE_WORDS} AS t FROM {{docs}}) SELECT hub_id FROM w WHERE ((contains(t, ' of the ') AND NOT contains(t, ' in ')) OR contains(t, ' de la ') OR (contains(t, ' und ') AND contains(t, ' der '))) AND spec <> 'src0'")
def match_phrases(spark, d):
    """Phrases, bare and of a field, words of a field in any order, and operators that lack an operand."""
    return S.match_fielded(text_docs(spark, d), '(("of the" -in) OR dc_title:"De la" OR dc_title:(der AND und)) AND NOT system.spec.raw:src0 AND').select("hub_id")


@_q(
    f"""WITH w AS (SELECT hub_id, {_WORDS} AS w FROM {{docs}}), c AS (SELECT hub_id, len(w) AS l, len(list_filter(w, lambda x: x = 'license')) AS a, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS b FROM w),
s AS (SELECT count(*) AS n, avg(l) AS av, count(CASE WHEN a > 0 THEN 1 END) AS da, count(CASE WHEN b > 0 THEN 1 END) AS db FROM c)
SELECT hub_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / av)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / av)), 4) AS score FROM c, s WHERE a > 0 AND b > 0"""
)
def match_text_phrase(spark, d):
    return S.match_text(table(spark, d, "docs"), '"of the" license', F.col("text")).select("hub_id", F.round("score", 4).alias("score"))


@_q("SELECT hub_id, CASE WHEN lang = 'de' THEN 0.5 ELSE 1.0 END * CASE WHEN spec = 'src1' THEN 0.5 ELSE 1.0 END AS score FROM {docs}")
def boost(spark, d):
    docs = text_docs(spark, d).withColumn("score", F.lit(1.0))
    return S.boost(S.boost(docs, F.col("lang") == "de", None, 0.5), F.col("spec") == "src1", "dc_title", 0.5).select("hub_id", "score")


@_q("SELECT hub_id, lang FROM {docs} ORDER BY lang, hub_id DESC LIMIT 32")
def sort_and_page(spark, d):
    docs = S.sort_hits(text_docs(spark, d), "dc_language.raw")
    return S.page_hits(docs, 16, 1).unionByName(S.page_hits(docs, 16, 2)).select("hub_id", "lang")


@_q("SELECT hub_id, row_number() OVER (ORDER BY md5(concat('seed1', hub_id)), hub_id)::INTEGER AS place FROM {docs} ORDER BY place LIMIT 50")
def random_order(spark, d):
    rows = S.random_order(table(spark, d, "docs"), "seed1").limit(50).select(F.md5(F.concat(F.lit("seed1"), "hub_id")).alias("k"), "hub_id")
    from pyspark.sql.window import Window

    return rows.select("hub_id", F.row_number().over(Window.orderBy("k", "hub_id")).cast("int").alias("place"))


@_q("SELECT hub_id FROM {docs} WHERE modified_at > TIMESTAMP '2024-01-01 01:00:00' OR (modified_at = TIMESTAMP '2024-01-01 01:00:00' AND hub_id < 'demo_src5') ORDER BY modified_at, hub_id DESC LIMIT 100")
def page_after(spark, d):
    import datetime as dt

    return S.page_after(table(spark, d, "docs"), dt.datetime(2024, 1, 1, 1, tzinfo=dt.timezone.utc), "demo_src5", 100).select("hub_id")


@_q("SELECT hub_id FROM {docs} WHERE spec NOT IN ('src1')")
def visible_docs(spark, d):
    listed = spark.createDataFrame([("src1", "10.0.0.1"), ("src2", "10.0.0.9"), ("src2", "10.0.0.1")], "spec string, ip string")
    return S.visible_docs(table(spark, d, "docs"), listed, "10.0.0.9").select("hub_id")


@_q("SELECT hub_id FROM {docs} WHERE doc_id % 10 = 3")
def find_items(spark, d):
    ids = table(spark, d, "docs").filter("doc_id % 10 = 3").select(F.upper("hub_id").alias("id"))
    return S.find_items(table(spark, d, "docs"), ids, ignore_case=True).select("hub_id")


@_q("SELECT hub_id FROM {docs} WHERE doc_id % 10 IN (3, 4)")
def find_by_identifier(spark, d):
    """Documents by one of two identifiers in their fields."""
    docs = table(spark, d, "docs")
    held = docs.withColumn("fields", F.create_map(F.lit("dc_identifier"), _entries(F.concat(F.lit("ID:"), "doc_id"), F.concat(F.lit("inv "), F.col("doc_id") + 1))))
    ids = docs.filter("doc_id % 10 = 3").select(F.concat(F.lit("id:"), "doc_id").alias("id")).unionByName(docs.filter("doc_id % 10 = 4").select(F.concat(F.lit("INV "), F.col("doc_id") + 1).alias("id")))
    return S.find_items(held, ids, by="dc_identifier", ignore_case=True).select("hub_id")


@_q(_P + "SELECT concat('c', z.k) AS slug, hub_id FROM p JOIN (SELECT DISTINCT p_size AS k FROM {part}) z ON p_size IN (z.k, z.k + 1) WHERE p_type IN (SELECT v FROM t WHERE r <= 2)")
def collection_members(spark, d):
    a, b = _types(spark, d, 2)
    f = lambda field, value: F.struct(F.lit(field).alias("field"), value.alias("value"))
    saved = table(spark, d, "part").select("p_size").distinct().select(F.concat(F.lit("c"), "p_size").alias("slug"), F.array(f("dc_subject", F.concat(F.lit("size "), "p_size")), f("dc_subject", F.concat(F.lit("size "), F.col("p_size") + 1)), f("dc_type", F.lit(a)), f("dc_type", F.lit(b))).alias("filters"))
    return S.collection_members(part_docs(spark, d), saved)


@_q(
    _P + """, z AS (SELECT DISTINCT p_size AS k FROM {part})
SELECT concat('c', z.k) AS slug, hub_id FROM p, z WHERE (p_size IN (z.k, z.k + 1) AND p_type <> (SELECT v FROM t WHERE r = 1)) OR (z.k % 2 = 0 AND p_brand = concat('Brand#1', z.k % 5) AND p_type = (SELECT v FROM t WHERE r = 2))
UNION ALL SELECT 'rest', hub_id FROM p WHERE p_type NOT IN (SELECT v FROM t WHERE r <= 2) AND p_size <> 7 UNION ALL SELECT 'all', hub_id FROM p"""
)
def collection_groups(spark, d):
    """Collections with alternatives and excluded values; one that only excludes, one without filters."""
    a, b = _types(spark, d, 2)
    f = lambda field, value: F.struct(F.lit(field).alias("field"), value.alias("value"))
    none = F.array().cast("array<struct<field:string,value:string>>")
    size = table(spark, d, "part").select("p_size").distinct()
    other = F.when(F.col("p_size") % 2 == 0, F.array(f("edm_dataProvider.raw", F.concat(F.lit("Brand#1"), F.col("p_size") % 5)), f("dc_type", F.lit(b))))
    own = F.array(f("dc_subject", F.concat(F.lit("size "), "p_size")), f("dc_subject.raw", F.concat(F.lit("size "), F.col("p_size") + 1)), f("-dc_type", F.lit(a)))
    saved = size.select(F.concat(F.lit("c"), "p_size").alias("slug"), own.alias("filters"), other.alias("or_filters"))
    rest = spark.range(1).select(F.lit("rest").alias("slug"), F.array(f("-dc_type", F.lit(a)), f("-dc_type.raw", F.lit(b)), f("-dc_subject", F.lit("size 7"))).alias("filters"), none.alias("or_filters"))
    every = spark.range(1).select(F.lit("all").alias("slug"), none.alias("filters"), none.alias("or_filters"))
    return S.collection_members(part_docs(spark, d), saved.unionByName(rest).unionByName(every))


@_q("WITH v AS (SELECT DISTINCT hub_id, field, left(value, 256) AS value FROM (SELECT hub_id, 'dc_title' AS field, replace(title, '\"', '''') AS value FROM {docs} UNION ALL SELECT hub_id, 'edm_dataProvider', spec FROM {docs})) SELECT hub_id, related, matches FROM (SELECT a.hub_id, b.hub_id AS related, count(*) AS matches, row_number() OVER (PARTITION BY a.hub_id ORDER BY count(*) DESC, b.hub_id) AS r FROM v a JOIN v b ON a.field = b.field AND a.value = b.value AND a.hub_id <> b.hub_id GROUP BY a.hub_id, b.hub_id) WHERE r <= 5")
def related_by_values(spark, d):
    return S.related_by_values(text_docs(spark, d), ["dc_title", "edm_dataProvider"], 5)


@_q(
    f"""WITH t AS (SELECT hub_id, unnest({_WORDS}) AS term FROM {{docs}}), tf AS (SELECT hub_id, term, count(*) AS tf FROM t GROUP BY hub_id, term),
df AS (SELECT term, ln(1 + (SELECT count(*) FROM {{docs}})::DOUBLE / count(*)) AS idf FROM tf GROUP BY term HAVING count(*) >= 2),
w AS (SELECT hub_id, tf.term, round(tf * idf, 6) AS w, idf FROM tf JOIN df ON tf.term = df.term),
best AS (SELECT hub_id, term, w * idf AS s FROM (SELECT *, row_number() OVER (PARTITION BY hub_id ORDER BY w DESC, term) AS r FROM w) WHERE r <= 12),
pairs AS (SELECT b.hub_id, w.hub_id AS related, round(sum(s), 4) AS score FROM best b JOIN w ON b.term = w.term WHERE b.hub_id <> w.hub_id GROUP BY b.hub_id, w.hub_id)
SELECT hub_id, related, score FROM (SELECT *, row_number() OVER (PARTITION BY hub_id ORDER BY score DESC, related) AS r FROM pairs WHERE score > 0) WHERE r <= 10"""
)
def more_like_this(spark, d):
    return S.more_like_this(table(spark, d, "docs"), F.col("text"), 10)


@_q(
    f"""WITH t AS (SELECT hub_id, unnest(list_filter(regexp_split_to_array(lower(title || ' ' || spec), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS term FROM {{docs}}), tf AS (SELECT hub_id, term, count(*) AS tf FROM t GROUP BY hub_id, term),
df AS (SELECT term, ln(1 + (SELECT count(*) FROM {{docs}})::DOUBLE / count(*)) AS idf FROM tf GROUP BY term HAVING count(*) >= 2),
w AS (SELECT hub_id, tf.term, round(tf * idf, 6) AS w, idf FROM tf JOIN df ON tf.term = df.term),
best AS (SELECT hub_id, term, w * idf AS s FROM (SELECT *, row_number() OVER (PARTITION BY hub_id ORDER BY w DESC, term) AS r FROM w) WHERE r <= 12),
pairs AS (SELECT b.hub_id, w.hub_id AS related, round(sum(s), 4) AS score FROM best b JOIN w ON b.term = w.term WHERE b.hub_id <> w.hub_id AND w.hub_id IN (SELECT hub_id FROM {{docs}} WHERE lang = 'de' OR lang = 'fr') GROUP BY b.hub_id, w.hub_id)
SELECT hub_id, related, score FROM (SELECT *, row_number() OVER (PARTITION BY hub_id ORDER BY score DESC, related) AS r FROM pairs WHERE score > 0) WHERE r <= 5"""
)
def more_like_this_fields(spark, d):
    """By the words of titles and providers, among records of two languages."""
    return S.more_like_this(text_docs(spark, d), ["dc_title.value", "edm_dataProvider.value"], 5, where=F.col("lang").isin("de", "fr"))


@_q(f"SELECT hub_id, array_to_string(list_filter({_WORDS}, lambda x: x NOT IN ({', '.join(repr(w) for w in S.STOP_NL)})), ' ') AS words FROM {{docs}}")
def analyze_nl(spark, d):
    return table(spark, d, "docs").select("hub_id", F.array_join(S.analyze_nl(F.col("text")), " ").alias("words"))


_KM = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - p.lon) / 2), 2))))"


@_q(f"SELECT c.hub_id AS centre, p.hub_id, round({_KM}, 4) AS km FROM {{points}} p, (SELECT * FROM {{points}} WHERE CAST(substring(hub_id, 3) AS BIGINT) % 20 = 0) c WHERE {_KM} <= 12")
def within_distance(spark, d):
    p = table(spark, d, "points")
    centres = p.filter(F.substring("hub_id", 3, 20).cast("long") % 20 == 0).select(F.col("hub_id").alias("centre"), "lat", "lon")
    return S.within_distance(p, centres, 12.0)


@_q("SELECT hub_id FROM {points} WHERE lat BETWEEN 51 AND 52.5 AND lon BETWEEN 4 AND 6")
def in_bbox(spark, d):
    return S.in_bbox(table(spark, d, "points"), 51, 4, 52.5, 6).select("hub_id")


def _point_docs(spark, d):
    p = table(spark, d, "points")
    bad = F.when(F.col("hub_id").endswith("7"), F.array(F.lit("3,44,7"), F.lit("x,y"))).otherwise(F.array(F.concat_ws(",", F.col("lat").cast("decimal(6,2)"), F.col("lon").cast("decimal(6,2)"))))
    return p.select("hub_id", bad.alias("point"))


@_q("SELECT hub_id FROM {points} WHERE hub_id NOT LIKE '%7'")
def has_geo(spark, d):
    return S.has_geo(_point_docs(spark, d)).select("hub_id")


@_q("SELECT hub_id, round(lat, 2) AS lat, round(lon, 2) AS lon FROM {points} WHERE hub_id NOT LIKE '%7' ORDER BY hub_id LIMIT 2500")
def point_list(spark, d):
    return S.point_list(_point_docs(spark, d))


_X3, _Y3 = "CAST(greatest(ceil((lon + 180) / 360 * 256) - 1, 0) AS BIGINT)", "CAST(greatest(ceil((lat + 90) / 180 * 128) - 1, 0) AS BIGINT)"


@_q(f"SELECT n, round((y + 0.5) * 180 / 128 - 90, 0) AS lat, round((x + 0.5) * 360 / 256 - 180, 0) AS lon FROM (SELECT {_X3} AS x, {_Y3} AS y, count(*) AS n FROM {{points}} GROUP BY 1, 2)")
def geo_clusters(spark, d):
    return S.geo_clusters(table(spark, d, "points"), 3).select("n", "lat", "lon")


@_q(_P + "SELECT hub_id FROM p WHERE p_type IN (SELECT v FROM t WHERE r <= 2) AND spec <> 's1' ORDER BY hub_id DESC LIMIT 16")
def search_hits(spark, d):
    listed = spark.createDataFrame([("s1", "10.0.0.1")], "spec string, ip string")
    hits, _ = S.search(part_docs(spark, d), filters={"dc_type.raw": _types(spark, d, 2)}, facets=["dc_type.raw"], whitelist=listed, ip="10.0.0.9")
    return hits.select("hub_id")
