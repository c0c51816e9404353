"""Search documents from record graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import hub_id_from_graph, rebase_uri
from ..functions.namespaces import DC, EDM, FOAF, ORE, QTERM, TYPE, WGS84
from ..functions.text import index_entry, natural_key
from ..schemas import QUAD
from .graph import CAPTIONS, THUMBNAILS, captions, filter_properties, graph_profile, pick_thumbnail, rank_of, resolve_labels, search_fields
from .tables import kept

# Media fields whose values keep the order of the media.
KEEP_ORDER = ["qterm_thumbSmall", "qterm_thumbLarge", "qterm_thumbnail", "qterm_deepZoomUrl", "edm_hasView"]
# Predicates whose objects are not followed.
NOT_FOLLOWED = [FOAF + "primaryTopic", ORE + "isAggregatedBy", "http://creativecommons.org/ns#attributionURL", EDM + "isShownAt"]


def _fields(quads: DataFrame, whole: bool = False) -> DataFrame:
    """(graph, field, entries): entries of a field, each once; in natural order but for media fields."""
    labelled = search_fields(filter_properties(resolve_labels(quads)))
    entry = index_entry(F.col("label"), F.col("o_kind"), F.col("label_lang"), F.col("o"), whole)
    key = F.when(F.col("label_of").isin(KEEP_ORDER), F.col("o")).otherwise(natural_key(F.left("label", F.lit(256))))
    item = F.struct(key.alias("k"), entry.alias("e"))
    # truncated, if at all, before it is collected; a set per (graph, field) first, then the map per graph
    return labelled.groupBy("graph", F.col("label_of").alias("field")).agg(F.array_sort(F.collect_set(item)).alias("_items"))


def to_flat_docs(quads: DataFrame, whole: bool = False) -> DataFrame:
    """(graph, fields): map from search label to array(struct(type, id, value, raw, lang)); with ``whole`` no value is cut."""
    per = _fields(quads, whole).select("graph", F.struct("field", F.transform("_items", lambda x: x["e"]).alias("entries")).alias("_f"))
    return per.groupBy("graph").agg(F.map_from_entries(F.collect_list("_f")).alias("fields"))


def _may_lead(record: Column) -> Column:
    """Whether a triple may be followed, if its object has triples of its own: it is a resource, but not the record, not the subject itself and not by a predicate of NOT_FOLLOWED."""
    return (F.col("o_kind") != "Literal") & ~F.col("p").isin(NOT_FOLLOWED) & (F.col("o") != record) & (F.col("o") != F.col("s"))


def followed(quads: DataFrame) -> DataFrame:
    """The triples whose object may be followed: a resource with triples of its own in the graph, but not the record, not the subject itself and not by a predicate of NOT_FOLLOWED."""
    links = quads.filter(_may_lead(F.regexp_replace("graph", "/graph$", "")))
    told = quads.filter(F.col("p") != TYPE).select(F.col("graph").alias("_g"), F.col("s").alias("_t")).distinct()
    return links.join(told, (F.col("graph") == F.col("_g")) & (F.col("o") == F.col("_t")), "left_semi")


def _resources(others: DataFrame, depth: int) -> DataFrame:
    """(_g, _s, inline): the fields of every resource in ``others``, by name its raw values; above depth 1 each value with the fields of what it links to."""
    raw = F.left("label", F.lit(256)).alias("raw")
    if depth <= 1:
        pairs = others.groupBy("graph", "s").agg(F.array_sort(F.collect_set(F.struct(F.col("label_of").alias("field"), raw))).alias("_pairs"))
        names = F.array_distinct(F.transform("_pairs", lambda x: x["field"]))
        fields = pairs.withColumn("inline", F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter("_pairs", lambda x: x["field"] == n), lambda x: x["raw"]))))
    else:
        joined = _linked(others.dropDuplicates(["graph", "s", "p", "o", "label"]), others, depth - 1)
        by_raw = lambda a, b: F.when(a["raw"] < b["raw"], -1).when(a["raw"] > b["raw"], 1).otherwise(0)
        # dealt by resource once, for both groupings and the join that follows
        per = joined.select("graph", "s", "label_of", raw, "inline").repartition("graph", "s").groupBy("graph", "s", "label_of").agg(F.array_sort(F.collect_list(F.struct("raw", "inline")), by_raw).alias("values"))
        fields = per.groupBy("graph", "s").agg(F.map_from_entries(F.collect_list(F.struct("label_of", "values"))).alias("inline"))
    return fields.select(F.col("graph").alias("_g"), F.col("s").alias("_s"), "inline")


def _linked(rows: DataFrame, others: DataFrame, depth: int) -> DataFrame:
    """Rows with ``inline``: the fields of the resource ``to`` that their triple leads to, null if it is not followed.

    Fields stay where they were grouped; the rows are dealt to them.
    """
    near = _resources(others, depth)
    return rows.join(near, (F.col("graph") == F.col("_g")) & (F.col("to") == F.col("_s")), "left").drop("_g", "_s")


def to_nested_docs(quads: DataFrame, depth: int = 2) -> DataFrame:
    """(graph, about, fields): fields of the record, each entry with ``inline``: the fields of the resource it links to, ``depth`` levels in all.

    ``inline`` maps names to raw values; with a depth of 3 or more, to structs of the raw value and the
    next level. What is followed is as ``followed`` says; deeper links may lead back to a resource
    further up, where the depth ends them. Triples and fields are made and written once,
    however many levels read them.
    """
    record = F.regexp_replace("graph", "/graph$", "")
    quads = kept(quads.select(*QUAD))
    # what has fields has triples of its own, as ``followed`` asks
    shown = kept(search_fields(filter_properties(resolve_labels(quads))).select("graph", "s", "p", "o", "o_kind", "label", "label_lang", "label_of", F.when(_may_lead(record), F.col("o")).alias("to")))
    own, others = shown.filter(F.col("s") == record), shown.filter(F.col("s") != record)
    joined = _linked(own, others, depth - 1) if depth > 1 else own.withColumn("inline", F.lit(None).cast("map<string,array<string>>"))
    entry = F.struct(F.col("o_kind").alias("type"), F.when(F.col("o_kind") != "Literal", F.col("o")).alias("id"), F.col("label").alias("value"), F.col("label_lang").alias("lang"), "inline")
    per = joined.select("graph", F.col("label_of").alias("field"), entry.alias("entry")).repartition("graph").groupBy("graph", "field").agg(F.collect_list("entry").alias("entries"))
    fields = per.select("graph", F.struct("field", "entries").alias("_f")).groupBy("graph").agg(F.map_from_entries(F.collect_list("_f")).alias("fields"))
    about = graph_profile(quads).join(captions(quads), "graph", "left").join(pick_thumbnail(quads), "graph", "left").select("graph", F.struct("classes", F.col("predicates").alias("properties"), "languages", "captions", "thumbnail").alias("about"))
    return about.join(fields, "graph", "left")


def attach_user_content(docs: DataFrame, content: DataFrame, entry_points: list[str], base: str) -> DataFrame:
    """Documents with ``user_content``: what users contributed to a record, an array of (link, name) in order of link, empty if nothing.

    ``content`` is (source_uri, link, name, seq). A contribution to a page or to data is one to the
    resource, under ``base`` if its host is one of ours; of those to the same resource with the same
    link the last counts.
    """
    resource = F.regexp_replace(F.regexp_replace("source_uri", "/data/", "/resource/"), "/page/", "/resource/")
    told = content.filter("link is not null").select(rebase_uri(resource, entry_points, base).alias("_uri"), "link", "name", "seq")
    last = told.groupBy("_uri", "link").agg(F.max_by("name", "seq").alias("name"))
    lists = last.groupBy("_uri").agg(F.array_sort(F.collect_list(F.struct("link", "name"))).alias("_content"))
    joined = docs.join(lists, F.col("source_uri") == F.col("_uri"), "left")
    return joined.withColumn("user_content", F.coalesce("_content", F.array().cast("array<struct<link:string,name:string>>"))).drop("_uri", "_content")


def record_summaries(quads: DataFrame) -> DataFrame:
    """(graph, captions, points, thumbnail, legacy) of every graph, in one pass over its triples.

    Captions, points and the thumbnail are as ``captions``, ``geo_points`` and ``pick_thumbnail``
    have them; ``legacy`` tells whether a record has a point, a digital object, a landing page, deep
    zoom, as the strings true and false, and its owner, provider, title and creator.
    """
    p, o, literal = F.col("p"), F.col("o"), F.col("o_kind") == "Literal"
    has = lambda c: F.when(F.max(c), "true").otherwise("false")
    least = lambda iri: F.min(F.when(p == iri, o))
    side = F.struct(F.col("s").alias("s"), (p == WGS84 + "lat").alias("lat"), o.alias("o"))
    per = quads.groupBy("graph").agg(
        *[F.array_sort(F.collect_set(F.when(literal & (p == c), o))).alias(f"_caption{k}") for k, c in enumerate(CAPTIONS)],
        F.collect_set(F.when(p.isin(WGS84 + "lat", WGS84 + "long"), side)).alias("_sides"),
        F.array_sort(F.collect_set(F.when((p == QTERM + "geoHash") & o.rlike("^[^,]+,[^,]+$"), o))).alias("_told"),
        F.min(F.when(p.isin(THUMBNAILS), F.struct(rank_of(p, THUMBNAILS).alias("rank"), o.alias("o")))).alias("_thumbnail"),
        has((p == QTERM + "geoHash") | p.endswith("wgs84_pos#lat")).alias("qsite_hasGeoHash"),
        has(p.isin(QTERM + "thumbnail", QTERM + "thumbSmall", QTERM + "thumbLarge", EDM + "object", EDM + "isShownBy")).alias("qsite_hasDigitalObject"),
        has(p == EDM + "isShownAt").alias("qsite_hasLandingPage"),
        # the key tested is qterm_deepZoom, not that of the URL
        has(p == QTERM + "deepZoom").alias("qsite_hasDeepZoom"),
        least(EDM + "dataProvider").alias("qsite_owner"),
        least(EDM + "provider").alias("qsite_provider"),
        least(DC + "title").alias("qsite_title"),
        least(DC + "creator").alias("qsite_creator"),
    )
    filled = lambda c: F.when(F.size(c) > 0, F.col(c))
    of = lambda s, lat: F.array_min(F.transform(F.filter("_sides", lambda x: (x["s"] == s) & (x["lat"] == lat)), lambda x: x["o"]))
    pairs = F.filter(F.transform(F.array_distinct(F.transform("_sides", lambda x: x["s"])), lambda s: F.struct(of(s, True).alias("lat"), of(s, False).alias("lon"))), lambda x: x["lat"].isNotNull() & x["lon"].isNotNull())
    good = F.forall("_pairs", lambda x: x["lat"].try_cast("double").isNotNull() & x["lon"].try_cast("double").isNotNull())
    points = F.when((F.size("_pairs") > 0) & good, F.array_sort(F.array_distinct(F.transform("_pairs", lambda x: F.concat_ws(",", x["lat"], x["lon"]))))).otherwise(filled("_told"))
    legacy = [c for c in per.columns if c.startswith("qsite_")]
    return per.withColumn("_pairs", pairs).select("graph", F.coalesce(*[filled(f"_caption{k}") for k in range(len(CAPTIONS))]).alias("captions"), points.alias("points"), F.col("_thumbnail.o").alias("thumbnail"), F.struct(*legacy).alias("legacy"))


def build_records(quads: DataFrame, org: str, at: Column | None = None, kind: str = "mdr", whole: bool = False) -> DataFrame:
    """(hub_id, spec, source_uri, graph, fields, point, system, legacy) of every record graph.

    ``at`` is the time of creation and change, now if not given; ``kind`` is part of the path of the preview.
    With ``whole`` values are kept at any length, as conversions and exports need them.
    """
    at = F.current_timestamp() if at is None else at
    source = F.regexp_replace("graph", "/graph$", "")
    spec = F.element_at(F.split(source, "/"), -2)
    hub = hub_id_from_graph(F.col("graph"), org, spec)
    return to_flat_docs(quads, whole).join(record_summaries(quads), "graph", "left").select(
        hub.alias("hub_id"),
        spec.alias("spec"),
        source.alias("source_uri"),
        "graph",
        "fields",
        F.col("points").alias("point"),
        F.struct(spec.alias("spec"), source.alias("about_uri"), F.array_min("captions").alias("caption"), "thumbnail", F.sha1(F.to_json("fields")).alias("content_hash"), hub.alias("slug"), F.concat(F.lit(f"detail/foldout/{kind}/"), hub).alias("preview"), source.alias("source_uri"), F.col("graph").alias("graph_name"), at.alias("created_at"), at.alias("modified_at")).alias("system"),
        "legacy",
    )


def raw_values(docs: DataFrame) -> DataFrame:
    """(hub_id, field, value): the exact values of documents, one row each."""
    return docs.select("hub_id", F.explode("fields").alias("field", "_e")).select("hub_id", "field", F.explode(F.array_distinct(F.transform("_e", lambda x: x["raw"]))).alias("value"))

