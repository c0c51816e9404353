"""Record graphs: filters, joins inside and between graphs, and what graphs hold.

A quad table has (graph, s, s_kind, p, o, o_kind, datatype, lang). Joins inside a record go by
(graph, s), so a value that all records share is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.namespaces import DC, EDM, FOAF, QSYNC, QTERM, ORE, RDFS, SKOS, TYPE, WGS84, search_label
from ..schemas import QUAD

# Properties that give a resource its label, best first; that give a record its thumbnail, and its caption, best first.
LABELS = [SKOS + "prefLabel", RDFS + "label", SKOS + "altLabel", FOAF + "name", "http://www.geonames.org/ontology#name", DC + "title", QSYNC + "proxyLiteralValue", "http://dbpedia.org/ontology/name"]
THUMBNAILS = [FOAF + "depiction", QTERM + "thumbnail", QTERM + "thumbSmall", QTERM + "thumbLarge", EDM + "object", EDM + "isShownBy"]
CAPTIONS = [DC + "title", SKOS + "prefLabel", RDFS + "label", "http://www.geonames.org/ontology#name"]
# Administrative properties that no document shows.
EXCLUDED = [QSYNC + x for x in "datasetMapToPrefix datasetCharacter datasetErrorTime acceptanceOnly synced stateSourced stateSaved stateProcessed stateProcessable stateMappable stateAnalyzed publishOAIPMH publishLOD publishIndex processedValid processedInvalid actorOwner".split()]
SAME_AS = SKOS + "exactMatch"


def rank_of(p: Column, order: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in order]), p)


def filter_properties(quads: DataFrame, exclude: list[str] = EXCLUDED, include: list[str] | None = None) -> DataFrame:
    """Triples that become fields: not of type, not excluded and, where a list of allowed ones is given, on it."""
    kept = quads.filter((F.col("p") != TYPE) & ~F.col("p").isin(exclude))
    return kept.filter(F.col("p").isin(include)) if include else kept


def filter_languages(quads: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """(graph, p, values): different literals of each field in order; tagged ones only in the allowed languages, all if none are named."""
    literals = quads.filter("o_kind = 'Literal'")
    if langs:
        literals = literals.filter(F.col("lang").isNull() | F.col("lang").isin(langs))
    return literals.groupBy("graph", "p").agg(F.array_sort(F.collect_set("o")).alias("values"))


def select_subject(quads: DataFrame, target: str) -> DataFrame:
    """Triples of a subject; the record's own IRI, or that with /about, means its whole graph."""
    record = target.removesuffix("/about").rstrip("/")
    return quads.filter((F.col("graph") == record + "/graph") | (F.col("s") == target))


def lod_allowed(quads: DataFrame) -> DataFrame:
    """(graph, lod): whether all statements on linked open data are true; none means allowed."""
    said = F.when(F.col("p") == QTERM + "allowLinkedOpenData", F.lower("o") == "true")
    return quads.groupBy("graph").agg(F.coalesce(F.bool_and(said), F.lit(True)).alias("lod"))


def aggregate_bnodes(quads: DataFrame, about: DataFrame) -> DataFrame:
    """The graph with (about, aggregates, node) for blank nodes typed in the record terms; ``about`` is (graph, about)."""
    nodes = quads.filter((F.col("p") == TYPE) & (F.col("s_kind") == "BNode") & F.col("o").startswith(QTERM)).select("graph", F.col("s").alias("_node")).distinct()
    added = nodes.join(about, "graph").select("graph", F.col("about").alias("s"), F.lit("URIRef").alias("s_kind"), F.lit(ORE + "aggregates").alias("p"), F.col("_node").alias("o"), F.lit("BNode").alias("o_kind"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))
    return union_graphs(quads, added)


def invert_aggregated_by(quads: DataFrame) -> DataFrame:
    """(x isAggregatedBy y) becomes (y aggregates x)."""
    turn = F.col("p") == ORE + "isAggregatedBy"
    return quads.select("graph", F.when(turn, F.col("o")).otherwise(F.col("s")).alias("s"), F.when(turn, F.col("o_kind")).otherwise(F.col("s_kind")).alias("s_kind"), F.when(turn, F.lit(ORE + "aggregates")).otherwise(F.col("p")).alias("p"), F.when(turn, F.col("s")).otherwise(F.col("o")).alias("o"), F.when(turn, F.col("s_kind")).otherwise(F.col("o_kind")).alias("o_kind"), "datatype", "lang")


def rows_to_quads(df: DataFrame, mapping: dict[str, str], subject: str = "uri") -> DataFrame:
    """Rows as triples: ``mapping`` names a predicate for each column; lists fan out, http and urn strings are IRIs, nulls and empty strings go, views are typed as web resources."""
    parts = []
    kinds = dict(df.dtypes)
    for column, p in mapping.items():
        values = F.transform(column, lambda v: v.cast("string")) if kinds[column].startswith("array") else F.array(F.col(column).cast("string"))
        parts.append(F.transform(values, _pair(p)))
    rows = df.select(F.col(subject).alias("s"), F.explode(F.concat(*parts)).alias("_t")).select("s", "_t.p", "_t.o").filter("o is not null and o <> ''")
    typed = rows.filter(F.col("p") == EDM + "hasView").select(F.col("s").alias("_g"), F.col("o").alias("s"), F.lit(TYPE).alias("p"), F.lit(EDM + "WebResource").alias("o"))
    every = rows.select(F.col("s").alias("_g"), "s", "p", "o").unionByName(typed)
    return every.select(F.concat("_g", F.lit("/graph")).alias("graph"), "s", F.lit("URIRef").alias("s_kind"), "p", "o", F.when(F.col("o").rlike("^(http|urn)"), "URIRef").otherwise("Literal").alias("o_kind"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))


def _pair(p: str):
    return lambda v: F.struct(F.lit(p).alias("p"), v.alias("o"))


def add_about_triples(records: DataFrame) -> DataFrame:
    """Ten statements on the description of each record (source_uri, hub_id, spec, created, modified, licence, attribution, owner, lod)."""
    about = F.concat("source_uri", F.lit("/about"))
    said = [(TYPE, F.lit(FOAF + "Document"), "URIRef"), (FOAF + "primaryTopic", F.col("source_uri"), "URIRef")]
    said += [("http://purl.org/dc/terms/" + k, F.col(k), "Literal") for k in ("created", "modified")]
    said += [("http://creativecommons.org/ns#license", F.col("licence"), "URIRef"), ("http://creativecommons.org/ns#attributionName", F.col("attribution"), "Literal"), ("http://creativecommons.org/ns#attributionURL", F.col("source_uri"), "URIRef")]
    said += [(QTERM + "hubId", F.col("hub_id"), "Literal"), (QTERM + "spec", F.col("spec"), "Literal"), (QTERM + "allowLinkedOpenData", F.col("lod"), "Literal")]
    rows = F.array(*[F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(k).alias("o_kind")) for p, o, k in said])
    return records.select(F.concat("source_uri", F.lit("/graph")).alias("graph"), about.alias("s"), F.lit("URIRef").alias("s_kind"), F.explode(rows).alias("_t")).select("graph", "s", "s_kind", "_t.p", "_t.o", "_t.o_kind", F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))


def union_graphs(*graphs: DataFrame) -> DataFrame:
    """All triples of graphs of one name, each once."""
    out = graphs[0].select(*QUAD)
    for g in graphs[1:]:
        out = out.unionByName(g.select(*QUAD))
    return out.dropDuplicates()


def resource_labels(quads: DataFrame, label_props: list[str] = LABELS) -> DataFrame:
    """(graph, s, label, label_lang): a resource's literal of the best label property; of several the least."""
    found = quads.filter((F.col("o_kind") == "Literal") & F.col("p").isin(label_props))
    best = F.min(F.struct(rank_of(F.col("p"), label_props).alias("rank"), F.col("lang").alias("lang"), F.col("o").alias("o")))
    return found.groupBy("graph", "s").agg(best.alias("_b")).select("graph", "s", F.col("_b.o").alias("label"), F.col("_b.lang").alias("label_lang"))


def resolve_labels(quads: DataFrame, label_props: list[str] = LABELS) -> DataFrame:
    """Quads with (label, label_lang): of an object that is a resource with a label in the graph that label, else the object."""
    labels = resource_labels(quads, label_props).withColumnRenamed("s", "_s").withColumnRenamed("graph", "_g")
    joined = quads.join(labels, (F.col("graph") == F.col("_g")) & (F.col("o") == F.col("_s")) & (F.col("o_kind") != "Literal"), "left")
    return joined.select(*QUAD, F.coalesce("label", "o").alias("label"), F.coalesce("label_lang", "lang").alias("label_lang"))


def inline_enrichments(quads: DataFrame, proxy_type: str = QSYNC + "ProxyResource") -> DataFrame:
    """Objects that are proxies become their match, or their literal label where they have none; the proxies' own triples go."""
    proxies = quads.filter((F.col("p") == TYPE) & (F.col("o") == proxy_type)).select("graph", F.col("s").alias("_proxy")).distinct()
    match = quads.filter(F.col("p") == SAME_AS).groupBy("graph", F.col("s").alias("_proxy")).agg(F.min("o").alias("_match"))
    label = resource_labels(quads).withColumnRenamed("s", "_proxy")
    known = proxies.join(match, ["graph", "_proxy"], "left").join(label, ["graph", "_proxy"], "left").withColumnRenamed("graph", "_g")
    kept = quads.join(known.select("_g", F.col("_proxy").alias("_own")), (F.col("graph") == F.col("_g")) & (F.col("s") == F.col("_own")), "left_anti")
    j = kept.join(known, (F.col("graph") == F.col("_g")) & (F.col("o") == F.col("_proxy")), "left")
    literal = F.col("_proxy").isNotNull() & F.col("_match").isNull() & F.col("label").isNotNull()
    return j.select("graph", "s", "s_kind", "p", F.when(literal, F.col("label")).otherwise(F.coalesce("_match", "o")).alias("o"), F.when(literal, "Literal").otherwise(F.col("o_kind")).alias("o_kind"), "datatype", F.when(literal, F.col("label_lang")).otherwise(F.col("lang")).alias("lang"))


def describe(quads: DataFrame, targets: DataFrame) -> DataFrame:
    """All triples of the subjects in ``targets`` (uri)."""
    return quads.join(targets.select(F.col("uri").alias("_u")).distinct(), F.col("s") == F.col("_u"), "left_semi")


def context_one_hop(quads: DataFrame, targets: DataFrame) -> DataFrame:
    """Each triple of the targets, with the triples of its object where it has any: (s, p, o, p2, o2)."""
    near = describe(quads, targets).select("s", "p", "o").distinct()
    far = quads.select(F.col("s").alias("_s2"), F.col("p").alias("p2"), F.col("o").alias("o2")).distinct()
    # a type is a hot object that leads nowhere
    return near.join(far, (F.col("o") == F.col("_s2")) & (F.col("p") != TYPE), "left").drop("_s2")


def context_graph(quads: DataFrame, targets: DataFrame, proxy_type: str = QSYNC + "ProxyResource", dataset_type: str = QSYNC + "Dataset") -> DataFrame:
    """(level, s, p, o): the targets' triples, those of their objects that are proxies, and those of the proxies' objects that are no dataset."""
    plain = quads.select("s", "p", "o").distinct()
    first = plain.join(targets.select(F.col("uri").alias("s")).distinct(), "s", "left_semi")
    typed = quads.filter(F.col("p") == TYPE)
    proxies = typed.filter(F.col("o") == proxy_type).select("s").distinct()
    datasets = typed.filter(F.col("o") == dataset_type).select("s").distinct()
    second = plain.join(first.select(F.col("o").alias("s")).distinct().join(proxies, "s", "left_semi"), "s", "left_semi")
    third = plain.join(second.filter(F.col("p") != TYPE).select(F.col("o").alias("s")).distinct().join(datasets, "s", "left_anti"), "s", "left_semi")
    return first.withColumn("level", F.lit(1)).unionByName(second.withColumn("level", F.lit(2))).unionByName(third.withColumn("level", F.lit(3)))


def concept_context(quads: DataFrame, targets: DataFrame) -> DataFrame:
    """(s, p, o): a concept's triples, and the labels of their objects."""
    own = describe(quads, targets).select("s", "p", "o").distinct()
    labels = quads.filter(F.col("p").isin(SKOS + "prefLabel", SKOS + "altLabel")).select("s", "p", "o").distinct()
    return own.unionByName(labels.join(own.select(F.col("o").alias("s")).distinct(), "s", "left_semi")).distinct()


def media_context(quads: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """All triples of the graphs in which something has a view; of the targets' (uri) alone if given."""
    views = quads.filter(F.col("p") == EDM + "hasView")
    if targets is not None:
        views = views.join(targets.select(F.col("uri").alias("_u")).distinct(), F.col("s") == F.col("_u"), "left_semi")
    return quads.join(views.select("graph").distinct(), "graph", "left_semi")


def concept_links(quads: DataFrame) -> DataFrame:
    """(concept, s, graph): concepts that something matches exactly, with the subjects that refer to them."""
    matched = quads.filter(F.col("p") == SAME_AS).select(F.col("o").alias("concept")).distinct()
    refers = quads.filter((F.col("o_kind") == "URIRef") & ~F.col("p").isin(TYPE, SAME_AS)).select(F.col("o").alias("concept"), "s", "graph").distinct()
    return refers.join(matched, "concept", "left_semi")


def cached_source(quads: DataFrame, base: str) -> DataFrame:
    """The graph with (uri, cacheUrl, cache IRI) for every web object, and the IRI a cache IRI stands for."""
    from ..functions.ids import cache_url

    objects = quads.filter((F.col("o_kind") == "URIRef") & F.col("o").startswith("http")).select("graph", F.col("o").alias("s")).distinct()
    added = objects.select("graph", "s", F.lit("URIRef").alias("s_kind"), F.lit(QTERM + "cacheUrl").alias("p"), cache_url(F.col("s"), base).alias("o"), F.lit("URIRef").alias("o_kind"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))
    return union_graphs(quads, added)


def inline_previews(quads: DataFrame, fields: dict[str, str], base: str) -> DataFrame:
    """(graph, s, p, o, preview): links to records under ``base`` as a JSON preview of the linked record's fields."""
    links = quads.filter((F.col("o_kind") == "URIRef") & F.col("o").startswith(base) & (F.concat("o", F.lit("/graph")) != F.col("graph")))
    names = F.create_map(*[F.lit(x) for pair in fields.items() for x in pair])
    shown = quads.filter(F.col("p").isin(list(fields))).groupBy("s", "p").agg(F.min("o").alias("o"))
    entry = F.struct(F.try_element_at(names, F.col("p")).alias("key"), F.col("o").alias("value"))
    preview = shown.groupBy("s").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("preview")).withColumnRenamed("s", "_linked")
    return links.join(preview, F.col("o") == F.col("_linked"), "left").select("graph", "s", "p", "o", "preview")


# ---- windows and aggregates of a graph ----


def reduce_duplicates(quads: DataFrame, preds: list[str], leave: int) -> tuple[DataFrame, DataFrame]:
    """The graph with the first ``leave`` triples, by subject and object, of each listed predicate, and (graph, removed)."""
    w = Window.partitionBy("graph", "p").orderBy("s", "o")
    listed = quads.filter(F.col("p").isin(preds)).withColumn("_n", F.row_number().over(w))
    kept = quads.filter(~F.col("p").isin(preds)).unionByName(listed.filter(F.col("_n") <= leave).drop("_n"))
    return kept, listed.filter(F.col("_n") > leave).groupBy("graph").agg(F.count(F.lit(1)).alias("removed"))


def order_media(quads: DataFrame) -> DataFrame:
    """(graph, s, place): web resources by their sort order, 0 if they have none, then by IRI; place from 1."""
    media = quads.filter((F.col("p") == TYPE) & (F.col("o") == EDM + "WebResource")).select("graph", "s").distinct()
    order = quads.filter(F.col("p") == QTERM + "resourceSortOrder").groupBy("graph", "s").agg(F.min(F.col("o").try_cast("int")).alias("_o"))
    w = Window.partitionBy("graph").orderBy(F.coalesce("_o", F.lit(0)), "s")
    return media.join(order, ["graph", "s"], "left").withColumn("place", F.row_number().over(w)).drop("_o")


def views_in_order(quads: DataFrame) -> DataFrame:
    """Quads with ``place``: views are the web resources of their graph in the order of ``order_media``; null on other quads.

    An aggregation that has any view, and the record itself, have all web resources as views, so
    views of an aggregation that are none go, and those of a graph without web resources.
    """
    kinds = quads.filter((F.col("p") == TYPE) & (F.col("o") == ORE + "Aggregation")).select("graph", "s").distinct().withColumn("_agg", F.lit(True))
    marked = quads.filter(F.col("p") == EDM + "hasView").join(kinds, ["graph", "s"], "left")
    media = order_media(quads).withColumnRenamed("s", "o")
    records = media.select("graph", F.regexp_replace("graph", "/graph$", "").alias("s"))
    holders = marked.filter("_agg").select("graph", "s").unionByName(records).distinct()
    null = F.lit(None).cast("string")
    views = media.join(holders, "graph").select("graph", "s", F.lit("URIRef").alias("s_kind"), F.lit(EDM + "hasView").alias("p"), "o", F.lit("URIRef").alias("o_kind"), null.alias("datatype"), null.alias("lang"), "place")
    others = marked.filter("_agg is null").drop("_agg").join(views.select("graph", "s", "o"), ["graph", "s", "o"], "left_anti")
    kept = quads.filter((F.col("p") != EDM + "hasView") | F.col("p").isNull()).select(*QUAD).unionByName(others.select(*QUAD))
    return kept.withColumn("place", F.lit(None).cast("int")).unionByName(views)


def pick_thumbnail(quads: DataFrame, order: list[str] = THUMBNAILS) -> DataFrame:
    """(graph, thumbnail): the least value of the first predicate in order that has one."""
    found = quads.filter(F.col("p").isin(order))
    return found.groupBy("graph").agg(F.min(F.struct(rank_of(F.col("p"), order).alias("rank"), F.col("o").alias("o")))["o"].alias("thumbnail"))


def graph_statistics(quads: DataFrame, by: str | None = "graph", top: int = 50, exclude: list[str] = EXCLUDED) -> DataFrame:
    """([graph,] kind, value, n): the most frequent languages, classes and properties."""
    kinds = F.filter(
        F.array(
            F.struct(F.lit("language").alias("kind"), F.col("lang").alias("value")),
            F.struct(F.lit("class").alias("kind"), F.when(F.col("p") == TYPE, F.col("o")).alias("value")),
            F.struct(F.lit("property").alias("kind"), F.when(~F.col("p").isin(exclude), F.col("p")).alias("value")),
        ),
        lambda x: x["value"].isNotNull(),
    )
    keys = [by] if by else []
    counted = quads.select(*keys, F.explode(kinds).alias("_k")).groupBy(*keys, "_k.kind", "_k.value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys, "kind").orderBy(F.desc("n"), "value")
    return counted.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).drop("_r")


def graph_profile(quads: DataFrame) -> DataFrame:
    """(graph, subjects, classes, languages, predicates): the different ones of a record, in order."""
    lists = {"subjects": F.col("s"), "classes": F.when(F.col("p") == TYPE, F.col("o")), "languages": F.col("lang"), "predicates": F.col("p")}
    return quads.groupBy("graph").agg(*[F.array_sort(F.collect_set(c)).alias(k) for k, c in lists.items()])


def captions(quads: DataFrame) -> DataFrame:
    """(graph, captions): literals of the graph's best label property, each once and in order."""
    found = quads.filter((F.col("o_kind") == "Literal") & F.col("p").isin(CAPTIONS)).select("graph", rank_of(F.col("p"), CAPTIONS).alias("rank"), "o")
    best = found.groupBy("graph").agg(F.min("rank").alias("rank"))
    return found.join(best, ["graph", "rank"]).groupBy("graph").agg(F.array_sort(F.collect_set("o")).alias("captions"))


def first_literals(quads: DataFrame, predicates: list[str]) -> DataFrame:
    """One column for each predicate, named by its search label: the least literal of the graph."""
    found = quads.filter((F.col("o_kind") == "Literal") & F.col("p").isin(predicates))
    return found.groupBy("graph").agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(_label(p)) for p in predicates])


def _label(p: str) -> str:
    from ..functions.namespaces import BY_PREFIX

    ns = p[: max(p.rfind("#"), p.rfind("/")) + 1]
    return next((f"{k}_{p[len(ns):]}" for k, v in BY_PREFIX.items() if v == ns), p)


def geo_points(quads: DataFrame) -> DataFrame:
    """(graph, points, only_geohash): "lat,lon" of the subjects that have both, none if one is no number; else what geoHash says."""
    sides = quads.filter(F.col("p").isin(WGS84 + "lat", WGS84 + "long")).groupBy("graph", "s").agg(F.min(F.when(F.col("p") == WGS84 + "lat", F.col("o"))).alias("lat"), F.min(F.when(F.col("p") == WGS84 + "long", F.col("o"))).alias("lon"))
    pair = sides.filter("lat is not null and lon is not null").groupBy("graph").agg(F.bool_and(F.col("lat").try_cast("double").isNotNull() & F.col("lon").try_cast("double").isNotNull()).alias("_good"), F.array_sort(F.collect_set(F.concat_ws(",", "lat", "lon"))).alias("_pairs"))
    told = quads.filter((F.col("p") == QTERM + "geoHash") & F.col("o").rlike("^[^,]+,[^,]+$")).groupBy("graph").agg(F.array_sort(F.collect_set("o")).alias("_told"))
    both = pair.filter("_good").join(told, "graph", "full_outer")
    return both.select("graph", F.coalesce("_pairs", "_told").alias("points"), F.col("_pairs").isNull().alias("only_geohash"))


def resources_by_type(quads: DataFrame, rdf_type: str, field: str, tag: str | None = None) -> DataFrame:
    """(value, resources, graphs, tags): resources of a type by a property, equal values merged.

    ``resources`` and ``graphs`` are counts; ``tags`` is the union, in order, of the non-empty values
    that the property ``tag`` has on the merged resources, empty without one. A resource without
    tags still counts.
    """
    typed = quads.filter((F.col("p") == TYPE) & (F.col("o") == rdf_type)).select("graph", "s").distinct()
    values = quads.filter(F.col("p") == field).select("graph", "s", F.col("o").alias("value")).join(typed, ["graph", "s"], "left_semi")
    counted = values.groupBy("value").agg(F.countDistinct("s").alias("resources"), F.countDistinct("graph").alias("graphs"))
    named = quads.filter((F.col("p") == F.lit(tag)) & (F.col("o") != "")).select("graph", "s", F.col("o").alias("tag"))
    tags = values.join(named, ["graph", "s"]).groupBy("value").agg(F.array_sort(F.collect_set("tag")).alias("_tags"))
    return counted.join(tags, "value", "left").select("value", "resources", "graphs", F.coalesce("_tags", F.array().cast("array<string>")).alias("tags"))


def count_triples(quads: DataFrame, by: str = "graph") -> DataFrame:
    return quads.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def ask(quads: DataFrame, graphs: DataFrame) -> DataFrame:
    """(graph, held): whether each of the named graphs has any triple."""
    known = quads.select("graph").distinct().withColumn("held", F.lit(True))
    return graphs.select("graph").distinct().join(known, "graph", "left").select("graph", F.coalesce("held", F.lit(False)).alias("held"))


# ---- graph store ----


def put_graphs(store: DataFrame, new: DataFrame) -> DataFrame:
    """Named graphs of ``new`` replace those of the store."""
    return drop_graphs(store, new.select("graph").distinct()).unionByName(new.select(*QUAD).dropDuplicates())


def post_graphs(store: DataFrame, new: DataFrame) -> DataFrame:
    return union_graphs(store, new)


def drop_graphs(store: DataFrame, graphs: DataFrame) -> DataFrame:
    return store.select(*QUAD).join(graphs.select("graph").distinct(), "graph", "left_anti").select(*QUAD)


def set_sync_flag(quads: DataFrame, dataset: str, value: bool) -> DataFrame:
    """The sync flag of all graphs of a dataset, which are those that say they belong to it."""
    mine = quads.filter((F.col("p") == QSYNC + "belongsTo") & (F.col("o") == dataset)).select("graph").distinct().withColumn("_mine", F.lit(True))
    joined = quads.join(mine, "graph", "left")
    return joined.withColumn("o", F.when(F.col("_mine") & (F.col("p") == QSYNC + "synced"), F.lit(str(value).lower())).otherwise(F.col("o"))).select(*QUAD)


def delete_dataset(quads: DataFrame, dataset: str, scope: str = "records") -> DataFrame:
    """Without a dataset's record graphs; with scope ``all`` without its thesaurus, mapping and own graphs too."""
    mine = quads.filter((F.col("p") == QSYNC + "belongsTo") & (F.col("o") == dataset)).select("graph").distinct()
    if scope == "all":
        mine = mine.unionByName(quads.filter(F.col("graph").startswith(dataset + "/")).select("graph").distinct()).distinct()
    return drop_graphs(quads, mine)


def delete_media_graphs(quads: DataFrame, spec: str) -> DataFrame:
    """Without the graphs that hold web resources of a spec."""
    media = quads.filter((F.col("p") == TYPE) & (F.col("o") == EDM + "WebResource") & F.col("s").startswith(f"urn:{spec}/")).select("graph").distinct()
    return drop_graphs(quads, media)


def search_fields(quads: DataFrame) -> DataFrame:
    """Quads with the search label of their predicate; predicates of unknown namespaces go."""
    return quads.withColumn("label_of", search_label(F.col("p"))).filter("label_of is not null")

