"""Conversion of search documents to flat schemas, and of graphs to JSON and XML."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import clean_local_id
from ..functions.namespaces import EDM, ORE, SKOS, TYPE, local_name, namespace_of, search_label

# Fields that every flat schema has, by namespace of the output key.
SHARED_DC = "title Title creator subject description publisher contributor date type format identifier source language relation coverage rights".split()
SHARED_DCTERMS = "created extent hasFormat hasPart hasVersion isFormatOf isPartOf isReferencedBy isReplacedBy isRequiredBy isVersionOf issued medium references replaces requires tableOfContents alternative spatial temporal provenance rightsHolder".split()
SHARED_EUROPEANA = "aggregatedCHO begin collectionName collectionTitle country currentLocation dataProvider end hasMet hasView isRelatedTo isRepresentationOf isShownAt isShownBy language object provider rights source type unstored uri".split()
# Fields of each schema's own namespace; they come from the qterm fields of the same name.
OWN = {
    "tib": "citName citOldId thumbLarge thumbSmall collection creatorRole productionPeriod productionStart productionEnd creatorBirthYear creatorDeathYear formatted year dimension objectNumber objectSoort material place technique color colorHex design exhibition subjectDepicted date collectionPart person region event theme pageStart pageEnd pages vindplaats location imageCopyright imageCreator".split(),
    "icn": "acceptedStateCharges acceptedStateChargesReason acquiredWithHelpFrom acquisitionMeans acquisitionYear collectionPart collectionType creatorRole creatorYearOfBirth creatorYearOfDeath currentLocation expulsionMeans expulsionYear legalStatus location material musipCollectionDisplayName musipCollectionUri musipMuseumDisplayName musipMuseumUri physicalState productionPeriod productionPlace province purchasePrice rijksCollection subjectDepicted technique thumbLarge thumbSmall dimension productionStart productionEnd objectNumber objectSoort".split(),
    "abm": "municipality municipalityNr aboutPerson county countyNr country namedPlace estateName estateNr propertyName propertyNr contentProvider address digitised introduction classification utm polygon_utm polygon_latLong latLong type collectionType category creatorUri videoUri soundUri imageUri textUri".split(),
    "ese": [],
}
# Output keys whose source has another name.
ICN_DEEPZOOM = {"icn_deepzoomURL": "qterm_thumbLarge"}
QSITE = {"qsite_year": "qsite_year", "qsite_thumbnail": "qterm_thumbnail", "qsite_deepZoomUrl": "qterm_deepZoomUrl", "qsite_fullTextObjectUrl": "qterm_fullTextObjectUrl", "qsite_fullText": "qterm_fullText", "qsite_geohash": "point"}
# Prefixes of query keys of each schema and what the index calls them.
KEY_PREFIXES = {"tib": {"europeana_": "edm_", "tib_": "qterm_"}, "icn": {"icn_": "qterm_", "europeana_": "edm_"}, "abm": {"abm_": "qterm_", "europeana_": "edm_"}, "ese": {"europeana_": "edm_"}, "edm": {"europeana_": "edm_"}, "v2": {}}
# Types that strict output keeps.
STRICT_TYPES = [ORE + "Aggregation", *[EDM + t for t in ("ProvidedCHO", "Place", "Agent", "TimeSpan", "Organisation")], SKOS + "Concept"]


def mapping(schema: str) -> dict[str, str]:
    """Output key to document field."""
    out = {f"dc_{n}": f"dc_{n}" for n in SHARED_DC} | {f"dcterms_{n}": f"dcterms_{n}" for n in SHARED_DCTERMS} | {f"europeana_{n}": f"edm_{n}" for n in SHARED_EUROPEANA}
    out |= {f"{schema}_{n}": f"qterm_{n}" for n in OWN[schema]}
    return out | (ICN_DEEPZOOM if schema == "icn" else {})


def convert(docs: DataFrame, schema: str, qsite: bool = True) -> DataFrame:
    """Documents with ``flat``: array(struct(key, values)) in order of key.

    ``fields`` gives the values; custom fields keep their name, qterm fields of resources and
    locations become qsite ones.
    """
    pairs = mapping(schema) | (QSITE if qsite else {})
    by_field: dict[str, list[str]] = {}
    for key, field in pairs.items():
        by_field.setdefault(field, []).append(key)
    keys = F.create_map(*[x for f, ks in by_field.items() for x in (F.lit(f), F.array(*[F.lit(k) for k in ks]))])
    extra = lambda f: F.when(f.startswith("custom_"), F.array(f)).when(f.startswith("qterm_") & (f.contains("_resource") | f.contains("_location")), F.array(F.regexp_replace(f, "^qterm_", "qsite_")))
    none = F.array().cast("array<string>")
    renamed = F.transform(F.map_entries("fields"), lambda e: F.transform(F.array_distinct(F.concat(F.coalesce(F.try_element_at(keys, e["key"]), none), F.coalesce(extra(e["key"]), none))), lambda k: F.struct(k.alias("key"), F.transform(e["value"], lambda x: x["value"]).alias("values"))))
    return docs.withColumn("flat", F.array_sort(F.flatten(renamed)))


def value_of(key: str, flat: str = "flat") -> Column:
    """Values of an output key, null if it is not there."""
    return F.try_element_at(F.filter(flat, lambda x: x["key"] == key), F.lit(1))["values"]


def add_defaults(converted: DataFrame, org: str) -> DataFrame:
    """The keys that every flat record has; ``converted`` has flat, source_uri and maybe legacy (a map).

    Landing pages in a server's own files go. The title comes from the document unless the legacy
    block has one that is not null.
    """
    parts = F.split("source_uri", "/")
    spec = F.element_at(parts, -2)
    hub = F.concat_ws("_", F.lit(org), spec, clean_local_id(F.element_at(parts, -1)))
    local = F.array(F.concat_ws("/", F.slice(F.split(hub, "_"), 2, 100)))
    resource = value_of("qsite_resourceUri")
    obj = F.coalesce(resource, value_of("europeana_object"))
    geo = F.coalesce(value_of("qsite_locationLatLong"), value_of("qsite_geoHash"))
    shown = value_of("europeana_isShownAt")
    own_file = F.exists(F.coalesce(shown, F.array().cast("array<string>")), lambda v: v.startswith("file:///opt"))
    yes = lambda c: F.array(c.cast("string"))
    legacy = {k: F.try_element_at("legacy", F.lit(k)) for k in ("qsite_collection", "qsite_title", "qsite_recordType", "qsite_creator", "qsite_owner", "qsite_provider")} if "legacy" in converted.columns else {}
    said = lambda k: F.when(legacy[k].isNotNull() & (legacy[k] != "null"), F.array(legacy[k])) if k in legacy else F.lit(None).cast("array<string>")
    made = {
        "qsite_recordType": F.coalesce(said("qsite_recordType"), F.array(F.lit("mdr"))),
        "qsite_hubId": F.array(hub),
        "qsite_pmhId": F.array(hub),
        "qsite_spec": F.array(spec),
        "europeana_uri": local,
        "europeana_object": obj,
        "qsite_hasDigitalObject": yes(obj.isNotNull()),
        "qsite_thumbnail": F.coalesce(obj, value_of("qsite_thumbnail")),
        "qsite_geoHash": geo,
        "qsite_hasGeoHash": yes(geo.isNotNull()),
        "europeana_isShownAt": F.when(~own_file, shown),
        "qsite_hasLandingPage": yes(F.coalesce(shown.isNotNull() & ~own_file, F.lit(False))),
        "qsite_title": F.coalesce(said("qsite_title"), value_of("dc_title")),
        "europeana_collectionName": F.array(spec),
        "qsite_orgId": F.array(F.lit(org)),
    } | {k: said(k) for k in ("qsite_collection", "qsite_creator", "qsite_owner", "qsite_provider")}
    added = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("values")) for k, v in made.items()]), lambda x: x["values"].isNotNull())
    kept = F.filter("flat", lambda x: ~x["key"].isin(list(made)))
    return converted.withColumn("flat", F.array_sort(F.concat(kept, added)))


def convert_v2(docs: DataFrame) -> DataFrame:
    """Documents with ``flat``: their fields but for rdf and qsync ones, in order of key."""
    kept = F.filter(F.map_entries("fields"), lambda e: (e["key"] != "rdf") & ~e["key"].startswith("qsync_"))
    return docs.withColumn("flat", F.array_sort(F.transform(kept, lambda e: F.struct(e["key"].alias("key"), F.transform(e["value"], lambda x: x["value"]).alias("values")))))


def to_edm_json(quads: DataFrame) -> DataFrame:
    """(graph, json): an array of one object for each subject, with its types, and values by qualified name."""
    value = F.when(F.col("o_kind") == "Literal", F.struct(F.lit(None).cast("string").alias("@id"), F.col("o").alias("@value"), F.col("lang").alias("@language"), F.col("datatype").alias("@type"))).otherwise(F.struct(F.col("o").alias("@id"), F.lit(None).cast("string").alias("@value"), F.lit(None).cast("string").alias("@language"), F.lit(None).cast("string").alias("@type")))
    props = quads.filter(F.col("p") != TYPE).groupBy("graph", "s", F.regexp_replace(search_label(F.col("p")), "_", ":").alias("k")).agg(F.array_sort(F.collect_set(value)).alias("v")).filter("k is not null")
    per = props.groupBy("graph", "s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    types = quads.groupBy("graph", "s").agg(F.array_sort(F.collect_set(F.when(F.col("p") == TYPE, F.col("o")))).alias("types"))
    node = F.struct(F.col("s").alias("@id"), F.col("types").alias("@type"), F.col("props").alias("properties"))
    return types.join(per, ["graph", "s"], "left").groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("s", F.to_json(node).alias("j")))).alias("n")).select("graph", F.concat(F.lit("["), F.array_join(F.transform("n", lambda x: x["j"]), ","), F.lit("]")).alias("json"))


def xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def to_edm_xml(quads: DataFrame, strict: bool = True) -> DataFrame:
    """(graph, xml): one element for each subject; strict keeps supported types, named by them, without aggregates and views."""
    kept = quads.filter(~F.col("p").isin(ORE + "aggregates", EDM + "hasView")) if strict else quads
    types = kept.filter(F.col("p") == TYPE)
    named = (types.filter(F.col("o").isin(STRICT_TYPES)) if strict else types).groupBy("graph", "s").agg(F.max("o").alias("_type"))
    element = lambda iri: F.concat(F.lit("<x:"), local_name(iri), F.lit(' xmlns:x="'), namespace_of(iri), F.lit('"'))
    close = lambda iri: F.concat(F.lit("</x:"), local_name(iri), F.lit(">"))
    ref = F.concat(element(F.col("p")), F.lit(' rdf:resource="'), xml_escape(F.col("o")), F.lit('"/>'))
    lang = F.when(F.col("lang").isNotNull(), F.concat(F.lit(' xml:lang="'), F.col("lang"), F.lit('"'))).otherwise("")
    text = F.concat(element(F.col("p")), lang, F.lit(">"), xml_escape(F.col("o")), close(F.col("p")))
    lines = kept.filter(F.col("p") != TYPE).select("graph", "s", F.when(F.col("o_kind") == "Literal", text).otherwise(ref).alias("line"))
    body = lines.groupBy("graph", "s").agg(F.array_join(F.array_sort(F.collect_set("line")), "").alias("_body"))
    node = F.concat(element(F.col("_type")), F.lit(' rdf:about="'), xml_escape(F.col("s")), F.lit('">'), F.coalesce("_body", F.lit("")), close(F.col("_type")))
    per = named.join(body, ["graph", "s"], "left").select("graph", node.alias("node"))
    root = F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">')
    return per.groupBy("graph").agg(F.concat(root, F.array_join(F.array_sort(F.collect_list("node")), ""), F.lit("</rdf:RDF>")).alias("xml"))


#: Converters by name; users add theirs.
CONVERTERS: dict[str, Callable[[DataFrame], DataFrame]] = {s: (lambda docs, s=s: convert(docs, s)) for s in OWN} | {"v2": convert_v2}


def register_converter(name: str, function: Callable[[DataFrame], DataFrame]) -> None:
    CONVERTERS[name] = function


def apply_hooks(df: DataFrame, hooks: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """User functions on a table of records, one after the other."""
    for hook in hooks:
        df = df.transform(hook)
    return df
