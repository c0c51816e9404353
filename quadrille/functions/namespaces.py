"""Namespaces, qualified names and search labels of predicates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prefix and namespace pairs that records and converters rely on. Those below schemas.example.org stand for
# a site's own: ``translated`` puts a caller's in their place.
NAMESPACES = {
    "abm": "http://purl.org/abm/sen",
    "europeana": "http://www.europeana.eu/schemas/ese/",
    "dc": "http://purl.org/dc/elements/1.1/",
    "qsite": "http://schemas.example.org/qsite/",
    "dcterms": "http://purl.org/dc/terms/",
    "custom": "http://schemas.example.org/custom/",
    "musip": "http://www.musip.nl/",
    "itin": "http://www.itin.nl/namespace",
    "drup": "http://www.itin.nl/drupal",
    "abc": "http://www.ab-c.nl/",
    "raw": "http://schemas.example.org/raw",
    "icn": "http://www.icn.nl/schemas/icn/",
    "aff": "http://schemas.example.org/aff/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "dbpedia-owl": "http://dbpedia.org/ontology/",
    "wgs84_pos": "http://www.w3.org/2003/01/geo/wgs84_pos#",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "owl": "http://www.w3.org/2002/07/owl#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "edm": "http://www.europeana.eu/schemas/edm/",
    "ore": "http://www.openarchives.org/ore/terms/",
    "qsync": "http://schemas.example.org/qsync/",
    "qterm": "http://schemas.example.org/qterm/",
    "tib": "http://schemas.example.org/tib/",
    "cc": "http://creativecommons.org/ns#",
    "gn": "http://www.geonames.org/ontology#",
    "rda": "http://rdvocab.info/ElementsGr2/",
    "nk": "http://data.collectienederland.nl/ns/nk/",
    "crm": "http://www.cidoc-crm.org/cidoc-crm/",
    "rdau": "http://www.rdaregistry.info/Elements/u/",
    "ebucore": "http://www.ebu.ch/metadata/ontologies/ebucore/ebucore#",
}


def full_namespace(ns: str) -> str:
    """A namespace that ends in neither / nor # gets a /."""
    return ns if ns.endswith(("/", "#")) else ns + "/"


BY_PREFIX = {prefix: full_namespace(ns) for prefix, ns in NAMESPACES.items()}
RDF, SKOS, DC, DCTERMS, EDM, ORE, QTERM, QSYNC, FOAF, RDFS, GN, WGS84 = (BY_PREFIX[p] for p in ("rdf", "skos", "dc", "dcterms", "edm", "ore", "qterm", "qsync", "foaf", "rdfs", "gn", "wgs84_pos"))
TYPE = RDF + "type"


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def namespace_of(iri: Column) -> Column:
    """Everything up to the last # or, without one, the last /."""
    return F.regexp_extract(iri, r"^(.*#|[^#]*/)", 1)


def local_name(iri: Column) -> Column:
    return F.regexp_replace(iri, r"^(.*#|[^#]*/)", "")


def to_qname(iri: Column) -> Column:
    """prefix:label, null if the namespace is not known."""
    prefix = F.try_element_at(_lookup({ns: p for p, ns in BY_PREFIX.items()}), namespace_of(iri))
    return F.concat(prefix, F.lit(":"), local_name(iri))


def search_label(iri: Column) -> Column:
    """prefix_label: the name a predicate has as a field of a document."""
    return F.regexp_replace(to_qname(iri), ":", "_")


def label_to_iri(label: Column) -> Column:
    """IRI of prefix:label or prefix_label, null if the prefix is not known."""
    prefix = F.regexp_extract(label, r"^(dbpedia-owl|wgs84_pos|[A-Za-z0-9-]+)[_:]", 1)
    rest = F.regexp_replace(label, r"^(dbpedia-owl|wgs84_pos|[A-Za-z0-9-]+)[_:]", "")
    return F.concat(F.try_element_at(_lookup(BY_PREFIX), prefix), rest)


def namespaced_tag(iri: Column) -> Column:
    """{namespace}label, split at # or else at the last /."""
    return F.concat(F.lit("{"), namespace_of(iri), F.lit("}"), local_name(iri))


def read_vocabulary(path: str) -> dict[str, str]:
    """Pairs of namespaces or key prefixes, ours and a site's own, from a JSON object in a file of the driver."""
    with open(path, encoding="utf-8") as f:
        return {str(k): str(v) for k, v in json.load(f).items()}


def translated(c: Column, vocabulary: dict[str, str], back: bool = False) -> Column:
    """IRI or field key with its namespace or prefix as the site has it, or, with ``back``, as we have it; longest first."""
    pairs = [(v, k) if back else (k, v) for k, v in vocabulary.items()]
    chosen = F.lit(None).cast("string")
    for old, new in sorted(pairs, key=lambda p: len(p[0])):
        chosen = F.when(c.startswith(old), F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 30))).otherwise(chosen)
    return F.coalesce(chosen, c)


def translate_quads(quads: DataFrame, vocabulary: dict[str, str], back: bool = False) -> DataFrame:
    """Quads with the namespaces of predicates, IRI objects and datatypes translated; literals stay."""
    objects = F.when(F.col("o_kind") == "URIRef", translated(F.col("o"), vocabulary, back)).otherwise(F.col("o"))
    return quads.withColumns({"p": translated(F.col("p"), vocabulary, back), "o": objects, "datatype": translated(F.col("datatype"), vocabulary, back)})
