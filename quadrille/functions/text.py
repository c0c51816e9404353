"""Values of documents, search parameters, harvest tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields of the qsite namespace that are not kept in the legacy block.
NON_LEGACY = ["qsite_deepZoomUrl", "qsite_geohash", "qsite_year", "qsite_thumbnail", "qsite_fullTextObjectUrl", "qsite_fullText", "qsite_spec"]
XSD = "http://www.w3.org/2001/XMLSchema#"


def typed_literal(o: Column, datatype: Column) -> Column:
    """struct(bool, int, text): the value under its datatype; text longer than 32766 is cut to 32700."""
    return F.struct(
        F.when(datatype == XSD + "boolean", F.lower(o) == "true").alias("bool"),
        F.when(datatype == XSD + "integer", o.try_cast("long")).alias("int"),
        F.when(~F.coalesce(datatype, F.lit("")).isin(XSD + "boolean", XSD + "integer"), F.when(F.length(o) > 32766, F.left(o, F.lit(32700))).otherwise(o)).alias("text"),
    )


def index_entry(o: Column, kind: Column, lang: Column, iri: Column | None = None, whole: bool = False) -> Column:
    """struct(type, id, value, raw, lang): raw cut to 256 with " as '; value cut to 32700 if over 32765, but never with ``whole``."""
    value = o if whole else F.when(F.length(o) > 32765, F.left(o, F.lit(32700))).otherwise(o)
    return F.struct(
        kind.alias("type"),
        F.when(kind == "URIRef", iri if iri is not None else o).alias("id"),
        value.alias("value"),
        F.translate(F.left(o, F.lit(256)), '"', "'").alias("raw"),
        lang.alias("lang"),
    )


def strip_control_chars(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{C}", "")


def natural_key(c: Column) -> Column:
    """A key that sorts runs of digits as numbers: digits are padded to 20."""
    parts = F.regexp_extract_all(c, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 20, "0")).otherwise(F.lower(x))), "")


def normalise_field(key: Column) -> Column:
    """Prefixes of older schemas become qterm_ and edm_; an index suffix goes."""
    out = F.regexp_replace(F.regexp_replace(key, "abm_|tib_|icn_|qsite_", "qterm_"), "europeana_", "edm_")
    return F.regexp_replace(out, "_(string|facet|text)$", "")


def facet_key(key: Column) -> Column:
    """Index field of a facet: legacy and spec fields move, .raw is added, leading - and + go."""
    moved = F.when(key.startswith("qsite_spec"), F.lit("system.spec.raw")).when(key.startswith("qsite_") & ~key.isin(*NON_LEGACY), F.concat(F.lit("legacy."), key)).otherwise(key)
    return F.regexp_replace(F.when(moved.contains("."), moved).otherwise(F.concat(moved, F.lit(".raw"))), "^[-+]+", "")


def is_fielded(q: Column) -> Column:
    return q.rlike(r"[_a-zA-Z0-9\.]+:\S|\sNOT\s|\sAND\s|\sOR\s")


def rewrite_query(q: Column) -> Column:
    """Field names of a query as the index has them."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(q, "_text:", ".value:"), "_facet:", ".raw:"), "_string:", ".raw:")
    out = F.regexp_replace(out, r"(\w+)_(\w+):", "$1_$2.value:")
    none_of = "".join(f"(?!{k})" for k in NON_LEGACY)
    legacy = F.regexp_replace(out, f"({none_of}qsite_[a-zA-Z]+)\\.value:", "legacy.$1.value:")
    return F.when(out.contains("qsite_spec.value"), F.replace(out, F.lit("qsite_spec.value"), F.lit("system.spec.raw"))).when(out.contains("qsite_"), legacy).otherwise(out)


def parse_filters(filters: Column, exclude: list[str] | None = None) -> Column:
    """array(struct(field, value)), each once and in order: what stands after the first colon is the value; the rest are free queries."""

    def one(f: Column) -> Column:
        key = F.regexp_replace(F.substring_index(f, ":", 1), "_facet|_string|_text", "")
        key = F.when(key.startswith("qsite_") & ~key.isin(*NON_LEGACY), F.concat(F.lit("legacy."), key)).otherwise(key)
        value = F.translate(F.regexp_replace(f, "^[^:]*:", ""), '"', "'")
        free = f.startswith("(") | f.contains(" OR ") | ~f.contains(":")
        return F.when(free, F.struct(F.lit("query").alias("field"), f.alias("value"))).otherwise(F.struct(key.alias("field"), value.alias("value")))

    kept = F.filter(filters, lambda f: f.isNotNull() & (f != "") & (~F.replace(f, F.lit(".raw"), F.lit("")).isin(*exclude) if exclude else F.lit(True)))
    return F.array_sort(F.array_distinct(F.transform(kept, one)))


def clean_params(query_string: Column) -> Column:
    """array(struct(key, value)) of a query string: aliases resolved, keys that start with _ left out."""

    def one(pair: Column) -> Column:
        raw = F.url_decode(F.substring_index(pair, "=", 1))
        value = F.when(pair.contains("="), F.url_decode(F.regexp_replace(pair, "^[^=]*=", ""))).otherwise(F.lit(""))
        key = F.when(raw == "qf[]", "qf").when(raw == "hqf[]", "hqf").when(raw.isin("facet.field[]", "facet.field", "facet_field"), "facet").otherwise(raw)
        return F.struct(key.alias("key"), F.when(key == "facet", F.replace(value, F.lit("_facet"), F.lit(".raw"))).otherwise(value).alias("value"))

    pairs = F.filter(F.split(F.coalesce(query_string, F.lit("")), "&"), lambda p: p != "")
    return F.filter(F.transform(pairs, one), lambda x: ~x["key"].startswith("_"))


def parse_collection_query(query: Column) -> Column:
    """Filters of a saved query: the qf values after its question mark."""
    return F.transform(F.filter(clean_params(F.regexp_extract(query, r"\?(.*)$", 1)), lambda x: x["key"] == "qf"), lambda x: x["value"])


def encode_token(prefix: Column, start: Column, until: Column, spec: Column, cursor: Column, size: Column) -> Column:
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit(""))) for k, v in (("prefix", prefix), ("from", start), ("until", until), ("set", spec), ("cursor", cursor), ("list_size", size))]
    # Spark breaks the lines of long base64
    return F.regexp_replace(F.base64(F.encode(F.concat_ws("::", *parts), "UTF-8")), "\\s", "")


def decode_token(token: Column) -> Column:
    return F.str_to_map(F.decode(F.unbase64(token), "UTF-8"), F.lit("::"), F.lit("="))


def fmt_date(c: Column) -> Column:
    """A request's date, with or without time, as YYYY-MM-DDTHH:MM:SS+0000."""
    return F.date_format(F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))), "yyyy-MM-dd'T'HH:mm:ssxx")


def inline_preview_json(fields: Column) -> Column:
    return F.to_json(fields)


def rewrite_keys(c: Column, replacements: dict[str, str], reverse: bool = False) -> Column:
    """Field prefixes of a query string from one schema to another."""
    for old, new in replacements.items():
        c = F.replace(c, F.lit(new if reverse else old), F.lit(old if reverse else new))
    return c
