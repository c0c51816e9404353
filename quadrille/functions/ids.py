"""Identifiers: hub ids, graph and source IRIs, hashes, media paths, proxy IRIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_local_id(c: Column, is_hub_id: bool = False) -> Column:
    """Separators become single dashes; outside hub ids underscores too."""
    out = F.translate(c, ": +/", "----")
    if not is_hub_id:
        out = F.translate(out, "_", "-")
    return F.regexp_replace(out, "-{2,10}", "-")


def hub_id_from_uri(uri: Column, org: str) -> Column:
    """org_spec_local from .../resource/type/spec/local...; a last colon becomes a dash."""
    path = F.split(F.substring_index(uri, "/resource/", -1), "/")
    local = F.array_join(F.slice(path, 3, F.greatest(F.size(path) - 2, F.lit(0))), "/")
    return F.regexp_replace(F.concat_ws("_", F.lit(org), path[1], clean_local_id(local)), ":$", "-")


def hub_id_from_graph(graph: Column, org: str, spec: Column) -> Column:
    return F.concat_ws("_", F.lit(org), spec, F.element_at(F.split(F.regexp_replace(graph, "/+graph$", ""), "/"), -1))


def index_item_hub_id(org: str, item_type: Column, item_id: Column) -> Column:
    return F.concat_ws("_", F.lit(org), F.lower(item_type), F.lower(item_id))


def index_item_uri(base: str, item_type: Column, item_id: Column) -> Column:
    return F.concat(F.lit(f"{base}/resource/"), F.lower(item_type), F.lit("/"), F.lower(item_id))


def named_graph(uri: Column) -> Column:
    return F.concat(F.regexp_replace(uri, "/+$", ""), F.lit("/graph"))


def source_uri(graph: Column) -> Column:
    return F.regexp_replace(graph, "/graph$", "")


def about_uri(uri: Column) -> Column:
    return F.concat(F.regexp_replace(uri, "/+$", ""), F.lit("/about"))


def spec_from_uri(uri: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(uri, "/+$", ""), "/"), -2)


def dataset_uri(base: str, spec: Column) -> Column:
    return F.concat(F.lit(f"{base}/resource/dataset/"), spec)


def id_kind(c: Column) -> Column:
    """typed (org_type__id), hub (org_spec_id) or invalid."""
    return F.when(c.rlike("^[^_]*?_[^_]+?__[^_]+$"), "typed").when(c.rlike("^[^_]*?_.*?_[^_]+$"), "hub").otherwise("invalid")


def content_hash(text: Column) -> Column:
    return F.sha1(text)


def media_hash(uri: Column) -> Column:
    return F.sha2(uri, 256)


def media_path(kind: Column, uri: Column) -> Column:
    """kind/abc/def/ghi/sha: directories from the first nine digits of the hash."""
    sha = media_hash(uri)
    return F.concat_ws("/", kind, *[F.substring(sha, k, 3) for k in (1, 4, 7)], sha)


def media_uri_parts(uri: Column) -> Column:
    """struct(kind, spec, path, object_number): cached if not a urn; the object number is what stands before __ in the name."""
    body = F.regexp_replace(uri, "^urn:", "")
    name = F.element_at(F.split(body, "/"), -1)
    return F.struct(
        F.when(uri.startswith("urn:"), "urn").otherwise("cached").alias("kind"),
        F.when(uri.startswith("urn:"), F.element_at(F.split(body, "/"), 1)).alias("spec"),
        F.regexp_replace(body, "__.*$", "").alias("path"),
        F.regexp_replace(F.substring_index(name, "__", 1), r"\.[A-Za-z0-9]+$", "").alias("object_number"),
    )


def media_api_params(url: Column) -> Column:
    """map of the parameters of a media URL; &amp; counts as &."""
    query = F.regexp_replace(F.regexp_extract(url, r"\?(.*)$", 1), "&amp;", "&")
    return F.when(query != "", F.str_to_map(query, F.lit("&"), F.lit("=")))


def derivative_urls(uri: Column, spec: Column, base: str, sizes=((220, 220), (500, 500))) -> Column:
    """array(kind:url): thumbnails of the sizes, deep zoom and source of a media object."""
    call = lambda kind, extra: F.concat(F.lit(f"{base}/api/webresource?docType={kind}&uri="), uri, F.lit("&spec="), spec, F.lit(extra))
    thumbs = [call("thumbnail", f"&width={w}&height={h}") for w, h in sizes]
    return F.array(*thumbs, call("deepzoom", ""), call("source", ""))


def rebase_uri(uri: Column, entry_points: list[str], base: str) -> Column:
    """An IRI under one of our hosts moves to ``base``; its path is unquoted. Others stay."""
    host = F.regexp_extract(uri, "^https?://([^/]+)", 1)
    return F.when(host.isin(*entry_points), F.concat(F.lit(base), F.url_decode(F.regexp_replace(F.regexp_extract(uri, "^https?://[^/]+(.*)$", 1), r"\+", "%2B")))).otherwise(uri)


def cache_url(uri: Column, base: str) -> Column:
    return F.when(uri.startswith("http"), F.concat(F.lit(f"{base}/resource/cache/"), F.regexp_replace(uri, "^https?://", ""))).otherwise(uri)


def proxy_slug(label: Column, lang: Column) -> Column:
    """Words of a label joined by dashes, lower-cased, with @lang if it has one."""
    kept = F.regexp_replace(label, r"(?U)[^\w\s-]", "")
    slug = F.lower(F.regexp_replace(F.trim(F.translate(kept, "-", " ")), r"\s+", "-"))
    return F.when(F.coalesce(lang, F.lit("")) != "", F.concat(slug, F.lit("@"), lang)).otherwise(slug)


def proxy_uri(dataset: Column, field: Column, label: Column, lang: Column) -> Column:
    return F.concat_ws("/", dataset, field, proxy_slug(label, lang))


def proxy_field_uri(dataset: Column, label: Column, lang: Column) -> Column:
    """The value itself as the last part, spaces as underscores, under its language if it has one."""
    value = F.translate(label, " ", "_")
    return F.when(F.coalesce(lang, F.lit("")) != "", F.concat_ws("/", dataset, lang, value)).otherwise(F.concat_ws("/", dataset, value))


def split_proxy_uri(uri: Column) -> Column:
    """struct(spec, search_label, label): the label is cut to 199 code points."""
    pattern = "/dataset/([^/]+)/([^/]+)/(.*)$"
    return F.struct(F.regexp_extract(uri, pattern, 1).alias("spec"), F.regexp_extract(uri, pattern, 2).alias("search_label"), F.left(F.regexp_extract(uri, pattern, 3), F.lit(199)).alias("label"))


def edm_boolean(o: Column) -> Column:
    return F.coalesce(F.lower(o) == "true", F.lit(False))
