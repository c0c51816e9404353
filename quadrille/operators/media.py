"""Media of records: derived URLs, preferred master files, stale derivatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ids import derivative_urls
from ..functions.namespaces import EDM, QTERM, TYPE
from ..schemas import QUAD

# Kinds of master files, best first.
MASTERS = ["tif", "jp2", "jpg"]


def add_media_triples(quads: DataFrame, base: str) -> DataFrame:
    """A record's graph with thumbnails and deep zoom of each urn that it has as a view, and of the first as what it is shown by.

    Blank nodes typed as web resources go.
    """
    blank = quads.filter((F.col("p") == TYPE) & (F.col("o") == EDM + "WebResource") & (F.col("s_kind") == "BNode")).select("graph", "s").distinct()
    kept = quads.join(blank, ["graph", "s"], "left_anti").select(*QUAD)
    views = quads.filter((F.col("p") == EDM + "hasView") & F.col("o").startswith("urn:")).select("graph", "s", "o").distinct()
    spec = F.regexp_extract("o", "^urn:([^/]+)/", 1)
    urls = derivative_urls(F.col("o"), spec, base)
    names = ["thumbSmall", "thumbLarge", "deepZoomUrl"]
    rows = F.array(*[F.struct(F.col("o").alias("s"), F.lit(QTERM + n).alias("p"), urls[k].alias("o")) for k, n in enumerate(names)])
    first = views.groupBy("graph", "s").agg(F.min("o").alias("o"))
    shown = first.select("graph", "s", F.lit(EDM + "isShownBy").alias("p"), derivative_urls(F.col("o"), spec, base)[1].alias("o"))
    more = views.select("graph", F.explode(rows).alias("t")).select("graph", "t.s", "t.p", "t.o").unionByName(shown)
    null = F.lit(None).cast("string")
    return kept.unionByName(more.select("graph", "s", F.lit("URIRef").alias("s_kind"), "p", "o", F.lit("URIRef").alias("o_kind"), null.alias("datatype"), null.alias("lang")))


def preferred_sources(manifest: DataFrame) -> DataFrame:
    """(stem, media_key, ext): the best master file of each stem; jpeg and tiff are jpg and tif."""
    ext = F.lower("ext")
    ext = F.when(ext == "tiff", "tif").when(ext == "jpeg", "jpg").otherwise(ext)
    rank = F.array_position(F.array(*[F.lit(x) for x in MASTERS]), F.col("ext"))
    w = Window.partitionBy("stem").orderBy(F.when(rank == 0, len(MASTERS) + 1).otherwise(rank), F.lpad("media_key", 20, "0"))
    return manifest.withColumn("ext", ext).withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("stem", "media_key", "ext")


def stale_derivatives(derived: DataFrame, source: DataFrame) -> DataFrame:
    """(media_key, kind): derivatives older than their source."""
    s = source.select("media_key", F.col("mtime").alias("_m"))
    return derived.join(s, "media_key").filter(F.col("mtime") < F.col("_m")).select("media_key", "kind")


def deleted_sources(derived: DataFrame, source: DataFrame) -> DataFrame:
    """(media_key): what has derivatives but no source any more."""
    return derived.select("media_key").distinct().join(source.select("media_key"), "media_key", "left_anti")
