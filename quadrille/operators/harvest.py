"""Harvest: selection, lists of records, sets, pages with resumption tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import encode_token
from .search import filter_docs, match_fielded
from .tables import cut


def public_only(docs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Documents of datasets that are published and not deleted."""
    return docs.join(datasets.filter("published and not deleted").select("spec"), "spec", "left_semi")


def harvest_select(docs: DataFrame, spec: str | None = None, start=None, until=None, query: str | None = None, filters: dict[str, list[str]] | None = None) -> DataFrame:
    """Documents of a set, modified from a time on and until one; of a saved query (fielded) and its filters, if given."""
    out = docs
    if query:
        out = match_fielded(out, query)
    if filters:
        out = filter_docs(out, filters)
    if spec is not None:
        out = out.filter(F.col("spec") == spec)
    if start is not None:
        out = out.filter(F.col("modified_at") >= F.lit(start))
    if until is not None:
        out = out.filter(F.col("modified_at") <= F.lit(until))
    return out


def no_match(docs: DataFrame) -> bool:
    """Whether the answer is the protocol's error of no matching records."""
    return docs.isEmpty()


def harvest_pages(docs: DataFrame, size: int = 100, prefix: str = "edm", spec: str = "") -> DataFrame:
    """(hub_id, position, page, cursor, list_size, token) of all documents in the order of date ascending, id descending.

    ``cursor`` is the position of a page's first record; the token leads to the next page and is
    null on the last. Rows are sorted by ranges; counts of the ranges, one row each, give the
    positions at which they start, so no task numbers the whole table.
    """
    rows = docs.select("hub_id", "modified_at")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(rows.repartitionByRange(parts, "modified_at", F.desc("hub_id")).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = counts.agg(F.sum("_n").alias("list_size"))
    placed = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy("modified_at", F.desc("hub_id")))).join(F.broadcast(offsets), "_part").crossJoin(F.broadcast(total))  # a row for each partition, and one
    position = F.col("_off") + F.col("_r") - 1
    page = F.floor(position / size)
    cursor = page * size
    token = F.when(cursor + size < F.col("list_size"), encode_token(F.lit(prefix), F.lit(None), F.lit(None), F.lit(spec), cursor + size, F.col("list_size")))
    return placed.select("hub_id", position.alias("position"), page.alias("page"), cursor.alias("cursor"), "list_size", token.alias("token"))


def list_identifiers(docs: DataFrame) -> DataFrame:
    """(identifier, datestamp, set_spec)."""
    return docs.select(F.concat(F.lit("oai:"), F.translate("hub_id", "_", ":")).alias("identifier"), F.date_format("modified_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datestamp"), F.col("spec").alias("set_spec"))


def list_records(docs: DataFrame, prefix: str, converters: dict) -> DataFrame:
    """Identifiers with the record through a converter (``flat``); oai_dc is ese."""
    flat = converters["ese" if prefix == "oai_dc" else prefix](docs)
    return flat.select(F.concat(F.lit("oai:"), F.translate("hub_id", "_", ":")).alias("identifier"), "flat")


def get_record(docs: DataFrame, hub_id: str, prefix: str, converters: dict) -> DataFrame:
    return list_records(docs.filter(F.col("hub_id") == hub_id), prefix, converters)


def list_sets(docs: DataFrame) -> DataFrame:
    """(spec, n) in order of spec."""
    return docs.groupBy("spec").agg(F.count(F.lit(1)).alias("n")).orderBy("spec")
