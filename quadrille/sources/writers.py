"""Sinks: document snapshots, N-Quads, converted results, query logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_params
from ..operators.exports import nquad_lines


def write_documents(df: DataFrame, path: str, by_spec: bool = True) -> None:
    """A snapshot in Parquet; by spec, only the partitions that have rows are replaced."""
    writer = df.write.mode("overwrite")
    if by_spec:
        writer = writer.partitionBy("spec").option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_nquads(quads: DataFrame, path: str) -> None:
    nquad_lines(quads).write.mode("overwrite").text(path)


def export_results(docs: DataFrame, converter: Callable[[DataFrame], DataFrame], path: str) -> None:
    """All hits as JSON through a converter."""
    flat = converter(docs).select("hub_id", F.map_from_entries(F.transform("flat", lambda x: F.struct(x["key"], x["values"]))).alias("fields"))
    flat.write.mode("overwrite").json(path)


def query_log(requests: DataFrame) -> DataFrame:
    """(created_at, raw_query, query_params) of requests (created_at, raw_query): parameters with their values in order."""
    pairs = clean_params(F.col("raw_query"))
    keys = F.array_sort(F.array_distinct(F.transform(pairs, lambda x: x["key"])))
    values = F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda x: x["key"] == k), lambda x: x["value"]))
    return requests.select("created_at", "raw_query", F.map_from_arrays(keys, values).alias("query_params"))


def append_query_log(requests: DataFrame, path: str) -> None:
    query_log(requests).write.mode("append").parquet(path)
