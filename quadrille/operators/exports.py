"""Documents and graphs as GeoJSON, KML, XML, N-Quads and update scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import parse_point
from ..functions.text import strip_control_chars
from .convert import value_of, xml_escape


def first_point(docs: DataFrame) -> Column:
    """struct(lat, lon): of qsite_geohash if the record has it, else of its own points; null if neither is good."""
    own = F.filter(F.transform(F.coalesce("point", F.array().cast("array<string>")), parse_point), lambda p: p.isNotNull())
    told = F.filter(F.transform(F.coalesce(value_of("qsite_geohash"), F.array().cast("array<string>")), parse_point), lambda p: p.isNotNull()) if "flat" in docs.columns else own
    return F.coalesce(F.try_element_at(told, F.lit(1)), F.try_element_at(own, F.lit(1)))


def to_geojson(docs: DataFrame) -> DataFrame:
    """(hub_id, feature): a feature [lon, lat] for each document with a point; dates are left out of its properties."""
    props = F.map_from_entries(F.transform(F.filter("flat", lambda x: ~x["key"].contains("date") & ~x["key"].contains("Date")), lambda x: F.struct(x["key"], x["values"])))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("_p.lon", "_p.lat").alias("coordinates")).alias("geometry"), props.alias("properties"))
    return docs.withColumn("_p", first_point(docs)).filter("_p is not null").select("hub_id", F.to_json(feature).alias("feature"))


def to_kml(docs: DataFrame) -> DataFrame:
    """(hub_id, placemark): id, name, description, extended data and point."""
    one = lambda key: F.coalesce(F.try_element_at(value_of(key), F.lit(1)), F.lit(""))
    data = F.array_join(F.transform("flat", lambda x: F.concat(F.lit('<Data name="'), x["key"], F.lit('"><value>'), xml_escape(F.array_join(x["values"], "; ")), F.lit("</value></Data>"))), "")
    mark = F.concat(F.lit('<Placemark id="'), xml_escape(F.col("hub_id")), F.lit('"><name>'), xml_escape(one("dc_title")), F.lit("</name><description>"), xml_escape(one("dc_description")), F.lit("</description><ExtendedData>"), data, F.lit("</ExtendedData><Point><coordinates>"), F.concat_ws(",", "_p.lon", "_p.lat"), F.lit("</coordinates></Point></Placemark>"))
    return docs.withColumn("_p", first_point(docs)).filter("_p is not null").select("hub_id", mark.alias("placemark"))


def to_record_xml(docs: DataFrame) -> DataFrame:
    """(hub_id, xml): an element prefix:name for each value, control characters stripped."""
    tag = lambda k: F.regexp_replace(k, "^([^_]+)_", "$1:")
    element = lambda x: F.array_join(F.transform(x["values"], lambda v: F.concat(F.lit("<"), tag(x["key"]), F.lit(">"), xml_escape(strip_control_chars(v)), F.lit("</"), tag(x["key"]), F.lit(">"))), "")
    return docs.select("hub_id", F.concat(F.lit("<record>"), F.array_join(F.transform("flat", element), ""), F.lit("</record>")).alias("xml"))


def statement(with_graph: bool) -> Column:
    """A quad as N-Quads, or N-Triples; quotes, backslashes and line ends are escaped."""
    escaped = F.col("o")
    for raw, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(code))
    suffix = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), F.col("lang"))).when(F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), F.col("datatype"), F.lit(">"))).otherwise("")
    node = lambda c, k: F.when(k == "BNode", F.concat(F.lit("_:"), c)).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    obj = F.when(F.col("o_kind") == "Literal", F.concat(F.lit('"'), escaped, F.lit('"'), suffix)).otherwise(node(F.col("o"), F.col("o_kind")))
    parts = [node(F.col("s"), F.col("s_kind")), F.concat(F.lit("<"), F.col("p"), F.lit(">")), obj] + ([F.concat(F.lit("<"), F.col("graph"), F.lit(">"))] if with_graph else [])
    return F.concat(F.concat_ws(" ", *parts), F.lit(" ."))


def nquad_lines(quads: DataFrame, with_graph: bool = True) -> DataFrame:
    """(value): one statement to a line."""
    return quads.select(statement(with_graph).alias("value"))


def graph_update_script(quads: DataFrame, batch: int = 50) -> DataFrame:
    """(batch, graphs, script): statements that replace each graph, ``batch`` graphs to a script.

    Graphs fall into batches by their place in ranges of their names, sorted in each task.
    """
    body = quads.groupBy("graph").agg(F.array_join(F.array_sort(F.collect_set(statement(False))), "\n").alias("_body"))
    replace = F.concat(F.lit("DROP SILENT GRAPH <"), F.col("graph"), F.lit(">;\nINSERT DATA { GRAPH <"), F.col("graph"), F.lit("> {\n"), F.col("_body"), F.lit("\n} };"))
    parts = max(1, int(quads.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = body.select("graph", replace.alias("_s")).repartitionByRange(parts, "graph").withColumn("_part", F.spark_partition_id())
    at = F.floor((F.row_number().over(Window.partitionBy("_part").orderBy("graph")) - 1) / batch)
    per = ranged.withColumn("_b", at).groupBy("_part", "_b").agg(F.array_sort(F.collect_list(F.struct("graph", "_s"))).alias("_l"))
    return per.select(F.concat_ws("-", "_part", "_b").alias("batch"), F.size("_l").alias("graphs"), F.array_join(F.transform("_l", lambda x: x["_s"]), "\n").alias("script"))
