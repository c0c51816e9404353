"""Readers of the inputs: bulk actions, index requests, marked records, N-Quads, harvest pages, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BULK_ACTION, INDEX_ACTION, INDEX_ITEM, QUAD

_IRI, _BLANK = "<([^>]*)>", "_:([A-Za-z0-9_](?:[A-Za-z0-9_.-]*[A-Za-z0-9_-])?)"
# possessive, so that a literal of any length is matched without recursion
_LITERAL = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?'
_STATEMENT = rf"^\s*(?:{_IRI}|{_BLANK})\s+{_IRI}\s+(?:{_IRI}|{_BLANK}|{_LITERAL})\s*(?:{_IRI}|{_BLANK})?\s*\.\s*$"


def read_bulk_actions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(actions, errors) of JSON lines; bad lines are kept as errors and stop nothing."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    rows = lines.select("value", F.from_json("value", f"{BULK_ACTION}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("a"))
    return rows.filter("a._bad is null").select("a.*").drop("_bad"), rows.filter("a._bad is not null").select(F.col("value").alias("line"))


def read_index_items(spark: SparkSession, path: str, fmt: str = "xml") -> DataFrame:
    """Index items of XML requests, or of JSON ones whose indexItem is an object or a list."""
    if fmt == "xml":
        return spark.read.format("xml").option("rowTag", "indexItem").option("attributePrefix", "@").option("valueTag", "#text").schema(INDEX_ITEM).load(path)
    text = spark.read.option("wholetext", True).text(path).select(F.get_json_object("value", "$.indexRequest.indexItem").alias("j"))
    item = "struct<" + INDEX_ITEM.replace(" string", ":string").replace(" array<", ":array<") + ">"
    many = F.when(F.col("j").startswith("["), F.from_json("j", f"array<{item}>")).otherwise(F.array(F.from_json("j", item)))
    return text.select(F.explode(many).alias("i")).select("i.*")


def parse_marked(df: DataFrame, text: str = "value") -> DataFrame:
    """(graph, hash, rdf_text): records that a comment with graph and hash follows."""
    marker = r"<!--<([^>]*?)__([^_>]*)>$"
    return df.filter(F.col(text).rlike(marker)).select("*", F.regexp_extract(text, marker, 1).alias("graph"), F.regexp_extract(text, marker, 2).alias("hash"), F.btrim(F.regexp_replace(text, marker, ""), F.lit(" \t\r\n")).alias("rdf_text")).drop(text)


def read_marked_records(spark: SparkSession, path: str) -> DataFrame:
    """(spec, graph, hash, rdf_text): the spec is the file's name without its ending."""
    rows = spark.read.option("lineSep", ">-->").text(path).withColumn("value", F.concat("value", F.lit(">")))
    spec = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^/.]*)?$", 1)
    return parse_marked(rows.withColumn("spec", spec))


def _decoded(text: Column, run: str, mark: str, charset: str) -> Column:
    """Runs of escaped code units in hexadecimal as characters."""
    units = F.transform(F.regexp_extract_all(text, F.lit(f"({run})"), F.lit(1)), lambda r: F.decode(F.unhex(F.replace(r, F.lit(mark), F.lit(""))), charset))
    between = F.split(text, run, -1)
    return F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("a"), units.alias("b")), lambda x: F.array(x["a"], F.coalesce(x["b"], F.lit(""))))), "")


def _let(value: Column, use) -> Column:
    """``use`` of a value that stands in the plan once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _unescape(text: Column) -> Column:
    c = F.replace(text, F.lit("\\\\"), F.lit("\u0000"))
    for code, raw in (("n", "\n"), ("r", "\r"), ("t", "\t"), ("b", "\b"), ("f", "\f"), ('"', '"'), ("'", "'")):
        c = F.replace(c, F.lit("\\" + code), F.lit(raw))
    # surrogates stand next to each other, so runs are decoded as a whole
    c = _let(c, lambda x: F.when(x.contains("\\u"), _decoded(x, r"(?:\\u[0-9A-Fa-f]{4})+", "\\u", "UTF-16BE")).otherwise(x))
    c = _let(c, lambda x: F.when(x.contains("\\U"), _decoded(x, r"(?:\\U[0-9A-Fa-f]{8})+", "\\U", "UTF-32")).otherwise(x))
    return F.when(F.instr(text, "\\") > 0, F.replace(c, F.lit("\u0000"), F.lit("\\"))).otherwise(text)


def parse_statements(df: DataFrame, line: str, graph: Column | None = None) -> DataFrame:
    """Quads of lines in N-Triples or N-Quads; lines that are no statement are left out. ``graph`` names those without one."""
    # all groups in one pass of the pattern, but for lines that hold the mark between them
    one_pass = F.split(F.regexp_replace(line, _STATEMENT, "\u0001".join(f"${k}" for k in range(1, 11))), "\u0001", -1)
    each = F.when(F.col(line).rlike(_STATEMENT), F.array(*[F.regexp_extract(line, _STATEMENT, k) for k in range(1, 11)])).otherwise(F.array(F.lit("")))
    found = df.withColumn("_g", F.when(F.col(line).contains("\u0001"), each).otherwise(one_pass)).filter(F.size("_g") == 10)
    # lines without a backslash, nearly all, go as they are
    found = found.withColumn("_g", F.when(F.col(line).contains("\\"), F.transform("_g", _unescape)).otherwise(F.col("_g")))
    g = lambda k: F.nullif(F.col("_g")[k - 1], F.lit(""))
    is_literal = g(4).isNull() & g(5).isNull()
    return found.select(
        F.coalesce(g(9), g(10), graph if graph is not None else F.lit(None).cast("string")).alias("graph"),
        F.coalesce(g(1), g(2)).alias("s"),
        F.when(g(1).isNotNull(), "URIRef").otherwise("BNode").alias("s_kind"),
        g(3).alias("p"),
        F.when(is_literal, F.col("_g")[5]).otherwise(F.coalesce(g(4), g(5))).alias("o"),
        F.when(is_literal, "Literal").when(g(4).isNotNull(), "URIRef").otherwise("BNode").alias("o_kind"),
        g(8).alias("datatype"),
        g(7).alias("lang"),
    )


def read_nquads(spark: SparkSession, path: str) -> DataFrame:
    return parse_statements(spark.read.text(path), "value")


def parse_ntriples(df: DataFrame, col: str, graph_col: str) -> DataFrame:
    """Quads of texts in N-Triples, a statement to a line, in the graph that the row names."""
    lines = df.select(F.col(graph_col).alias("_graph"), F.explode(F.split(col, "\n")).alias("_line"))
    return parse_statements(lines, "_line", F.col("_graph"))


def broken_ntriples(df: DataFrame, col: str, graph_col: str) -> DataFrame:
    """(graph, error) of the lines of such texts that are no statement, comment or blank."""
    lines = df.select(F.col(graph_col).alias("graph"), F.explode(F.split(col, "\n")).alias("_line"))
    wrong = ~F.col("_line").rlike(_STATEMENT) & ~F.col("_line").rlike(r"^\s*(#.*)?$")
    return lines.filter(wrong).select("graph", F.concat(F.lit("no statement: "), "_line").alias("error"))


def bindings_to_triples(df: DataFrame) -> DataFrame:
    """(s, p, o, o_kind, lang, datatype) of query results: rows with ``vars`` array<string> and ``binding`` map<string, struct<type, value, lang, datatype>>.

    Three variables are one level, each further two another that starts at the object before; a
    row ends at its last bound variable; blank objects are left out.
    """
    levels = [("s", "p", "o"), ("o", "p2", "o2"), ("o2", "p3", "o3")]
    at = lambda v: F.try_element_at("binding", F.lit(v))
    many = F.floor((F.size(F.filter("vars", lambda v: v != "g")) - 3) / 2) + 1
    rows = F.array(*[F.struct(F.lit(k).alias("level"), at(s)["value"].alias("s"), at(p)["value"].alias("p"), at(o)["value"].alias("o"), at(o)["type"].alias("kind"), at(o)["lang"].alias("lang"), at(o)["datatype"].alias("datatype")) for k, (s, p, o) in enumerate(levels, 1)])
    out = df.select(many.alias("_many"), F.explode(rows).alias("t")).filter("t.level <= _many and t.s is not null and t.p is not null and t.o is not null and t.kind <> 'bnode'")
    return out.select("t.s", "t.p", "t.o", F.when(F.col("t.kind") == "uri", "URIRef").otherwise("Literal").alias("o_kind"), "t.lang", "t.datatype").dropDuplicates()


def read_index_actions(spark: SparkSession, path: str) -> DataFrame:
    """Index actions of the lines that start as one; ``_source`` stays JSON."""
    lines = spark.read.text(path).filter(F.col("value").startswith('{"_op_type":'))
    return lines.select(F.from_json("value", INDEX_ACTION).alias("a")).select("a.*")


def parse_oai_pages(pages: DataFrame, verb: str = "ListRecords", text: str = "value") -> DataFrame:
    """(token, cursor, list_size, record): the records, or headers, of saved harvest responses."""
    tag = "header" if verb == "ListIdentifiers" else "record"
    clean = F.regexp_replace(text, r"<openskos:status>[^<]*</openskos:status>|<openskos:status\s*/>", "")
    token = r"<resumptionToken([^>]*)>([^<]*)<"
    attribute = lambda name: F.regexp_extract(F.regexp_extract(clean, token, 1), rf'{name}="([0-9]+)"', 1).try_cast("long")
    each = F.regexp_extract_all(clean, F.lit(rf"(?s)(<{tag}[ >].*?</{tag}>)"), F.lit(1))
    return pages.select(F.nullif(F.regexp_extract(clean, token, 2), F.lit("")).alias("token"), attribute("cursor").alias("cursor"), attribute("completeListSize").alias("list_size"), F.explode(each).alias("record"))


def read_oai_pages(spark: SparkSession, path: str, verb: str = "ListRecords") -> DataFrame:
    return parse_oai_pages(spark.read.option("wholetext", True).text(path), verb)


def filter_gazetteer(lines: DataFrame, country_uri: str, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """(places, featured): XML lines that mention the country, and of those the ones with a feature code."""
    places = lines.filter(F.col("value").startswith("<?xml ") & F.col("value").contains(country_uri))
    found = F.lit(False)
    for f in features:
        found = found | F.col("value").contains(f)
    return places, places.filter(found)


def read_gazetteer(spark: SparkSession, path: str, country_uri: str, features: list[str]) -> tuple[DataFrame, DataFrame]:
    return filter_gazetteer(spark.read.text(path), country_uri, features)


def read_media_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, spec, kind, stem, ext) of media files laid out as spec/kind/...; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("modificationTime").alias("mtime"))
    tail = F.split(F.regexp_replace("path", "^.*?" + root.rstrip("/").split("/")[-1] + "/", ""), "/")
    name = F.element_at(tail, -1)
    return files.select("path", "mtime", tail[0].alias("spec"), tail[1].alias("kind"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.regexp_extract(name, r"\.([^.]*)$", 1).alias("ext"))


def index_items_to_quads(items: DataFrame, org: str, base: str) -> tuple[DataFrame, DataFrame]:
    """(quads, invalid) of index items: prefixed names are predicates, others custom ones, system fields theirs.

    Links are IRIs; a location gives a geohash too, a resource IRI an edm object; empty text goes.
    """
    from ..functions.ids import index_item_hub_id, index_item_uri
    from ..functions.namespaces import BY_PREFIX, EDM, QTERM, TYPE, label_to_iri

    good = F.col("`@itemId`").isNotNull() & F.col("`@itemType`").isNotNull() & F.col("field").isNotNull() & ~F.exists("field", lambda f: f["@name"].isNull())
    invalid = items.filter(~F.coalesce(good, F.lit(False)))
    valid = items.filter(good)
    uri = index_item_uri(base, F.col("`@itemType`"), F.col("`@itemId`"))
    t = lambda p, o, k: F.struct(p.alias("p"), o.alias("o"), k.alias("o_kind"))
    literal, iri = F.lit("Literal"), F.lit("URIRef")

    def of_field(f: Column) -> Column:
        named = F.coalesce(label_to_iri(F.when(f["@name"].contains(":"), f["@name"])), label_to_iri(F.when(f["@name"].contains("_"), f["@name"])), F.concat(F.lit(BY_PREFIX["custom"]), f["@name"]))
        own = t(named, f["#text"], F.when(f["@fieldType"] == "link", iri).otherwise(literal))
        geo = F.when(f["@fieldType"] == "location", t(F.lit(QTERM + "geoHash"), f["#text"], literal))
        obj = F.when(f["@name"].endswith("resourceUri"), t(F.lit(EDM + "object"), f["#text"], iri))
        return F.filter(F.array(geo, own, obj), lambda x: x.isNotNull())

    system = F.transform(F.coalesce("systemField", F.array().cast("array<struct<`@name`:string,`#text`:string>>")), lambda f: t(F.concat(F.lit(BY_PREFIX["qsite"]), f["@name"]), f["#text"], literal))
    kind = t(F.lit(TYPE), F.lit(QTERM + "IndexItem"), iri)
    rows = valid.select(uri.alias("s"), index_item_hub_id(org, F.col("`@itemType`"), F.col("`@itemId`")).alias("hub_id"), F.explode(F.concat(F.array(kind), F.flatten(F.transform("field", of_field)), system)).alias("t"))
    rows = rows.filter("t.o is not null and trim(t.o) <> ''")
    null = F.lit(None).cast("string")
    quads = rows.select(F.concat("s", F.lit("/graph")).alias("graph"), "s", iri.alias("s_kind"), "t.p", "t.o", "t.o_kind", null.alias("datatype"), null.alias("lang"))
    return quads.select(*QUAD), invalid
