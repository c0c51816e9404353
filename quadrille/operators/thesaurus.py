"""Thesaurus work: ancestors, proxies of literal values, gazetteers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import proxy_uri
from ..functions.namespaces import EDM, GN, QSYNC, SKOS, TYPE
from ..schemas import QUAD
from .graph import union_graphs
from .tables import cut

# Parents of a place, nearest first.
PARENTS = [GN + "parentFeature", GN + "parentADM2", GN + "parentADM1", GN + "parentCountry"]


def broader_closure(quads: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(s, ancestor, label): everything broader than a concept at any depth, itself left out.

    Paths double: a round joins the pairs that the last one found, which are all those from half
    its reach up to its reach, with all pairs known, so rounds grow with the logarithm of the depth.
    Cycles end, as their pairs are known by then; lineage is cut each round. ``max_depth`` bounds the steps.
    """
    step = quads.filter((F.col("p") == SKOS + "broader") & F.col("s").isNotNull() & F.col("o").isNotNull()).select("s", F.col("o").alias("ancestor"), F.lit(1).alias("steps")).distinct()
    known = fresh = cut(step)
    while max_depth is None or max_depth > 1:
        on = known.select(F.col("s").alias("ancestor"), F.col("ancestor").alias("_above"), F.col("steps").alias("_more"))
        further = fresh.join(on, "ancestor").select("s", F.col("_above").alias("ancestor"), (F.col("steps") + F.col("_more")).alias("steps"))
        if max_depth is not None:
            further = further.filter(F.col("steps") <= max_depth)
        found = further.groupBy("s", "ancestor").agg(F.min("steps").alias("steps"))
        fresh = cut(found.join(known, ["s", "ancestor"], "left_anti"))
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
    labels = quads.filter(F.col("p") == SKOS + "prefLabel").groupBy(F.col("s").alias("ancestor")).agg(F.min("o").alias("label"))
    return known.filter("s <> ancestor").join(labels, "ancestor", "left").select("s", "ancestor", "label")


def apply_proxy_fields(quads: DataFrame, fields: DataFrame, proxies: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Literals of a dataset's proxy fields become proxies; with the proxies that were not there yet.

    ``quads`` has a spec; ``fields`` is (spec, p, field, dataset), ``proxies`` (proxy).
    """
    f = fields.withColumnRenamed("p", "_p").withColumnRenamed("spec", "_spec")
    j = quads.join(f, (F.col("spec") == F.col("_spec")) & (F.col("p") == F.col("_p")) & (F.col("o_kind") == "Literal"), "left")
    made = proxy_uri(F.col("dataset"), F.col("field"), F.col("o"), F.col("lang"))
    marked = j.withColumn("_proxy", F.when(F.col("_p").isNotNull(), made))
    new = marked.filter("_proxy is not null").select(F.col("_proxy").alias("proxy"), "spec", "dataset", "p", "field", F.col("o").alias("label"), F.col("lang")).dropDuplicates(["proxy"])
    if proxies is not None:
        new = new.join(proxies.select("proxy"), "proxy", "left_anti")
    done = marked.withColumns({"o": F.coalesce("_proxy", "o"), "o_kind": F.when(F.col("_proxy").isNotNull(), "URIRef").otherwise(F.col("o_kind")), "lang": F.when(F.col("_proxy").isNull(), F.col("lang"))})
    return done.select(*QUAD), new


def proxy_graph(proxies: DataFrame, mappings: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """Quads of proxies (proxy, dataset, p, label, lang), matched to their concept where ``mappings`` (proxy, concept) has one; with the concept's triples if ``concepts`` are given."""
    m = mappings.select("proxy", F.col("concept").alias("_concept")).dropDuplicates(["proxy"])
    j = proxies.join(m, "proxy", "left")
    said = [(TYPE, F.lit(SKOS + "Concept"), "URIRef"), (TYPE, F.lit(QSYNC + "ProxyResource"), "URIRef"), (QSYNC + "proxyLiteralField", F.col("p"), "URIRef"), (QSYNC + "proxyLiteralValue", F.col("label"), "Literal")]
    said += [(QSYNC + "belongsTo", F.col("dataset"), "URIRef"), (SKOS + "prefLabel", F.col("label"), "Literal"), (SKOS + "exactMatch", F.col("_concept"), "URIRef")]
    rows = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(k).alias("o_kind")) for p, o, k in said])
    null = F.lit(None).cast("string")
    out = j.select("proxy", "lang", F.explode(rows).alias("t")).filter("t.o is not null")
    out = out.select(F.concat("proxy", F.lit("/graph")).alias("graph"), F.col("proxy").alias("s"), F.lit("URIRef").alias("s_kind"), "t.p", "t.o", "t.o_kind", null.alias("datatype"), F.when(F.col("t.o_kind") == "Literal", F.col("lang")).alias("lang"))
    if concepts is None:
        return out
    return union_graphs(out, concepts.join(m.select(F.col("_concept").alias("s")).distinct(), "s", "left_semi"))


def record_context(record: DataFrame, fields: DataFrame, mappings: DataFrame, concepts: DataFrame, preds: list[str], leave: int, media: DataFrame | None = None, base: str | None = None) -> DataFrame:
    """A record graph with proxies for its literals, the proxies' and concepts' triples, and repeated values reduced.

    With ``media``, quads of any graph, the triples of a record's views come into its graph; with
    ``base`` those of its thumbnails and deep zoom, too.
    """
    from .graph import reduce_duplicates
    from .media import add_media_triples

    done, new = apply_proxy_fields(record, fields, None)
    added = proxy_graph(new, mappings, concepts)
    kept, _ = reduce_duplicates(done, preds, leave)
    if media is not None:
        views = done.filter(F.col("p") == EDM + "hasView").select("graph", F.col("o").alias("_view")).distinct()
        kept = union_graphs(kept, media.drop("graph").join(views, F.col("s") == F.col("_view")).select(*QUAD))
    if base is not None:
        kept = add_media_triples(kept, base)
    return union_graphs(kept, added)


def skosify(quads: DataFrame) -> DataFrame:
    """Places as concepts: every typed thing is one, names are preferred and alternate names other labels."""
    renamed = quads.withColumn("p", F.when(F.col("p") == GN + "name", F.lit(SKOS + "prefLabel")).when(F.col("p") == GN + "alternateName", F.lit(SKOS + "altLabel")).otherwise(F.col("p")))
    concepts = quads.filter(F.col("p") == TYPE).withColumn("o", F.lit(SKOS + "Concept"))
    return renamed.unionByName(concepts)


def gazetteer_hierarchy(quads: DataFrame) -> DataFrame:
    """(s, p, o): broader and narrower between a place and its parents, nearest first and each once."""
    from .graph import rank_of

    chain = quads.filter(F.col("p").isin(PARENTS)).groupBy("s").agg(F.array_sort(F.collect_set(F.struct(rank_of(F.col("p"), PARENTS).alias("r"), F.col("o").alias("o")))).alias("_c"))
    line = chain.select(F.array_distinct(F.concat(F.array("s"), F.transform("_c", lambda x: x["o"]))).alias("line")).filter(F.size("line") > 1)
    near = F.arrays_zip(F.slice("line", 1, F.size("line") - 1).alias("a"), F.slice("line", 2, F.size("line") - 1).alias("b"))
    pairs = line.select(F.explode(near).alias("z")).select("z.a", "z.b").distinct()
    both = F.array(F.struct(F.col("a").alias("s"), F.lit(SKOS + "broader").alias("p"), F.col("b").alias("o")), F.struct(F.col("b").alias("s"), F.lit(SKOS + "narrower").alias("p"), F.col("a").alias("o")))
    return pairs.select(F.explode(both).alias("t")).select("t.s", "t.p", "t.o").distinct()
