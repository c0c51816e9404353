"""Search over documents: text, fields, filters, facets, order, pages, related records.

A search document has (hub_id, spec, fields), where ``fields`` is a map from field to
array(struct(type, id, value, raw, lang)), and maybe ``point`` array<string>.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import geohash_decode, geohash_encode, haversine_km, parse_point
from .documents import raw_values
from .tables import cut, kept

K1, B = 1.2, 0.75
# Dutch words that text analysis leaves out, and words that keep a form of their own.
STOP_NL = "aan al alles als altijd andere ben bij daar dan dat de der deze die dit doch doen door dus een eens en er ge geen geweest haar had heb hebben heeft hem het hier hij hoe hun iemand iets ik in is ja je kan kon kunnen maar me meer men met mij mijn moet na naar niet niets nog nu of om omdat onder ons ook op over reeds te tegen toch toen tot u uit uw van veel voor want waren was wat werd wezen wie wil worden wordt zal ze zelf zich zij zijn zo zonder zou".split()
OVERRIDES_NL = {"fiets": "fiets", "bromfiets": "bromfiets", "ei": "eier", "kind": "kinder"}


def raws(field: str) -> Column:
    """Exact values of a field; none if the document lacks it."""
    return F.coalesce(F.transform(F.try_element_at("fields", F.lit(field.removesuffix(".raw").removesuffix(".value"))), lambda e: e["raw"]), F.array().cast("array<string>"))


#: What is between words.
NO_WORD = r"[^\p{L}\p{N}]+"


def words_of(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), NO_WORD), lambda w: w != "")


def text_of(docs: DataFrame) -> Column:
    """All values of a document."""
    return F.array_join(F.flatten(F.transform(F.map_values("fields"), lambda v: F.transform(v, lambda e: e["value"]))), " ")


def match_text(docs: DataFrame, query: str, text: Column | None = None, key: str = "hub_id") -> DataFrame:
    """Documents with ``score``: up to two terms must all occur, of more at least half; BM25 over the matches' terms.

    Words in quotes are one term, which occurs where they follow each other. Only the query's
    terms are counted; document frequencies and the mean length are one row.
    """
    terms = sorted({tuple(w) for part, phrase in re.findall(r'"([^"]*)"|([^"]+)', query) for w in ([_words(part)] if part else [[x] for x in _words(phrase)]) if w})
    need = len(terms) if len(terms) <= 2 else -(-len(terms) // 2)
    low = F.lower(text if text is not None else text_of(docs))
    counted = docs.withColumns({"_tf": F.array(*[_count(low, t) for t in terms]) if terms else F.array().cast("array<int>"), "_len": F.regexp_count(low, F.lit(r"[\p{L}\p{N}]+"))})
    stats = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), F.array(*[F.count_if(F.col("_tf")[k] > 0) for k in range(len(terms))]).alias("_df"))
    hits = counted.filter(F.size(F.filter("_tf", lambda x: x > 0)) >= need) if terms else counted.filter(F.lit(False))
    idf = lambda k: F.log(1 + (F.col("_n") - F.col("_df")[k] + 0.5) / (F.col("_df")[k] + 0.5))
    part = lambda k: idf(k) * F.col("_tf")[k] * (K1 + 1) / (F.col("_tf")[k] + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    score = reduce(lambda a, b: a + b, [part(k) for k in range(len(terms))], F.lit(0.0))
    return hits.crossJoin(F.broadcast(stats)).withColumn("score", score).drop("_tf", "_len", "_n", "_avg", "_df")  # stats is one row


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def _count(low: Column, term: tuple[str, ...]) -> Column:
    """How often the words of a term follow each other as whole words of a text; a text without their letters is not searched."""
    words = r"[^\p{L}\p{N}]+".join(rf"\Q{w}\E" for w in term)
    found = F.regexp_count(low, F.lit(rf"(?<![\p{{L}}\p{{N}}]){words}(?![\p{{L}}\p{{N}}])"))
    return F.when(reduce(lambda a, b: a & b, [low.contains(w) for w in term]), found).otherwise(0)


def in_order(value: Column, words: list[str]) -> Column:
    """Whether the words follow each other in a text."""
    return F.concat(F.lit(" "), F.array_join(words_of(value), " "), F.lit(" ")).contains(f" {' '.join(words)} ")


def parse_fielded(query: str) -> Column:
    """One condition for a query of field:value, field:(...), bare words and phrases in quotes, AND, OR, NOT (or -) and parentheses.

    AND binds closer; OR is implied. A phrase matches where its words follow each other in one
    value, several words without quotes where one value has them all. Operators and parentheses
    without an operand are left out, and a query without any matches everything.
    """
    tokens = re.findall(r'[()]|-?[^\s():"]+:"[^"]*"|-?[^\s():"]+:(?=\()|-?[^\s():"]+:[^\s()"]+|-?"[^"]*"|[^\s()"]+', query)
    at = 0

    def joined(left: Column | None, right: Column | None, both: bool) -> Column | None:
        if left is None or right is None:
            return right if left is None else left
        return left & right if both else left | right

    def either(field: str, depth: int) -> Column | None:
        nonlocal at
        left = None
        while at < len(tokens):
            if tokens[at] == ")":
                if depth:
                    break
                at += 1  # closes nothing
            elif tokens[at] in ("OR", "AND"):
                at += 1
            else:
                left = joined(left, every_(field, depth), False)
        return left

    def every_(field: str, depth: int) -> Column | None:
        nonlocal at
        left = single(field, depth)
        while at < len(tokens) and (tokens[at] in ("AND", "NOT") or tokens[at].startswith("-")):
            if tokens[at] == "AND":
                at += 1
            left = joined(left, single(field, depth), True)
        return left

    def single(field: str, depth: int) -> Column | None:
        nonlocal at
        if at >= len(tokens) or tokens[at] in (")", "AND", "OR"):
            return None
        token = tokens[at]
        at += 1
        if token == "NOT":
            inner = single(field, depth)
            return None if inner is None else ~inner
        if token.startswith("-") and len(token) > 1:
            tokens[at - 1] = token[1:]
            at -= 1
            inner = single(field, depth)
            return None if inner is None else ~inner
        if token == "(" or token.endswith(":"):
            if token != "(":
                field, at = token[:-1], at + 1
            inner = either(field, depth + 1)
            at += 1
            return inner
        if not token.startswith('"') and ":" in token:
            field, _, token = token.partition(":")
        return term(field, token.strip('"'), token.startswith('"'))

    def term(field: str, value: str, phrase: bool) -> Column | None:
        if field.startswith("system.spec"):
            return F.col("spec") == value
        if field.endswith(".raw"):
            return F.array_contains(raws(field), value)
        words = _words(value)
        if not words:
            return None
        met = (lambda v: in_order(v, words)) if phrase else (lambda v: F.size(F.array_except(F.array(*[F.lit(w) for w in words]), words_of(v))) == 0)
        if field:
            return F.exists(F.coalesce(F.transform(F.try_element_at("fields", F.lit(field.removesuffix(".value"))), lambda e: e["value"]), F.array().cast("array<string>")), met)
        return F.exists(F.flatten(F.map_values("fields")), lambda e: met(e["value"]))

    found = either("", 0)
    return F.lit(True) if found is None else found


def match_fielded(docs: DataFrame, query: str) -> DataFrame:
    return docs.filter(parse_fielded(query))


def condition(field: str, values: list[str], mode: str = "OR") -> Column:
    """Whether a document has one of (or all) the exact values; a leading - negates."""
    bare = field.lstrip("-+")
    held = F.array(F.col("spec")) if bare.startswith("system.spec") else raws(bare)
    wanted = F.array(*[F.lit(v) for v in values])
    met = F.arrays_overlap(held, wanted) if mode == "OR" else F.size(F.array_except(wanted, held)) == 0
    return ~met if field.startswith("-") else met


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def filter_docs(docs: DataFrame, filters: dict[str, list[str]], mode: str = "OR") -> DataFrame:
    return docs.filter(every([condition(f, v, mode) for f, v in filters.items()]))


def hidden_filter(docs: DataFrame, hidden: dict[str, list[str]], or_hidden: list[dict[str, list[str]]], exclude: list[str] = ()) -> DataFrame:
    """Filters of a saved search: all hidden ones, and one of each hidden alternative, but for excluded fields."""
    use = [condition(f, v) for f, v in hidden.items() if f not in exclude]
    for group in or_hidden:
        options = [condition(f, v) for f, v in group.items() if f not in exclude]
        if options:
            use.append(reduce(lambda a, b: a | b, options))
    return docs.filter(every(use))


def boost(hits: DataFrame, demote: Column | None, promote_field: str | None, factor: float) -> DataFrame:
    """Scores of hits that match ``demote``, and of those without the promoted field, by a factor."""
    score = F.col("score")
    if demote is not None:
        score = score * F.when(demote, factor).otherwise(1.0)
    if promote_field is not None:
        score = score * F.when(F.size(raws(promote_field)) == 0, factor).otherwise(1.0)
    return hits.withColumn("score", score)


#: Parts in which the values of a facet are ranked.
PARTS = 64


def term_facets(docs: DataFrame, facets: list[str], filters: dict[str, list[str]], mode: str = "OR", size: int = 50) -> DataFrame:
    """(facet, value, n, other, total, doc_count): buckets of each facet, largest first, then by value.

    In OR mode a facet's buckets heed all filters but its own field's, compared before the first
    dot, so that choosing a value leaves the others on show. One scan: each filter is a condition,
    each facet's values are exploded under those that apply to it, and values are counted in each
    task first.
    """
    met = {f: condition(f, v, mode) for f, v in filters.items()}
    entries = []
    for facet in facets:
        own = facet.split(".")[0]
        use = [c for f, c in met.items() if not (mode == "OR" and f.lstrip("-+").split(".")[0] == own)]
        values = F.array(F.col("spec")) if facet.startswith("system.spec") else F.array_distinct(raws(facet))
        entries.append(F.struct(F.lit(facet).alias("facet"), F.when(every(use), values).otherwise(F.array().cast("array<string>")).alias("values")))
    per_doc = docs.select(F.explode(F.array(*entries)).alias("_e")).select("_e.facet", "_e.values")
    counted = per_doc.select("facet", F.explode("values").alias("value")).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    holding = per_doc.filter(F.size("values") > 0).groupBy("facet").agg(F.count(F.lit(1)).alias("doc_count"))
    # each part's largest first, so that no task ranks all values of a field, then the largest of those
    part = F.pmod(F.xxhash64("value"), F.lit(PARTS))
    first = counted.withColumn("_r", F.row_number().over(Window.partitionBy("facet", part).orderBy(F.desc("n"), "value"))).filter(F.col("_r") <= size)
    ranked = first.withColumn("_r", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value")))
    sums = counted.groupBy("facet").agg(F.sum("n").alias("total"))
    shown = ranked.filter(F.col("_r") <= size).drop("_r")
    top = shown.groupBy("facet").agg(F.sum("n").alias("_shown"))
    return shown.join(sums, "facet").join(top, "facet").join(holding, "facet").select("facet", "value", "n", (F.col("total") - F.col("_shown")).alias("other"), "total", "doc_count")


def full_facet(docs: DataFrame, field: str, filters: dict[str, list[str]], size: int = 2000) -> DataFrame:
    return term_facets(docs, [field], filters, size=size)


def order_facets(facets: DataFrame, config: list[str]) -> DataFrame:
    """Facets with their place in the configured order; those not in it, and places, are left out."""
    place = F.array_position(F.array(*[F.lit(c) for c in config]), F.col("facet")).cast("int")
    return facets.filter(F.col("facet") != "places.raw").withColumn("place", place).filter("place > 0")


def sort_hits(docs: DataFrame, sort_by: str | None = None, order: str = "asc") -> DataFrame:
    """By a field's least value, or by score, then hub id and date, both descending; ascending unless another order is given."""
    if sort_by is None:
        first = F.desc("score") if "score" in docs.columns else F.desc("hub_id")
    else:
        key = F.array_min(raws(sort_by))
        first = key.asc_nulls_last() if order == "asc" else key.desc_nulls_last()
    rest = [F.desc("hub_id")] + ([F.desc("modified_at")] if "modified_at" in docs.columns else [])
    return docs.orderBy(first, *rest)


def random_order(docs: DataFrame, seed: str) -> DataFrame:
    """The same shuffled order for the same seed."""
    return docs.orderBy(F.md5(F.concat(F.lit(seed), "hub_id")), "hub_id")


def page_hits(docs: DataFrame, rows: int = 16, page: int = 1, start: int | None = None) -> DataFrame:
    """A page of ordered hits; ``start``, from 1, wins over the page. Spark keeps the top rows only."""
    skip = max(start - 1, 0) if start is not None else (max(page, 1) - 1) * rows
    return docs.offset(skip).limit(rows)


def page_after(docs: DataFrame, modified_at, hub_id: str, n: int) -> DataFrame:
    """The n documents that follow a key in the order of date ascending, id descending."""
    later = (F.col("modified_at") > F.lit(modified_at)) | ((F.col("modified_at") == F.lit(modified_at)) & (F.col("hub_id") < hub_id))
    return docs.filter(later).orderBy("modified_at", F.desc("hub_id")).limit(n)


def visible_docs(docs: DataFrame, whitelist: DataFrame, ip: str) -> DataFrame:
    """Without documents of specs that are restricted to other addresses; ``whitelist`` is (spec, ip)."""
    hidden = whitelist.groupBy("spec").agg(F.bool_or(F.col("ip") == ip).alias("_ok")).filter("not _ok").select("spec")
    return docs.join(hidden, "spec", "left_anti")


def find_items(docs: DataFrame, ids: DataFrame, by: str = "hub_id", ignore_case: bool = False) -> DataFrame:
    """Documents whose ``by`` is among ``ids`` (id): a column, or a field such as dc_identifier, of which one exact value is enough."""
    fold = F.lower if ignore_case else (lambda c: c)
    wanted = ids.select(fold(F.col("id")).alias("_id")).distinct()
    if by in docs.columns:
        return docs.join(wanted, fold(F.col(by)) == F.col("_id"), "left_semi")
    held = docs.select("hub_id", F.explode(F.array_distinct(F.transform(raws(by), fold))).alias("_id"))
    return docs.join(held.join(wanted, "_id", "left_semi").select("hub_id"), "hub_id", "left_semi")


#: Parts into which the documents of groups without a wanted value are dealt.
DEALT = 64


def collection_members(docs: DataFrame, collections: DataFrame) -> DataFrame:
    """(slug, hub_id): documents of saved collections (slug, filters[, or_filters]), both array<struct<field, value>>.

    A document fits a group of filters if every field has one of its wanted values and no field with
    ``-`` before its name has a value named there. It is a member if it fits ``filters`` or, unless
    null or empty, ``or_filters``; filters that are null, empty or only exclude fit all else. Groups
    meet documents on (field, value) and count the fields met; a field counts once however many of
    its values match. Groups that want no value meet all documents, in ``DEALT`` parts.
    """
    none = F.array().cast("array<struct<field:string,value:string>>")
    sides = [F.coalesce("filters", none)] + ([F.when(F.size("or_filters") > 0, F.col("or_filters"))] if "or_filters" in collections.columns else [])
    groups = collections.select("slug", F.posexplode(F.array(*sides)).alias("_g", "_f")).filter("_f is not null")
    terms = F.array_distinct(F.transform("_f", lambda f: F.struct(f["field"].startswith("-").alias("bad"), F.regexp_replace(f["field"], r"^-|\.raw$", "").alias("field"), f["value"].alias("value"))))
    need = F.size(F.array_distinct(F.transform(F.filter("_t", lambda t: ~t["bad"]), lambda t: t["field"])))
    parts = F.transform(F.sequence(F.lit(0), F.lit(DEALT - 1)), lambda i: F.struct(F.lit(False).alias("bad"), F.lit("").alias("field"), i.cast("string").alias("value")))
    groups = groups.withColumn("_t", terms).withColumn("_need", need)
    wanted = groups.select("slug", "_g", F.greatest("_need", F.lit(1)).alias("_need"), F.explode(F.when(F.col("_need") == 0, F.concat("_t", parts)).otherwise(F.col("_t"))).alias("t")).select("slug", "_g", "_need", "t.bad", "t.field", "t.value")
    held = raw_values(docs).select("hub_id", "field", "value")
    if not groups.filter("_need = 0").isEmpty():
        held = held.unionByName(docs.select("hub_id", F.lit("").alias("field"), F.pmod(F.xxhash64("hub_id"), F.lit(DEALT)).cast("string").alias("value")))
    met = held.join(wanted, ["field", "value"]).groupBy("slug", "_g", "hub_id").agg(F.count_distinct(F.when(~F.col("bad"), F.col("field"))).alias("_got"), F.max("_need").alias("_need"), F.bool_or("bad").alias("_bad"))
    return met.filter("_got = _need and not _bad").select("slug", "hub_id").distinct()


#: Heavy values of a set up to which all its parts are listed; larger sets meet others one by one.
WIDE = 10


def related_by_values(docs: DataFrame, fields: list[str], k: int, max_df: int | None = None, dense: int = 60, where: Column | None = None) -> DataFrame:
    """(hub_id, related, matches): for each record the k that share most exact values of the fields, ties by id.

    ``where`` is a condition on the records that may be related. Records meet in pairs on values of
    at most ``dense`` records. Of a record's other, heavy values every part (subset) is looked up in
    an index of the parts of all sets, which lists the k + 1 smallest ids that have a part: of the
    records that share just that part, one further down has k before it. So a value that all
    records share pairs neither records nor sets, and the result is exact and does not depend on
    ``dense``. Sets of more than ``WIDE`` heavy values meet the others on single values instead.
    With ``max_df``, values that more documents have do not count.
    """
    named = raw_values(docs).filter(F.col("field").isin(fields)).dropDuplicates()
    values = cut(named.select("hub_id", F.struct(F.xxhash64("field", "value").alias("x"), F.xxhash64(F.lit(7), "value", "field").alias("y")).alias("v")))
    allowed = None if where is None else cut(docs.filter(where).select(F.col("hub_id").alias("related")).distinct())
    may = lambda rows: rows if allowed is None else rows.join(allowed, "related", "left_semi")
    counted = values.groupBy("v").agg(F.count(F.lit(1)).alias("_df"))
    if max_df is not None:
        values = values.join(counted.filter(F.col("_df") > max_df), "v", "left_anti")
    heavy = cut(counted.filter(F.col("_df") > dense).select("v"))
    light, held = values.join(heavy, "v", "left_anti"), values.join(heavy, "v", "left_semi")
    sets = cut(held.groupBy("hub_id").agg(F.sort_array(F.collect_set("v")).alias("set")).withColumn("g", F.struct(F.xxhash64("set").alias("x"), F.xxhash64(F.lit(7), "set").alias("y"))))
    # pairs on light values, with the heavy values that they share as well
    pairs = light.join(may(light.withColumnRenamed("hub_id", "related")), "v").filter("hub_id <> related").groupBy("hub_id", "related").agg(F.count(F.lit(1)).alias("n"))
    mine, theirs = sets.select("hub_id", F.col("set").alias("_a")), sets.select(F.col("hub_id").alias("related"), F.col("set").alias("_b"))
    also = F.coalesce(F.size(F.array_intersect("_a", "_b")), F.lit(0))
    near = pairs.join(mine, "hub_id", "left").join(theirs, "related", "left").select("hub_id", "related", (F.col("n") + F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), also).otherwise(0)).alias("matches"))
    # the smallest ids of every set, then of every part of one
    least = cut(_first(may(sets.select("g", "set", F.col("hub_id").alias("related"))), "g", k + 1, "related"))
    parts = F.transform(F.sequence(F.lit(1), F.pow(F.lit(2), F.size("set")).cast("int") - 1), lambda m: F.filter("set", lambda x, i: F.getbit(m, i) == 1))
    part = lambda rows, *keep: rows.filter(F.size("set") <= WIDE).select(*keep, F.explode(parts).alias("_p")).select(*keep, F.size("_p").cast("long").alias("matches"), F.xxhash64("_p").alias("x"), F.xxhash64(F.lit(7), "_p").alias("y"))
    listed = _first(part(least, "related"), ["x", "y"], k + 1, "related").drop("matches")
    kinds = sets.select("g", "set").dropDuplicates(["g"])
    met = part(kinds, "g").join(listed, ["x", "y"]).groupBy("g", "related").agg(F.max("matches").alias("matches"))
    wide = kinds.filter(F.size("set") > WIDE)
    if not wide.isEmpty():
        one, other = kinds.select("g", F.size("set").alias("_n"), F.explode("set").alias("v")), kinds.select(F.col("g").alias("g2"), F.size("set").alias("_m"), F.explode("set").alias("v"))
        apart = one.join(other, "v").filter((F.col("_n") > WIDE) | (F.col("_m") > WIDE)).groupBy("g", "g2").agg(F.count(F.lit(1)).alias("matches"))
        met = met.unionByName(apart.join(least.select(F.col("g").alias("g2"), "related"), "g2").select("g", "related", "matches"))
    best = _first(met, "g", k + 1, F.desc("matches"), "related")
    lists = best.groupBy("g").agg(F.collect_list(F.struct("related", "matches")).alias("l"))
    far = sets.select("hub_id", "g").join(lists, "g").select("hub_id", F.explode("l").alias("l")).select("hub_id", "l.related", "l.matches").filter("hub_id <> related")
    # light values count in ``near`` alone, which has all of a pair's
    shared = near.unionByName(far).groupBy("hub_id", "related").agg(F.max("matches").alias("matches"))
    return _first(shared, "hub_id", k, F.desc("matches"), "related")


def _first(rows: DataFrame, key: str | list[str], n: int, *order) -> DataFrame:
    """The first n rows of each key; Spark takes them in every task before it shuffles."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def more_like_this(docs: DataFrame, text: Column | list[str], k: int, terms: int = 12, min_tf: int = 1, min_df: int = 2, max_df: int | None = None, where: Column | None = None) -> DataFrame:
    """(hub_id, related, score): for each record the k others that share most weight of its best terms by tf * idf.

    ``text`` is a text, or the fields whose values make it up; ``where`` is a condition on the
    records that may be related, whose frequencies count all records nevertheless.
    Of every record, one row of ``docs``, at most ``terms`` terms are looked up, however frequent they
    are. Every record first meets the head, the least ids of those that may be related: its k-th best
    there is a bound that any other must pass, as of equal scores the least ids count. The rarest
    terms without which no sum passes it, for most records none or few, then visit each block of the
    others and add up their postings there; so no pair of records is ever a row, and a block passes
    on k of each. With ``max_df``, terms of more documents are not used.
    """
    if isinstance(text, list):
        values = [F.coalesce(F.transform(F.try_element_at("fields", F.lit(f.removesuffix(".raw").removesuffix(".value"))), lambda e: e["value"]), F.array().cast("array<string>")) for f in text]
        text = F.array_join(F.flatten(F.array(*values)), " ")
    may = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    spark = docs.sparkSession
    packed = kept(_weighed(docs.select("hub_id", F.regexp_replace(F.lower(text), NO_WORD, " ").alias("words"), may.alias("may")), terms, min_tf, min_df, max_df))
    open_ = packed.filter("may and hub_id is not null")
    sizes = open_.orderBy("hub_id").select("hub_id", F.size("held").alias("n")).limit(HEAD_DOCS).collect()
    first = int(np.searchsorted(np.cumsum([r.n for r in sizes]), HEAD_TERMS, "right")) if sizes else 0
    last = sizes[first - 1].hub_id if first else None
    head = [(r.hub_id, r.held) for r in open_.filter(F.col("hub_id") <= F.lit(last)).select("hub_id", "held").collect()] if first else []
    index = spark.sparkContext.broadcast(_Postings(*zip(*sorted(head), strict=True)) if head else None)
    # with what the head holds for it: its k best there, the bound, and how many terms it takes to pass it
    met = kept(packed.select("hub_id", "t", "s").mapInArrow(_in_head(index, k), "hub_id string, t array<long>, s array<double>, least double, need int, best array<struct<related string, score double>>"))
    rest = open_ if last is None else open_.filter(F.col("hub_id") > F.lit(last))
    n, held = rest.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("held")), F.lit(0))).first()
    blocks = max(-(-n // BLOCK_DOCS), -(-held // BLOCK_TERMS), min(2 * spark.sparkContext.defaultParallelism, -(-n // 1024)), 1)
    null = lambda kind: F.lit(None).cast(kind)
    # side 0 has the terms of the block's own records that may be related, side 1 the best terms of all that need it
    own = rest.select(F.pmod(F.xxhash64("hub_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side"), "hub_id", F.col("held").alias("t"), null("array<double>").alias("s"), null("double").alias("least"), null("int").alias("need"))
    every_ = met.filter("need > 0").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), "hub_id", "t", "s", "least", "need")
    far = own.unionByName(every_).repartition(blocks, "block").sortWithinPartitions("block", "side", "hub_id").mapInArrow(_in_blocks(k), "hub_id string, related string, score double")
    near = met.select("hub_id", F.explode("best").alias("b")).select("hub_id", "b.*")
    return _first(near.unionByName(far), "hub_id", k, F.desc("score"), "related")


#: Most records, and terms of records, of a block on average; of the head at all; and bytes of texts whose terms are counted together.
BLOCK_DOCS, BLOCK_TERMS = 131072, 8_000_000
HEAD_DOCS, HEAD_TERMS = 4096, 2_000_000
SLICE_BYTES = 4 << 20
#: Pairs of record and posting that are added up at once.
PAIRS = 1 << 20


def _weighed(texts: DataFrame, terms: int, min_tf: int, min_df: int, max_df: int | None) -> DataFrame:
    """(hub_id, may, held, t, s) of every (hub_id, words, may) with terms: numbers of all its terms, and of the best, rarest first, with what each adds to a score.

    Words are between spaces. Texts are counted in slices; only a slice's different terms are
    shuffled by term, and come back with their number and weight to the counts of their slice.
    """
    counts = kept(texts.mapInArrow(_counted, "slice long, hub_id string, may boolean, code binary, tf binary, terms array<string>, dfs array<int>"))
    n = counts.filter("terms is null").count()
    listed = counts.filter("terms is not null").select("slice", F.posexplode(F.arrays_zip("terms", "dfs")).alias("code", "x")).select("slice", "code", F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
    seen = F.col("df") >= min_df if max_df is None else F.col("df").between(min_df, max_df)
    # a term has a row for each slice at most; in order of term, its number is the same if a task runs again
    known = listed.groupBy("term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("slice", "code")).alias("at")).filter(seen).sortWithinPartitions("term")
    known = known.select(F.monotonically_increasing_id().alias("t"), F.log(1 + F.lit(float(n)) / F.col("df")).alias("idf"), "at")  # numbered before the rows of the slices are made
    known = known.select("t", "idf", F.explode("at").alias("a")).select("a.slice", F.lit(0).alias("side"), "a.code", "t", "idf")
    held = counts.filter("terms is null").select("slice", F.lit(1).alias("side"), "hub_id", "may", F.col("code").alias("codes"), "tf")
    rows = known.unionByName(held, allowMissingColumns=True).repartition(F.col("slice")).sortWithinPartitions("slice", "side")
    return rows.select("slice", "side", "code", "t", "idf", "hub_id", "may", "codes", "tf").mapInArrow(_best_terms(terms, min_tf), "hub_id string, may boolean, held array<long>, t array<long>, s array<double>")


def _ends(values) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)]).astype(np.int64)


def _lists(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), _ends(column.value_lengths().to_numpy(zero_copy_only=False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each slice of texts a row of each (codes and counts of its terms) and a row of the slice (its terms in order, whose places are the codes, and how many texts have each)."""
    names = ["slice", "hub_id", "may", "code", "tf", "terms", "dfs"]
    kinds = [pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32())]
    of, made = TaskContext.get().partitionId() << 32, 0
    for batch in (b for b in batches if len(b)):
        sizes = np.nan_to_num(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        part = np.cumsum(sizes) // SLICE_BYTES
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
            rows, n = batch.slice(int(a), int(b - a)), int(b - a)
            split = pc.split_pattern(rows.column(1).cast(pa.large_string()).fill_null(""), " ")
            words = split.flatten().dictionary_encode()
            order = pc.array_sort_indices(words.dictionary).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            terms = words.dictionary.take(pa.array(order))
            code = place[words.indices.to_numpy()]
            row = np.repeat(np.arange(n), split.value_lengths().to_numpy())
            if len(terms) and terms[0].as_py() == "":  # what is before the first and after the last space
                row, code, terms = row[code > 0], code[code > 0] - 1, terms[1:]
            key, tf = np.unique(row * max(len(terms), 1) + code, return_counts=True)
            row, code = np.divmod(key, max(len(terms), 1))
            at = _ends(np.bincount(row, minlength=n)).tolist()
            raw, times = code.astype(np.int32).tobytes(), tf.astype(np.int32).tobytes()
            bits = [pa.array([x[4 * i : 4 * j] for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()) for x in (raw, times)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, of + made)), rows.column(0).cast(pa.string()), rows.column(2), *bits, pa.nulls(n, kinds[5]), pa.nulls(n, kinds[6])], names)
            whole = np.array([0, len(terms)])
            listed = pa.ListArray.from_arrays(pa.array(whole.astype(np.int32)), terms.cast(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([of + made]), *[pa.nulls(1, x) for x in kinds[1:5]], listed, _lists(np.bincount(code, minlength=len(terms)).astype(np.int32), whole)], names)
            made += 1


def _best_terms(terms: int, min_tf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_, got, number, idf = None, [], None, None
        for batch in batches:
            of, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            turns = np.flatnonzero((np.diff(of) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *turns], [*turns, len(side)], strict=True):
                if not b > a:
                    continue
                if of[a] != slice_:
                    slice_, got, number = of[a], [], None
                part = batch.slice(int(a), int(b - a))
                if side[a] == 0:
                    got.append([part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)])
                    continue
                if not got:
                    continue
                if number is None:
                    code, t, x = (np.concatenate(c) for c in zip(*got, strict=True))
                    number, idf = np.full(int(code.max()) + 1, -1, np.int64), np.zeros(int(code.max()) + 1)
                    number[code.astype(np.int64)], idf[code.astype(np.int64)] = t, x
                codes = [np.frombuffer(x, np.int32) for x in part.column(7).to_pylist()]
                row = np.repeat(np.arange(len(codes)), [len(x) for x in codes])
                code, tf = np.concatenate(codes), np.frombuffer(b"".join(part.column(8).to_pylist()), np.int32)
                on = code < len(number)
                on[on] = number[code[on]] >= 0
                row, code, tf = row[on], code[on], tf[on]
                w = np.round(tf * idf[code], 6)
                # codes ascend with the terms
                use = np.flatnonzero(tf >= min_tf)
                use = use[np.lexsort((code[use], -w[use], row[use]))]
                rank = np.arange(len(use)) - np.searchsorted(row[use], row[use])
                use = use[rank < terms]
                use = use[np.lexsort((code[use], -idf[code[use]], row[use]))]
                ends = lambda r: _ends(np.bincount(r, minlength=len(codes)))
                best = ends(row[use])
                out = [part.column(5), part.column(6), _lists(number[code], ends(row)), _lists(number[code[use]], best), _lists(w[use] * idf[code[use]], best)]
                yield pa.RecordBatch.from_arrays(out, ["hub_id", "may", "held", "t", "s"]).filter(pa.array(np.bincount(row, minlength=len(codes)) > 0))

    return run


class _Postings:
    """Records by term: those of ``known[i]`` are ``docs[bounds[i] : bounds[i + 1]]``, ascending, as places in ``names``."""

    def __init__(self, names, held):
        self.names = np.array(names, object)
        every = np.concatenate([np.asarray(x, np.int64) for x in held])
        docs = np.repeat(np.arange(len(self.names), dtype=np.int32), [len(x) for x in held])
        by = np.argsort(every, kind="stable")
        every, self.docs = every[by], docs[by]
        first = np.flatnonzero(np.diff(every, prepend=every[:1] - 1)) if len(every) else np.zeros(0, np.int64)
        self.known, self.bounds = every[first], np.append(first, len(every)).astype(np.int64)
        self.place = {h: i for i, h in enumerate(self.names)}
        self._keys = None

    def spots(self, t: np.ndarray) -> np.ndarray:
        """Where terms are in ``known``, -1 for others."""
        if not len(self.known):
            return np.full(len(t), -1)
        spot = np.minimum(np.searchsorted(self.known, t), len(self.known) - 1)
        return np.where(self.known[spot] == t, spot, -1)

    def holds(self, spot: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether the records have the terms at those spots."""
        if self._keys is None:
            self._keys = np.repeat(np.arange(len(self.known)), np.diff(self.bounds)) * len(self.names) + self.docs
        key = spot * len(self.names) + doc
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return (spot >= 0) & (self._keys[at] == key)


def _in_head(index, k: int):
    """Rows with their k best of the head, without themselves, the k-th score (0 if there are fewer), and the number of terms, rarest first, whose lack no other record can make up."""
    names = ["hub_id", "t", "s", "least", "need", "best"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = index.value
        for batch in batches:
            (t, at), (s, _) = _flat(batch.column(1)), _flat(batch.column(2))
            spot = p.spots(t) if p else np.full(len(t), -1)
            least, need, found, scores = np.zeros(len(batch)), np.zeros(len(batch), np.int32), [], []
            for i, h in enumerate(batch.column(0).to_pylist()):
                a, b = int(at[i]), int(at[i + 1])
                few = np.zeros(0, np.int64)
                if p:
                    score = np.zeros(len(p.names))
                    for j in range(a, b):
                        if (x := spot[j]) >= 0:
                            score[p.docs[p.bounds[x] : p.bounds[x + 1]]] += s[j]
                    if h in p.place:
                        score[p.place[h]] = 0.0
                    few = np.flatnonzero(score)
                    value = np.round(score[few], 4)
                    few, value = few[value > 0], value[value > 0]
                    if len(few) > k:
                        edge = np.partition(value, len(few) - k)[len(few) - k]
                        above, equal = np.flatnonzero(value > edge), np.flatnonzero(value == edge)
                        pick = np.concatenate([above, equal[: k - len(above)]])  # ids ascend
                        few, value = few[pick], value[pick]
                    if len(few) == k:
                        least[i] = value.min()
                    scores.append(value)
                # what the terms from each on add up to
                after = np.cumsum(s[a:b][::-1])[::-1]
                need[i] = np.count_nonzero(np.round(after + 1e-9, 4) > least[i])
                found.append(few)
            ends = _ends([len(x) for x in found])
            picked = np.concatenate(found) if found else np.zeros(0, np.int64)
            pairs = pa.StructArray.from_arrays([pa.array(p.names[picked] if p else [], pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["related", "score"])
            best = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(least), pa.array(need), best], names)

    return run


def _in_blocks(k: int):
    """For every record of side 1 the k best of the block's records of side 0, without itself, that score above its bound."""

    def best(p: _Postings, hubs: list[str], t: np.ndarray, s: np.ndarray, least: np.ndarray, need: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(record, place, score); t and s are tables of a row for each record, t -1 and s 0 where it has fewer terms."""
        spot = p.spots(t.ravel()).reshape(t.shape)
        used = (np.arange(t.shape[1]) < need[:, None]) & (spot >= 0)
        long = np.where(used, p.bounds[spot + 1] - p.bounds[spot], 0)
        spare = np.where(np.arange(t.shape[1]) < need[:, None], 0.0, s).sum(1)
        bits = len(p.names).bit_length()
        itself = np.array([p.place.get(h, -1) for h in hubs])
        cuts = np.cumsum(long.sum(1)) // PAIRS
        starts = np.flatnonzero(np.diff(cuts, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(cuts)], strict=True):
            n = long[a:b].ravel()
            take = np.repeat(p.bounds[spot[a:b].ravel()] - _ends(n)[:-1], n) + np.arange(n.sum())
            key = (np.repeat(np.repeat(np.arange(a, b), t.shape[1]), n) << bits) + p.docs[take]
            by = np.argsort(key, kind="stable")
            key, adds = key[by], np.repeat(s[a:b].ravel(), n)[by]
            new = np.diff(key, prepend=-1) != 0
            q, doc = key[new] >> bits, key[new] & ((1 << bits) - 1)
            score, other = np.bincount(np.cumsum(new) - 1, adds, len(q)), spare[q]  # in the order of terms, as in the head
            # what isn't above the bound when rounded goes
            on = (doc != itself[q]) & (score + other > least[q] + 4e-5)
            for j in range(int(need[a:b].min()), t.shape[1]):
                q, doc, score, other = q[on], doc[on], score[on], other[on]
                asks = np.flatnonzero((j >= need[q]) & (s[q, j] > 0))
                x = s[q[asks], j]
                score[asks] += np.where(p.holds(spot[q[asks], j], doc[asks]), x, 0.0)
                other[asks] -= x
                on = score + other > least[q] + 4e-5
            q, doc, score = q[on], doc[on], score[on]
            score = np.round(score, 4)
            on = (score > least[q]) & (score > 0)
            q, doc, score = q[on], doc[on], score[on]
            by = np.lexsort((-score, q))  # places ascend, and stay so where scores are equal
            q, doc, score = q[by], doc[by], score[by]
            on = np.arange(len(q)) - np.searchsorted(q, q) < k
            yield q[on], doc[on], score[on]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, hubs, held, p = None, [], [], None
        for batch in batches:
            block_of, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            turns = np.flatnonzero((np.diff(block_of) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *turns], [*turns, len(side)], strict=True):
                if not b > a:
                    continue
                if block_of[a] != block:
                    block, hubs, held, p = block_of[a], [], [], None
                part = batch.slice(int(a), int(b - a))
                hub = part.column(2).to_pylist()
                t, at = _flat(part.column(3))
                if side[a] == 0:
                    hubs += hub
                    held += np.split(t, at[1:-1])
                    continue
                if not hubs:
                    continue
                if p is None:
                    p = _Postings(hubs, held)
                    held = []
                s, _ = _flat(part.column(4))
                wide = np.arange(int(np.diff(at).max())) < np.diff(at)[:, None]
                table_t, table_s = np.full(wide.shape, -1, np.int64), np.zeros(wide.shape)
                table_t[wide], table_s[wide] = t, s
                names = np.array(hub, object)
                for q, doc, score in best(p, hub, table_t, table_s, part.column(5).to_numpy(zero_copy_only=False), part.column(6).to_numpy(zero_copy_only=False)):
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(names[q], pa.string()), pa.array(p.names[doc], pa.string()), pa.array(score)], ["hub_id", "related", "score"])

    return run


def analyze_nl(c: Column) -> Column:
    """Words of a Dutch text without stop words; some keep a form of their own."""
    over = F.create_map(*[F.lit(x) for pair in OVERRIDES_NL.items() for x in pair])
    kept = F.filter(words_of(c), lambda w: ~w.isin(STOP_NL))
    return F.transform(kept, lambda w: F.coalesce(F.try_element_at(over, w), w))


# ---- points ----


#: Rows of a side of a cell that one part holds, at least, and dense cells of a side at most.
PART_ROWS, DENSE_CELLS = 10_000, 50_000


def dense_parts(points: DataFrame, centres: DataFrame, cell: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with (_p, _c): rows of a cell that has too many are dealt into parts by hash.

    A point lies in one part _p and is copied to all parts _c of the cell's centres, a centre the
    other way, so each pair meets once. A cell is dense above ``PART_ROWS`` rows of a side, or above
    the side's rows divided by ``DENSE_CELLS`` if that is more; so at most ``DENSE_CELLS`` cells of a
    side are dense and the table of them, which is broadcast, has a bound. Equal rows share a part.
    """

    def parts(side: DataFrame, name: str) -> DataFrame:
        counted = cut(side.groupBy(*cell).agg(F.count(F.lit(1)).alias("_m")))
        most = max(PART_ROWS, -(-(counted.agg(F.sum("_m")).first()[0] or 0) // DENSE_CELLS))
        return counted.filter(F.col("_m") > most).select(*cell, F.ceil(F.col("_m") / most).cast("int").alias(name))

    dense = cut(parts(points, "_np").join(parts(centres, "_nc"), cell, "full_outer"))

    def dealt(side: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        place = F.pmod(F.xxhash64(*[c for c in side.columns if c not in cell]), F.coalesce(own_n, F.lit(1))).cast("int")
        rows = side.join(F.broadcast(dense), cell, "left").withColumn(own, place)
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(other_n, F.lit(1)) - 1))).drop("_np", "_nc")

    return dealt(points, "_p", "_np", "_c", "_nc"), dealt(centres, "_c", "_nc", "_p", "_np")


def within_distance(points: DataFrame, centres: DataFrame, km: float) -> DataFrame:
    """(centre, hub_id, km): points within a distance of each centre (centre, lat, lon), by the great circle.

    Points and centres meet on cells: bands of latitude as high as the distance, cut into columns
    that are at least as wide, so fewer towards the poles and one at them; columns go on across
    longitude 180. A centre looks into its own and the next bands and columns, so no pair of tables
    is crossed. Cells are counted first: the points and the centres of a dense one are dealt into
    parts that meet each other, so no task gets a whole town.
    """
    high = max(min(km / 111.0, 180.0), 1e-6)
    # how wide the distance is, in degrees of longitude, where a band with the next ones is nearest to a pole
    edge = lambda band: F.least(F.greatest(F.abs(band * high - 90 - high), F.abs((band + 2) * high - 90)), F.lit(90.0))
    columns = lambda band: F.greatest(F.lit(1), F.floor(F.lit(360.0) * F.cos(F.radians(edge(band))) / (high * 1.01))).cast("long")
    band_of = lambda lat: F.floor((lat + 90) / high)
    column_of = lambda lon, n: F.pmod(F.floor((F.pmod(lon + 180, F.lit(360.0))) / 360 * n), n)
    wide = centres.select("centre", F.col("lat").alias("clat"), F.col("lon").alias("clon"), band_of(F.col("lat")).alias("_own")).filter("clat is not null and clon is not null")
    wide = wide.withColumn("_y", F.explode(F.sequence(F.col("_own") - 1, F.col("_own") + 1))).withColumn("_n", columns(F.col("_y")))
    at = column_of(F.col("clon"), F.col("_n"))
    wide = wide.withColumn("_x", F.explode(F.array_distinct(F.transform(F.sequence(at - 1, at + 1), lambda x: F.pmod(x, F.col("_n"))))))
    cells = points.select("hub_id", "lat", "lon").withColumn("_y", band_of(F.col("lat"))).withColumn("_x", column_of(F.col("lon"), columns(F.col("_y"))))
    d = haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    cells, wide = dense_parts(cells, wide, ["_y", "_x"])
    return cells.join(wide, ["_y", "_x", "_p", "_c"]).withColumn("km", d).filter(F.col("km") <= km).select("centre", "hub_id", F.round("km", 4).alias("km"))


def in_bbox(points: DataFrame, min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> DataFrame:
    return points.filter(F.col("lat").between(min_lat, max_lat) & F.col("lon").between(min_lon, max_lon))


def has_geo(docs: DataFrame) -> DataFrame:
    """Documents with a point."""
    return docs.filter(F.exists(F.coalesce("point", F.array().cast("array<string>")), lambda p: parse_point(p).isNotNull()))


def geo_clusters(points: DataFrame, precision: int = 3) -> DataFrame:
    """(cell, n, lat, lon): documents in each geohash cell, and its centre."""
    counted = points.groupBy(geohash_encode(F.col("lat"), F.col("lon"), precision).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    centre = geohash_decode(F.col("cell"), precision)
    return counted.select("cell", "n", centre["lat"].alias("lat"), centre["lon"].alias("lon"))


def point_list(docs: DataFrame, most: int = 2500) -> DataFrame:
    """(hub_id, lat, lon): one row for each good point of a document, the first ``most`` by id."""
    rows = docs.select("hub_id", F.explode("point").alias("_p")).select("hub_id", parse_point(F.col("_p")).alias("p")).filter("p is not null")
    return rows.select("hub_id", "p.lat", "p.lon").orderBy("hub_id", "lat", "lon").limit(most)


def search(docs: DataFrame, query: str | None = None, filters: dict[str, list[str]] | None = None, hidden: dict[str, list[str]] | None = None, facets: list[str] | None = None, whitelist: DataFrame | None = None, ip: str = "", rows: int = 16, page: int = 1) -> tuple[DataFrame, DataFrame]:
    """(hits of the page, facets): restricted specs, hidden filters and the text come first, the facets' filters after."""
    base = docs if whitelist is None else visible_docs(docs, whitelist, ip)
    base = hidden_filter(base, hidden or {}, [])
    if query and re.search(r"[_a-zA-Z0-9.]+:\S|\s(NOT|AND|OR)\s", query):
        base = match_fielded(base, query).withColumn("score", F.lit(1.0))
    elif query:
        base = match_text(base, query)
    else:
        base = base.withColumn("score", F.lit(1.0))
    counted = term_facets(base, facets or [], filters or {}) if facets else None
    hits = page_hits(sort_hits(filter_docs(base, filters or {})), rows, page)
    return hits, counted
