"""Mixing sources to target weights by a low-discrepancy schedule.

Every source gets a target of words: a share of all words by weight, at most ``most`` times what
it holds, the excess reshared. Golden-ratio points mapped through the cumulative targets name the
source of each slot of the mix. A source's documents, shuffled by hash and repeated end to end,
are cut into blocks of equally many words; the slot of rank r in its source takes block r. So the
points decide what is taken: a source's words differ from its target by a few blocks, as the
discrepancy of the points has it, and a source that has no block left leaves its slot empty.

Slots grow with the corpus once a block would have more than ``BLOCK_WORDS`` words. Running sums
inside a source go by ranges of the hash, so no task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, n_words, running, small, spread31

WEIGHTS = (5.0, 2.0, 1.0)
#: The golden ratio's fractional part in units of 2**-31 (odd, so that points repeat only after 2**31).
GOLDEN = 1_327_217_885
CELLS = 4096
#: Slots of a small mix, most words of a block in a large one, and rows of a range.
LEAST_SLOTS, BLOCK_WORDS, RANGE_ROWS = 1 << 17, 1 << 20, 4000


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_id, docs, source_size, target) of each source; null is a source, the last.

    The level L with sum(min(most * size, L * weight)) = share * total is the largest of
    (total - caps before) / (weights from here) over the sources in order of cap by weight.
    One row for each source passes a window without a key; documents do not.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
        .withColumn("source_id", F.row_number().over(by_name) - 1)
        .withColumn("_weight", F.element_at(cycle, (F.col("source_id") % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    )
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), "source_id")
    every = Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("_weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    return (
        sources.withColumn("_level", level)
        .withColumn("target", F.least("_cap", F.max("_level").over(every) * F.col("_weight")))
        .select("source", "source_id", "docs", "source_size", "target")
    )


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """(source_id, rank, place) of every slot of the mix; rank counts a source's slots from 0."""
    spark = targets.sparkSession
    ahead = Window.orderBy("source_id")
    held = (
        targets.filter("target > 0")
        .withColumn("_to", F.sum("target").over(ahead) / F.sum("target").over(Window.partitionBy()))
        .withColumn("_from", F.coalesce(F.lag("_to").over(ahead), F.lit(0.0)))
        .withColumn("_to", F.when(F.lead("_to").over(ahead).isNull(), F.lit(1.0)).otherwise(F.col("_to")))
        .select("source_id", "_from", "_to")
    )
    cells = held.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") * CELLS), F.least(F.floor(F.col("_to") * CELLS), F.lit(CELLS - 1)))))
    points = (
        spark.range(slots)
        .withColumnRenamed("id", "place")
        .withColumn("_point", (F.col("place") * F.lit(GOLDEN) % F.lit(1 << 31)) / F.lit(float(1 << 31)))
        .withColumn("_cell", F.floor(F.col("_point") * CELLS))
    )
    named = points.join(cells, "_cell").filter("_point >= _from and _point < _to").select("source_id", "place")
    width = F.floor(F.col("place") * F.lit(float(1 << 31) / max(slots, 1))).cast("long")
    return running(named, ["source_id"], F.lit(max(1, slots // RANGE_ROWS)), F.least(width, F.lit((1 << 31) - 1)), [F.col("place")], F.lit(1), "rank").select("source_id", "rank", "place")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, slots: int | None = None, seed: int = 11) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, taken, first_place, places, slots): words the mix takes of every row.

    ``taken`` counts repeats and is at most ``most`` times ``size``, rounded up; a source's sum is
    its target but for a few blocks. Rows without words get 0. Null source is a source of its own, null text has no words,
    an empty table gives an empty result, columns other than doc_id, text and source are not read.
    Equal rows are separate rows; the hash of doc_id and text orders a source, so reruns agree.
    ``first_place`` is the earliest slot of the mix that takes words of the row, null if none does;
    ``places`` has the earliest of each time round its source; ``slots`` is their number.
    """
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    targets = cut(source_targets(sized, weights, share, most))
    total = targets.agg(F.sum(F.round("target"))).first()[0] or 0
    block = max(1, int(total) // (slots or max(LEAST_SLOTS, int(total) // BLOCK_WORDS)))
    places = int(total) // block + 1 if total else 0
    known = sized.join(small(targets), sized.source.eqNullSafe(targets.source)).drop(targets.source)
    filled = known.filter("size > 0")
    placed = running(filled, ["source_id"], F.greatest(F.lit(1), F.ceil(F.col("docs") / RANGE_ROWS)).cast("long"), spread31(seed, F.col("doc_id"), F.col("text_hash")), [F.col("doc_id"), F.col("text_hash"), F.col("size")], F.col("size"), "start")
    passes = int(-(-most // 1))
    blocks = (
        placed.withColumn("_pass", F.explode(F.array(*[F.lit(k) for k in range(passes)])))
        .withColumn("_lo", F.col("start") + F.col("_pass") * F.col("source_size"))
        .withColumn("_hi", F.col("_lo") + F.col("size"))
        .withColumn("_most", F.floor(F.lit(float(most)) * F.col("source_size")))
        .withColumn("rank", F.explode(F.sequence(F.floor(F.col("_lo") / block), F.floor((F.col("_hi") - 1) / block))))
    )
    slot = schedule(targets, places)
    piece = F.greatest(F.lit(0), F.least("_hi", (F.col("rank") + 1) * block, "_most") - F.greatest("_lo", F.col("rank") * block))
    of_row = ["doc_id", "text_hash", "source", "source_id", "start", "size", "source_size", "target"]
    taken = (
        blocks.join(slot, ["source_id", "rank"], "left")
        .withColumn("_piece", F.when(F.col("place").isNotNull(), piece).otherwise(F.lit(0)))
        .groupBy(*of_row)
        .agg(F.sum("_piece").cast("long").alias("taken"), F.array(*[F.min(F.when((F.col("_piece") > 0) & (F.col("_pass") == k), F.col("place"))) for k in range(passes)]).alias("places"))
        .withColumn("first_place", F.array_min("places"))
    )
    out = ["doc_id", "text_hash", "source", "size", "source_size", "target", "taken", "first_place", "places"]
    empty = known.filter("size = 0").withColumns({"taken": F.lit(0).cast("long"), "first_place": F.lit(None).cast("long"), "places": F.array().cast("array<bigint>")})
    return taken.select(*out).unionByName(empty.select(*out)).withColumn("slots", F.lit(places).cast("long"))


def mixture(docs: DataFrame, place: str | None = None, **how) -> DataFrame:
    """The documents of the mix, as many whole copies of each as the taken words round to, half up.

    Columns are those of ``docs``; ``place`` names one more, the slot of each copy, by which the
    sources follow each other as the schedule has them. Rows equal in doc_id, text and source
    share their mean.
    """
    copies = (
        mix(docs, **how)
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("source").alias("_from"))
        .agg(F.avg(F.when(F.col("size") > 0, F.col("taken") / F.col("size"))).alias("_times"), F.min("places").alias("_places"), F.min("first_place").alias("_first"))
        .withColumn("_copies", F.floor(F.coalesce("_times", F.lit(0.0)) + 0.5).cast("int"))
        .filter("_copies > 0")
    )
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_of"), F.xxhash64("text").alias("_text"), F.col("source").alias("_source"))
    joined = rows.join(copies, F.col("_of").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")) & F.col("_source").eqNullSafe(F.col("_from")))
    each = joined.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    own = [F.coalesce(F.get("_places", F.col("_copy")), F.col("_first")).alias(place)] if place else []
    return each.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c != place], *own)
