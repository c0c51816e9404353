"""Ingest and synchronisation: routing of actions, change detection, upserts, deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Verbs of a bulk action.
VERBS = ["index", "clear_orphans", "disable_index", "drop_dataset"]


def route_actions(actions: DataFrame) -> DataFrame:
    """Actions with (route, error): the verb, or ``error`` with its reason; acceptance as a boolean, false by default.

    Needs (spec, action, graph, modified_at, acceptance). A dataset is needed always, a graph for
    ``index``, a date for ``clear_orphans``.
    """
    error = (
        F.when(F.col("spec").isNull(), "no dataset")
        .when(F.col("action").isNull() | ~F.col("action").isin(VERBS), "unknown action")
        .when((F.col("action") == "index") & F.col("graph").isNull(), "no graph")
        .when((F.col("action") == "clear_orphans") & F.col("modified_at").isNull(), "no date")
    )
    return actions.withColumns({"error": error, "route": F.when(error.isNull(), F.col("action")).otherwise("error"), "acceptance": F.coalesce(F.lower(F.col("acceptance").cast("string")) == "true", F.lit(False))})


def latest_actions(actions: DataFrame, keys: list[str] = ["hub_id"], sequence: str = "seq") -> DataFrame:  # noqa: B006
    """The last action of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(sequence))
    return actions.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def diff_by_hash(actions: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Actions whose (hub_id, content_hash) the snapshot does not have; of the snapshot those two columns alone are read."""
    seen = snapshot.select(F.col("hub_id").alias("_h"), F.col("content_hash").alias("_c"))
    return actions.join(seen, (F.col("hub_id") == F.col("_h")) & F.col("content_hash").eqNullSafe(F.col("_c")), "left_anti")


def classify_sync(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(hub_id, status): new, updated, unchanged or orphaned, by full comparison of (hub_id, content_hash)."""
    a = incoming.select("hub_id", F.col("content_hash").alias("_new"), F.lit(True).alias("_in"))
    b = stored.select("hub_id", F.col("content_hash").alias("_old"), F.lit(True).alias("_st"))
    status = F.when(F.col("_st").isNull(), "new").when(F.col("_in").isNull(), "orphaned").when(F.col("_new").eqNullSafe(F.col("_old")), "unchanged").otherwise("updated")
    return a.join(b, "hub_id", "full_outer").select("hub_id", status.alias("status"))


def diff_subjects(subjects: DataFrame, lookup: DataFrame) -> DataFrame:
    """(s, change): subjects added to or removed from the lookup table."""
    a = subjects.select("s").distinct().withColumn("_a", F.lit(True))
    b = lookup.select("s").distinct().withColumn("_b", F.lit(True))
    both = a.join(b, "s", "full_outer").filter("_a is null or _b is null")
    return both.select("s", F.when(F.col("_b").isNull(), "added").otherwise("removed").alias("change"))


def apply_actions(snapshot: DataFrame, actions: DataFrame) -> DataFrame:
    """The snapshot after index and delete actions of hub ids; ``actions`` has the snapshot's columns and a boolean ``delete``."""
    kept = snapshot.join(actions.select("hub_id").distinct(), "hub_id", "left_anti").select(*snapshot.columns)
    return kept.unionByName(actions.filter("not delete").select(*snapshot.columns))


def upsert_records(stored: DataFrame, incoming: DataFrame, acceptance: bool = False) -> DataFrame:
    """(hub_id, production_hash, acceptance_hash): one of the two hashes is replaced, new records are added."""
    side, other = ("acceptance_hash", "production_hash") if acceptance else ("production_hash", "acceptance_hash")
    new = incoming.select("hub_id", F.col("content_hash").alias("_new"))
    joined = stored.join(new, "hub_id", "full_outer")
    return joined.select("hub_id", F.coalesce("_new", side).alias(side), other).select("hub_id", "production_hash", "acceptance_hash")


def toggle_rows(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table with rows got or created, or deleted, by unique keys; ``changes`` has them and a boolean ``delete``."""
    gone = changes.filter("delete").select(*keys).distinct()
    kept = table.join(gone, keys, "left_anti").select(*table.columns)
    made = changes.filter("not delete").select(*table.columns).dropDuplicates(keys).join(kept.select(*keys), keys, "left_anti").select(*table.columns)
    return kept.unionByName(made)


def delete_spec(docs: DataFrame, specs: list[str]) -> DataFrame:
    return docs.filter(~F.col("spec").isin(specs) | F.col("spec").isNull())


def remove_orphans(docs: DataFrame, purges: DataFrame, enabled: bool = True) -> DataFrame:
    """Documents without those of a purged spec last modified at or before its purge; ``purges`` is (spec, purged_at).

    The latest purge of a spec counts; documents modified after it stay, so a late purge does no harm.
    """
    if not enabled:
        return docs
    last = purges.groupBy(F.col("spec").alias("_spec")).agg(F.max("purged_at").alias("_at"))
    return docs.join(last, (F.col("spec") == F.col("_spec")) & (F.col("modified_at") <= F.col("_at")), "left_anti")


def count_orphans(docs: DataFrame, purges: DataFrame, enabled: bool = True) -> DataFrame:
    """(spec, removed): how many documents ``remove_orphans`` removes for each purged spec; 0 for all if not enabled."""
    last = purges.groupBy("spec").agg(F.max("purged_at").alias("_at"))
    if not enabled:
        return last.select("spec", F.lit(0).cast("long").alias("removed"))
    held = docs.select(F.col("spec").alias("_spec"), "modified_at")
    # purges are few, so documents are counted before anything is shuffled
    gone = held.join(last, (F.col("_spec") == F.col("spec")) & (F.col("modified_at") <= F.col("_at"))).groupBy("spec").agg(F.count(F.lit(1)).alias("_n"))
    return last.join(gone, "spec", "left").select("spec", F.coalesce("_n", F.lit(0)).alias("removed"))


def bulk_stats(routed: DataFrame, changed: DataFrame) -> DataFrame:
    """(spec, received, errors, indexed, stored, hash_matches) of a batch."""
    received = routed.groupBy("spec").agg(F.count(F.lit(1)).alias("received"), F.count_if(F.col("route") == "error").alias("errors"), F.count_if(F.col("route") == "index").alias("indexed"))
    stored = changed.groupBy(F.col("spec").alias("_s")).agg(F.count(F.lit(1)).alias("stored"))
    joined = received.join(stored, F.col("spec").eqNullSafe(F.col("_s")), "left").drop("_s")
    return joined.withColumn("stored", F.coalesce("stored", F.lit(0))).withColumn("hash_matches", F.col("indexed") - F.col("stored"))


def index_stats(items: DataFrame) -> DataFrame:
    """(total, indexed, deleted, invalid) of index items with booleans ``delete`` and ``valid``."""
    return items.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.expr("valid and not delete")).alias("indexed"), F.count_if(F.expr("valid and delete")).alias("deleted"), F.count_if(F.expr("not valid")).alias("invalid"))


def spec_counts(docs: DataFrame, most: int = 500) -> DataFrame:
    """(spec, n): the largest specs, most first."""
    return docs.groupBy("spec").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "spec").limit(most)


def data_counts(docs: DataFrame, datasets: DataFrame) -> DataFrame:
    """(datasets, objects): totals."""
    return datasets.agg(F.count(F.lit(1)).alias("datasets")).crossJoin(docs.agg(F.count(F.lit(1)).alias("objects")))


def dataset_statistics(datasets: DataFrame, docs: DataFrame) -> DataFrame:
    """(spec, valid, deleted, indexed): declared valid records against indexed ones."""
    indexed = docs.groupBy("spec").agg(F.count(F.lit(1)).alias("indexed"))
    return datasets.join(indexed, "spec", "left").select("spec", "valid", "deleted", F.coalesce("indexed", F.lit(0)).alias("indexed"))


def dataset_audit(stats: DataFrame) -> DataFrame:
    """(bucket, n): deleted, not indexed, wrong count, correct."""
    bucket = F.when(F.col("deleted"), "deleted").when(F.col("indexed") == 0, "not indexed").when(F.col("indexed") != F.col("valid"), "wrong count").otherwise("correct")
    return stats.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def datasets_from_quads(quads: DataFrame, qsync: str) -> DataFrame:
    """(uri, spec, owner, total, valid, invalid): dataset rows from graphs of datasets; counts are 0 and the owner is the spec by default."""
    from ..functions.namespaces import TYPE

    typed = quads.filter((F.col("p") == TYPE) & (F.col("o") == qsync + "Dataset")).select("s").distinct()
    pick = lambda name: F.min(F.when(F.col("p") == qsync + name, F.col("o")))
    rows = quads.join(typed, "s", "left_semi").groupBy(F.col("s").alias("uri")).agg(pick("datasetSpec").alias("spec"), pick("datasetOwner").alias("_owner"), *[F.coalesce(pick(n).try_cast("long"), F.lit(0)).alias(k) for k, n in (("total", "datasetRecordCount"), ("valid", "processedValid"), ("invalid", "processedInvalid"))])
    return rows.select("uri", "spec", F.coalesce("_owner", "spec").alias("owner"), "total", "valid", "invalid")
