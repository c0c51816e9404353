"""Hash trees of datasets, so that a synchronisation reads only the records of leaves that differ.

A record belongs to a leaf of its dataset, by the hash of its hub id. A leaf's digest is the count of
its records with the sum and the exclusive or of two 64-bit hashes of (hub id, content hash), so it
is added up in the tasks, and a dataset's digest is the sum of its leaves'. Two leaves are held to be
equal if count and both digests are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sync import classify_sync
from .tables import cut

#: Leaves of a dataset.
LEAVES = 256
#: Folders into which the records of a stored tree are dealt by leaf.
FOLDERS = 64
#: Differing leaves up to which they are broadcast (some 60 bytes each).
SENT_LEAVES = 200_000


def leaf_of(leaves: int) -> Column:
    """The leaf of a record; -1 without a hub id, as such records equal no other."""
    return F.when(F.col("hub_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("hub_id"), F.lit(leaves))).cast("int")


def leaf_digests(records: DataFrame, leaves: int = LEAVES) -> DataFrame:
    """(spec, leaf, n, total, parity) of records (spec, hub_id, content_hash)."""
    told = F.concat(F.when(F.col("content_hash").isNull(), "0").otherwise("1"), F.coalesce("content_hash", F.lit("")))
    rows = records.select("spec", leaf_of(leaves).alias("leaf"), F.xxhash64("hub_id", told).cast("decimal(20,0)").alias("_a"), F.xxhash64(F.lit(7), told, "hub_id").alias("_b"))
    return rows.groupBy("spec", "leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("_a").alias("total"), F.bit_xor("_b").alias("parity"))


def dataset_digests(digests: DataFrame) -> DataFrame:
    """(spec, n, total, parity): the root of each dataset's tree."""
    return digests.groupBy("spec").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.bit_xor("parity").alias("parity"))


def differing_leaves(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(spec, leaf): leaves that one side lacks or whose digests differ; of datasets with equal roots only leaves without ids."""

    def unequal(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        marked = a.unionByName(b)
        return marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_sides"), F.count_distinct(F.struct("n", "total", "parity")).alias("_kinds"))

    roots = unequal(dataset_digests(incoming), dataset_digests(stored), ["spec"]).filter("_sides = 2 and _kinds = 1").select(F.col("spec").alias("_same"))
    open_ = lambda rows: rows.join(roots, (F.col("leaf") >= 0) & F.col("spec").eqNullSafe(F.col("_same")), "left_anti")
    return unequal(open_(incoming), open_(stored), ["spec", "leaf"]).filter("_sides = 1 or _kinds > 1 or leaf < 0").select("spec", "leaf")


def write_tree(records: DataFrame, path: str, leaves: int = LEAVES, folders: int = FOLDERS) -> None:
    """Write records (spec, hub_id, content_hash) dealt to folders by leaf and sorted by dataset, then the digests of their leaves."""
    placed = records.select("spec", "hub_id", "content_hash", leaf_of(leaves).alias("leaf"))
    placed = placed.withColumn("folder", F.pmod(F.xxhash64("spec", "leaf"), F.lit(folders)).cast("int"))
    placed.repartition("folder", "leaf").sortWithinPartitions("folder", "spec", "leaf").write.partitionBy("folder").parquet(f"{path}/records")
    # from what was written, so that the records are made once
    leaf_digests(records.sparkSession.read.schema("spec string, hub_id string, content_hash string").parquet(f"{path}/records"), leaves).write.parquet(f"{path}/leaves")


def read_leaves(spark: SparkSession, path: str, changed: DataFrame, folders: int = FOLDERS) -> DataFrame:
    """The stored records of the given leaves; only folders that hold one are read."""
    held = changed.select(F.pmod(F.xxhash64("spec", "leaf"), F.lit(folders)).cast("int").alias("f")).distinct()
    wanted = [r.f for r in held.collect()]  # at most ``folders`` numbers
    schema = "spec string, hub_id string, content_hash string, leaf int, folder int"
    if not wanted:
        return spark.createDataFrame([], schema).drop("folder")
    stored = spark.read.schema(schema).parquet(f"{path}/records").filter(F.col("folder").isin(wanted)).drop("folder")
    return _in_leaves(stored, changed, "left_semi")


def _in_leaves(records: DataFrame, changed: DataFrame, how: str) -> DataFrame:
    """Records with a leaf that lie in one of the given leaves, or in none of them."""
    named = changed.select(F.col("spec").alias("_spec"), F.col("leaf").alias("_leaf"))
    if changed.count() <= SENT_LEAVES:
        named = F.broadcast(named)
    return records.join(named, F.col("spec").eqNullSafe(F.col("_spec")) & (F.col("leaf") == F.col("_leaf")), how)


def classify_by_tree(incoming: DataFrame, path: str, leaves: int = LEAVES, folders: int = FOLDERS) -> DataFrame:
    """(hub_id, status) as ``classify_sync`` gives them, of incoming records (spec, hub_id, content_hash) against a stored tree.

    Both sides have one record of a hub id. Digests of leaves are compared first: records of equal
    leaves are unchanged, and their stored side is not read. A record that went to another dataset
    differs in a leaf of both, so it is still compared by hub id. Empty sides need no care: all
    leaves differ then.
    """
    spark = incoming.sparkSession
    stored = spark.read.schema("spec string, leaf int, n long, total decimal(30,0), parity long").parquet(f"{path}/leaves")
    changed = cut(differing_leaves(leaf_digests(incoming, leaves), stored))
    placed = incoming.select("spec", "hub_id", "content_hash", leaf_of(leaves).alias("leaf"))
    same = _in_leaves(placed, changed, "left_anti").select("hub_id", F.lit("unchanged").alias("status"))
    return classify_sync(_in_leaves(placed, changed, "left_semi"), read_leaves(spark, path, changed, folders)).unionByName(same)
