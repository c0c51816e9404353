"""Streams: bulk actions and index requests applied to a snapshot, query logs.

State is the snapshot table, kept as a base and the changes of the batches since: a batch writes
the rows it adds, replaces or deletes alone, and every ``COMPACT`` batches a new base is written
and what it replaces goes. A base lies in buckets of hub ids, sorted by spec, so that a batch reads
the buckets of its records and, of the others, the parts with specs that it drops or purges. A batch is compared with the state before it by hub id and hash and
writes under its own number, so a batch that is repeated after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sync import latest_actions, route_actions
from ..operators.tables import cut
from ..schemas import BULK_ACTION
from ..sources.writers import query_log

SNAPSHOT = "hub_id string, spec string, content_hash string, graph string, modified_at timestamp"
#: Batches of changes before they are joined into a new base.
COMPACT = 16
#: Buckets of a new base, and specs of a batch that are looked for by name; with more of them all buckets are read.
BUCKETS, SPECS = 256, 1000
#: Where a line stands: files in order of their time and name, lines in order.
_PLACE = ["_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start"]


def bucket_of(n: int) -> Column:
    return F.pmod(F.xxhash64("hub_id"), F.lit(n)).cast("int")


class Snapshot:
    """A table under one path: bases b-<batch> and changes c-<batch>; those without _SUCCESS do not count."""

    def __init__(self, spark: SparkSession, path: str, compact: int = COMPACT, buckets: int = BUCKETS):
        self.spark, self.path, self.compact, self.buckets = spark, path, compact, buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._folder = self._path(path)
        self._fs = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _known(self, kind: str) -> list[int]:
        if not self._fs.exists(self._folder):
            return []
        names = [s.getPath() for s in self._fs.listStatus(self._folder)]
        return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith(f"{kind}-") and self._fs.exists(self._path(p, "_SUCCESS")))

    def _parts(self, before: int | None) -> tuple[int | None, list[int]]:
        bases = [v for v in self._known("b") if before is None or v < before]
        base = bases[-1] if bases else None
        return base, [v for v in self._known("c") if (base is None or v > base) and (before is None or v < before)]

    def _buckets_of(self, base: int) -> int | None:
        """How many buckets a base has, which its folder tells; a base without rows has none."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/b-{base}"))]
        return next((int(n.split("=")[1]) for n in names if n.startswith("buckets=")), None)

    def read(self, before: int | None = None) -> DataFrame:
        """The table after all batches, or after those before one."""
        return self._merged(before, lambda rows, _: rows)

    def read_for(self, hub_ids: DataFrame, specs: DataFrame, before: int | None = None) -> DataFrame:
        """As ``read``, with all rows of the hub ids (hub_id) and the specs (spec) and maybe others.

        Only the buckets of the ids are read whole; of the others, where there are specs, row groups
        whose bounds hold one. The numbers of the buckets and at most ``SPECS`` names come to the driver.
        """
        named = [r.spec for r in specs.filter("spec is not null").select("spec").distinct().limit(SPECS + 1).collect()]

        def few(rows: DataFrame, n: int | None) -> DataFrame:
            if n is None or len(named) > SPECS:
                return rows
            touched = [r[0] for r in hub_ids.filter("hub_id is not null").select(bucket_of(n)).distinct().collect()]  # at most n numbers
            own = rows.filter(F.col("bucket").isin(touched))
            return own if not named else own.unionByName(rows.filter(~F.col("bucket").isin(touched) & F.col("spec").isin(named)))

        return self._merged(before, few)

    def _merged(self, before: int | None, choose) -> DataFrame:
        base, changes = self._parts(before)
        columns = [c.split(" ")[0] for c in SNAPSHOT.split(", ")]
        load = lambda name, more="": self.spark.read.schema(f"{SNAPSHOT}, deleted boolean{more}").parquet(f"{self.path}/{name}")
        rows = [choose(load(f"b-{base}", ", buckets int, bucket int"), self._buckets_of(base)).select(*columns, "deleted", F.lit(base).cast("long").alias("_batch"))] if base is not None else []
        rows += [load(f"c-{v}").withColumn("_batch", F.lit(v).cast("long")) for v in changes]
        if not rows:
            return self.spark.createDataFrame([], SNAPSHOT)
        every = rows[0]
        for r in rows[1:]:
            every = every.unionByName(r)
        if not changes:
            return every.select(*columns)
        last = every.groupBy("hub_id").agg(F.max_by(F.struct(*columns, "deleted"), "_batch").alias("_row"))
        return last.filter("not _row.deleted").select("_row.*").select(*columns)

    def write(self, changes: DataFrame, batch: int) -> None:
        """Changes of one batch: rows with ``deleted``, one for each hub id."""
        changes.write.mode("overwrite").parquet(f"{self.path}/c-{batch}")
        base, since = self._parts(None)
        if len(since) < self.compact:
            return
        dealt = self.read().select("*", F.lit(False).alias("deleted"), F.lit(self.buckets).alias("buckets"), bucket_of(self.buckets).alias("bucket"))
        dealt.hint("rebalance", "bucket").sortWithinPartitions("bucket", "spec", "hub_id").write.mode("overwrite").partitionBy("buckets", "bucket").parquet(f"{self.path}/b-{batch}")
        # the batch may be repeated: what it starts from stays
        for kind, known in (("c", [v for v in self._known("c") if base is not None and v <= base]), ("b", [v for v in self._known("b") if base is not None and v < base])):
            for v in known:
                self._fs.delete(self._path(f"{self.path}/{kind}-{v}"), True)


#: Actions on whole datasets.
OF_SPEC = ("clear_orphans", "disable_index", "drop_dataset")


def routed_of(batch: DataFrame) -> DataFrame:
    """Bulk actions with their route."""
    seq = F.col("seq") if "seq" in batch.columns else F.monotonically_increasing_id()
    return route_actions(batch.select(F.col("hubId").alias("hub_id"), F.col("dataset").alias("spec"), "action", F.col("graphUri").alias("graph"), F.col("contentHash").alias("content_hash"), F.col("acceptanceMode").alias("acceptance"), F.to_timestamp("modification_date").alias("modified_at"), seq.alias("seq")))


def bulk_changes(snapshot: DataFrame, batch: DataFrame, orphans: bool = True) -> DataFrame:
    """What a batch of bulk actions changes: rows of the snapshot with ``deleted``, one for each hub id.

    Datasets are dropped and purged first, whatever the order in the batch; then the last index
    action of a record counts, if what is left does not have its hash. So a batch that drops a
    dataset and indexes it again leaves the new records. A purge takes only documents last modified
    at or before it, so a late one leaves newer documents. ``seq`` orders the actions; a batch
    without it has them in order of its rows.
    """
    routed = cut(routed_of(batch))
    purged_at = F.max(F.when((F.col("route") == "clear_orphans") & F.lit(orphans), F.col("modified_at")))
    of_spec = routed.filter(f"route in {OF_SPEC}").groupBy("spec").agg(F.bool_or(F.col("route") != "clear_orphans").alias("_dropped"), purged_at.alias("_purged_at"))
    gone = F.coalesce(F.col("_dropped") | (F.col("modified_at") <= F.col("_purged_at")), F.col("_dropped"), F.lit(False))
    row = F.struct(*snapshot.columns)
    held = snapshot.join(of_spec, "spec", "left").select(F.col("hub_id").alias("_held"), row.alias("_old"), gone.alias("_gone"))
    new = latest_actions(routed.filter("route = 'index'")).select(F.col("hub_id").alias("_key"), row.alias("_new"))
    # one join by hub id: what is put in place of nothing, of what is gone or of another hash, and what is gone without it
    both = held.join(new, F.col("_held") == F.col("_key"), "full_outer")
    put = F.col("_new").isNotNull() & (F.col("_old").isNull() | F.col("_gone") | ~F.col("_old.content_hash").eqNullSafe(F.col("_new.content_hash")))
    deleted = F.col("_new").isNull() & F.col("_gone")
    return both.filter(put | deleted).select(F.when(put, F.col("_new")).otherwise(F.col("_old")).alias("_row"), deleted.alias("deleted")).select("_row.*", "deleted")


def applied(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """The snapshot after changes."""
    kept = snapshot.join(changes.select("hub_id"), "hub_id", "left_anti").select(*snapshot.columns)
    return kept.unionByName(changes.filter("not deleted").select(*snapshot.columns))


def apply_bulk_batch(snapshot: DataFrame, batch: DataFrame, orphans: bool = True) -> DataFrame:
    """The snapshot after a batch of bulk actions, as ``bulk_changes`` has it."""
    return applied(snapshot, cut(bulk_changes(snapshot, batch, orphans)))


def stream_bulk(spark: SparkSession, source: str, snapshot: str, checkpoint: str) -> StreamingQuery:
    """Bulk-action files that arrive in a folder, until what is there is done; lines that are no JSON are kept in <snapshot>/errors-<batch>."""
    store = Snapshot(spark, snapshot)

    def apply(df: DataFrame, batch: int) -> None:
        lines = df.filter("trim(value) <> ''").select("value", F.struct(*_PLACE, F.monotonically_increasing_id().alias("line")).alias("seq"))
        rows = lines.select("value", "seq", F.from_json("value", f"{BULK_ACTION}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("a"))
        rows.filter("a._bad is not null").select(F.col("value").alias("line")).write.mode("overwrite").parquet(f"{snapshot}/errors-{batch}")
        actions = cut(rows.filter("a._bad is null").select("a.*", "seq").drop("_bad"))
        of_spec = routed_of(actions).filter(f"route in {OF_SPEC}")
        store.write(bulk_changes(store.read_for(actions.select(F.col("hubId").alias("hub_id")), of_spec, before=batch), actions), batch)

    stream = spark.readStream.text(source).select("value", "_metadata")
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def item_changes(items: DataFrame, org: str) -> DataFrame:
    """Rows of a snapshot with ``deleted`` from index items with ``seq``: the last of each hub id; those without id or type are left out."""
    from ..functions.ids import index_item_hub_id

    rows = items.filter("`@itemId` is not null and `@itemType` is not null")
    rows = rows.select(index_item_hub_id(org, F.col("`@itemType`"), F.col("`@itemId`")).alias("hub_id"), F.lower("`@itemType`").alias("spec"), F.sha1(F.to_json("field")).alias("content_hash"), F.lit(None).cast("string").alias("graph"), F.lit(None).cast("timestamp").alias("modified_at"), F.coalesce(F.lower("`@delete`") == "true", F.lit(False)).alias("deleted"), "seq")
    return latest_actions(rows).drop("seq")


def stream_index_items(spark: SparkSession, source: str, snapshot: str, checkpoint: str, org: str) -> StreamingQuery:
    """Index requests, one JSON item to a line, with deletes; lines without JSON, id or type are kept in <snapshot>/errors-<batch>."""
    store = Snapshot(spark, snapshot)
    schema = "`@itemId` string, `@itemType` string, `@delete` string, field array<struct<`@name`:string,`#text`:string>>"

    def apply(df: DataFrame, batch: int) -> None:
        lines = df.filter("trim(value) <> ''").select("value", F.from_json("value", schema).alias("i"), F.struct(*_PLACE, F.monotonically_increasing_id().alias("line")).alias("seq"))
        wrong = F.col("i.`@itemId`").isNull() | F.col("i.`@itemType`").isNull()
        lines.filter(wrong).select(F.col("value").alias("line")).write.mode("overwrite").parquet(f"{snapshot}/errors-{batch}")
        store.write(item_changes(lines.select("i.*", "seq"), org), batch)

    stream = spark.readStream.text(source).select("value", "_metadata")
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_query_log(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Requests (created_at, raw_query) in JSON, appended as a log."""
    requests = spark.readStream.schema("created_at timestamp, raw_query string").json(source)
    return query_log(requests).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start()
