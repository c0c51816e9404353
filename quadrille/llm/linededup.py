"""Line deduplication that can be undone: reference counts and cuckoo filters, sharded by key.

A line's key is the line without white space at both ends, A-Z lower-cased. The exact table holds
for each key (two 64-bit hashes) the number of documents that have it; adding or deleting
documents adds to or takes from it. Keys that reach the threshold are inserted into cuckoo
filters, one for each shard of keys, and deleted from them when deletions take them below it. The
filters are small enough to go to every task, where they screen out nearly all lines; what
passes is confirmed against the exact table, so false positives of the filters cost time only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import SPACES, checkpoint_folder, cut, lower_ascii, mix, small

SLOTS = 4
#: Most bytes of filters that are sent to every task at once; with more, lines are first written apart by group of shards.
FILTER_BYTES = 64 << 20
KEYS_PER_SHARD = 20_000


def line_keys(text):
    """Column: the keys of a text's lines, in order; null is one empty line."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: lower_ascii(F.btrim(x, F.lit(SPACES))))


def hashed(keys):
    """Column: struct (h1, h2) of each key; the second hash starts from another seed."""
    return F.transform(keys, lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2")))


def keys_of(docs: DataFrame, least_chars: int = 1) -> DataFrame:
    """(doc_id, h1, h2): the different keys of each row, those of ``least_chars`` code points on."""
    long_enough = F.filter(line_keys(F.col("text")), lambda k: F.char_length(k) >= least_chars)
    return docs.select("doc_id", F.explode(F.array_distinct(hashed(long_enough))).alias("k")).select("doc_id", "k.h1", "k.h2")


def counts(docs: DataFrame, least_chars: int = 1) -> DataFrame:
    """The exact table: (h1, h2, docs). Counted in each task first, so a line of all documents is one row a task.

    Rows of one doc_id are one document; rows without an id are one each. Only keys of ids that
    stand in several rows are shuffled to find those they share.
    """
    keys = keys_of(docs, least_chars)
    repeated = cut(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("doc_id").alias("_id")))
    if not repeated.isEmpty():
        again = F.col("doc_id") == F.col("_id")
        keys = keys.join(small(repeated), again, "left_anti").unionByName(keys.join(small(repeated), again, "left_semi").distinct())
    return keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"))


def change(table: DataFrame, added: DataFrame | None = None, deleted: DataFrame | None = None, least_chars: int = 1) -> DataFrame:
    """The exact table after documents came and went; keys that nothing holds any more leave it."""
    parts = [table]
    if added is not None:
        parts.append(counts(added, least_chars))
    if deleted is not None:
        parts.append(counts(deleted, least_chars).withColumn("docs", -F.col("docs")))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("h1", "h2").agg(F.sum("docs").alias("docs")).filter("docs > 0")


class Cuckoo:
    """A cuckoo filter: buckets of four 16-bit fingerprints, each in one of two buckets."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table.reshape(buckets, SLOTS).copy()

    def spots(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        print_ = ((h2.astype(np.uint64) & np.uint64(0xFFFF)) | np.uint64(1)).astype(np.uint16)
        first = mix(h1.astype(np.uint64)) & np.uint64(self.buckets - 1)
        return print_, first, self.other(first, print_)

    def other(self, at, print_):
        return at ^ (mix(np.asarray(print_, np.uint64)) & np.uint64(self.buckets - 1))

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        p, a, b = self.spots(h1, h2)
        return ((self.table[a] == p[:, None]) | (self.table[b] == p[:, None])).any(axis=1)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """False if the table is too full; the caller then doubles it."""
        rng = np.random.default_rng(5)
        for p, a, b in zip(*self.spots(h1, h2), strict=True):
            at = a if not self.table[a].all() else b
            for _ in range(500):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = p
                    break
                k = rng.integers(SLOTS)
                p, self.table[at, k] = self.table[at, k], p
                at = self.other(np.asarray([at], np.uint64), [p])[0]
            else:
                return False
        return True

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Only keys that were inserted may be deleted."""
        for p, a, b in zip(*self.spots(h1, h2), strict=True):
            for at in (a, b):
                there = np.flatnonzero(self.table[at] == p)
                if len(there):
                    self.table[at, there[0]] = 0
                    break


def filled(h1: np.ndarray, h2: np.ndarray) -> Cuckoo:
    buckets = 1 << max(2, int(np.ceil(np.log2(max(1, len(h1)) / (SLOTS * 0.85)))))
    while not (made := Cuckoo(buckets)).insert(h1, h2):
        buckets *= 2
    return made


def build_filters(hot: DataFrame, shards: int) -> DataFrame:
    """(shard, buckets, bits): one filter for each shard of the keys in (h1, h2)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = filled(pdf.h1.to_numpy(), pdf.h2.to_numpy())
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "buckets": [f.buckets], "bits": [f.table.tobytes()]})

    return hot.select("h1", "h2", shard_of(shards).alias("shard")).groupBy("shard").applyInPandas(build, "shard int, buckets int, bits binary")


def change_filters(filters: DataFrame, inserted: DataFrame, removed: DataFrame, shards: int, hot: DataFrame | None = None) -> DataFrame:
    """The filters after keys came (``inserted``) and went (``removed``).

    A filter that gets too full is built anew from ``hot``, the exact table's keys after the
    change; without it, one with too little room raises.
    """
    marked = inserted.select("h1", "h2", F.lit(1).alias("way")).unionByName(removed.select("h1", "h2", F.lit(-1).alias("way"))).withColumn("shard", shard_of(shards))
    rebuilt = hot is not None

    def apply(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        come, go = new[new.way > 0], new[new.way < 0]
        if old.empty:
            f = filled(come.h1.to_numpy(), come.h2.to_numpy())
        else:
            f = Cuckoo(int(old.buckets.iloc[0]), np.frombuffer(old.bits.iloc[0], np.uint16))
            f.delete(go.h1.to_numpy(), go.h2.to_numpy())
            if not f.insert(come.h1.to_numpy(), come.h2.to_numpy()):
                if not rebuilt:
                    raise ValueError("a cuckoo filter is full: give the exact table's keys to build it anew")
                return pd.DataFrame({"shard": [int(key[0])], "buckets": [0], "bits": [b""]})
        return pd.DataFrame({"shard": [int(key[0])], "buckets": [f.buckets], "bits": [f.table.tobytes()]})

    changed = filters.groupBy("shard").cogroup(marked.groupBy("shard")).applyInPandas(apply, "shard int, buckets int, bits binary")
    if not rebuilt:
        return changed
    changed = cut(changed)
    full = changed.filter("buckets = 0").select("shard")
    if full.isEmpty():
        return changed
    again = hot.select("h1", "h2").join(F.broadcast(full.withColumnRenamed("shard", "_shard")), shard_of(shards) == F.col("_shard"), "left_semi")
    return changed.filter("buckets > 0").unionByName(build_filters(again, shards))


def shard_of(shards: int):
    return F.pmod(F.col("h1"), F.lit(shards)).cast("int")


def screen(keys: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The rows of ``keys`` (with h1, h2) that the filters may hold.

    Filters of ``FILTER_BYTES`` at most go to every task at once. Of more, shards form groups of
    about that size; the rows are written apart by group, unshuffled, and each group meets its filters.
    """
    size = filters.agg(F.sum(F.length("bits"))).first()[0] or 0
    groups = max(1, min(shards, -(-size // FILTER_BYTES)))
    if groups == 1:
        return passing(keys, filters, shards)
    path = f"{checkpoint_folder(keys.sparkSession)}/lines-{uuid.uuid4().hex}"
    of_group = lambda c: F.pmod(c, F.lit(groups)).cast("int")
    keys.withColumn("_group", of_group(shard_of(shards))).write.partitionBy("_group").parquet(path)
    written = keys.sparkSession.read.schema(StructType([*keys.schema.fields, StructField("_group", IntegerType())])).parquet(path)
    parts = [passing(written.filter(F.col("_group") == g).select(*keys.columns), filters.filter(of_group(F.col("shard")) == g), shards) for g in range(groups)]
    return reduce(DataFrame.unionByName, parts)


def passing(keys: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    sent = keys.sparkSession.sparkContext.broadcast({r["shard"]: (r["buckets"], r["bits"]) for r in filters.collect()})  # about FILTER_BYTES at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {s: Cuckoo(n, np.frombuffer(b, np.uint16)) for s, (n, b) in sent.value.items()}
        for pdf in batches:
            h1, h2 = pdf.h1.to_numpy(), pdf.h2.to_numpy()
            of, maybe = np.mod(h1, shards), np.zeros(len(pdf), bool)
            for s in np.unique(of):
                if s in held:
                    at = np.flatnonzero(of == s)
                    maybe[at] = held[s].has(h1[at], h2[at])
            yield pdf[maybe]

    return keys.mapInPandas(run, keys.schema)


def drop_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, table: DataFrame | None = None) -> DataFrame:
    """All columns of ``docs`` with kept_text, n_lines and n_dropped, which win over clashing ones.

    A key held by ``least_docs`` documents or more loses all its lines in every document; other
    lines stay, joined by a line feed. Rows of one doc_id are one document, rows without an id one
    each. Null and empty texts are one empty line. Lines of white space have an empty key, which
    stays as long as ``least_chars`` is 1 or more. ``table`` is the exact table to go by, of these
    documents by default. An empty table gives an empty result. The work on a text is linear in it.
    """
    named = docs.select("doc_id", "text")
    table = counts(named, least_chars) if table is None else table
    hot = cut(table.filter(F.col("docs") >= least_docs).select("h1", "h2"))
    shards = max(1, -(-hot.count() // KEYS_PER_SHARD))
    filters = cut(build_filters(hot, shards))
    keys = F.transform(line_keys(F.col("text")), lambda k: F.when(F.char_length(k) >= least_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"))))
    lines = named.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(keys).alias("at", "k")).filter("k is not null").select("doc_id", "text_hash", "at", "k.h1", "k.h2")
    found = screen(lines, filters, shards).join(hot, ["h1", "h2"])
    of_row = found.groupBy(F.col("doc_id").alias("_of"), F.col("text_hash").alias("_hash")).agg(F.collect_set("at").alias("_gone"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    joined = rows.join(of_row, F.col("_id").eqNullSafe(F.col("_of")) & (F.xxhash64("_text") == F.col("_hash")), "left")
    split = F.split(F.coalesce("_text", F.lit("")), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_gone", F.array().cast("array<int>")))
    made = joined.withColumn("_lines", split).withColumn("_left", left)
    own = {"kept_text": F.array_join(F.transform("_left", lambda i: F.get("_lines", i)), "\n"), "n_lines": F.size("_lines").cast("long"), "n_dropped": (F.size("_lines") - F.size("_left")).cast("long")}
    return made.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in own], *[v.alias(k) for k, v in own.items()])
