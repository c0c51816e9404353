"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space as the contracts define it: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows that a table may have to be sent to every executor as a broadcast of two or three longs each.
BROADCAST_ROWS = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs on this machine alone, as in tests, is a local one made.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or f"{os.environ.get('TMPDIR', '/tmp')}/checkpoint-{uuid.uuid4().hex}")
    return sc._jsc.sc().getCheckpointDir().get()


def released() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: unlike a checkpoint, nothing of the old plan comes along.

    For loops, whose plans would otherwise gather constraints round by round on the driver.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    """Number of words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark for broadcast if it has at most that many rows; beyond, Spark shuffles it like any other."""
    return F.broadcast(df) if df.count() <= rows else df


def running(df: DataFrame, keys: list[str], ranges: Column, spread: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` within ``keys``, without one task for a key.

    ``spread`` is a long from 0 to 2**31 - 1, uniform and leading in the order; ``order`` follows.
    The rows of a key are cut into ``ranges`` ranges of it (a column, say one for 20,000 rows) and
    summed; the running total of those sums is added to the running sum inside a range. The sums
    of ranges are a small table: one row for some 20,000 of the input's.
    """
    ranged = df.withColumn("_spread", spread).withColumn("_value", value).withColumn("_range", F.shiftright(F.col("_spread") * ranges, 31))
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*keys, "_range").orderBy("_spread", *order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_inner", F.coalesce(F.sum("_value").over(within), F.lit(0)))
        .join(sums, [*keys, "_range"])
        .withColumn(out, F.col("_base") + F.col("_inner"))
        .drop("_base", "_inner", "_range", "_spread", "_value")
    )


def spread31(seed: int, *cols: Column) -> Column:
    """A uniform long from 0 to 2**31 - 1, decided by the values alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 33)


# ---- hashes of words, for a whole Arrow column at a time ----

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES.encode())] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the offsets of its rows (nulls are empty)."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of rows of about ``most`` bytes; a longer row stands alone."""
    start = 0
    while start < len(offsets) - 1:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, end
        start = end


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and its row."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~_IS_SPACE[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[filled] = False
    after[filled[filled > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes: a polynomial, from prefix sums, then scrambled."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, A-Z lower-cased, and its row."""
    starts, ends, rows = words_of(data, offsets)
    return span_hashes(_LOWERED[data], starts, ends), rows


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words in a row, and its row; a shorter row is one run as a whole."""
    counts = np.bincount(rows, minlength=n_rows)
    full = len(words) - width + 1
    out, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if full > 0:
        out = mix(words[:full] + np.uint64(width))
        for k in range(1, width):
            out = mix(out * np.uint64(3) + words[k : k + full])
        same = rows[:full] == rows[width - 1 :]
        out, of = out[same], rows[:full][same]
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    for n in range(1, width):
        short = np.flatnonzero(counts == n)
        if len(short):
            h = mix(words[first[short]] + np.uint64(n))
            for k in range(1, n):
                h = mix(h * np.uint64(3) + words[first[short] + k])
            out, of = np.concatenate([out, h]), np.concatenate([of, short])
    return out, of


# ---- tables that several passes read by block ----


def in_blocks(df: DataFrame, key: str, blocks: int) -> DataFrame:
    """Write a table to the shared folder bucketed by ``key``, so that later passes by it need no exchange of these rows."""
    spark, name = df.sparkSession, f"blocks_{uuid.uuid4().hex}"
    path = f"{checkpoint_folder(spark)}/{name}"
    df.repartition(blocks, key).write.bucketBy(blocks, key).option("path", path).saveAsTable(name)
    written = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # from the catalogue alone: the files stay, and ``written`` knows them
    return written


def packed(values: np.ndarray, borders: np.ndarray) -> list[bytes]:
    """The bytes of each range of values between two borders."""
    return [values[a:b].tobytes() for a, b in zip(borders[:-1], borders[1:], strict=True)]
