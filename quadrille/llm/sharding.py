"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows fall into virtual partitions by hash. How many rows each partition sends to each shard is
drawn exactly (multivariate hypergeometric, row by row of the matrix, on counts alone), so that
shard sizes are at most one row apart and every assignment of rows is equally likely. Rows are
permuted inside their partition, dealt out by the matrix, exchanged, and permuted again inside
their shard. Partitions are decided by the rows' values, not by Spark's tasks: a task that is
repeated after a lost executor finds the same rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import running, spread31

#: The matrix is drawn on the driver; it has at most so many rows, whatever the input's size (20,000 rows each up to 5 * 10**9 rows).
MOST_PARTITIONS = 1 << 18
#: Populations up to it are drawn from by numpy, whose own bound this is.
NUMPY_MOST = 1_000_000_000


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows by partition and shard: row sums are ``counts``, column sums differ by one at most."""
    rng, total = np.random.default_rng(seed), sum(counts)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    matrix = np.zeros((len(counts), shards), np.int64)
    for p, n in enumerate(counts):
        rest, need = int(left.sum()), int(n)
        for s in range(shards):  # one marginal after the other
            rest -= int(left[s])
            k = int(left[s]) if not rest and need >= left[s] else draw(rng, int(left[s]), rest, need)
            matrix[p, s], need = k, need - k
        left -= matrix[p]
    return matrix


def draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn without replacement are good.

    Beyond numpy's range by inversion: probabilities follow from their ratios, from the mode out to
    where all that is left is less than 1e-30.
    """
    if not n or not good:
        return 0
    if not bad:
        return n
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    spread = (n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1))) ** 0.5
    reach = int(12 * spread) + 40
    k = np.arange(max(0, n - bad, mode - reach), min(n, good, mode + reach) + 1, dtype=np.float64)
    steps = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[1:]) - np.log(bad - n + k[1:])
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    chances = np.cumsum(np.exp(logs - logs.max()))
    return int(k[np.searchsorted(chances, rng.random() * chances[-1], "right")])


def shard(docs: DataFrame, shards: int = 8, seed: int = 23, carry: list[str] | None = None) -> DataFrame:
    """Every row with (size, text_crc32, shard, slot); slots of a shard are gapless from 0.

    ``size`` is the text's bytes plus 1 (null: 1), ``text_crc32`` that of its bytes (null: null).
    ``carry`` names the columns that come along, all by default; own names win over clashing ones.
    Equal rows are separate and may land apart; which of them has which slot does not matter.
    An empty table gives an empty result.
    """
    carry = docs.columns if carry is None else carry
    made = {"size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1, "text_crc32": F.crc32(F.encode("text", "UTF-8")).cast("long")}
    kept = [c for c in carry if c.lower() not in ("size", "text_crc32", "shard", "slot")]
    rows = docs.select(F.struct(*kept, *[v.alias(k) for k, v in made.items()]).alias("_row"), F.xxhash64("doc_id", "text").alias("_key"))
    n = docs.count()
    parts = max(64, min(MOST_PARTITIONS, n // 20_000))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(F.lit(seed), "_key"), F.lit(parts)).cast("int"))
    keyed = docs.select(F.pmod(F.xxhash64(F.lit(seed), F.xxhash64("doc_id", "text")), F.lit(parts)).cast("int").alias("_part"))
    counted = dict(keyed.groupBy("_part").count().collect())  # at most MOST_PARTITIONS rows
    matrix = communication_matrix([counted.get(p, 0) for p in range(parts)], shards, seed)
    bounds = docs.sparkSession.createDataFrame([(p, [int(x) for x in np.cumsum(row)]) for p, row in enumerate(matrix)], "_part int, _bounds array<long>")
    local = Window.partitionBy("_part").orderBy(F.xxhash64(F.lit(seed + 1), "_key"), "_key")
    dealt = (
        rows.withColumn("_at", F.row_number().over(local) - 1)
        .join(F.broadcast(bounds), "_part")
        .withColumn("shard", F.size(F.filter("_bounds", lambda b: b <= F.col("_at"))))
        .drop("_at", "_bounds", "_part")
    )
    ranges = max(1, -(-n // shards // 20_000))
    return running(dealt, ["shard"], F.lit(ranges), spread31(seed + 2, F.col("_key")), [F.col("_key")], F.lit(1), "slot").select(*[F.col("_row")[c].alias(c) for c in [*kept, *made]], "shard", F.col("slot").cast("long").alias("slot"))
