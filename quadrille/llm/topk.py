"""Exact top-k inner products by a pivot-distance index.

With M the largest length of a vector, (x, sqrt(M^2 - |x|^2)) and (q, 0) are at the squared distance
|q|^2 + M^2 - 2 q.x, so the largest inner products are the nearest neighbours. Every vector is
filed under its nearest pivot by its distance from it, and each pivot's distances are cut into
annuli, those of many vectors into parts of bounded size besides. A query first searches a part of
the annulus nearest to it, which bounds its k-th best; by the triangle inequality it then needs only
annuli within that bound of its own distance from the pivot. It is sent to those, in blocks of
bounded size; each part walks its sorted distances outwards from the queries' and leaves a query
out of every slice that the bound, as it stands then, excludes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small

#: Pivots, and the bounded sample they are chosen from.
PIVOTS, SAMPLE = 32, 2048
#: Vectors of a part and queries of a block, on average; vectors of a slice; and annuli of a pivot before those of few vectors are joined.
PART, BLOCK, SLICE, ANNULI = 2048, 2048, 256, 256


def quantised(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(256 * x) of every component, one row for each id, all of one width.

    Left out are vectors null, empty or with null or non-finite components, those whose width is
    not the commonest (of equally common ones the largest), and those with a component so large
    that inner products would not fit a long. Of different vectors of one id the least stays.
    """
    infinite = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    whole = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("_x")).filter("vec_id is not null and _x is not null")
    whole = whole.filter(~F.exists("_x", infinite))
    common = whole.groupBy(F.size("_x").alias("_width")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), F.desc("_width")).first()
    width = common["_width"] if common else 0
    most = float(int((2.0**63 / max(width, 1)) ** 0.5) - 1)
    scaled = F.transform("_x", lambda c: F.floor(F.lit(256.0) * c.cast("double")).try_cast("long"))
    fit = whole.filter((F.size("_x") == width) & (F.size("_x") > 0) & ~F.exists("_x", lambda c: F.abs(c.cast("double")) * 256.0 > most))
    vectors = fit.select("vec_id", scaled.alias("v"))
    repeated = cut(vectors.groupBy("vec_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("vec_id"))
    if repeated.isEmpty():
        return vectors
    again = vectors.join(small(repeated), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    return vectors.join(small(repeated), "vec_id", "left_anti").unionByName(again)


def matrix(column: pd.Series, kind: type = np.float64) -> np.ndarray:
    return np.stack([np.asarray(x, kind) for x in column]) if len(column) else np.zeros((0, 0), kind)


def pivots_of(vectors: DataFrame, most_square: float, pivots: int, sample: int) -> np.ndarray:
    """Farthest-first choice among the vectors of the least hash, lifted by the extra component."""
    ids = vectors.select(F.col("vec_id").alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = vectors.join(F.broadcast(ids), F.col("vec_id") == F.col("_id")).select("vec_id", "v").toPandas().sort_values("vec_id")
    x = lifted(matrix(rows["v"]), most_square)
    chosen = [0]
    near = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def lifted(x: np.ndarray, most_square: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(most_square - (x * x).sum(1), 0))[:, None]], axis=1)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def reaches(square: np.ndarray, most: float, kth: np.ndarray) -> np.ndarray:
    """How far from its own distance a query must look, with what rounding may hide; everywhere without a k-th best."""
    far = square + most
    return np.where(np.isnan(kth) | (kth == -np.inf), np.inf, np.sqrt(np.maximum(far - 2 * kth, 0)) + 1e-6 * np.sqrt(far) + 1e-6)


def filed(vectors: DataFrame, pivots: np.ndarray, most_square: float) -> DataFrame:
    """(vec_id, v, pivot, distance): the index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = distances(lifted(matrix(pdf["v"]), most_square), pivots)
                pdf["pivot"] = d.argmin(1).astype(np.int32)
                pdf["distance"] = d.min(1)
                yield pdf

    return vectors.mapInPandas(run, "vec_id long, v array<long>, pivot int, distance double")


def annuli_of(index: DataFrame, part: int) -> pd.DataFrame:
    """One row for each annulus: pivot, lo to hi of its cuts, parts, inner and outer distance. ``ANNULI`` rows a pivot at most."""
    cells = index.groupBy("pivot").agg(F.min("distance").alias("_inner"), F.max("distance").alias("_outer"))
    placed = index.select("pivot", "distance").join(F.broadcast(cells), "pivot").select("pivot", "distance", place().alias("cut"))
    counted = placed.groupBy("pivot", "cut").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("inner"), F.max("distance").alias("outer")).toPandas().sort_values(["pivot", "cut"])
    out = []
    for pivot, cell in counted.groupby("pivot"):
        held = None
        for c, n, inner, outer in zip(cell["cut"], cell["n"], cell["inner"], cell["outer"], strict=True):
            if held and held[3] + n <= part:
                held = [pivot, held[1], c, held[3] + n, held[4], outer]
            else:
                out += [held] if held else []
                held = [pivot, c, c, n, inner, outer]
        out.append(held)
    made = pd.DataFrame(out, columns=["pivot", "lo", "hi", "n", "inner", "outer"])
    made["parts"] = -(-made["n"] // part)
    return made


def place():
    """Column: the place of a distance among a pivot's cuts."""
    width = F.col("_outer") - F.col("_inner")
    return F.when(width > 0, F.least(F.floor((F.col("distance") - F.col("_inner")) / width * ANNULI), F.lit(ANNULI - 1))).otherwise(0).cast("int")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS, sample: int = SAMPLE, part: int = PART, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of every query with all vectors but its own row's id.

    Both tables are (vec_id, v) as ``quantised`` gives them: ids that differ, integers, one width.
    Ties go to the smaller vec_id; with fewer than k candidates all are returned. Empty tables
    give an empty result. Copies of a vector lie in one annulus, spread over its parts.
    """
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score long"
    vectors = cut(vectors)
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    n, most = vectors.agg(F.count(F.lit(1)), F.max(norm)).first()
    if not n:
        return spark.createDataFrame([], out)
    centres = pivots_of(vectors, most, pivots, sample)
    index = cut(filed(vectors, centres, most))
    annuli = annuli_of(index, part)
    inner, outer, of_pivot, parts = (annuli[c].to_numpy() for c in ("inner", "outer", "pivot", "parts"))
    cells = annuli.groupby("pivot").agg(_inner=("inner", "min"), _outer=("outer", "max")).reset_index()
    named = [(int(p), float(a), float(b)) for p, a, b in cells.itertuples(index=False)]
    cuts = [(int(r.pivot), c, i, int(r.parts)) for i, r in enumerate(annuli.itertuples(index=False)) for c in range(r.lo, r.hi + 1)]
    placed = index.join(F.broadcast(spark.createDataFrame(named, "pivot int, _inner double, _outer double")), "pivot").withColumn("cut", place())
    placed = placed.join(F.broadcast(spark.createDataFrame(cuts, "pivot int, cut int, annulus int, _parts int")), ["pivot", "cut"])
    placed = placed.select("vec_id", "v", "pivot", "distance", "annulus", F.pmod(F.xxhash64("vec_id"), F.col("_parts")).cast("int").alias("part"))
    blocks = max(1, -(-queries.count() // block))
    spread = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def sent(only_nearest: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                q = matrix(pdf["v"])
                own = distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), centres)[:, of_pivot]
                gap = np.maximum(np.maximum(own - outer, inner - own), 0)
                if only_nearest:
                    near = gap.argmin(1)
                    yield pdf.assign(annulus=near.astype(np.int32), part=(pdf["vec_id"].to_numpy() % parts[near]).astype(np.int32))
                    continue
                need = gap <= reaches((q * q).sum(1), most, pdf["kth"].to_numpy(np.float64))[:, None]
                for a in np.flatnonzero(need.any(0)):
                    rows = pdf[need[:, a]]
                    for p in range(parts[a]):
                        yield rows.assign(annulus=np.int32(a), part=np.int32(p))

        return run

    schema = "vec_id long, v array<long>, kth double, block int, annulus int, part int"
    asked = queries.select("vec_id", "v", F.lit(None).cast("double").alias("kth"), F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(blocks)).cast("int").alias("block"))
    begun = cut(within(spread, asked.mapInPandas(sent(True), schema), k, centres, most))
    kth = begun.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_kth")).select(F.col("query_id").alias("_q"), F.when(F.col("_n") >= k, F.col("_kth")).cast("double").alias("_bound"))
    bounded = asked.join(small(kth), F.col("vec_id") == F.col("_q"), "left").withColumn("kth", F.col("_bound")).select("vec_id", "v", "kth", "block")
    found = within(spread, bounded.mapInPandas(sent(False), schema), k, centres, most)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def walked(x: np.ndarray, ids: np.ndarray, far: np.ndarray, q: np.ndarray, own_ids: np.ndarray, own: np.ndarray, square: np.ndarray, kth: np.ndarray, k: int, most: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids) of shape (queries, k), -1 where there is none, and how many inner products were taken.

    x are the vectors of a part by ascending distance ``far`` from its pivot, q the queries, ``own``
    their distances from it.
    """
    # integers are exact in a double up to 2**53
    exact = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1] < 2.0**53
    kind = np.float64 if exact else np.int64
    x, q = x.astype(kind), q.astype(kind)
    lowest = np.iinfo(np.int64).min
    scores, got = np.full((len(q), k), lowest, np.int64), np.full((len(q), k), -1, np.int64)
    bound, taken = np.where(np.isnan(kth), -np.inf, kth), 0
    starts = np.arange(0, len(far), SLICE)
    middle = np.median(own)
    nearest = np.maximum(np.maximum(far[starts] - middle, middle - far[np.minimum(starts + SLICE, len(far)) - 1]), 0)
    for s in starts[np.argsort(nearest, kind="stable")]:
        e = min(s + SLICE, len(far))
        gap = np.maximum(np.maximum(far[s] - own, own - far[e - 1]), 0)
        need = np.flatnonzero(gap <= reaches(square, most, bound))
        if not len(need):
            continue
        taken += len(need) * (e - s)
        new = (q[need] @ x[s:e].T).astype(np.int64)
        new[own_ids[need][:, None] == ids[s:e][None]] = lowest
        better = new.max(1) >= scores[need, -1]
        rows = need[better]
        both = np.concatenate([scores[rows], new[better]], axis=1)
        names = np.concatenate([got[rows], np.where(new[better] == lowest, -1, np.broadcast_to(ids[s:e], new[better].shape))], axis=1)
        names = np.where(both == lowest, -1, names)
        order = np.lexsort((names, -both.astype(np.float64) if exact else ~both), axis=1)[:, :k]
        scores[rows], got[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        full = got[rows, -1] != -1
        bound[rows[full]] = np.maximum(bound[rows[full]], scores[rows[full], -1].astype(np.float64))
    return scores, got, taken


def within(index: DataFrame, asked: DataFrame, k: int, centres: np.ndarray, most: float) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query within the parts it is sent to."""

    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        by = np.lexsort((vectors["vec_id"], vectors["distance"]))
        x, ids, far = matrix(vectors["v"], np.int64)[by], vectors["vec_id"].to_numpy()[by], vectors["distance"].to_numpy()[by]
        q, own_ids = matrix(queries["v"], np.int64), queries["vec_id"].to_numpy()
        centre = centres[int(vectors["pivot"].iloc[0])]
        lengths = q.astype(np.float64)
        own = np.sqrt(((lengths - centre[:-1]) ** 2).sum(1) + centre[-1] ** 2)
        scores, got, _ = walked(x, ids, far, q, own_ids, own, (lengths * lengths).sum(1), queries["kth"].to_numpy(np.float64), k, most)
        held = scores != np.iinfo(np.int64).min
        return pd.DataFrame({"query_id": np.repeat(own_ids, held.sum(1)), "vec_id": got[held], "score": scores[held]})

    keys = ["annulus", "part", "block"]
    return index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long")
