"""Benchmark decontamination by template canonicalisation.

Texts become sequences of canonical words: punctuation around a word goes, letters are lowered,
and numbers, names (capitalised inside a sentence) and units become typed placeholders. Windows of
``WINDOW`` such words, and of the plain words, are hash-joined with the benchmark's. A document
that has at least ``LEAST`` of an item's windows close together and in line, with slots filled
consistently (one value of the item stands for one value of the document throughout), leaks it.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, cut, mix, released, slices, small, span_hashes, words_of

WINDOW = 5
LEAST = 0.5
#: A window of the template must keep so many words as they are; the rest may be placeholders.
LEAST_WORDS = 2
#: Bits of the filter of the benchmark's windows that goes to every task; more windows only let more pass it to the join.
FILTER_BITS = 1 << 26
UNITS = "kg g mg lb lbs oz km m cm mm mi mile miles ft feet inch inches l ml litre litres liter liters hour hours minute minutes second seconds day days week weeks month months year years percent dollar dollars euro euros cent cents mph kmh degrees".split()

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[list(b".,:/%-")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the Latin-1 capitals in UTF-8 lower-cased, byte by byte."""
    out = _LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    out[second] += 0x20
    return out


def _unit_hashes() -> np.ndarray:
    data, offsets = bytes_of(pa.array(UNITS))
    return np.sort(span_hashes(data, offsets[:-1], offsets[1:]))


def canonical(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Of every word with a letter or digit: row, start, end, hash as it is, and hash or placeholder."""
    starts, ends, rows = words_of(data, offsets)
    alnum = _ALNUM[data]
    where = np.flatnonzero(alnum)
    if not len(where) or not len(starts):
        return {k: np.zeros(0, np.int64 if k in ("row", "start", "end") else np.uint64) for k in ("row", "start", "end", "plain", "typed")}
    first = np.searchsorted(where, starts)
    last = np.searchsorted(where, ends) - 1
    full = last >= first
    whole_end, starts_line = ends[full], np.zeros(len(starts), bool)
    newlines = np.flatnonzero(data == 10)
    starts_line[0:1] = True
    starts_line[1:] = (np.searchsorted(newlines, starts[1:]) > np.searchsorted(newlines, starts[:-1])) | (rows[1:] != rows[:-1])
    row, lead = rows[full], starts_line[full]
    start, end = where[first[full]], where[last[full]] + 1
    plain = span_hashes(lowered(data), start, end)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    numeric = np.concatenate([[0], np.cumsum(_NUMERIC[data])])
    n = end - start
    number = _DIGIT[data[start]] & (2 * (digits[end] - digits[start]) >= n) & (numeric[end] - numeric[start] >= n - 3)
    two = data[np.minimum(start + 1, len(data) - 1)]
    capital = ((data[start] >= 65) & (data[start] <= 90)) | ((data[start] == 0xC3) & (two >= 0x80) & (two <= 0x9E))
    closes = np.isin(data[whole_end - 1], np.frombuffer(b".!?:;", np.uint8))
    after_stop = np.ones(len(row), bool)
    after_stop[1:] = closes[:-1] | (row[1:] != row[:-1]) | lead[1:]
    units = _unit_hashes()
    at = np.minimum(np.searchsorted(units, plain), len(units) - 1)
    typed = np.where(number, _NUMBER, np.where(units[at] == plain, _UNIT, np.where(capital & ~after_stop, _NAME, plain)))
    return {"row": row, "start": start, "end": end, "plain": plain, "typed": typed}


def windows(words: dict[str, np.ndarray], kind: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window, and the index of its first word; windows of mostly placeholders are left out.

    A row of fewer words than a window is one window as a whole.
    """
    h, row = words[kind], words["row"]
    fixed = np.concatenate([[0], np.cumsum(~np.isin(h, [_NUMBER, _NAME, _UNIT]))])
    out, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    n = len(h) - width + 1
    if n > 0:
        hashed = mix(h[:n] + np.uint64(len(kind)))
        for k in range(1, width):
            hashed = mix(hashed * np.uint64(5) + h[k : k + n])
        use = (row[:n] == row[width - 1 :]) & (fixed[width : width + n] - fixed[:n] >= LEAST_WORDS)
        out.append(hashed[use])
        of.append(np.flatnonzero(use))
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(row)))
    for n in range(LEAST_WORDS, width):
        at = first[size == n]
        at = at[fixed[at + n] - fixed[at] >= LEAST_WORDS]
        hashed = mix(h[at] + np.uint64(64 + n))
        for k in range(1, n):
            hashed = mix(hashed * np.uint64(5) + h[at + k])
        out.append(hashed)
        of.append(at)
    return np.concatenate(out), np.concatenate(of)


SCHEMA = "id long, kind string, pos int, words int, hash long, tokens string"


def window_filter(hashes: DataFrame) -> np.ndarray:
    """A bit for each value of the low bits of the hashes; of ``FILTER_BITS`` bits, whatever their number."""
    bit = F.col("hash").bitwiseAND(FILTER_BITS - 1)
    words = hashes.groupBy(F.shiftright(bit, 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("bits"))
    held = words.toArrow()  # at most FILTER_BITS / 64 rows
    out = np.zeros(FILTER_BITS >> 6, np.uint64)
    out[held.column("word").to_numpy()] = held.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return out


def window_rows(table: DataFrame, width: int, only=None) -> DataFrame:
    """(id, kind, pos, words, hash, tokens) of the windows of (id, text), of those alone that the filter ``only`` may hold.

    ``only`` is a broadcast ``window_filter``. ``words`` is the number of words of the row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = only.value if only is not None else None
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            data, offsets = bytes_of(text)
            for a, b in slices(offsets):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                words = canonical(part, off)
                first = np.searchsorted(words["row"], np.arange(b - a + 1))
                for kind in ("plain", "typed"):
                    h, at = windows(words, kind, width)
                    if bits is not None:
                        low = h & np.uint64(FILTER_BITS - 1)
                        hit = np.flatnonzero(bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1))
                        h, at = h[hit], at[hit]
                    if not len(h):
                        continue
                    row = words["row"][at]
                    last = np.minimum(at + width, first[row + 1])
                    tokens = [" ".join(bytes(part[words["start"][i] : words["end"][i]]).decode("utf-8", "replace") for i in range(a, b)) for a, b in zip(at, last, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(row + a)), pa.array([kind] * len(h)), pa.array((at - first[row]).astype(np.int32)), pa.array((first[row + 1] - first[row]).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(tokens)],
                        ["id", "kind", "pos", "words", "hash", "tokens"],
                    )
        released()

    return table.select(table.columns[0], table.columns[1]).toDF("id", "text").withColumn("id", F.col("id").cast("long")).mapInArrow(run, SCHEMA)


def judged(width: int, least: float):
    """Of the matching windows of a document and an item: whether they stand in line and fill slots consistently."""

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        best, consistent = 0.0, True
        for kind, g in pdf.groupby("kind"):
            total = int(g["possible"].iloc[0])
            by = defaultdict(set)
            for pos, idx in zip(g["pos"], g["idx"], strict=True):
                by[(pos - idx) // 8].add(idx)
            share = max(len(by[d] | by.get(d + 1, set())) for d in list(by)) / total
            if kind == "typed" and share > best:
                at = max(by, key=lambda d: len(by[d] | by.get(d + 1, set())))
                near = g[((g["pos"] - g["idx"]) // 8).isin([at, at + 1])]
                pairs = {(i + k, a.lower(), b.lower()) for i, x, y in zip(near["idx"], near["item_tokens"], near["tokens"], strict=True) for k, (a, b) in enumerate(zip(x.split(" "), y.split(" "), strict=False))}
                seen = Counter((a, b) for _, a, b in pairs if a != b)
                to = defaultdict(set)
                for _, a, b in pairs:
                    to[a].add(b)
                consistent = sum(len(v) > 1 for v in to.values()) <= max(1, len(seen)) // 4
                share = share if consistent else 0.0
            best = max(best, share)
        kinds = set(pdf["kind"])
        out = {"doc_id": [pdf["id"].iloc[0]], "item_id": [pdf["item_id"].iloc[0]], "share": [round(best, 4)], "plain": ["plain" in kinds]}
        return pd.DataFrame(out)[lambda x: x.share >= least]

    return judge


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, share, plain) of every document that holds ``least`` of an item's windows.

    The share is of the windows that the item has of a kind, but of half as many as it has places
    at least. Null and empty texts match nothing; an item of fewer words than a window, and two at
    least, is matched by documents that are that item as a whole. Repeated rows of a doc_id count
    as one document; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    items = cut(window_rows(benchmark.select("item_id", "text"), width)).select(F.col("id").alias("item_id"), "kind", F.col("pos").alias("idx"), F.col("words").alias("words_of_item"), "hash", F.col("tokens").alias("item_tokens"))
    places = F.greatest(F.max("words_of_item") - width + 1, F.lit(1))
    has = items.groupBy("item_id", "kind").agg(F.greatest(F.countDistinct("idx"), F.ceil(places / 2)).cast("int").alias("possible"))
    items = cut(items.join(has, ["item_id", "kind"]).drop("words_of_item"))
    only = spark.sparkContext.broadcast(window_filter(items))
    hits = cut(window_rows(docs.select("doc_id", "text"), width, only))
    keys = items.select("item_id", "kind", "idx", "possible", "hash")
    pairs = hits.select("id", "kind", "hash").distinct().join(small(keys), ["kind", "hash"])
    enough = pairs.groupBy("id", "item_id", "kind").agg((F.countDistinct("idx") / F.max("possible")).alias("held")).filter(F.col("held") >= least).select("id", "item_id").distinct()
    full = hits.join(small(items), ["kind", "hash"]).join(small(enough.withColumnRenamed("id", "_id").withColumnRenamed("item_id", "_item")), F.col("id").eqNullSafe(F.col("_id")) & F.col("item_id").eqNullSafe(F.col("_item"))).drop("_id", "_item")
    return full.groupBy("id", "item_id").applyInPandas(judged(width, least), "doc_id long, item_id long, share double, plain boolean")


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that leak no item, with the columns they had."""
    bad = leaks(docs, benchmark, **how).select(F.col("doc_id").alias("_bad")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"))
    return rows.join(small(bad), F.col("_id").eqNullSafe(F.col("_bad")), "left_anti").select(*[F.col("_row")[c].alias(c) for c in docs.columns])
