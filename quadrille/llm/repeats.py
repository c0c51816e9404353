"""Repeated passages, byte for byte, by suffix sorting across documents.

A string of ``length`` bytes is removed wherever a document of a smaller id has it too. Documents
lie in blocks, a table bucketed by block that each pass reads where it is. A window of ``length``
bytes has a key, the least hash of its short runs of bytes, which equal windows share; neighbouring
windows of one key form a chunk.

1. Every block sends the different keys of its windows, four bytes each, by bucket of key, and gets
   back one bit for each: whether another document has that key. Most text ends here.
2. The chunks of shared keys, each once a block, go to their key's bucket. There their suffixes are
   sorted, one bucket of suffixes at a time, with long ties resolved by the ranks of a difference
   cover; equal windows are neighbours, and the least id of each group goes back to the blocks.
3. Every block removes the bytes of windows whose least id is smaller than the document's.

A key that a third of all documents have is one entry from each block, so no bucket is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import bytes_of, in_blocks, kept, mix, packed, released
from .suffixes import PERIOD, Suffixes

#: Bytes of text in a block; a longer document is a block by itself or nearly so.
BLOCK_BYTES = 8 << 20
#: Bytes in a run whose hash may be a key.
GRAM = 20
#: Places worked on at a time, so that the arrays of hashes stay small.
PIECE = 1 << 17
#: Bytes of chunks whose suffixes are sorted together; chunks of one key stay together.
SORT_BYTES = 1 << 20
#: Rows without an id come after all others; none of them is before another.
NO_ID = np.iinfo(np.int64).max
_TABLE = mix(np.arange(1, 257).astype(np.uint64))


def _hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes from every place, doubled from the halves."""
    have, width_of, factor = _TABLE[data], 1, 0x9E3779B97F4A7C15
    made, made_width = None, 0
    while True:
        step = np.uint64(factor)
        if width & width_of:
            if made is None:
                made, made_width = have, width_of
            else:
                made = made[: len(made) - width_of] * step + have[made_width:]
                made_width += width_of
        if 2 * width_of > width:
            return mix(made)
        have = have[: len(have) - width_of] * step + have[width_of:]
        width_of, factor = 2 * width_of, factor * 0xD1342543DE82EF95 % 2**64


def _least(hashes: np.ndarray, count: int) -> np.ndarray:
    """The least of each ``count`` neighbours."""
    width = 1
    while 2 * width <= count:
        hashes, width = np.minimum(hashes[: len(hashes) - width], hashes[width:]), 2 * width
    rest = count - width
    return np.minimum(hashes[: len(hashes) - rest], hashes[rest:]) if rest else hashes


def chunks(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, end of windows, key) of each run of windows of one key inside a row."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram, keys = max(1, min(GRAM, length // 2)), np.empty(n, np.uint64)
    for a in range(0, n, PIECE):
        b = min(a + PIECE, n)
        keys[a:b] = _least(_hashes(data[a : b + length - 1], gram), length - gram + 1)
    across = np.zeros(n + 1, np.int32)
    np.add.at(across, np.clip(offsets[1:-1] - length + 1, 0, n), 1)
    np.add.at(across, np.minimum(offsets[1:-1], n), -1)
    inside = np.cumsum(across[:n]) == 0
    goes_on = np.zeros(n + 1, bool)
    goes_on[1:n] = (keys[1:] == keys[:-1]) & inside[1:] & inside[:-1]
    starts = np.flatnonzero(inside & ~goes_on[:n])
    return starts, np.flatnonzero(inside & ~goes_on[1:]) + 1, keys[starts]


class Block:
    """The rows of one block and their chunks, in an order that every pass finds again."""

    def __init__(self, table: pa.Table, buckets: int, length: int):
        self.table = table.sort_by([("_id", "ascending"), ("_text", "ascending")])
        self.data, self.offsets = bytes_of(self.table["_text"].combine_chunks())
        self.ids = self.table["_id"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self.length, self.buckets = length, buckets
        self.starts, self.ends, keys = chunks(self.data, self.offsets, length)
        self.of_id = self.ids[np.searchsorted(self.offsets, self.starts, "right") - 1]
        code = (((keys >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
        self.codes, self.code_of = np.unique(code, return_inverse=True)

    def borders(self, codes: np.ndarray) -> np.ndarray:
        """Where each bucket begins in sorted codes."""
        return np.searchsorted(codes >> np.uint64(32), np.arange(self.buckets + 1, dtype=np.uint64))

    def keys(self) -> list[tuple[int, bytes, bytes]]:
        """(bucket, the different keys, whether several ids of this block have each)."""
        least, most = np.full(len(self.codes), NO_ID), np.full(len(self.codes), np.iinfo(np.int64).min)
        np.minimum.at(least, self.code_of, self.of_id)
        np.maximum.at(most, self.code_of, self.of_id)
        at = self.borders(self.codes)
        values = packed(self.codes.astype(np.uint32), at)
        return [(k, values[k], np.packbits((least < most)[at[k] : at[k + 1]]).tobytes()) for k in range(self.buckets) if at[k] < at[k + 1]]

    def choose(self, answers: pa.Table) -> None:
        """Keep the chunks of shared keys; give each different text of them a number, in order of bucket and text."""
        at, shared = self.borders(self.codes), np.zeros(len(self.codes), bool)
        for k, bits in zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True):
            shared[at[k] : at[k + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8))[: at[k + 1] - at[k]]
        chosen = np.flatnonzero(shared[self.code_of])
        self.starts, self.ends, self.of_id, code = self.starts[chosen], self.ends[chosen], self.of_id[chosen], self.code_of[chosen]
        data, more, numbers = self.data.tobytes(), self.length - 1, {}
        met = np.fromiter((numbers.setdefault(data[a : b + more], len(numbers)) for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)), np.int64, len(chosen))
        texts = list(numbers)
        own = np.zeros(len(texts), np.uint64)
        own[met] = self.codes[code]
        order = np.argsort(own, kind="stable")  # rows are in a fixed order, so first meetings are too
        self.texts, self.text_codes = [texts[k] for k in order], own[order]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.met = back[met] if len(met) else met

    def sent(self) -> list[tuple[int, bytes, bytes, bytes, bytes]]:
        """(bucket, keys, lengths, least ids, texts end to end) of the chosen chunks."""
        least = np.full(len(self.texts), NO_ID)
        np.minimum.at(least, self.met, self.of_id)
        sizes, at = np.array([len(t) for t in self.texts], np.int32), self.borders(self.text_codes)
        parts = [packed(x, at) for x in (self.text_codes.astype(np.uint32), sizes, least)]
        return [(k, *(p[k] for p in parts), b"".join(self.texts[at[k] : at[k + 1]])) for k in range(self.buckets) if at[k] < at[k + 1]]

    def removed(self, answers: pa.Table) -> np.ndarray:
        """Which bytes go, from the runs of least ids that the buckets found for each chunk."""
        rows = sorted(zip(*(answers[c].to_pylist() for c in ("bucket", "counts", "ends", "least")), strict=True))
        counts, ends, least = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) if rows else np.zeros(0, t) for k, t in ((1, np.int32), (2, np.int32), (3, np.int64)))
        first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        begins[first[:-1]] = 0
        n = counts[self.met]
        at = np.repeat(first[self.met] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        start, of_id = np.repeat(self.starts, n), np.repeat(self.of_id, n)
        goes = of_id > least[at]
        cover = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(cover, (start + begins[at])[goes], 1)
        np.add.at(cover, (start + ends[at] - 1 + self.length)[goes], -1)
        return np.cumsum(cover[:-1]) > 0

    def result(self, gone: np.ndarray) -> dict[str, pa.Array]:
        """What is left of each row, and its maximal removed spans."""
        row_of = lambda p: np.searchsorted(self.offsets, p, "right") - 1
        edge = np.zeros(len(gone) + 1, bool)
        edge[self.offsets] = True
        starts = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])[: len(gone)]))
        ends = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]])[: len(gone)])) + 1
        rows = row_of(starts)
        left = np.concatenate([[0], np.cumsum(~gone)])[self.offsets]
        spans = pa.StructArray.from_arrays([pa.array(starts - self.offsets[rows]), pa.array(ends - self.offsets[rows])], ["start", "end"])
        list_at = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(self.ids)))]).astype(np.int32)
        texts = pa.Array.from_buffers(pa.large_binary(), len(self.ids), [None, pa.py_buffer(left.astype(np.int64).tobytes()), pa.py_buffer(self.data[~gone].tobytes())])
        return {
            "n_bytes": pa.array(np.diff(self.offsets)),
            "n_removed": pa.array(np.diff(self.offsets) - np.diff(left)),
            "removed": pa.ListArray.from_arrays(pa.array(list_at), spans),
            "kept_bytes": texts.cast(pa.binary()),
        }


def shared_keys(table: pa.Table) -> pa.Table:
    """One bucket of keys: for each block, bits of the keys that several ids have."""
    held = [np.frombuffer(v, np.uint32) for v in table["keys"].to_pylist()]
    several = [np.unpackbits(np.frombuffer(v, np.uint8))[: len(h)] for v, h in zip(table["several"].to_pylist(), held, strict=True)]
    _, of, counts = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    shared = (counts > 1) | (np.bincount(of, weights=np.concatenate(several), minlength=len(counts)) > 0)
    at = np.concatenate([[0], np.cumsum([len(h) for h in held])])
    bits = [np.packbits(shared[of[a:b]]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.table({"block": table["block"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})


def least_ids(texts: list[bytes], least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text, how many runs of windows it has, where they end, and the least id that has a run's windows."""
    sizes = np.array([len(t) for t in texts], np.int64)
    windows = sizes - length + 1
    base, first = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.concatenate([[0], np.cumsum(windows)])
    within = np.arange(first[-1]) - np.repeat(first[:-1], windows)
    places, ids = np.repeat(base, windows) + within, np.repeat(least, windows)
    found = np.empty_like(ids)
    for order, begins in Suffixes(np.frombuffer(b"".join(texts), np.uint8), length).equal_groups(places):
        groups = np.minimum.reduceat(ids[order], begins)
        found[order] = np.repeat(groups, np.diff(np.concatenate([begins, [len(order)]])))
    ends = np.flatnonzero(np.concatenate([(found[1:] != found[:-1]) | (within[1:] == 0), [True]]))
    return np.diff(np.searchsorted(ends, first, "left")).astype(np.int32), (within[ends] + 1).astype(np.int32), found[ends]


def sorted_bucket(table: pa.Table, length: int) -> pa.Table:
    """One bucket of chunks: each different one once, sorted in parts of whole keys; answers for each block's list of chunks."""
    numbers, keys, least, lists = {}, [], [], []
    for k, n, i, text in zip(*(table[c].to_pylist() for c in ("keys", "sizes", "least", "texts")), strict=True):
        ends = np.cumsum(np.frombuffer(n, np.int32), dtype=np.int64).tolist()
        lists.append(np.array([numbers.setdefault(text[a:b], len(numbers)) for a, b in zip([0, *ends[:-1]], ends, strict=True)], np.int64))
        keys.append(np.frombuffer(k, np.uint32))
        least.append(np.frombuffer(i, np.int64))
    texts, met = list(numbers), np.concatenate(lists)
    ids, of_key = np.full(len(texts), NO_ID), np.zeros(len(texts), np.uint32)
    np.minimum.at(ids, met, np.concatenate(least))
    of_key[met] = np.concatenate(keys)
    order = np.argsort(of_key, kind="stable")
    size = np.cumsum([len(texts[k]) for k in order])
    part = np.concatenate([[0], size[:-1]]) // SORT_BYTES
    # a part begins where the key changes too
    new_key = np.concatenate([[True], of_key[order][1:] != of_key[order][:-1]])
    part = part[np.maximum.accumulate(np.where(new_key, np.arange(len(order)), 0))]
    made, counts = [], np.zeros(len(texts), np.int32)
    for at in np.split(order, np.flatnonzero(np.diff(part)) + 1):
        n, ends, found = least_ids([texts[k] for k in at], ids[at], length)
        counts[at] = n
        made.append((ends, found))
    ends, found = (np.concatenate([m[k] for m in made]) for k in (0, 1))
    first = np.zeros(len(texts), np.int64)
    first[order] = np.concatenate([[0], np.cumsum(counts[order])[:-1]])
    del numbers, texts
    released()
    out = {"block": table["block"], "bucket": table["bucket"], "counts": [], "ends": [], "least": []}
    for of in lists:
        n = counts[of].astype(np.int64)
        at = np.repeat(first[of] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        for c, v in (("counts", counts[of]), ("ends", ends[at]), ("least", found[at])):
            out[c].append(v.tobytes())
    return pa.table({c: v if c in ("block", "bucket") else pa.array(v, pa.binary()) for c, v in out.items()})


def cut_repeats(docs: DataFrame, length: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` with n_bytes, n_removed, removed (spans of bytes, end exclusive) and kept_bytes, which win over clashing ones.

    Removed is each byte that a string of ``length`` bytes covers which starts in a row of a
    smaller doc_id too; overlaps count and strings are judged on the input. Texts are UTF-8 bytes,
    null ones are empty; matches never cross rows. Rows of one id don't remove each other; rows
    without an id come after all others. An empty table gives an empty result. ``length`` is seven
    at least. What is left need not be UTF-8, since a span may cut a character.
    """
    if length < PERIOD:
        raise ValueError(f"length is {PERIOD} at least")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    own = StructType([StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("removed", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))), StructField("kept_bytes", BinaryType())])
    rest = [c for c in docs.columns if c.lower() not in [f.name for f in own]]
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block")
    table = in_blocks(docs.select(block, F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), F.struct(*[F.col(c) for c in rest if c != "text"]).alias("_rest")), "block", blocks)
    texts = table.select("block", "_id", "_text")

    def keys(rows: pa.Table) -> pa.Table:
        made = Block(rows, blocks, length).keys()
        released()
        return _rows(made, {"bucket": pa.int32(), "keys": pa.binary(), "several": pa.binary()}, rows)

    def chosen(rows: pa.Table, answers: pa.Table) -> pa.Table:
        made = []
        if rows.num_rows and answers.num_rows:
            held = Block(rows, blocks, length)
            held.choose(answers)
            made = held.sent()
            del held
            released()
        return _rows(made, {"bucket": pa.int32(), "keys": pa.binary(), "sizes": pa.binary(), "least": pa.binary(), "texts": pa.binary()}, rows)

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        held = Block(rows, blocks, length)
        gone = np.zeros(len(held.data), bool)
        if answers.num_rows:
            held.choose(answers.filter(pc.is_valid(answers["bits"])))
            gone = held.removed(answers.filter(pc.is_valid(answers["counts"])))
        made = held.result(gone)
        del gone
        released()
        return pa.table({"_rest": held.table["_rest"], "_text": held.table["_text"], **made})

    by_block = texts.groupBy("block")
    bits = by_block.applyInArrow(keys, "block int, bucket int, keys binary, several binary").groupBy("bucket").applyInArrow(shared_keys, "block int, bucket int, bits binary")
    bits = kept(bits)
    sent = by_block.cogroup(bits.groupBy("block")).applyInArrow(chosen, "block int, bucket int, keys binary, sizes binary, least binary, texts binary")
    found = kept(sent.groupBy("bucket").applyInArrow(lambda t: sorted_bucket(t, length), "block int, bucket int, counts binary, ends binary, least binary"))
    answers = bits.unionByName(found, allowMissingColumns=True)
    schema = StructType([table.schema["_rest"], table.schema["_text"], *own])
    done = table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)
    value = lambda c: F.col("_text").alias(c) if c == "text" else F.col("_rest")[c].alias(c)
    return done.select(*[value(c) for c in rest], *own.names)


def _rows(made: list[tuple], types: dict[str, pa.DataType], rows: pa.Table) -> pa.Table:
    columns = list(zip(*made, strict=True)) or [[] for _ in types]
    held = {c: pa.array(v, t) for (c, t), v in zip(types.items(), columns, strict=True)}
    block = rows["block"][0].as_py() if rows.num_rows else 0
    return pa.table({"block": pa.array([block] * len(made), pa.int32()), **held})
