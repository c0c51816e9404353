"""Phrase collocations from an index of words for each shard, summed across shards.

Documents lie in shards, a table bucketed by shard that every pass reads where it is. Phrases of
fewer occurrences than the least count are pruned by their parts of two words, then of three:
every shard sends how often it has each word and pair, then each triple of passing pairs, packed
by bucket, and gets back a bit for each.

Then each shard builds an FM-index over word ids, in both directions, of the stretches whose
pairs all pass: the Burrows-Wheeler transform of the word ids and of their reverse, with suffixes
sorted as deep as phrases go. An interval of suffixes for every phrase is extended by a word to
the left in one and to the right in the other, all intervals of a length at once, which gives the
count of every longer phrase. The counts of shards are summed by phrase.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import _LOWERED, bytes_of, in_blocks, kept, mix, packed, released, slices, span_hashes, words_of

SHARD_BYTES = 8 << 20
BREAKS = b".,;:!?\n\x0b\x0c\r"
_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
#: Breaks become spaces before words are found.
_BLANKED = _LOWERED.copy()
_BLANKED[list(BREAKS)] = 32
_COUNTS = "lang string, phrase string, n long"


class Words:
    """The words of a shard: a hash of language and word, the id by hash, and whether the next word follows in the same piece."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("lang", "ascending"), ("text", "ascending")])
        data, offsets = bytes_of(table["text"].combine_chunks())
        langs = table["lang"].combine_chunks().dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        lang_hash = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs], np.uint64)
        lang_of_row = langs.indices.to_numpy(zero_copy_only=False)
        found = []
        for a, b in slices(offsets):
            part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            starts, ends, rows = words_of(_BLANKED[part], at)
            lang = lang_of_row[a + rows]
            hashes = mix(span_hashes(_LOWERED[part], starts, ends) + (lang_hash[lang] if len(lang) else np.zeros(0, np.uint64)))
            piece = np.concatenate([[0], np.cumsum(_BREAK[part])])[starts]
            follows = np.zeros(len(starts), bool)
            follows[:-1] = (rows[1:] == rows[:-1]) & (piece[1:] == piece[:-1])
            found.append((hashes, follows, starts + offsets[a], ends + offsets[a], lang))
        hashes, self.follows, starts, ends, lang = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, t in enumerate((np.uint64, bool, np.int64, np.int64, np.int64)))
        self.hashes, first, self.ids, self.counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        self.lang_of, self.spans, self.data = lang[first], (starts[first], ends[first]), data
        self.lang_counts = np.bincount(lang, minlength=len(self.langs))

    def text(self, word: int) -> str:
        return _LOWERED[self.data[self.spans[0][word] : self.spans[1][word]]].tobytes().decode()


class Grams:
    """The n-grams of a shard, a length at a time: their keys, and which of them pass."""

    def __init__(self, words: Words, buckets: int):
        self.words, self.buckets, self.length = words, buckets, 1
        self.hash, self.passes = words.hashes[words.ids], {1: np.ones(len(words.ids), bool)}

    def grow(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys, in order of bucket, and counts of the n-grams a word longer whose two parts pass; with pairs come the words."""
        words, last = self.words, self.passes[self.length]
        valid = last & np.append(last[1:], False) if len(last) else last
        self.at = np.flatnonzero(valid & words.follows if self.length == 1 else valid)
        longer = mix(self.hash[self.at] * np.uint64(3) + words.hashes[words.ids[self.at + self.length]])
        self.hash = np.zeros_like(self.hash)
        self.hash[self.at] = longer
        self.length += 1
        grams, gram_of, counts = np.unique(longer, return_inverse=True, return_counts=True)
        if self.length == 2:
            grams, counts = np.concatenate([grams, mix(words.hashes)]), np.concatenate([counts, words.counts])
        keys = (((grams >> np.uint64(32)) % np.uint64(self.buckets)) << np.uint64(32)) | (grams & np.uint64(0xFFFFFFFF))
        keys, self.key_of = np.unique(keys, return_inverse=True)
        self.gram_of = gram_of
        return keys, np.bincount(self.key_of, weights=counts, minlength=len(keys)).astype(np.uint32)

    def answer(self, keys: np.ndarray, answers: pa.Table) -> None:
        """Which n-grams pass, from the bits for each bucket's keys."""
        at, enough = self.borders(keys), np.zeros(len(keys), bool)
        for k, bits in zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True):
            enough[at[k] : at[k + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8))[: at[k + 1] - at[k]]
        enough = enough[self.key_of]
        self.passes[self.length] = np.zeros(len(self.words.ids), bool)
        self.passes[self.length][self.at] = enough[self.gram_of]
        if self.length == 2:
            self.word_passes = enough[len(enough) - len(self.words.hashes) :]

    def borders(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(keys >> np.uint64(32), np.arange(self.buckets + 1, dtype=np.uint64))

    def passing(self, places: np.ndarray, length: int) -> np.ndarray:
        """Whether all parts of the n-grams from these places pass, as far as lengths were asked about."""
        known = min(length, self.length)
        flags = self.passes[known]
        out = np.ones(len(places), bool)
        for k in range(length - known + 1):
            out &= flags[places + k]
        return out


class Index:
    """One direction of the index: suffixes sorted as deep as phrases go, the symbol before each, and ranks of symbols."""

    def __init__(self, symbols: np.ndarray, depth: int):
        n = len(symbols)
        rank, known = symbols.astype(np.int64), 1
        while known < depth:
            step = min(known, depth - known)
            ahead = np.zeros(n, np.int64)
            ahead[: n - step] = rank[step:]
            key = rank * (n + int(symbols.max()) + 1) + ahead
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
            known += step
        self.places = np.argsort(rank, kind="stable")
        self.before = symbols[self.places - 1].astype(np.int64)  # the text begins with a break
        by_symbol = np.argsort(self.before, kind="stable")
        self.ranked = (self.before[by_symbol] << 32) | by_symbol

    def extended(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the suffixes begin that have ``symbol`` before one from ``at`` on: smaller symbols, and the rank of this one."""
        return np.searchsorted(self.ranked, (symbol << 32) | at)


def extend(index: Index, low: np.ndarray, other_low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, low in the other direction, count) of all phrases that have a word before those of the given intervals.

    Symbols before the suffixes of an interval are in order the intervals into which the
    other direction's is cut.
    """
    total = int(count.sum())
    of = np.repeat(np.arange(len(low)), count)
    first = np.cumsum(count) - count
    symbol = index.before[np.arange(total) - first[of] + low[of]]
    key = np.sort((of << 32) | symbol, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if total else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([new, [total]]))
    of, symbol = key[new] >> 32, key[new] & 0xFFFFFFFF
    words = symbol > 0
    of, symbol, new, counts = of[words], symbol[words], new[words], counts[words]
    return index.extended(symbol, low[of]), other_low[of] + new - first[of], counts


def phrases(words: Words, grams: Grams, most_words: int) -> list[tuple[str, str, int]]:
    """(lang, phrase, count) of the words and phrases that pass, and the number of all words of a language as phrase ''."""
    out = [(words.langs[k], "", int(n)) for k, n in enumerate(words.lang_counts) if n]
    out += [(words.langs[words.lang_of[k]], words.text(k), int(words.counts[k])) for k in np.flatnonzero(grams.word_passes)]
    linked = grams.passes[2]
    used = linked.copy()
    used[1:] |= linked[:-1]
    at = np.flatnonzero(used)
    if not len(at):
        return out
    present, symbol = np.unique(words.ids[at], return_inverse=True)
    texts = [words.text(w) for w in present]
    langs = [words.langs[k] for k in words.lang_of[present]]
    # symbols from 1; a break, 0, at both ends and wherever a word isn't linked to the next
    place = np.arange(len(at)) + 1 + np.concatenate([[0], np.cumsum(~linked[at])[:-1]])
    text, word_at = np.zeros(place[-1] + 2, np.int64), np.zeros(place[-1] + 2, np.int64)
    text[place], word_at[place] = symbol + 1, at
    forward, backward = Index(text, most_words), Index(text[::-1], most_words)
    counts = np.bincount(text)
    low = np.cumsum(counts) - counts
    low, other, count = low[1:], low[1:].copy(), counts[1:]
    for n in range(2, most_words + 1):
        # outwards from the middle: to the left, to the right, to the left
        if n % 2 == 0:
            low, other, count = extend(forward, low, other, count)
        else:
            other, low, count = extend(backward, other, low, count)
        start = forward.places[low]
        held = grams.passing(word_at[start], n)
        low, other, count, start = low[held], other[held], count[held], start[held]
        symbols = text[start[:, None] + np.arange(n)] - 1
        out += [(langs[s[0]], " ".join([texts[k] for k in s]), c) for s, c in zip(symbols.tolist(), count.tolist(), strict=True)]
    return out


def counted(docs: DataFrame, least: int, most_words: int, shard_bytes: int = SHARD_BYTES, pruned_words: int = 3) -> DataFrame:
    """(lang, phrase, n): phrases of up to ``most_words`` words that occur ``least`` times or more, their words, and the number of all words as phrase ''.

    Lengths up to ``pruned_words`` are counted beforehand, one exchange of packed keys for each.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    shard = F.pmod(F.xxhash64(*[c for c in ("doc_id", "text") if c in docs.columns]), F.lit(shards)).cast("int").alias("shard")
    table = in_blocks(docs.select(shard, F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text")), "shard", shards)

    def answered(rows: pa.Table, answers: pa.Table | None) -> Grams:
        grams = Grams(Words(rows), shards)
        if answers is not None:
            for length in sorted(set(answers["length"].to_pylist())):
                keys, _ = grams.grow()
                grams.answer(keys, answers.filter(pc.equal(answers["length"], length)))
        return grams

    def send(rows: pa.Table, answers: pa.Table | None = None) -> pa.Table:
        grams = answered(rows, answers)
        keys, counts = grams.grow()
        at = grams.borders(keys)
        held = [k for k in range(shards) if at[k] < at[k + 1]]
        keys, counts = packed(keys.astype(np.uint32), at), packed(counts, at)
        shard = [rows["shard"][0].as_py()] * len(held)
        del grams
        released()
        return pa.table({"shard": pa.array(shard, pa.int32()), "bucket": pa.array(held, pa.int32()), "keys": pa.array([keys[k] for k in held], pa.binary()), "counts": pa.array([counts[k] for k in held], pa.binary())})

    def answer(rows: pa.Table) -> pa.Table:
        held = [np.frombuffer(v, np.uint32) for v in rows["keys"].to_pylist()]
        counts = np.concatenate([np.frombuffer(v, np.uint32) for v in rows["counts"].to_pylist()])
        keys, of = np.unique(np.concatenate(held), return_inverse=True)
        enough = np.bincount(of, weights=counts, minlength=len(keys)) >= least
        ends = np.cumsum([len(h) for h in held])
        bits = [np.packbits(enough[of[b - len(h) : b]]).tobytes() for h, b in zip(held, ends, strict=True)]
        return pa.table({"shard": rows["shard"], "bucket": rows["bucket"], "bits": pa.array(bits, pa.binary())})

    def count(rows: pa.Table, answers: pa.Table) -> pa.Table:
        grams = answered(rows, answers)
        parts: dict[int, list] = {}
        for row in phrases(grams.words, grams, most_words) if answers.num_rows else []:  # no answers: no words
            parts.setdefault(zlib.crc32(row[1].encode()) % shards, []).append(row)
        columns = [pa.array([[r[k] for r in rows] for rows in parts.values()], pa.list_(t)) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))]
        made = pa.table({"bucket": pa.array(list(parts), pa.int32()), **dict(zip(("lang", "phrase", "n"), columns, strict=True))})
        del grams, parts
        released()
        return made

    def total(rows: pa.Table) -> pa.Table:
        flat = pa.table({c: pc.list_flatten(rows[c]) for c in ("lang", "phrase", "n")})
        sums = flat.group_by(["lang", "phrase"]).aggregate([("n", "sum")])
        sums = pa.table({"lang": sums["lang"], "phrase": sums["phrase"], "n": sums["n_sum"]})
        return sums.filter(pc.or_(pc.greater_equal(sums["n"], least), pc.equal(sums["phrase"], "")))

    by_shard, known = table.groupBy("shard"), None
    for length in range(2, max(2, min(pruned_words, most_words)) + 1):
        shape = "shard int, bucket int, keys binary, counts binary"
        sent = by_shard.applyInArrow(lambda rows: send(rows), shape) if known is None else by_shard.cogroup(known.groupBy("shard")).applyInArrow(lambda rows, answers: send(rows, answers), shape)
        bits = kept(sent.groupBy("bucket").applyInArrow(answer, "shard int, bucket int, bits binary")).withColumn("length", F.lit(length))
        known = bits if known is None else known.unionByName(bits)
    made = by_shard.cogroup(known.groupBy("shard")).applyInArrow(count, "bucket int, lang array<string>, phrase array<string>, n array<long>")
    return made.groupBy("bucket").applyInArrow(total, _COUNTS)


def collocations(docs: DataFrame, least: int = 100, most_words: int = 5, cover_percent: int = 100, top: int = 2000, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut): each language's ``top`` phrases by the association of their weakest cut.

    Texts are lower-cased (A-Z), split at . , ; : ! ? and line ends into pieces, and pieces at
    spaces and tabs into words. A phrase has 2 to ``most_words`` words of one piece and occurs
    ``least`` times or more, overlaps included. Cut after its first k words, whose count is l,
    with r of the rest and n words in all, its score is floor(1000 * a * n / (l * r)) in exact
    decimals; the lowest counts, of equals that of the smallest k. A phrase goes if a longer one
    that holds it has ``cover_percent`` of its count. Order: score, a, both falling, then phrase
    in order of its bytes. A null language is ``und``; null and empty texts have no words; each row
    counts, repeated ones too; other columns are not read; an empty table gives an empty result.
    """
    table = kept(counted(docs, least, most_words, shard_bytes))
    words = F.split("phrase", " ", -1)
    candidates = table.filter("phrase <> ''").withColumn("w", words).filter("size(w) > 1").select("lang", "phrase", "w", F.col("n").alias("a"))
    total = table.filter("phrase = ''").select("lang", "n")
    sub = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = candidates.select("lang", "phrase", "a", F.size("w").alias("m"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select("lang", "phrase", "a", "k", sub(F.lit(1), F.col("k")).alias("first"), sub(F.col("k") + 1, F.col("m")).alias("rest"))
    part = lambda c, n: table.select("lang", F.col("phrase").alias(c), F.col("n").alias(n))
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(total, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    scored = scored.withColumn("_above", F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n")).withColumn("_below", exact("l") * exact("r"))
    scored = scored.withColumn("score", F.expr("_above div _below"))
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    longer = candidates.filter("size(w) > 2").select("lang", F.explode(F.array(sub(F.lit(1), F.size("w") - 1), sub(F.lit(2), F.size("w")))).alias("phrase"), F.col("a").alias("longer"))
    covered = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = weakest.join(covered, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < cover_percent * F.col("a")))
    left = left.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score", F.col("c.k").alias("cut"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of parts of a language first, so that no task ranks all of its phrases
    parts = left.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")
