"""Fill-in-middle: texts cut in two places and put together in another order, for training infilling.

Every byte of a text has a class, and a wavelet matrix over the classes answers how many of a
range of classes lie before a place. Bytes that begin a unit, and bytes that begin a character,
are such ranges: their ranks give a text's units, a bisection on ranks gives the place of a cut,
and ranks there give its code points. One matrix serves a whole slice of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Classes of bytes, in an order that makes each kind of unit a range from one class on.
CONTINUED, IN_WORD, OTHER, WORD = 0, 1, 2, 3
LEVELS = 2
#: The first class of the bytes that begin a unit.
UNITS = {"char": IN_WORD, "token": OTHER, "word": WORD}


class WaveletMatrix:
    """Classes below 2 ** LEVELS, a bit vector for each bit from the highest, zeros before ones in the next."""

    def __init__(self, classes: np.ndarray):
        self.n, self.levels = len(classes), []
        for level in reversed(range(LEVELS)):
            bits = (classes >> level) & 1
            words = np.zeros((self.n >> 6) + 1, np.uint64)
            packed = np.packbits(bits, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=ones[1:])
            self.levels.append((words, ones, self.n - int(ones[-1])))
            one = bits.astype(bool)
            classes = np.concatenate([classes[~one], classes[one]])

    @staticmethod
    def _ones(words: np.ndarray, ones: np.ndarray, at: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return ones[at >> 6] + np.bitwise_count(words[at >> 6] & below)

    def rank_from(self, least: int, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` elements have class ``least`` or a higher one."""
        start, end, found = np.zeros_like(at), at, np.zeros_like(at)
        for k, (words, ones, zeros) in enumerate(self.levels):
            a, b = self._ones(words, ones, start), self._ones(words, ones, end)
            if (least >> (LEVELS - 1 - k)) & 1:
                start, end = zeros + a, zeros + b
            else:
                found = found + (b - a)
                start, end = start - a, end - b
        return found + (end - start)

    def select_from(self, least: int, nth: np.ndarray) -> np.ndarray:
        """Place of the ``nth`` element, from 0, of class ``least`` or higher; the length if there are fewer. By bisection on ranks."""
        low, high = np.zeros_like(nth), np.full_like(nth, self.n)
        while (low < high).any():
            half = (low + high) >> 1
            enough = self.rank_from(least, np.minimum(half + 1, self.n)) > nth
            low, high = np.where(enough | (low >= high), low, half + 1), np.where(enough, half, high)
        return low


def classes_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A class for every UTF-8 byte: inside a character, inside a run of letters, any other character, first letter of a run."""
    lowered = data | 32
    letter = (lowered >= 97) & (lowered <= 122)
    goes_on = np.zeros(len(data), bool)
    goes_on[1:] = letter[:-1]
    goes_on[offsets[:-1][offsets[:-1] < len(data)]] = False
    classes = np.where(letter, np.where(goes_on, IN_WORD, WORD), OTHER).astype(np.uint8)
    classes[(data & 0xC0) == 0x80] = CONTINUED
    return classes


def places(texts: pa.Array, one: np.ndarray, other: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and the code points before and between its cuts: the remainders of two numbers by units + 1."""
    data, offsets = bytes_of(texts)
    out = np.zeros((3, len(texts)), np.int64)
    for a, b in slices(offsets, 4 << 20):
        at = offsets[a : b + 1] - offsets[a]
        matrix = WaveletMatrix(classes_of(data[offsets[a] : offsets[b]], at))
        units, chars = matrix.rank_from(UNITS[unit], at), matrix.rank_from(UNITS["char"], at)
        n = np.diff(units)
        first, second = one[a:b] % (n + 1), other[a:b] % (n + 1)
        cuts = []
        for k in (np.minimum(first, second), np.maximum(first, second)):
            place = np.where(k == n, at[1:], matrix.select_from(UNITS[unit], units[:-1] + k))
            cuts.append(matrix.rank_from(UNITS["char"], np.where(k == 0, at[:-1], place)) - chars[:-1])
        out[:, a:b] = n, cuts[0], cuts[1] - cuts[0]
    return out[0], out[1], out[2]


def transform(docs: DataFrame, unit: str = "token", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """All columns of ``docs`` with n_units, form, prefix_chars, middle_chars and fim_text, which win over clashing ones.

    Both cuts stand between units: ``token`` (runs of ASCII letters, and each other character),
    ``char``, or ``word`` (from one run of letters to the next). The seed and doc_id decide cuts
    and form: ``psm`` (prefix, suffix, middle, each after its mark), ``spm`` (suffix, prefix,
    middle) or ``plain`` (the text as it is; also if it is empty or holds a mark), whose counts of
    characters are null. Null texts are empty, a null doc_id counts as an empty one, equal rows
    give equal rows, an empty table gives an empty result. Whole texts of any length.
    """

    @F.arrow_udf("struct<n:long,before:long,between:long>")
    def cut_places(texts: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
        found = places(texts, one.to_numpy(zero_copy_only=False), other.to_numpy(zero_copy_only=False), unit)
        return pa.StructArray.from_arrays([pa.array(x) for x in found], ["n", "before", "between"])

    text = F.coalesce("_text", F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    number = lambda k: F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | text.contains(m)
    form = F.when((text == "") | marked | (number(3) % 100 >= 100 - plain_percent), "plain").when(number(4) % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    rows = rows.select("_row", text.alias("_text"), form.alias("_form"), cut_places(text, number(1), number(2)).alias("_cut"))
    part = lambda start, n: F.substring("_text", (start + 1).cast("int"), n.cast("int"))
    before, between = F.col("_cut.before"), F.col("_cut.between")
    prefix, middle, suffix = part(F.lit(0), before), part(before, between), part(before + between, F.char_length("_text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    of_cut = lambda c: F.when(F.col("_form") != "plain", c)
    own = {
        "n_units": F.col("_cut.n"),
        "form": F.col("_form"),
        "prefix_chars": of_cut(before),
        "middle_chars": of_cut(between),
        "fim_text": F.when(F.col("_form") == "psm", psm).when(F.col("_form") == "spm", spm).otherwise(F.col("_text")),
    }
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in own], *[v.alias(k) for k, v in own.items()])


def restored(output: Column, form: Column) -> Column:
    """The text again, from the output and its form alone: marks can't come to stand across the borders of parts."""
    after = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
    first, second = lambda c, m: F.split(c, m, 2)[0], lambda c, m: F.split(c, m, 2)[1]
    from_psm = F.concat(first(after, SUFFIX), second(second(after, SUFFIX), MIDDLE), first(second(after, SUFFIX), MIDDLE))
    from_spm = F.concat(F.replace(second(after, PREFIX), F.lit(MIDDLE), F.lit("")), first(after, PREFIX))
    return F.when(form == "psm", from_psm).when(form == "spm", from_spm).otherwise(output)
