"""Toxicity by multiple-instance learning: documents are bags of sentences.

A sentence's score is logistic in hashed features of its different words (the word and its
leading 4 to 8 bytes). A document's score is the noisy-or of its sentences, and the weights are
fitted to document labels alone, so the model also says which sentences offend.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWERED, bytes_of, mix, released, slices, span_hashes, words_of

#: Bounds of the training sample: documents of each label, those of the least hash of doc_id, and bytes of a document.
SAMPLE_DOCS, SAMPLE_BYTES = 2500, 1 << 18
BITS = 18
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.3
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?\"'()[]{}*_-#$%&|<>")] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, sentence of each row of ids, row of each sentence): ids has a column for each feature of a word.

    A sentence ends with . ! ? at the end of a word, or a line feed. Each word counts once in it.
    """
    starts, ends, rows = words_of(data, offsets)
    if not len(starts):
        return np.zeros((0, len(PREFIXES) + 1), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lines = np.searchsorted(np.flatnonzero(data == 10), starts)
    new = np.ones(len(starts), bool)
    new[1:] = _ENDS[data[ends[:-1] - 1]] | (lines[1:] != lines[:-1]) | (rows[1:] != rows[:-1])
    sentence = np.cumsum(new) - 1
    of = rows[new]
    tail = ends - 1
    for _ in range(3):  # punctuation that clings to the word
        tail = np.where((tail > starts) & _PUNCTUATION[data[tail]], tail - 1, tail)
    head = np.where((tail > starts) & _PUNCTUATION[data[starts]], starts + 1, starts)
    stop = tail + 1
    low = _LOWERED[data]
    word = span_hashes(low, head, stop)
    once = np.unique(mix(word + sentence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    once.sort()
    head, stop, word, sentence = head[once], stop[once], word[once], sentence[once]
    ids = np.empty((len(once), len(PREFIXES) + 1), np.int64)
    ids[:, 0] = word & np.uint64((1 << BITS) - 1)
    for k, n in enumerate(PREFIXES, 1):
        ids[:, k] = mix(span_hashes(low, head, np.minimum(head + n, stop)) + np.uint64(n)) & np.uint64((1 << BITS) - 1)
    return ids, sentence, of


def sentence_logits(weights: np.ndarray, ids: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(sentence, weights[ids].sum(1), n) + weights[-1]


def log_none(logits: np.ndarray) -> np.ndarray:
    """Log of the probability that a sentence does not offend."""
    return -np.logaddexp(0, logits)


def fit(texts: pa.Array | list[str], labels: np.ndarray, epochs: int = 30, rate: float = 0.3, shrink: float = 3e-5, seed: int = 1) -> np.ndarray:
    """Weights (the last is the bias) that maximise the likelihood of document labels under the noisy-or, by Adagrad on mini-batches."""
    weights = np.zeros((1 << BITS) + 1, np.float64)
    weights[-1] = -9.0
    if not len(texts) or not labels.any():
        return weights
    rng, squares = np.random.default_rng(seed), np.full_like(weights, 1e-3)
    bags = []
    for k in range(0, len(texts), 64):
        data, offsets = bytes_of(texts[k : k + 64] if isinstance(texts, pa.Array) else pa.array(texts[k : k + 64], pa.string()))
        ids, sentence, of = features(data, offsets)
        touched, where = np.unique(ids, return_inverse=True)
        bags.append((touched.astype(np.int32), where.reshape(ids.shape).astype(np.int32), sentence.astype(np.int32), of.astype(np.int32), labels[k : k + 64]))
    seen = np.bincount(np.concatenate([b[0] for b in bags]), minlength=1 << BITS)
    for _ in range(epochs):
        for at in rng.permutation(len(bags)):
            touched, where, sentence, of, y = bags[at]
            if not len(of):
                continue
            held = weights[touched]
            logits = np.bincount(sentence, held[where].sum(1), len(of)) + weights[-1]
            none = np.bincount(of, log_none(logits), len(y))
            p = -np.expm1(none)
            # d loss / d logit = sigma(logit) for clean documents, -sigma(logit) * (1 - p) / p for toxic ones
            factor = np.where(y > 0, -np.exp(none) / np.maximum(p, 1e-9), 1.0)
            slope = factor[of] / (1 + np.exp(-logits))
            grad = np.bincount(where.reshape(-1), np.repeat(slope[sentence], where.shape[1]), len(touched)) / len(y) + shrink * held
            squares[touched] += grad * grad
            weights[touched] -= rate * grad / np.sqrt(squares[touched])
            bias = slope.sum() / len(y)
            squares[-1] += bias * bias
            weights[-1] -= rate * bias / np.sqrt(squares[-1])
    weights[:-1][seen < 2] = 0.0  # of one batch alone
    return weights


def sampled(labels: DataFrame, docs_per_label: int) -> DataFrame:
    """(_id, toxic): ``docs_per_label`` documents of each label at most; every task keeps its first ones only."""
    ids = labels.filter("doc_id is not null and toxic is not null").select(F.col("doc_id").alias("_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).distinct()
    clean_ids, toxic_ids = (ids.filter(F.col("toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(docs_per_label) for y in (0, 1))
    return clean_ids.unionByName(toxic_ids)


def train(docs: DataFrame, labels: DataFrame, docs_per_label: int = SAMPLE_DOCS) -> np.ndarray:
    """Fit on at most ``docs_per_label`` documents of each label, of those in ``labels`` (doc_id, toxic), none above ``SAMPLE_BYTES``.

    The bounded sample goes to one task, which fits the weights; the driver sees these alone.
    """
    ids = sampled(labels, docs_per_label)
    known = docs.select("doc_id", "text").filter(F.octet_length("text") <= SAMPLE_BYTES)
    rows = known.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", "toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = list(batches)
        if every:
            held = pa.Table.from_batches(every).sort_by([("doc_id", "ascending"), ("toxic", "ascending"), ("text", "ascending")])
            order = np.random.default_rng(2).permutation(len(held))
            held = held.take(pa.array(order))
            weights = fit(held.column("text").combine_chunks(), held.column("toxic").to_numpy().astype(np.int64))
            del held, every
            released()
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    made = rows.repartition(1).mapInArrow(run, "weights binary").collect()
    return np.frombuffer(bytes(made[0]["weights"]), np.float64) if made else fit([], np.zeros(0, np.int64))


SCHEMA = "doc_id long, score double, worst int"


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score, worst) of every row; ``worst`` is the place, from 0, of the sentence that offends most.

    Null and empty texts have no sentence and score 0. Equal rows give equal rows; other columns
    are not read; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column(1))
            scores, worst = np.zeros(len(offsets) - 1), np.full(len(offsets) - 1, -1, np.int32)
            for a, b in slices(offsets):
                ids, sentence, of = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(of):
                    continue
                logits = sentence_logits(sent.value, ids, sentence, len(of))
                scores[a:b] = -np.expm1(np.bincount(of, log_none(logits), b - a))
                by = np.lexsort((np.arange(len(of)), -logits, of))
                top = by[np.concatenate([[True], of[by][1:] != of[by][:-1]])]
                first = np.searchsorted(of, np.arange(b - a))
                worst[a + of[top]] = top - first[of[top]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(scores, 0, 1)), pa.array(worst, mask=worst < 0)], ["doc_id", "score", "worst"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score less than ``threshold``, with all their columns; the text is scored once, where it is read."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column(at))
            keep = np.ones(len(offsets) - 1, bool)
            for a, b in slices(offsets):
                ids, sentence, of = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                none = np.bincount(of, log_none(sentence_logits(sent.value, ids, sentence, len(of))), b - a)
                keep[a:b] = -np.expm1(none) < threshold
            yield batch.filter(pa.array(keep))
        released()

    return docs.mapInArrow(run, docs.schema)
