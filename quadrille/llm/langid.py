"""Language of a text by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes forwards and backwards and gives every position a distribution
over the learned languages; a document's probabilities are the mean over all its positions. Its
state goes on across words and lines: a long text is read in windows that overlap, each direction
starting ``CONTEXT`` bytes before the positions that a window answers for, so that windows can be
read side by side. It is trained in numpy by backpropagation through time (Adam) on windows of a
bounded sample of labelled documents. Gates are piecewise linear and candidates x / (1 + |x|),
which numpy computes many times faster than their smooth kin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bytes_of, slices, spread31

#: Bounds of the training sample: documents, documents of a language, windows of a document, bytes of a window.
SAMPLE_ROWS, SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_BYTES = 19_200, 300, 48, 48
HIDDEN, EMBED = 8, 16
#: Positions that a window answers for, and bytes that each direction reads before them.
STRIDE, CONTEXT = 448, 32
#: Windows read at once, and the steps in which their lengths differ.
AT_ONCE, STEP = 2048, 64
#: The symbol for what lies outside a text; it leaves the state as it is.
PAD = 256


def gate(x: np.ndarray) -> np.ndarray:
    return np.clip(0.2 * x + 0.5, 0, 1)


def candidate(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


class Reader:
    """The network: embedding, a gated recurrent layer in each direction, and a softmax at every position."""

    def __init__(self, classes: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        shape = lambda *s: (rng.standard_normal(s) * (0.3 if s[0] == PAD else 1 / np.sqrt(s[0]))).astype(np.float32)
        self.p = {"E": shape(PAD, EMBED), "c": np.zeros(classes, np.float32)}
        for d in "fb":
            self.p[f"V{d}"] = shape(HIDDEN, classes)
            for g in "zrn":  # update, reset, candidate
                self.p |= {f"W{g}{d}": shape(EMBED, HIDDEN), f"U{g}{d}": shape(HIDDEN, HIDDEN), f"b{g}{d}": np.zeros(HIDDEN, np.float32)}

    def fed(self, d: str) -> dict[str, np.ndarray]:
        """What each byte adds to each gate; a pad closes the update gate."""
        out = {}
        for g in "zrn":
            of_bytes = self.p["E"] @ self.p[f"W{g}{d}"] + self.p[f"b{g}{d}"]
            out[g] = np.concatenate([of_bytes, np.full((1, HIDDEN), -1e6 if g == "z" else 0, of_bytes.dtype)])
        return out

    def states(self, x: np.ndarray, d: str, keep: list | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(t, state) of all windows x (n, length) after each byte, in the direction's order."""
        p, fed = self.p, self.fed(d)
        h = np.zeros((len(x), HIDDEN), p["E"].dtype)
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            at = x[:, t]
            z = gate(fed["z"][at] + h @ p[f"Uz{d}"])
            r = gate(fed["r"][at] + h @ p[f"Ur{d}"])
            new = candidate(fed["n"][at] + (r * h) @ p[f"Un{d}"])
            if keep is not None:
                keep.append((t, h, z, r, new))
            h = h + z * (new - h)
            yield t, h

    def labels(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(t, probabilities (n, classes)) of every position of windows x (n, length)."""
        back = np.empty((x.shape[1], len(x), HIDDEN), self.p["E"].dtype)
        for t, h in self.states(x, "b"):
            back[t] = h
        for t, h in self.states(x, "f"):
            yield t, softmax(h @ self.p["Vf"] + back[t] @ self.p["Vb"] + self.p["c"])

    def outputs(self, x: np.ndarray, d: str) -> Iterator[tuple[int, np.ndarray]]:
        """(t, what the direction adds to the logits) of windows x (length, n): ``states`` without keeping, in place."""
        p, fed, n = self.p, self.fed(d), x.shape[1]
        # the gates' line is part of the weights; update and reset together
        gates = (0.2 * np.concatenate([fed["z"], fed["r"]], axis=1) + 0.5).astype(np.float32)
        of_state = (0.2 * np.concatenate([p[f"Uz{d}"], p[f"Ur{d}"]], axis=1)).astype(np.float32)
        h, held, new, more = (np.zeros((n, HIDDEN), np.float32) for _ in range(4))
        zr, add, out = np.empty((n, 2 * HIDDEN), np.float32), np.empty((n, 2 * HIDDEN), np.float32), np.empty((n, p["c"].size), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            np.take(gates, x[t], axis=0, out=zr, mode="clip")
            zr += np.matmul(h, of_state, out=add)
            np.clip(zr, 0, 1, out=zr)
            np.multiply(zr[:, HIDDEN:], h, out=held)
            np.take(fed["n"], x[t], axis=0, out=new, mode="clip")
            new += np.matmul(held, p[f"Un{d}"], out=more)
            np.abs(new, out=more)
            more += 1
            new /= more
            new -= h
            new *= zr[:, :HIDDEN]
            h += new
            yield t, np.matmul(h, p[f"V{d}"], out=out)

    def pooled(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(n, classes): probabilities of all positions of windows x (length, n), weighted by counts (length, n) and summed."""
        back = np.empty((*x.shape, self.p["c"].size), np.float32)
        for t, out in self.outputs(x, "b"):
            back[t] = out
        total, ones = np.zeros(back.shape[1:], np.float32), np.ones((self.p["c"].size, 1), np.float32)
        back += self.p["c"]
        for t, out in self.outputs(x, "f"):
            out += back[t]
            np.clip(out, -60, 60, out=out)
            np.exp(out, out=out)
            out *= counts[t][:, None] / (out @ ones)
            total += out
        return total

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of all positions but pads, by backpropagation through time."""
        p, grad = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        kept: dict[str, list] = {"f": [], "b": []}
        held = {d: np.empty((x.shape[1], len(x), HIDDEN), p["E"].dtype) for d in "fb"}
        for d in "fb":
            for t, h in self.states(x, d, kept[d]):
                held[d][t] = h
        wrong = softmax(held["f"] @ p["Vf"] + held["b"] @ p["Vb"] + p["c"])
        wrong[:, np.arange(len(x)), y] -= 1
        real = (x != PAD).T[:, :, None]
        wrong = wrong * real / max(real.sum(), 1)
        grad["c"] = wrong.sum((0, 1))
        rows = np.minimum(x, PAD - 1)
        for d in "fb":
            grad[f"V{d}"] = np.einsum("tnk,tnc->kc", held[d], wrong)
            back = wrong @ p[f"V{d}"].T
            dh = np.zeros((len(x), HIDDEN), p["E"].dtype)
            for t, h, z, r, new in reversed(kept[d]):
                dh = dh + back[t]
                inside = {"n": dh * z * (1 - np.abs(new)) ** 2}
                inside["z"] = dh * (new - h) * 0.2 * ((z > 0) & (z < 1))
                rh = inside["n"] @ p[f"Un{d}"].T
                inside["r"] = rh * h * 0.2 * ((r > 0) & (r < 1))
                seen = np.zeros((len(x), EMBED), p["E"].dtype)
                e = p["E"][rows[:, t]] * real[t]
                for g, of in inside.items():
                    grad[f"U{g}{d}"] += (r * h if g == "n" else h).T @ of
                    grad[f"W{g}{d}"] += e.T @ of
                    grad[f"b{g}{d}"] += (of * real[t]).sum(0)
                    seen += of @ p[f"W{g}{d}"].T
                np.add.at(grad["E"], rows[:, t], seen * real[t])
                dh = dh * (1 - z) + inside["z"] @ p[f"Uz{d}"].T + inside["r"] @ p[f"Ur{d}"].T + rh * r
        return grad

    def packed(self) -> bytes:
        return b"".join(np.ascontiguousarray(v, np.float32).tobytes() for v in self.p.values())

    @classmethod
    def unpacked(cls, raw: bytes, classes: int) -> Reader:
        net, values, at = cls(classes), np.frombuffer(raw, np.float32), 0
        for k, v in net.p.items():
            net.p[k], at = values[at : at + v.size].reshape(v.shape).copy(), at + v.size
        return net


def trained(x: np.ndarray, langs: np.ndarray, classes: int, steps: int = 800, batch: int = 384, seed: int = 3) -> Reader:
    """Fit on windows of bytes and pads (n, length) and their languages, each drawn equally often."""
    net, rng = Reader(classes, seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(w) for k, w in net.p.items()} for _ in range(2))
    share = 1 / np.bincount(langs, minlength=classes)[langs] / classes
    for step in range(1, steps + 1):
        use = rng.choice(len(x), batch, p=share / share.sum())
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, grad in net.gradient(x[use], langs[use]).items():
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad * grad
            net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def within_share(spread: Column, n: Column, wanted: Column) -> Column:
    """Whether a value spread evenly over 31 bits is among about the ``wanted`` least of n; in doubles, since the product may pass a long."""
    return spread.cast("double") * n.cast("double") <= wanted.cast("double") * F.lit(2.0**31)


def sample(train: DataFrame, docs: int = SAMPLE_DOCS, langs: int | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, doc_id, at, window) of at most ``docs`` documents of each language, fewer where there are so many languages that ``rows`` would not do, but one at least.

    With ``langs``, only the commonest count. The documents are those of the least hash of doc_id, chosen by id alone; of each come at most
    ``SAMPLE_WINDOWS`` windows of ``SAMPLE_BYTES`` bytes, spread over the whole text.
    """
    named = train.select("doc_id", "lang", "text")
    common = named.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    if langs is not None:
        common = common.orderBy(F.desc("_n"), "lang").limit(langs)
    each = common.agg(F.greatest(F.lit(1), F.least(F.lit(docs), F.floor(F.lit(rows) / F.count(F.lit(1))))).alias("_docs"))
    common = common.crossJoin(F.broadcast(each)).select(F.col("lang").alias("_known"), "_n", "_docs")  # each is one row
    first = Window.partitionBy("_lang").orderBy("_hash", "_id")
    ids = named.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), spread31(5, F.col("doc_id")).alias("_hash")).join(common, F.col("_lang") == F.col("_known"))
    # of a large language only about eight times as many go to the task that numbers them; at least 64, so that chance leaves enough
    near = within_share(F.col("_hash"), F.col("_n"), F.greatest(F.lit(64), 8 * F.col("_docs")))
    ids = ids.filter(near).withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= F.col("_docs")).select("_id", "_lang").distinct()
    of_ids = named.join(F.broadcast(ids), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("lang", "doc_id", "text")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column(2))
            row, at, held = [], [], []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                for s in range(a, b, max(SAMPLE_BYTES, -(-(b - a) // SAMPLE_WINDOWS))):
                    row.append(i)
                    at.append(s - a)
                    held.append(data[s : min(s + SAMPLE_BYTES, b)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), batch.column(1).take(pa.array(row, pa.int64())), pa.array(at, pa.int64()), pa.array(held, pa.binary())], ["lang", "doc_id", "at", "window"])

    return of_ids.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(cut_out, "lang string, doc_id long, at long, window binary")


def fit(train: DataFrame, docs: int = SAMPLE_DOCS, langs: int | None = None, steps: int = 800) -> tuple[list[str], Reader | None]:
    """Languages and network from (doc_id, text, lang) without nulls.

    The sample, bounded as ``sample`` has it, goes to one task, which trains the network. Without any
    text there is neither.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = list(batches)
        if every:
            held = pa.Table.from_batches(every).sort_by([(c, "ascending") for c in ("lang", "doc_id", "at", "window")])
            names = held.column("lang").to_pylist()
            known = sorted(set(names))
            x = np.full((len(held), SAMPLE_BYTES), PAD, np.int64)
            for i, w in enumerate(held.column("window").to_pylist()):
                x[i, : len(w)] = np.frombuffer(w, np.uint8)
            net = trained(x, np.array([known.index(n) for n in names]), len(known), steps)
            yield pa.RecordBatch.from_arrays([pa.array([known], pa.list_(pa.string())), pa.array([net.packed()], pa.binary())], ["langs", "net"])

    made = sample(train, docs, langs).repartition(1).mapInArrow(run, "langs array<string>, net binary").collect()
    return (list(made[0]["langs"]), Reader.unpacked(bytes(made[0]["net"]), len(made[0]["langs"]))) if made else ([], None)


def windows_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first position, length in bytes with the context of both sides) of every window; a row's own are decided by its size alone."""
    size = np.diff(offsets)
    many = -(-size // STRIDE)
    row = np.repeat(np.arange(len(size)), many)
    k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    left = np.minimum(size[row] - k * STRIDE, STRIDE)
    return row, k * STRIDE, -(-left // STEP) * STEP + 2 * CONTEXT


def sums(net: Reader, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the probabilities of all positions of each row."""
    row, first, length = windows_of(offsets)
    out = np.zeros((len(offsets) - 1, net.p["c"].size))
    for n in np.unique(length):
        of = np.flatnonzero(length == n)
        for k in range(0, len(of), AT_ONCE):
            w = of[k : k + AT_ONCE]
            start, end = offsets[row[w]], offsets[row[w] + 1]
            at = (start + first[w] - CONTEXT)[:, None] + np.arange(n)
            real = (at >= start[:, None]) & (at < end[:, None])
            x = np.where(real, data[np.clip(at, 0, len(data) - 1)].astype(np.intp), PAD).T.copy(order="C")
            real[:, :CONTEXT] = real[:, n - CONTEXT :] = False
            np.add.at(out, row[w], net.pooled(x, real.T.astype(np.float32, order="C")))
    return out


SCHEMA = "doc_id long, lang_pred string, score double"


def predict(docs: DataFrame, langs: list[str], net: Reader | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row: the language of the highest mean probability, ties to the first in order.

    Null, empty and letterless texts get ``und`` and 0, as does everything where nothing was
    learned. A row's result depends on its text alone, so equal rows give equal rows; other columns
    are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column(1))
            texts = batch.column(1)
            best, score = np.full(len(texts), -1), np.zeros(len(texts))
            for a, b in slices(offsets, 4 << 20) if net is not None else ():
                letters = np.array([t is not None and any(c.isalpha() for c in t) for t in texts.slice(a, b - a).to_pylist()])
                at = np.flatnonzero(letters)
                if not len(at):
                    continue
                mean = sums(net, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[at] / np.diff(offsets[a : b + 1])[at][:, None]
                best[at + a], score[at + a] = mean.argmax(1), np.clip(mean.max(1), 0, 1)
            named = [langs[k] if k >= 0 else "und" for k in best]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
