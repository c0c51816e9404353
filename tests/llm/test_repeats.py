"""Repeated passages against brute force, and suffix sorting against sorting of slices."""

import numpy as np
import pytest

from quadrille.llm import repeats, suffixes


@pytest.mark.parametrize(("n", "letters", "depth"), [(200, 2, 10), (500, 1, 20), (900, 3, 50), (300, 1, 50), (300, 2, 7), (700, 2, 13)])
@pytest.mark.parametrize("most", [1 << 18, 64])
def test_suffix_order(n, letters, depth, most):
    rng = np.random.default_rng(n)
    base = rng.integers(97, 97 + letters, n).astype(np.uint8)
    text = np.concatenate([base, base[: n // 2], rng.integers(97, 97 + letters, 50).astype(np.uint8), base])
    places, held = np.arange(len(text) - depth + 1), text.tobytes()
    seen, groups = [], 0
    for order, first in suffixes.Suffixes(text, depth).equal_groups(places, most):
        seen += [held[p : p + depth] for p in places[order]]
        groups += len(first)
    assert len(seen) == len(places) and seen == sorted(seen) and groups == len(set(seen))


def brute(rows, length):
    first = lambda i: float("inf") if i is None else i
    least = {}
    for i, t in sorted(rows, key=lambda r: first(r[0])):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            least.setdefault(b[p : p + length], first(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < first(i):
                gone[p : p + length] = b"\1" * length
        starts = [p for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1])]
        ends = [p + 1 for p in range(len(b)) if gone[p] and (p + 1 == len(b) or not gone[p + 1])]
        out.append((str(i), len(b), sum(gone), list(zip(starts, ends, strict=True)), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.removed], bytes(r.kept_bytes)) for r in df.collect())


@pytest.mark.parametrize(("length", "block_bytes"), [(50, 1 << 24), (50, 3000), (12, 3000), (7, 4000)])
def test_against_brute_force(documents, length, block_bytes):
    rng = np.random.default_rng(length)
    letters = list("abcé漢 \n")
    passage = "".join(rng.choice(letters, 130))
    rows = []
    for i in range(40):
        text = "".join(rng.choice(letters, rng.integers(0, 200)))
        kind = i % 5
        if kind == 0:
            text += passage  # in most documents, at its end
        elif kind == 1:
            text = passage[20:100] + text + passage[20:100] + text
        elif kind == 2 and rows:
            text = rows[rng.integers(len(rows))][1]  # an exact copy
        elif kind == 3:
            text = "a" * int(rng.integers(0, 300)) + passage[:length]
        rows.append((int(rng.integers(1000)), text))
    rows += [(None, passage), (None, passage), (5, None), (6, ""), (rows[3][0], passage), (rows[3][0], passage), (2000, "x" * (length - 1)), (2001, "x" * (length - 1))]
    made = repeats.cut_repeats(documents(rows), length, block_bytes)
    assert found(made) == brute(rows, length)
    assert all(r.size == 1 and r.key == "k" for r in made.collect())  # the caller's columns stay


def test_edges_and_empty_table(spark, edges, nothing):
    short = [(r.doc_id, r.text) for r in edges.collect() if r.doc_id != 4]
    assert found(repeats.cut_repeats(edges.filter("doc_id is null or doc_id <> 4"))) == brute(short, 50)
    long = repeats.cut_repeats(edges).filter("doc_id = 4").first()
    assert long.n_removed == 0 and bytes(long.kept_bytes).decode() == long.text
    assert repeats.cut_repeats(nothing).count() == 0
    clash = spark.createDataFrame([(1, "a" * 60, 7, 8, 9), (2, "a" * 60, 7, 8, 9)], "doc_id long, text string, block int, _text int, n_bytes int")
    assert sorted((r.doc_id, r.block, r._text, r.n_bytes, r.n_removed) for r in repeats.cut_repeats(clash).collect()) == [(1, 7, 8, 60, 0), (2, 7, 8, 60, 60)]
    with pytest.raises(ValueError, match="7 at least"):
        repeats.cut_repeats(edges, length=6)
