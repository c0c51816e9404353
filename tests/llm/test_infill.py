"""Fill-in-middle against brute force, and the wavelet matrix against counting."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from quadrille.llm import infill


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        seq = rng.integers(0, 1 << infill.LEVELS, n).astype(np.uint8)
        m = infill.WaveletMatrix(seq)
        at = np.arange(n + 1)
        for least in range(1 << infill.LEVELS):
            counts = np.concatenate([[0], np.cumsum(seq >= least)])
            assert (m.rank_from(least, at) == counts).all()
            found = np.flatnonzero(seq >= least)
            assert m.select_from(least, np.arange(len(found) + 1)).tolist() == [*found, n]


def brute(doc_id, text, seed=1):
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    x, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(u), "spm", len(x), len(m), f"<S>{s}<P>{x}<M>{m}"
    return len(u), "psm", len(x), len(m), f"<P>{x}<S>{s}<M>{m}"


def test_against_brute_force(documents, edges):
    rng = np.random.default_rng(2)
    letters = list("aZbé漢😀 \n\r\x0b.,<PSM>0")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(300)] + ["has <P> mark", "<S>", "ends <", "S>starts", "<P", "aa" * 3000]
    rows = [(i, t) for i, t in enumerate(texts)]
    for df, of in ((documents(rows), dict(rows)), (edges, None)):
        made = infill.transform(df)
        out = made.select("*", infill.restored(made.fim_text, made.form).alias("again")).collect()
        assert len(out) == df.count()
        for r in out:
            text = r.text or ""
            assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.fim_text) == brute(r.doc_id, text) and r.again == text
            assert r.size == 1 and r.key == "k"  # the caller's columns stay
    forms = {infill_row.form for infill_row in infill.transform(documents(rows)).collect()}
    assert forms == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", ["char", "word"])
def test_units(unit):
    text = "  Ab cd, éf gh"
    n = {"char": 14, "word": 4}[unit]
    cuts = {"char": list(range(15)), "word": [0, 5, 10, 12, 14]}[unit]
    for k in range(n + 1):
        got = infill.places(pa.array([None, text, ""]), np.array([0, k, 3]), np.array([5, n, 4]), unit)
        assert got[0].tolist() == [0, n, 0]
        assert got[1].tolist() == [0, 0 if k == 0 else cuts[k], 0] and got[2].tolist() == [0, len(text) - got[1][1], 0]


def test_empty_table_and_clashing_names(spark, nothing):
    assert infill.transform(nothing).count() == 0
    df = spark.createDataFrame([(1, "a b", "mine", 7, 8)], "doc_id long, text string, form string, _row int, _cut int")
    r = infill.transform(df).first()
    assert (r._row, r._cut, r.text) == (7, 8, "a b") and r.form in ("plain", "psm", "spm") and len(r) == 9
