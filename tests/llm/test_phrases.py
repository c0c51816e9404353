"""Phrase collocations against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

from quadrille.llm import phrases

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, most):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
        w = re.findall(r"[^\x20\x09]+", piece)
        for m in range(1, most + 1):
            for i in range(len(w) - m + 1):
                yield tuple(w[i : i + m])


def brute(rows, least, most, percent, top):
    out = []
    for lang in {lang or "und" for _, _, lang in rows}:
        f = Counter(g for _, t, x in rows if (x or "und") == lang for g in grams(t, most))
        n = sum(c for g, c in f.items() if len(g) == 1)
        cands = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        kept = []
        for g, a in cands.items():
            score, _, l, r = min(((1000 * a * n) // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            if not any(len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h))) and 100 * c >= percent * a for h, c in cands.items()):
                kept.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "most", "percent", "top", "shard_bytes"), [(5, 5, 100, 2000, 1 << 24), (5, 5, 100, 2000, 2500), (3, 4, 60, 15, 4000), (1, 3, 100, 2000, 9000), (4, 2, 100, 7, 3000)])
def test_against_brute_force(documents, least, most, percent, top, shard_bytes):
    rng = np.random.default_rng(least + most)
    vocabulary = ["a", "b", "A", "c", "Éé", "漢字", "d-e", "f'g", "\xa0x", "p q"]
    fixed = ["in the long run", "a b a b a", "of course , in the long run", "new york city"]
    rows = []
    for i in range(60):
        words = [str(rng.choice(vocabulary)) if rng.random() < 0.7 else str(rng.choice(fixed)) for _ in range(rng.integers(0, 40))]
        seps = [str(rng.choice([" ", "  ", "\t", " ", ". ", ";", "\n", "\x0b", "!?"])) for _ in words]
        rows.append((i, "".join(w + s for w, s in zip(words, seps, strict=True)), rng.choice(["en", "de", None], p=[0.6, 0.3, 0.1])))
    rows += [(60, None, "en"), (61, "", "fr"), (62, " \t. ", "fr"), (3, rows[3][1], rows[3][2])]
    made = phrases.collocations(documents([(i, t, "s", lang) for i, t, lang in rows]), least, most, percent, top, shard_bytes)
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in made.collect())
    assert got == brute(rows, least, most, percent, top)


def test_edges_and_empty_table(edges, nothing):
    assert phrases.collocations(nothing).count() == 0
    assert phrases.collocations(edges.filter("doc_id in (1, 2, 3)"), shard_bytes=1).count() == 0
    rows = [(r.doc_id, r.text, r.lang) for r in edges.collect()]
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(edges, least=60, top=500).collect())
    assert got == [x for x in brute([r for r in rows], 60, 5, 100, 500)]


def test_counts_beyond_64_bits(spark):
    """A product of counts may pass 64 bits."""
    from pyspark.sql import functions as F

    big = spark.createDataFrame([(3 * 10**9, 10**12, 10**9, 10**9)], "a long, n long, l long, r long")
    d = lambda c: F.col(c).cast("decimal(19,0)")
    made = big.withColumn("_above", F.lit(1000).cast("decimal(4,0)") * d("a") * d("n")).withColumn("_below", d("l") * d("r"))
    assert made.select(F.expr("_above div _below").alias("s")).first().s == 1000 * 3 * 10**9 * 10**12 // 10**18
