"""Related records against brute force, where values are shared by many."""

import math
import re
import shutil
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quadrille import catalog
from quadrille.operators import search


def best(values, k):
    """{(hub_id, related, matches)} from {hub_id: set of values}."""
    out = set()
    for a, x in values.items():
        ranked = sorted((-len(x & y), b) for b, y in values.items() if a != b and x & y)
        out |= {(a, b, -n) for n, b in ranked[:k]}
    return out


@pytest.mark.parametrize("dense", [1, 3, 60])
def test_related_by_values_of_heavy_values(spark, dense):
    values = {f"d{i:02}": {("t", f"t{min(i % 17, 9)}"), ("p", f"p{i % 2}"), *[("s", f"s{j}") for j in range(4) if (i * 7 + j * 5) % 3 == 0]} for i in range(70)}
    entry = "map<string,array<struct<raw:string>>>"
    rows = []
    for h, v in values.items():
        fields = defaultdict(list)
        for f, x in v:
            fields[f].append((x,))
        rows.append((h, dict(fields)))
    docs = spark.createDataFrame(rows, f"hub_id string, fields {entry}")
    got = {tuple(r) for r in search.related_by_values(docs, ["t", "p", "s"], 5, dense=dense).select("hub_id", "related", "matches").collect()}
    assert got == best(values, 5)


@pytest.mark.parametrize("wide", [1, 10])
def test_related_by_values_of_wide_sets_and_filters(spark, monkeypatch, wide):
    """Sets too wide for all their parts, and conditions on the related records."""
    monkeypatch.setattr(search, "WIDE", wide)
    values = {f"d{i:02}": {("s", f"s{j}") for j in range(12) if (i * j + j) % (2 + i % 3) == 0 or i % 9 == 0} for i in range(45)}
    docs = spark.createDataFrame([(h, {"s": [(x,) for _, x in v]}) for h, v in values.items()], "hub_id string, fields map<string,array<struct<raw:string>>>")
    for where, allowed in ((None, set(values)), (F.substring("hub_id", 3, 1) == "4", {h for h in values if h[2] == "4"})):
        got = {tuple(r) for r in search.related_by_values(docs, ["s"], 4, dense=2, where=where).select("hub_id", "related", "matches").collect()}
        want = set()
        for a, x in values.items():
            ranked = sorted((-len(x & y), b) for b, y in values.items() if a != b and x & y and b in allowed)
            want |= {(a, b, -n) for n, b in ranked[:4]}
        assert got == want


def test_related_by_values_query_keeps_values_of_many_records(spark, sf_dir, tmp_path):
    shutil.copytree(sf_dir, tmp_path / "d")
    at = tmp_path / "d/documents.parquet"
    t = pq.read_table(at)
    one = pa.array(["src0"] * t.num_rows, t.schema.field("source").type)
    (tmp_path / "d").chmod(0o755)
    at.chmod(0o644)
    pq.write_table(t.set_column(t.schema.get_field_index("source"), "source", one), at)
    got = catalog.QUERIES["related_by_values"](spark, str(tmp_path / "d")).groupBy("hub_id").agg(F.count("*").alias("n")).collect()
    assert len(got) == t.num_rows and {r.n for r in got} == {5}


def ranked_by_brute_force(texts, k, terms):
    tf = {d: Counter(w for w in re.split(r"[\W_]+", t.lower()) if w) for d, t in texts.items()}
    df = Counter(t for c in tf.values() for t in c)
    idf = {t: math.log(1 + len(texts) / n) for t, n in df.items() if n >= 2}
    out = {}
    for d, c in tf.items():
        top = sorted((-round(n * idf[t], 6), t) for t, n in c.items() if t in idf)[:terms]
        score = {e: round(sum(-w * idf[t] for w, t in top if t in o), 4) for e, o in tf.items() if e != d}
        out[d] = sorted((s for s in score.values() if s > 0), reverse=True)[:k]
    return out


def test_more_like_this_uses_frequent_terms(spark, monkeypatch):
    texts = {f"d{i:04}": "common " * (i % 5 + 1) + f"w{i % 3} x{i % 7}" for i in range(1200)}
    monkeypatch.setattr(search, "BLOCK_DOCS", 500)
    got = defaultdict(list)
    for r in search.more_like_this(spark.createDataFrame(list(texts.items()), "hub_id string, text string"), F.col("text"), 4, terms=2).collect():
        assert r.hub_id != r.related
        got[r.hub_id].append(r.score)
    want = ranked_by_brute_force(texts, 4, 2)
    assert {d: sorted(s, reverse=True) for d, s in got.items()} == {d: pytest.approx(s, abs=2e-4) for d, s in want.items()}


def test_more_like_this_query_reads_whole_texts(spark, sf_dir):
    texts = {f"demo_{r.source}_{r.doc_id}": r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").collect()}
    got = defaultdict(list)
    for r in catalog.QUERIES["more_like_this"](spark, sf_dir).collect():
        got[r.hub_id].append(r.score)
    want = {d: s for d, s in ranked_by_brute_force(texts, 10, 12).items() if s}
    assert {d: sorted(s, reverse=True) for d, s in got.items()} == {d: pytest.approx(s, abs=2e-3) for d, s in want.items()}


def exact_ranks(texts, k, terms):
    tf = {d: Counter(t.split()) for d, t in texts.items()}
    df = Counter(t for c in tf.values() for t in c)
    idf = {t: math.log(1 + len(texts) / n) for t, n in df.items() if n >= 2}
    out = {}
    for d, c in tf.items():
        top = sorted((-round(n * idf[t], 6), t) for t, n in c.items() if t in idf)[:terms]
        score = {e: round(sum(-w * idf[t] for w, t in top if t in o), 4) for e, o in tf.items() if e != d}
        out[d] = sorted(((-s, e) for e, s in score.items() if s > 0))[:k]
    return out


def test_more_like_this_looks_beyond_the_head_only_where_it_must(spark, monkeypatch):
    texts = {f"d{i:04}": " ".join(["common"] * (i % 4 + 1) + [f"w{i % 5}", f"x{i % 90}"] * (1 + i % 2)) for i in range(900)} | {"e1": "rare once", "e2": "rare twice"}
    tables, kept = [], search.kept
    monkeypatch.setattr(search, "kept", lambda df: tables.append(kept(df)) or tables[-1])
    monkeypatch.setattr(search, "HEAD_DOCS", 400)
    monkeypatch.setattr(search, "BLOCK_DOCS", 200)
    got = defaultdict(list)
    for r in search.more_like_this(spark.createDataFrame(list(texts.items()), "hub_id string, text string"), F.col("text"), 3, terms=3).collect():
        got[r.hub_id].append((-r.score, r.related))
    want = {d: s for d, s in exact_ranks(texts, 3, 3).items() if s}
    assert {d: [e for _, e in sorted(s)] for d, s in got.items()} == {d: [e for _, e in s] for d, s in want.items()}
    # all but the two rare records find their three best, with all of their terms, in the head; before, each met all blocks
    assert [r.hub_id for r in tables[-1].filter("need > 0").orderBy("hub_id").collect()] == ["e1", "e2"]


def test_more_like_this_with_a_condition_looks_beyond_the_head_only_where_it_must(spark, monkeypatch):
    texts = {f"d{i:04}": f"common common w{i % 5}" for i in range(600)}
    tables, kept = [], search.kept
    monkeypatch.setattr(search, "kept", lambda df: tables.append(kept(df)) or tables[-1])
    monkeypatch.setattr(search, "HEAD_DOCS", 200)
    docs = spark.createDataFrame([(d, {"t": [t]}) for d, t in texts.items()], "hub_id string, words map<string,array<string>>")
    docs = docs.select("hub_id", F.transform_values("words", lambda _, v: F.transform(v, lambda x: F.struct(x.alias("value")))).alias("fields"))
    got = defaultdict(list)
    for r in search.more_like_this(docs, ["t.value"], 3, terms=2, where=F.col("hub_id") >= "d0100").collect():
        got[r.hub_id].append(r.related)
    like = lambda d: [e for e in texts if e >= "d0100" and e != d and texts[e] == texts[d]][:3]
    assert {d: sorted(e) for d, e in got.items()} == {d: like(d) for d in texts}
    assert tables[-1].filter("need > 0").isEmpty()
