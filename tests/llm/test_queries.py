"""The registered queries, against their SQL where there is one, and the pipeline."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quadrille.llm import decontaminate, jaccard, mixing, queries, toxicity


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rel = c.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(x) for x in columns]
    assert sorted(tuple(r[x] for x in columns) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())


COLUMNS = {
    "op1_mix_sources": {"doc_id", "size", "source_size", "target", "taken", "first_place", "slots"},
    "op2_shard": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op6_decontaminate": {"doc_id", "item_id", "share"},
    "op7_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op9_html_text": {"page_id", "url", "text", "n_chars"},
    "op10_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_covers_its_table(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    table = "pages" if "html" in name else "documents"
    assert set(df.columns) == COLUMNS[name]
    if name != "op6_decontaminate":
        assert len(rows) == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    if name == "op7_toxicity":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in rows)


def test_pii_against_brute_force(spark, sf_dir):
    """Counts and digest of every document, from the patterns as the contract states them."""
    from test_models import brute_spans

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op10_pii(spark, sf_dir).collect():
        want = brute_spans(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in want) for k in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        listed = r.spans.split(",") if r.spans else []
        assert set(f"{k}:{a}:{b}" for k, a, b in want) <= set(listed) and len(listed) == len(r.scores.split(",") if r.scores else [])


def test_toxicity_scores_are_noisy_or_of_sentences(spark, documents):
    """Each document's score from its sentences one by one."""
    rng = np.random.default_rng(5)
    weights = rng.normal(0, 1, (1 << toxicity.BITS) + 1)
    rows = [(1, "Good day. You are bad! And?"), (2, "one line\nanother line. more"), (3, ""), (4, None), (5, "word " * 500 + ". end")]
    got = {r.doc_id: r for r in toxicity.score(documents(rows), weights).collect()}
    for d, text in rows:
        sentences = [s for line in (text or "").split("\n") for s in re.split(r"(?<=[.!?])\s+", line) if s.strip()]
        p = []
        for s in sentences:
            ids, sentence, _ = toxicity.features(np.frombuffer(s.encode(), np.uint8), np.array([0, len(s.encode())]))
            assert len(set(sentence.tolist())) == 1
            p.append(1 / (1 + math.exp(-(weights[ids].sum() + weights[-1]))))
        assert got[d].score == pytest.approx(1 - math.prod(1 - x for x in p), abs=1e-9)
        assert got[d].worst == (int(np.argmax(p)) if p else None)


def test_pipeline(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "sharding"]
    weights = toxicity.train(documents, labels.select("doc_id", "toxic"))
    bad = {r.doc_id for r in toxicity.score(documents, weights).filter("score >= 0.3").collect()}
    left = documents.filter(~documents.doc_id.isin(list(bad)))
    least = {r.component_id for r in jaccard.join(left, 5, 80).collect()}
    left = left.filter(left.doc_id.isin(list(least)))
    leaks = {r.doc_id for r in decontaminate.leaks(left, benchmark).collect()}
    left = left.filter(~left.doc_id.isin(list(leaks)))
    copies = {r.doc_id: int(r.taken / r.size + 0.5) if r.size else 0 for r in mixing.mix(left).collect()}
    out = corpus_pipeline.run(spark, sf_dir)
    rows = out.collect()
    got: dict[int, int] = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {d: n for d, n in copies.items() if n}
    sizes = [sum(r["shard"] == k for r in rows) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1 and set(documents.columns) < set(out.columns)


def test_pipeline_of_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
        if k < 4:
            assert docs.columns == columns


def test_pipeline_of_odd_rows(spark, sf_dir, edges):
    """Null and empty texts, a very long one, repeated rows, a null id and clashing columns go through every stage."""
    docs, ids = edges, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert k == 4 or out.columns == edges.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        ids.append(sorted((r.doc_id for r in docs.collect()), key=str))
    # null and empty texts aren't toxic, near-duplicates or leaks, but have no words to mix; copies leave one of each
    assert ids[1] == [1, 2, 3, 4, 5, 7, None] or ids[1] == [1, 2, 3, 4, 5, 7]
    assert ids[2] == ids[1] and set(ids[3]) <= {4, 5, 7, None} and ids[4] == ids[3]
