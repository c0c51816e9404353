"""Every registered query against its SQL on the smallest tables."""

import sys
from decimal import Decimal

import duckdb
import pytest

from quadrille import catalog
from quadrille.plans.bridge import TABLES


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def cell(v):
    if isinstance(v, (float, Decimal)):
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted([cell(r[c]) for c in columns] for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted([cell(r[i]) for i in at] for r in rel.fetchall())


def test_stands_without_the_llm_folder(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("quadrille.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "quadrille.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__ as entry

    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.ORACLE_SQL)
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_more_like_this_against_brute_force(spark):
    import math
    from collections import Counter, defaultdict

    from pyspark.sql import functions as F

    from quadrille.operators.search import more_like_this

    rows = [(f"d{i}", " ".join(f"t{(i * k) % 13}" for k in range(1, 9))) for i in range(30)]
    got = defaultdict(dict)
    for r in more_like_this(spark.createDataFrame(rows, "hub_id string, text string"), F.col("text"), 4, terms=3, max_df=20).collect():
        got[r.hub_id][r.related] = r.score
    tf = {d: Counter(t.split()) for d, t in rows}
    df = Counter(t for c in tf.values() for t in c)
    idf = {t: math.log(1 + 30 / n) for t, n in df.items() if 2 <= n <= 20}
    for d, c in tf.items():
        best = sorted(((-round(n * idf[t], 6), t) for t, n in c.items() if t in idf))[:3]
        score = {e: round(sum(-w * idf[t] for w, t in best if t in o), 4) for e, o in tf.items() if e != d}
        want = sorted(((-s, e) for e, s in score.items() if s > 0))[:4]
        assert sorted(got[d].values(), reverse=True) == pytest.approx([-s for s, _ in want], abs=2e-4)
