"""Synchronisation by hash trees: the statuses of the plain comparison, and only changed leaves are read."""

import random

from quadrille.operators import hashtree, sync

SCHEMA = "spec string, hub_id string, content_hash string"


def _rows(n=600):
    rng = random.Random(5)
    return [(f"d{i % 7}" if i % 7 else None, f"h{i}", f"c{rng.randrange(9)}" if i % 11 else None) for i in range(n)]


def _statuses(df):
    return sorted(((r.hub_id or ""), r.status) for r in df.collect())


def _by_tree(spark, incoming, stored, folder, **sizes):
    path = str(folder)
    hashtree.write_tree(spark.createDataFrame(stored, SCHEMA), path, **sizes)
    return hashtree.classify_by_tree(spark.createDataFrame(incoming, SCHEMA), path, **sizes)


def test_same_statuses_as_the_plain_comparison(spark, tmp_path):
    stored = _rows()
    incoming = [(s, h, "new" if i % 50 == 3 else c) for i, (s, h, c) in enumerate(stored) if i % 40 != 5]
    # moved to another dataset, with and without a change; new records and a new dataset; records without id
    incoming += [("d2", "h5", stored[5][2]), ("d3", "h45", "other"), ("d1", "x1", "c"), ("d9", "x2", None), ("d1", None, "c")]
    stored += [("d8", "y1", "c"), ("d1", None, "c"), ("d1", "y2", None)]
    plain = sync.classify_sync(spark.createDataFrame(incoming, SCHEMA), spark.createDataFrame(stored, SCHEMA))
    for k, sizes in enumerate([{"leaves": 4, "folders": 3}, {"leaves": 64, "folders": 16}, {"leaves": 1, "folders": 1}]):
        assert _statuses(_by_tree(spark, incoming, stored, tmp_path / str(k), **sizes)) == _statuses(plain)


def test_leaves_that_are_too_many_to_send(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hashtree, "SENT_LEAVES", 0)
    stored = _rows(200)
    incoming = [(s, h, "new" if h.endswith("7") else c) for s, h, c in stored]
    plain = sync.classify_sync(spark.createDataFrame(incoming, SCHEMA), spark.createDataFrame(stored, SCHEMA))
    assert _statuses(_by_tree(spark, incoming, stored, tmp_path / "t", leaves=8, folders=4)) == _statuses(plain)


def test_unchanged_datasets_read_no_records(spark, tmp_path):
    stored = _rows()
    path = str(tmp_path / "t")
    hashtree.write_tree(spark.createDataFrame(stored, SCHEMA), path, leaves=16, folders=8)
    digests = hashtree.leaf_digests(spark.createDataFrame(stored[::-1], SCHEMA), 16)
    same = hashtree.differing_leaves(digests, spark.read.parquet(f"{path}/leaves"))
    assert same.count() == 0
    assert hashtree.read_leaves(spark, path, same, folders=8).inputFiles() == []
    # one changed record opens one leaf, which lies in one folder of eight
    one = [("d1", "h1", "changed") if h == "h1" else (s, h, c) for s, h, c in stored]
    few = hashtree.differing_leaves(hashtree.leaf_digests(spark.createDataFrame(one, SCHEMA), 16), spark.read.parquet(f"{path}/leaves"))
    assert few.count() == 1
    files = hashtree.read_leaves(spark, path, few, folders=8)
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "folder" in plan
    assert {r.hub_id for r in files.collect()} >= {"h1"}
    assert all(r.spec == "d1" for r in files.collect())


def test_roots_are_sums_of_leaves_and_order_does_not_matter(spark):
    a, b = (hashtree.leaf_digests(spark.createDataFrame(rows, SCHEMA).repartition(p), 8) for rows, p in ((_rows(), 3), (_rows()[::-1], 5)))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    roots = {r.spec: r.n for r in hashtree.dataset_digests(a).collect()}
    assert sum(roots.values()) == 600 and len(roots) == 7


def test_empty_sides(spark, tmp_path):
    rows = _rows(30)
    assert {s for _, s in _statuses(_by_tree(spark, [], rows, tmp_path / "a"))} == {"orphaned"}
    assert {s for _, s in _statuses(_by_tree(spark, rows, [], tmp_path / "b"))} == {"new"}
    assert _statuses(_by_tree(spark, [], [], tmp_path / "c")) == []


def test_the_snapshot_needs_no_labels(spark, sf_dir):
    from quadrille.plans.bridge import table

    hashes = table(spark, sf_dir, "snapshot").select("hub_id", "content_hash")
    assert "Join" not in hashes._jdf.queryExecution().optimizedPlan().toString()
    assert table(spark, sf_dir, "docs").filter("toxic is not null").count() == table(spark, sf_dir, "labels").count()
