"""Queries of ingest and synchronisation, and of their statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import hashtree
from ..operators import media as M
from ..operators import sync as S
from ..operators.tables import shared_folder
from ..registry import query
from .bridge import BASE, QSYNC, RDF_TYPE, plain, table


def _q(sql: str):
    return query(plain(sql))


_ROUTED = "SELECT *, CASE WHEN action NOT IN ('index', 'clear_orphans', 'disable_index', 'drop_dataset') THEN 'unknown action' END AS error FROM (SELECT seq, CASE WHEN seq % 97 = 0 THEN 'noise' ELSE action END AS action, spec, graph, hub_id, content_hash, acceptance, modified_at FROM {actions})"


def _routed(spark, d):
    a = table(spark, d, "actions")
    return S.route_actions(a.withColumn("action", F.when(F.col("seq") % 97 == 0, "noise").otherwise(F.col("action"))))


@_q(f"SELECT seq, coalesce(CASE WHEN error IS NULL THEN action END, 'error') AS route, error, acceptance = 'true' AS acceptance FROM ({_ROUTED})")
def route_actions(spark, d):
    return _routed(spark, d).select("seq", "route", "error", "acceptance")


@_q("SELECT hub_id, max(seq) AS seq FROM {actions} WHERE action = 'index' GROUP BY hub_id")
def latest_actions(spark, d):
    return S.latest_actions(table(spark, d, "actions").filter("action = 'index'")).select("hub_id", "seq")


@_q("SELECT hub_id, content_hash FROM {docs} a WHERE NOT EXISTS (SELECT 1 FROM {snapshot} b WHERE a.hub_id = b.hub_id AND a.content_hash = b.content_hash)")
def diff_by_hash(spark, d):
    return S.diff_by_hash(table(spark, d, "docs"), table(spark, d, "snapshot")).select("hub_id", "content_hash")


@_q("SELECT coalesce(a.hub_id, b.hub_id) AS hub_id, CASE WHEN b.hub_id IS NULL THEN 'new' WHEN a.hub_id IS NULL THEN 'orphaned' WHEN a.content_hash = b.content_hash THEN 'unchanged' ELSE 'updated' END AS status FROM {docs} a FULL JOIN {snapshot} b ON a.hub_id = b.hub_id")
def classify_sync(spark, d):
    return S.classify_sync(table(spark, d, "docs"), table(spark, d, "snapshot"))


@_q("SELECT coalesce(a.hub_id, b.hub_id) AS hub_id, CASE WHEN b.hub_id IS NULL THEN 'new' WHEN a.hub_id IS NULL THEN 'orphaned' WHEN a.content_hash = b.content_hash THEN 'unchanged' ELSE 'updated' END AS status FROM {docs} a FULL JOIN {snapshot} b ON a.hub_id = b.hub_id")
def sync_by_tree(spark, d):
    """The snapshot as a stored hash tree; of leaves without changes no record is read."""
    path = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    hashtree.write_tree(table(spark, d, "snapshot"), path)
    return hashtree.classify_by_tree(table(spark, d, "docs"), path)


@_q("SELECT s, CASE WHEN b THEN 'added' ELSE 'removed' END AS change FROM (SELECT source_uri AS s, TRUE AS b FROM {docs} WHERE source_uri NOT IN (SELECT source_uri FROM {snapshot}) UNION ALL SELECT source_uri, FALSE FROM {snapshot} WHERE source_uri NOT IN (SELECT source_uri FROM {docs}))")
def diff_subjects(spark, d):
    return S.diff_subjects(table(spark, d, "docs").select(F.col("source_uri").alias("s")), table(spark, d, "snapshot").select(F.col("source_uri").alias("s")))


@_q("SELECT hub_id, content_hash FROM {snapshot} WHERE hub_id NOT IN (SELECT hub_id FROM {docs} WHERE doc_id % 3 = 0) UNION ALL SELECT hub_id, content_hash FROM {docs} WHERE doc_id % 3 = 0 AND doc_id % 6 <> 0")
def apply_actions(spark, d):
    actions = table(spark, d, "docs").filter("doc_id % 3 = 0").withColumn("delete", F.col("doc_id") % 6 == 0)
    return S.apply_actions(table(spark, d, "snapshot"), actions).select("hub_id", "content_hash")


@_q("SELECT coalesce(a.hub_id, b.hub_id) AS hub_id, coalesce(a.content_hash, b.content_hash) AS production_hash, CASE WHEN b.hub_id IS NOT NULL THEN 'accepted' END AS acceptance_hash FROM {docs} a FULL JOIN {snapshot} b ON a.hub_id = b.hub_id")
def upsert_records(spark, d):
    stored = table(spark, d, "snapshot").select("hub_id", F.col("content_hash").alias("production_hash"), F.lit("accepted").alias("acceptance_hash"))
    return S.upsert_records(stored, table(spark, d, "docs"))


@_q("SELECT spec, label FROM {proxies} WHERE label NOT IN ('BUILDING') UNION ALL SELECT DISTINCT spec, 'NEW' FROM {proxies}")
def toggle_rows(spark, d):
    p = table(spark, d, "proxies").select("spec", "label")
    changes = p.filter("label = 'BUILDING'").withColumn("delete", F.lit(True)).unionByName(p.select("spec", F.lit("NEW").alias("label"), F.lit(False).alias("delete"))).unionByName(p.filter("label <> 'BUILDING'").withColumn("delete", F.lit(False)))
    return S.toggle_rows(p, changes, ["spec", "label"])


@_q("SELECT hub_id FROM {docs} WHERE spec NOT IN ('src1', 'src2')")
def delete_spec(spark, d):
    return S.delete_spec(table(spark, d, "docs"), ["src1", "src2"]).select("hub_id")


@_q("WITH p AS (SELECT concat('src', CAST(substring(spec, 2) AS INTEGER) % 25) AS spec, TIMESTAMP '2024-01-01' + CAST(max(seq) % 500 AS INTEGER) * INTERVAL '1' MINUTE AS purged FROM {actions} WHERE action = 'clear_orphans' GROUP BY 1) SELECT hub_id FROM {docs} d LEFT JOIN p ON p.spec = d.spec WHERE purged IS NULL OR d.modified_at > purged")
def remove_orphans(spark, d):
    purges = table(spark, d, "actions").filter("action = 'clear_orphans'").groupBy(F.concat(F.lit("src"), F.substring("spec", 2, 20).cast("int") % 25).alias("spec")).agg((F.lit("2024-01-01").cast("timestamp") + (F.max("seq") % 500) * F.expr("interval 1 minute")).alias("purged_at"))
    return S.remove_orphans(table(spark, d, "docs"), purges).select("hub_id")


@_q("WITH p AS (SELECT concat('src', CAST(substring(spec, 2) AS INTEGER) % 25) AS spec, TIMESTAMP '2024-01-01' + CAST(max(seq) % 500 AS INTEGER) * INTERVAL '1' MINUTE AS purged FROM {actions} WHERE action = 'clear_orphans' GROUP BY 1) SELECT p.spec, count(d.hub_id) AS removed FROM p LEFT JOIN {docs} d ON p.spec = d.spec AND d.modified_at <= purged GROUP BY p.spec")
def count_orphans(spark, d):
    purges = table(spark, d, "actions").filter("action = 'clear_orphans'").groupBy(F.concat(F.lit("src"), F.substring("spec", 2, 20).cast("int") % 25).alias("spec")).agg((F.lit("2024-01-01").cast("timestamp") + (F.max("seq") % 500) * F.expr("interval 1 minute")).alias("purged_at"))
    return S.count_orphans(table(spark, d, "docs"), purges)


@_q(
    f"WITH r AS ({_ROUTED}), i AS (SELECT * FROM r WHERE action = 'index' AND error IS NULL), c AS (SELECT * FROM i WHERE (hub_id, content_hash) NOT IN (SELECT hub_id, content_hash FROM r WHERE seq < 2000 AND action = 'index')) "
    "SELECT r.spec, count(*) AS received, count(CASE WHEN error IS NOT NULL THEN 1 END) AS errors, count(CASE WHEN action = 'index' AND error IS NULL THEN 1 END) AS indexed, coalesce(max(n), 0) AS stored, count(CASE WHEN action = 'index' AND error IS NULL THEN 1 END) - coalesce(max(n), 0) AS hash_matches FROM r LEFT JOIN (SELECT spec, count(*) AS n FROM c GROUP BY spec) s ON r.spec = s.spec GROUP BY r.spec"
)
def bulk_stats(spark, d):
    r = _routed(spark, d)
    index = r.filter("route = 'index'")
    return S.bulk_stats(r, S.diff_by_hash(index, index.filter("seq < 2000").select("hub_id", "content_hash").distinct()))


@_q("SELECT count(*) AS total, count(CASE WHEN value >= 0 AND event_type <> 'error' THEN 1 END) AS indexed, count(CASE WHEN value >= 0 AND event_type = 'error' THEN 1 END) AS deleted, count(CASE WHEN NOT value >= 0 THEN 1 END) AS invalid FROM {events}")
def index_stats(spark, d):
    return S.index_stats(table(spark, d, "events").select((F.col("event_type") == "error").alias("delete"), (F.col("value") >= 0).alias("valid")))


@_q("SELECT spec, count(*) AS n FROM {docs} GROUP BY spec ORDER BY n DESC, spec LIMIT 500")
def spec_counts(spark, d):
    return S.spec_counts(table(spark, d, "docs"))


@_q("SELECT (SELECT count(*) FROM {datasets}) AS datasets, (SELECT count(*) FROM {docs}) AS objects")
def data_counts(spark, d):
    return S.data_counts(table(spark, d, "docs"), table(spark, d, "datasets"))


@_q("SELECT d.spec, d.valid, d.deleted, count(o.hub_id) AS indexed FROM {datasets} d LEFT JOIN {docs} o ON d.spec = o.spec AND o.spec <> 'src5' GROUP BY d.spec, d.valid, d.deleted")
def dataset_statistics(spark, d):
    return S.dataset_statistics(table(spark, d, "datasets"), table(spark, d, "docs").filter("spec <> 'src5'"))


@_q("SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN d.deleted THEN 'deleted' WHEN count(o.hub_id) = 0 THEN 'not indexed' WHEN count(o.hub_id) <> d.valid THEN 'wrong count' ELSE 'correct' END AS bucket FROM {datasets} d LEFT JOIN {docs} o ON d.spec = o.spec AND o.spec <> 'src5' GROUP BY d.spec, d.valid, d.deleted) GROUP BY bucket")
def dataset_audit(spark, d):
    return S.dataset_audit(S.dataset_statistics(table(spark, d, "datasets"), table(spark, d, "docs").filter("spec <> 'src5'")))


@_q(f"SELECT concat('{BASE}/resource/dataset/', spec) AS uri, spec, spec AS owner, 0 AS total, valid, 0 AS invalid FROM {{datasets}} WHERE published")
def datasets_from_quads(spark, d):
    ds = table(spark, d, "datasets")
    rows = F.array(*[F.struct(F.lit(p).alias("p"), o.cast("string").alias("o")) for p, o in ((RDF_TYPE, F.when(F.col("published"), F.lit(QSYNC + "Dataset")).otherwise(F.lit(QSYNC + "Draft"))), (QSYNC + "datasetSpec", F.col("spec")), (QSYNC + "processedValid", F.col("valid")))])
    q = ds.select(F.concat(F.lit(f"{BASE}/resource/dataset/"), "spec").alias("s"), F.explode(rows).alias("t")).select("s", "t.p", "t.o")
    return S.datasets_from_quads(q, QSYNC)


# ---- media ----

_MEDIA = "SELECT concat('k', o_orderkey) AS media_key, concat('stem', o_custkey) AS stem, CASE o_orderkey % 4 WHEN 0 THEN 'tiff' WHEN 1 THEN 'jp2' WHEN 2 THEN 'jpeg' ELSE 'png' END AS ext, o_orderdate AS mtime FROM {orders}"


@_q(f"SELECT stem, arg_min(media_key, rk || lpad(media_key, 20, '0')) AS media_key, arg_min(e, rk || lpad(media_key, 20, '0')) AS ext FROM (SELECT *, CASE ext WHEN 'tiff' THEN 'tif' WHEN 'jpeg' THEN 'jpg' ELSE ext END AS e, CASE ext WHEN 'tiff' THEN '1' WHEN 'jp2' THEN '2' WHEN 'jpeg' THEN '3' ELSE '4' END AS rk FROM ({_MEDIA})) GROUP BY stem")
def preferred_sources(spark, d):
    m = spark.sql(_MEDIA, orders=table(spark, d, "orders")).withColumn("media_key", F.col("media_key"))
    return M.preferred_sources(m)


@_q(f"SELECT concat('k', l_orderkey) AS media_key, l_linenumber AS kind FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate + INTERVAL '30' DAY")
def stale_derivatives(spark, d):
    derived = table(spark, d, "lineitem").select(F.concat(F.lit("k"), "l_orderkey").alias("media_key"), F.col("l_linenumber").alias("kind"), F.col("l_shipdate").alias("mtime"))
    source = table(spark, d, "orders").select(F.concat(F.lit("k"), "o_orderkey").alias("media_key"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("mtime"))
    return M.stale_derivatives(derived, source)


@_q("SELECT DISTINCT concat('k', l_orderkey) AS media_key FROM {lineitem} WHERE l_orderkey NOT IN (SELECT o_orderkey FROM {orders} WHERE o_orderkey % 3 <> 0)")
def deleted_sources(spark, d):
    derived = table(spark, d, "lineitem").select(F.concat(F.lit("k"), "l_orderkey").alias("media_key"))
    source = table(spark, d, "orders").filter("o_orderkey % 3 <> 0").select(F.concat(F.lit("k"), "o_orderkey").alias("media_key"))
    return M.deleted_sources(derived, source)


@_q(
    """WITH q AS (SELECT * FROM {quads}) SELECT graph, s, p, o FROM q UNION ALL
SELECT graph, o AS s, concat('http://schemas.example.org/qterm/', k) AS p, concat('http://img.example.org/api/webresource?docType=', t, '&uri=', o, '&spec=', regexp_extract(o, '^urn:([^/]+)/', 1), x) AS o FROM q, (VALUES ('thumbSmall', 'thumbnail', '&width=220&height=220'), ('thumbLarge', 'thumbnail', '&width=500&height=500'), ('deepZoomUrl', 'deepzoom', '')) v(k, t, x) WHERE p = 'http://www.europeana.eu/schemas/edm/hasView'
UNION ALL SELECT graph, s, 'http://www.europeana.eu/schemas/edm/isShownBy', concat('http://img.example.org/api/webresource?docType=thumbnail&uri=', first, '&spec=', regexp_extract(first, '^urn:([^/]+)/', 1), '&width=500&height=500') FROM (SELECT graph, s, min(o) AS first FROM q WHERE p = 'http://www.europeana.eu/schemas/edm/hasView' GROUP BY graph, s)"""
)
def add_media_triples(spark, d):
    return M.add_media_triples(table(spark, d, "quads"), "http://img.example.org").select("graph", "s", "p", "o")
