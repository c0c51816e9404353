"""Points near centres where one cell is dense."""

import random

from pyspark.sql import functions as F

from quadrille.operators import search


def _points():
    """Half of all points in one town, some of them the same rows, the others scattered; some without a place."""
    rng = random.Random(8)
    town = [(f"t{i}", 52.3702 + rng.random() / 500, 4.8952 + rng.random() / 500) for i in range(240)]
    town += town[:20]
    far = [(f"f{i}", rng.uniform(51, 53), rng.uniform(4, 6)) for i in range(240)]
    return town + far + [("n1", None, 4.9), ("n2", 52.4, None)]


def test_dense_cells_give_the_same_pairs(spark, monkeypatch):
    rows = spark.createDataFrame(_points(), "hub_id string, lat double, lon double")
    centres = rows.withColumnRenamed("hub_id", "centre").dropDuplicates(["centre"])
    pairs = lambda: sorted((r.centre, r.hub_id, r.km) for r in search.within_distance(rows, centres, 12.0).collect())
    whole = pairs()
    monkeypatch.setattr(search, "PART_ROWS", 16)
    split = pairs()
    assert split == whole and len(whole) > 260 * 240


def test_no_part_of_a_dense_cell_is_large(spark, monkeypatch):
    monkeypatch.setattr(search, "PART_ROWS", 25)
    points = spark.range(1000).select(F.concat(F.lit("p"), "id").alias("hub_id"), F.when(F.col("id") < 500, 0).otherwise(F.col("id")).alias("cell"))
    centres = spark.range(300).select(F.col("id").alias("centre"), F.when(F.col("id") < 150, 0).otherwise(F.col("id") * 3).alias("cell"))
    a, b = search.dense_parts(points, centres, ["cell"])
    for side, of_cell in ((a, 500), (b, 150)):
        sizes = [r["count"] for r in side.groupBy("cell", "_p", "_c").count().collect()]
        assert max(sizes) < 2.2 * 25 and max(sizes) < of_cell
    met = a.join(b, ["cell", "_p", "_c"]).groupBy("hub_id", "centre").count()
    want = points.join(centres, "cell")
    assert met.count() == want.count() and met.filter("count <> 1").isEmpty()


def test_dense_cells_are_bounded_in_number(spark, monkeypatch):
    monkeypatch.setattr(search, "PART_ROWS", 1)
    monkeypatch.setattr(search, "DENSE_CELLS", 3)
    points = spark.range(40).select("id", (F.col("id") % 10).alias("cell"))
    a, _ = search.dense_parts(points, points.limit(0), ["cell"])
    assert a.filter("_p > 0").isEmpty() and a.count() == 40  # ten cells of 4 rows, none above 40 / 3
