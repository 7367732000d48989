"""What keeps the work of matching and training in proportion to items rather than to their pairs."""

import pytest
from pyspark.sql import functions as F

from panelyst.operators import blocking, graph, matching, training

ITEM = "id string, brand string, name string, gtin string, ingredients array<string>, size_value double, size_unit string, ord int, product_id string"


@pytest.fixture(scope="module")
def catalog(spark):
    names = ["red bolt", "red bolt SPF 30", "blue bolt 5%", "red ring lavender", None]
    row = lambda i: (f"i{i:02}", [None, "Brand#1", "Brand#1", "x"][i % 4], names[i % 5], f"{i % 9:012}" if i % 3 else None, [f"x{j}" for j in range(i % 3, 5 + i % 4)] if i % 7 else None, [20.3, 20.4, 50.0, None][i % 4 if i % 5 else 1], "ml", 99 - i, f"q{i // 2}" if i > 50 else f"i{i:02}")
    items = spark.createDataFrame([row(i) for i in range(70)], ITEM)
    return graph.kept(blocking.prepared(items, spark.createDataFrame([("Brand#1", "Brand#1", [], 0)], "id string, name string, aliases array<string>, ord int")), "catalog")


def test_an_item_keeps_the_two_hits_that_decide(spark, catalog):
    seen = catalog.withColumn("gtin14", F.lit(None).cast("string"))
    found = matching.hits(seen, catalog)
    near = matching.near_hits(*matching.met_by_names(seen, catalog), matching.hits_without_names(seen, catalog), catalog)
    most = lambda df: max(r["count"] for r in df.groupBy("a").count().collect())
    assert most(near) == 2 < most(found)
    shown = lambda df: sorted(map(str, df.collect()))
    assert shown(matching.resolve(seen, catalog)) == shown(matching.resolve(seen, catalog, found=found))


def test_names_are_prepared_once(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2] if i % 5 else None) for i in range(40)], "id int, name string")
    made = graph.kept(blocking.once_each(rows, "name", {"made": F.uuid()}), "made")
    assert made.count() == 40 and made.select("name", "made").distinct().count() == 3


def test_training_pairs_are_counted_without_being_drawn(catalog):
    drawn = training.labeled_sightings(catalog, brandless=1).groupBy("label", F.element_at(F.split("id", "-"), 3).alias("kind")).agg(F.count("*").alias("n"))
    counted = training.labeled_counts(catalog, brandless=1)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, drawn.collect()))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "_l" not in plan and "FlatMap" not in plan


def test_tiles_of_large_keys_grow_instead_of_being_copied(spark, monkeypatch):
    monkeypatch.setattr(blocking, "TILE_ROWS", 2)
    rows = spark.range(100).selectExpr("'k' AS key", "id")
    a, b = blocking.tiled(rows, rows, ["key"])
    assert a.count() == b.count() == 100 * blocking.TILE_BLOCKS
    assert a.withColumnRenamed("id", "x").join(b, ["key", "_l", "_r"]).select("x", "id").distinct().count() == 10000
