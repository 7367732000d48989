import json
import os

import pytest
from pyspark.sql import functions as F

from panelyst.operators.blocking import prepared
from panelyst.sources import feed
from panelyst.sources.store import Merge, Store
from panelyst.streaming.growing import grow_stream

NOW = "2024-01-01 00:00:00"


def answer(code, name, brand="Glow", **more):
    product = {"code": code, "product_name": name, "brands": brand, "quantity": "50 ml", "categories": "Skin, Cream"} | more
    return json.dumps({"code": code, "status": 1, "product": product})


#: Three files: known and new products; the same new ones under other listings; a repeated listing with other ratings.
FILES = [
    [answer("11111111", "Rose Cream"), answer("22222222", "Night Serum Gold"), answer("22222223", "Night Serum Gold "), "{broken", answer("", "No Code At All", "")],
    [answer("33333333", "Night Serum Gold"), answer("44444444", "Sea Salt Soap", "Shore"), answer("44444445", "Sea Salt Soap", "Shore", ecoscore_score=40, ecoscore_grade="b")],
    [answer("44444445", "Sea Salt Soap", "Shore", ecoscore_score=60), answer("44444446", "Sea Salt Soap", "Shore"), answer("11111111", "Rose Cream", ecoscore_score=1)],
]


def catalog(spark):
    product = spark.createDataFrame([("p1", "b1", "Rose Cream", "Cream", "11111111", 50.0, "ml", ["a"], 1)], feed.PRODUCT_ROW)
    brand = spark.createDataFrame([("b1", "Glow", None, ["Glow"])], feed.BRAND_ROW)
    return product, brand


def land(tmp_path, n, first=0):
    at = tmp_path / "landed"
    at.mkdir(exist_ok=True)
    for i in range(first, n):
        (at / f"{i}.json").write_text("\n".join(FILES[i]))
        os.utime(at / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return f"file://{at}"


def new_store(spark, tmp_path, name):
    store = Store(spark, f"file://{tmp_path}/{name}", feed.TABLES, buckets=2)
    feed.seeded(store, *catalog(spark))
    return store


def run(spark, store, tmp_path, name):
    landed = spark.readStream.option("maxFilesPerTrigger", 1).option("latestFirst", False).text(f"file://{tmp_path}/landed").withColumnRenamed("value", "raw")
    grow_stream(landed, store, f"file://{tmp_path}/{name}-checkpoint", lambda: NOW, quarantine=f"file://{tmp_path}/{name}-bad", once=True).awaitTermination()


def tables(store):
    cols = {"listing": ["id", "raw_name"], "rating": ["listing_id", "score_raw"], "match": ["listing_id", "product_id", "method"], "product": ["id", "brand_id", "display_name"], "brand": ["id", "name"]}
    return {t: sorted(map(str, store.read(t).select(*c).collect())) for t, c in cols.items()}


def test_growth_stops_and_restarts(spark, tmp_path, monkeypatch):
    """A stream that stops before a manifest, and after one but before its checkpoint, ends like one that never stops."""
    land(tmp_path, 3)
    whole = new_store(spark, tmp_path, "whole")
    run(spark, whole, tmp_path, "whole")
    assert whole.applied("feed") == 2
    got = {r.listing_id: (r.product_id, r.method) for r in whole.read("match").collect()}
    assert got["obf-11111111"] == ("p1", "obf-auto")
    # minted once, named after the least listing; later listings find it in the catalog
    assert got["obf-22222222"] == ("prod-obf-22222222", "obf-new") == got["obf-22222223"]
    assert got["obf-33333333"] == ("prod-obf-22222222", "obf-auto")
    assert got["obf-44444446"][0] == "prod-obf-44444444" and got["obf-44444445"][0] == "prod-obf-44444444"
    ratings = {r.listing_id: r.score_raw for r in whole.read("rating").collect()}
    assert ratings == {"obf-44444445": 60.0, "obf-11111111": 1.0}
    assert {r.id for r in whole.read("brand").collect()} == {"b1", "brand-unknown", "brand-obf-shore"}
    assert spark.read.parquet(f"file://{tmp_path}/whole-bad/batch=0").count() == 1

    store = new_store(spark, tmp_path, "stopped")
    commit = Store._commit

    def before(self, m):
        if m["batches"].get("feed") == 0:
            raise RuntimeError("stopped before the manifest")
        commit(self, m)

    def after(self, m):
        commit(self, m)
        if m["batches"].get("feed") == 1:
            raise RuntimeError("stopped after the manifest")

    for stop in (before, after):
        monkeypatch.setattr(Store, "_commit", stop)
        with pytest.raises(Exception, match="stopped"):
            run(spark, store, tmp_path, "stopped")
        monkeypatch.undo()
    assert store.applied("feed") == 1
    run(spark, store, tmp_path, "stopped")
    assert tables(store) == tables(whole)


def test_one_batch_equals_ingest(spark, tmp_path):
    at = land(tmp_path, 2)
    store = new_store(spark, tmp_path, "one")
    good, _ = feed.parsed(feed.read_landed(spark, at))
    assert feed.ingest_into(store, good, NOW, ("feed", 0)) and not feed.ingest_into(store, good, NOW, ("feed", 0))
    product, brand = catalog(spark)
    brands = brand.withColumn("ord", F.lit(0))
    items = product.select("id", F.lit("Glow").alias("brand"), F.col("display_name").alias("name"), "gtin", "ingredients", "size_value", "size_unit", F.lit(0).alias("ord"), F.col("id").alias("product_id"))
    want = feed.ingest(good, prepared(items, brands), brands, NOW)["match"]
    pairs = lambda df: sorted((r.listing_id, r.product_id) for r in df.collect())
    assert pairs(store.read("match")) == pairs(want)
    # the same feed again: every listing stays with its product, minted ids are the same, and a review is kept
    human = store.read("match").where("listing_id = 'obf-44444445'").withColumn("reviewed", F.lit(True)).withColumn("product_id", F.lit("p1"))
    before = dict(pairs(store.read("match"))) | {"obf-44444445": "p1"}
    store.merge({"match": Merge(human)})
    assert feed.ingest_into(store, good, NOW, ("feed", 1))
    assert dict(pairs(store.read("match"))) == before
    assert store.read("product").count() == 1 + len({p for p in before.values() if p.startswith("prod-")} | {"prod-obf-44444444"})


def test_minting_with_known_products(spark):
    grouped = spark.createDataFrame([("c", "a"), ("a", "a"), ("b", "a"), ("x", "x"), ("y", "x")], "id string, cluster_id string")
    known = spark.createDataFrame([("b", "prod-q"), ("c", "prod-m"), ("z", "prod-z")], "listing_id string, product_id string")
    got = {r.id: r.product_id for r in feed.minted(grouped, known).collect()}
    assert got == {"a": "prod-m", "b": "prod-q", "c": "prod-m", "x": "prod-x", "y": "prod-x"}
