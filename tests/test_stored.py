import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyst.operators import training
from panelyst.operators.blocking import prepared
from panelyst.plans import adapters as a
from panelyst.sources import feed, stored
from panelyst.sources.store import Store

from .conftest import DATA
from .test_growing import NOW, answer, catalog


def test_rows_and_tables(spark):
    rows = spark.createDataFrame([("b1", "A", None, '["x", "y"]'), ("b2", "B", "b1", None), ("b3", "C", "b1", "null"), ("b4", "D", "b1", "{broken")], "id string, name string, parent_id string, aliases string")
    got = {r.id: (r.parent_id, r.aliases) for r in stored.from_rows("brand", rows).collect()}
    assert got == {"b1": (None, ["x", "y"]), "b2": ("b1", []), "b3": ("b1", []), "b4": ("b1", [])}
    again = {r.id: r.aliases for r in stored.to_rows("brand", stored.from_rows("brand", rows)).collect()}
    assert again == {"b1": '["x","y"]', "b2": "[]", "b3": "[]", "b4": "[]"}
    flags = spark.createDataFrame([("f", '[{"body": "EU", "stance": "concern"}]', '["n"]'), ("g", None, "[1")], "id string, positions string, notes string")
    got = {r.id: ([tuple(p) for p in r.positions], r.notes) for r in stored.from_rows("flag", flags).collect()}
    assert got == {"f": ([("EU", "concern")], ["n"]), "g": ([], [])}
    sources = spark.createDataFrame([("s1", "labor", "higher_is_better", "nonprofit"), ("s2", "smell", "higher_is_better", None)], "id string, axis string, scale_direction string, funding_model string")
    assert sorted(map(tuple, stored.unknown_values(sources).collect())) == [("s2", "axis", "smell"), ("s2", "funding_model", None)]
    assert stored.from_rows("source", sources).count() == 2


def test_seeding_replaces_whole_tables(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", stored.KEYS, buckets=2)
    brand = spark.createDataFrame([(f"b{i}", f"N{i}", None, ["x"]) for i in range(9)], feed.BRAND_ROW)
    match = spark.createDataFrame([("l1", "p1", 1.0, "seed", False)], feed.MATCH_ROW)
    assert {r.table: r.n for r in stored.seed(store, {"brand": brand, "match": match}).collect()} == {"brand": 9, "match": 1}
    assert {r.table: r.n for r in stored.seed(store, {"brand": brand.limit(2), "match": match.limit(0)}).collect()} == {"brand": 2, "match": 0}
    assert stored.from_rows("brand", store.read("brand")).first().aliases == ["x"]


@pytest.fixture
def landed(tmp_path):
    at = tmp_path / "landed"
    at.mkdir()
    rows = [answer("11111111", "Rose Cream"), answer("22222222", "Night Serum Gold"), answer("22222223", "Night Serum Gold"), "{broken", json.dumps({"code": "9", "status": 0}), answer("33333333", "Soap", "Shore", ecoscore_score=3)]
    (at / "x.json").write_text("\n".join(rows))
    return f"file://{at}"


def test_ingestion_job(spark, tmp_path, landed):
    store = Store(spark, f"file://{tmp_path}/t", feed.TABLES, buckets=2)
    feed.seeded(store, *catalog(spark))
    job = lambda *argv: feed.run_job(spark, [*argv, "--landed", landed, "--tables", f"file://{tmp_path}/t"], NOW).first().asDict()
    whole = {"fetched": 4, "not_found": 1, "invalid": 1, "matched": 1, "created": 2, "joined": 1, "ratings": 1}
    assert job("--dry") == whole and store.manifest()["version"] == 1
    assert job("1111-1111", "--dry") == dict.fromkeys(whole, 0) | {"fetched": 1, "matched": 1}
    assert job("--search", "SHORE", "--dry") == dict.fromkeys(whole, 0) | {"fetched": 1, "created": 1, "ratings": 1}
    assert job("--search", "serum", "--limit", "1", "--dry") == dict.fromkeys(whole, 0) | {"fetched": 1, "created": 1}
    assert job() == whole and store.read("product").count() == 3 and store.read("rating").count() == 1


def _fit(x, y, epochs, rate, l2):
    """Gradient descent one row and one weight at a time."""
    w, b = [0.0] * len(x[0]), 0.0
    for _ in range(epochs):
        grad, bias = [0.0] * len(w), 0.0
        for row, label in zip(x, y, strict=True):
            err = 1 / (1 + np.exp(-(sum(p * q for p, q in zip(row, w, strict=True)) + b))) - label
            grad = [g + err * v for g, v in zip(grad, row, strict=True)]
            bias += err
        w = [p - rate * (g / len(y) + l2 * p) for p, g in zip(w, grad, strict=True)]
        b -= rate * bias / len(y)
    return w, b


def test_training_against_an_independent_fit(spark, monkeypatch):
    """Labelled pairs of the catalog: the same weights from plain loops, and from jobs in place of the driver's arrays."""
    items = prepared(a.items(spark, DATA).limit(30), a.brands(spark, DATA)).cache()
    rows = training.labeled_pairs(items, a.brands(spark, DATA), brandless=1).select("id", "vector", "label").cache()
    got = rows.collect()
    assert {r.label for r in got} == {0, 1} and len(got) > 100
    want_w, want_b = _fit([r.vector for r in got], [r.label for r in got], 12, 0.3, 1e-3)
    for most in (training.DISTINCT_MOST, 5):
        monkeypatch.setattr(training, "DISTINCT_MOST", most)
        model = training.train_logistic(rows, epochs=12)
        assert np.allclose(model.weights, want_w, atol=1e-9) and abs(model.bias - want_b) < 1e-9
    with pytest.raises(ValueError):
        training.train_logistic(rows.where(F.lit(False)))
