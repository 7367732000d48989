import random

import pytest
from pyspark.sql import functions as F

from panelyst.operators.graph import connected
from panelyst.sources import kept_components as kc
from panelyst.sources.store import Merge, Store


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merges_touch_only_their_buckets(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", {"t": "k", "u": "k"}, buckets=8)
    assert store.read("t", "k int, v string, seen string").count() == 0 and store.applied("x") == -1
    first = spark.createDataFrame([(i, f"v{i}", "no") for i in range(200)], "k int, v string, seen string")
    assert store.merge({"t": Merge(first), "u": Merge(first.limit(0))}, ("x", 0))
    assert rows(store.read("t")) == rows(first) and store.read("u", "k int, v string, seen string").count() == 0
    before = store.manifest()["tables"]["t"]["folders"]
    again = spark.createDataFrame([("yes", 7, "new"), ("yes", 1000, "new")], "seen string, k int, v string")
    assert store.merge({"t": Merge(again, keep=("seen",))}, ("x", 1))
    after = store.manifest()["tables"]["t"]["folders"]
    assert 0 < sum(before[b] != after[b] for b in before) <= 2
    got = {r.k: (r.v, r.seen) for r in store.read("t").collect()}
    assert len(got) == 201 and got[7] == ("new", "no") and got[1000] == ("new", "yes") and got[8] == ("v8", "no")
    # a batch that is in changes nothing, also under another number of rows
    assert not store.merge({"t": Merge(first.limit(3))}, ("x", 1)) and store.manifest()["version"] == 2
    # old versions stay readable until they are cleared
    assert rows(store.read("t", version=1)) == rows(first)
    assert store.vacuum(versions=1) > 0 and {r.k: (r.v, r.seen) for r in store.read("t").collect()} == got
    # all rows of a key go, also for none
    store.merge({"t": Merge(first.limit(0), replaced=spark.createDataFrame([(k,) for k in got], "k int"))})
    assert store.read("t").count() == 0 and store.applied("x") == 1


@pytest.mark.parametrize("step", ["first table", "second table", "manifest"])
def test_a_run_that_stops_leaves_old_or_new(spark, tmp_path, monkeypatch, step):
    keys = {"t": "k", "u": "k"}
    store = Store(spark, f"file://{tmp_path}/s", keys, buckets=4)
    one = spark.createDataFrame([(i, "old") for i in range(20)], "k int, v string")
    store.merge({"t": Merge(one), "u": Merge(one)})
    new = one.withColumn("v", F.lit("new"))
    bad = new.withColumn("v", F.assert_true(F.col("k") < 5, "stopped").cast("string"))
    stop = (bad, new) if step == "first table" else (new, bad) if step == "second table" else (new, new)
    if step == "manifest":
        monkeypatch.setattr(Store, "_commit", lambda self, m: 1 / 0)
    with pytest.raises(Exception):  # noqa: B017
        store.merge({"t": Merge(stop[0]), "u": Merge(stop[1])}, ("x", 0))
    monkeypatch.undo()
    again = Store(spark, f"file://{tmp_path}/s", keys)
    assert rows(again.read("t")) == rows(one) == rows(again.read("u")) and again.applied("x") == -1
    assert again.merge({"t": Merge(new), "u": Merge(new)}, ("x", 0))
    assert rows(again.read("t")) == rows(new) == rows(again.read("u"))
    again.vacuum(1)
    assert rows(again.read("u")) == rows(new)


def test_two_writers(spark, tmp_path):
    a = Store(spark, f"file://{tmp_path}/s", {"t": "k"})
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    a.merge({"t": Merge(one)})
    with pytest.raises(RuntimeError, match="another writer"):
        a._commit({"version": 1, "tables": {}, "batches": {}})
    assert rows(a.read("t")) == [(1, "a")]


def test_kept_components_equal_a_full_run(spark, tmp_path):
    rng = random.Random(4)
    store = Store(spark, f"file://{tmp_path}/s", kc.TABLES, buckets=4)
    kept = kc.KeptComponents(store, "long")
    links = []
    for batch in range(10):
        # chains within a batch, links between old ones, links that are there already, a node by itself
        fresh = [(rng.randrange(300), rng.randrange(300)) for _ in range(12)] + [(1000 + 10 * batch + i, 1001 + 10 * batch + i) for i in range(5)]
        fresh += [(5000 - batch, 5000 - batch), (None, 3)] + rng.sample(links, min(2, len(links)))
        links += fresh
        df = spark.createDataFrame(fresh, "a long, b long")
        assert kept.add(df, ("links", batch))
        if batch % 3 == 0:
            assert not kept.add(spark.createDataFrame([(1, 299)], "a long, b long"), ("links", batch))
    whole = spark.createDataFrame(links, "a long, b long").where("a IS NOT NULL AND b IS NOT NULL")
    want = {r.node: r.root for r in connected(whole).collect()}
    got = {r.node: r.root for r in kept.read().collect()}
    assert {n: r for n, r in got.items() if n in want} == want and len(got) > 150
    assert all(n == r for n, r in got.items() if n not in want) and {5000, 4991} <= set(got)
    # a link between two components moves roots, not the nodes of either
    before = store.manifest()["tables"]["node"]
    a, b = sorted({r for r in got.values()})[:2]
    kept.add(spark.createDataFrame([(a, b)], "a long, b long"))
    assert store.manifest()["tables"]["node"] == before
    assert {r.root for r in kept.read().where(F.col("node").isin(a, b)).collect()} == {a}
