"""The blocking index that stays, bounds of Jaro-Winkler, the sweep over ranges, and search by trigrams."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelyst.functions.similarity import character_set, jaro_winkler_most, jaro_winkler_of
from panelyst.operators import catalog, matching, training
from panelyst.operators.block_index import BlockIndex
from panelyst.operators.blocking import prepared
from panelyst.operators.search import SearchIndex
from panelyst.plans import adapters as a

from .conftest import DATA


def exchanges_below(plan: str, scan: str) -> int:
    """Exchanges between the root and the scan of a table whose name holds ``scan``, by the indentation of the plan."""
    lines = [x for x in plan.splitlines() if x.strip()]
    at = next(i for i, x in enumerate(lines) if "Scan" in x and scan in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    inner, count = depth(lines[at]), 0
    for x in reversed(lines[:at]):
        if depth(x) < inner:
            inner = depth(x)
            count += "Exchange hashpartitioning" in x
    return count


def test_index_resolves_like_the_whole_catalog(spark):
    brands = a.brands(spark, DATA)
    catalog = prepared(a.items(spark, DATA), brands).cache()
    seen = prepared(training.synthetic_sightings(a.items(spark, DATA)), brands)
    index = BlockIndex(spark, "blocks").build(catalog, 4)
    got = {r.id: (r.product_id, round(r.confidence, 9), r.ambiguous) for r in index.resolve(seen).collect()}
    want = {r.id: (r.product_id, round(r.confidence, 9), r.ambiguous) for r in matching.resolve(seen, catalog).collect()}
    assert got == want and len(want) > 100
    # names lead: each stands once in the index, and the keys of items are not read
    plan = index.resolve(seen)._jdf.queryExecution().executedPlan().toString()
    assert "blocks_members" in plan and "blocks_keys" not in plan
    assert index._table("names").count() < index.entries().count()


def test_index_moves_only_the_batch(spark):
    """No exchange between the key table, or the entries, and the join that meets a batch: the catalog stays where it is."""
    brands = a.brands(spark, DATA)
    batch = prepared(training.synthetic_sightings(a.items(spark, DATA).limit(20)), brands)
    index = BlockIndex(spark, "blocks")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mine = index._keyed(batch)
        met = mine.join(spark.table("blocks_keys"), "key")
        assert exchanges_below(met._jdf.queryExecution().executedPlan().toString(), "blocks_keys") == 0
        pairs = index.candidates(batch).withColumnRenamed("id", "a").withColumnRenamed("entry_id", "b")
        sides = matching.sided(pairs, batch, index.entries())
        assert exchanges_below(sides._jdf.queryExecution().executedPlan().toString(), "blocks_entries") == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_bound_is_no_less(spark):
    rng = random.Random(1)
    name = lambda: " ".join("".join(rng.choice("abcdeé1") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 3)))
    pairs = [(n, name()) for n in (name() for _ in range(300))] + [(n, n) for n in (name() for _ in range(20))] + [(n, n[::-1]) for n in (name() for _ in range(60))] + [("a", "b"), ("ab", "a")]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("ca", character_set(F.col("a"))).withColumn("cb", character_set(F.col("b")))
    for r in df.withColumn("most", jaro_winkler_most(F.col("a"), F.col("b"), F.col("ca"), F.col("cb"))).collect():
        exact = jaro_winkler_of(r.a, r.b)
        assert exact - 1e-12 <= r.most <= 1.0


def test_few_pairs_reach_jaro_winkler(spark):
    """Hits are those of all pairs, and most pairs are ruled out before."""
    items = prepared(a.items(spark, DATA), a.brands(spark, DATA)).cache()
    scored = matching.scored_pairs(items).cache()
    sides = matching.sided(scored.select("a", "b"), items, items).cache()
    pairs = lambda df: {(r.a, r.b, round(r.score, 9)) for r in df.collect()}
    for model in (matching.SHIPPED, matching.Model((1.0, 0.5, -2.0, 0.3, *matching.SHIPPED.weights[4:]), -1.0, 0.6)):
        every = scored.withColumn("score", matching.probability(model))
        assert pairs(matching.hits_among(sides, model)) == pairs(every.where(F.col("score") >= model.threshold))
    left = matching.able(sides).count()
    assert left < 0.5 * scored.count()


@settings(max_examples=12, deadline=None)
@given(rows=st.lists(st.tuples(st.sampled_from([0.0, 0.1, 0.1004, 0.1006, 0.5, 0.77, 0.999, 1.0]), st.sampled_from([0, 1])), max_size=30))
def test_sweep_by_brute_force(spark, rows):
    got = {r.threshold: (r.tp, r.fp, r.tn, r.fn) for r in training.threshold_sweep(spark.createDataFrame(rows, "p double, label int")).collect()}
    want = {}
    for t in {p for p, _ in rows} | {0.5, 1.01}:
        said = [(p >= t, y) for p, y in rows]
        want[t] = tuple(sum(s == a and y == b for s, y in said) for a, b in ((True, 1), (True, 0), (False, 0), (False, 1)))
    assert got == want


def test_sweep_has_no_single_task(spark):
    rows = spark.range(1000).select((F.col("id") / 1000).alias("p"), (F.col("id") % 2).cast("int").alias("label"))
    plan = training.threshold_sweep(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_search_by_trigrams(spark, tmp_path):
    """The rows of the scan, for words, parts of words, barcodes, blanks and what isn't there; postings of other trigrams aren't read."""
    products, brands = a.products(spark, DATA), a.brands(spark, DATA)
    named = catalog.search_products(products, brands, "a").unionByName(catalog.search_products(products, brands, "brand").where("NOT contains(lower(display_name), 'a')")).dropDuplicates(["id"]).cache()
    index = SearchIndex(spark, f"file://{tmp_path}/search", 8).build(named)
    ids = lambda df: sorted(r.id for r in df.collect())
    queries = [" Lavender ", "avend", "SPF 30", "rand#1", "00000000", "zzzz", "ab", "", "   ", "é"]
    for q in queries:
        assert ids(index.search(named, q)) == ids(catalog.search_products(products, brands, q).join(named.select("id"), "id", "left_semi")), q
    every = index.search_all(named, spark.createDataFrame([(q,) for q in queries], "query string"))
    got = {q: sorted(r.id for r in every.collect() if r.query == q) for q in queries}
    assert all(got[q] == (ids(index.search(named, q)) if len(q.strip()) >= 3 else []) for q in queries) and got["avend"]
    plan = index.candidates("avend")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [shard" in plan
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [IsNotNull(gram)" in plan
