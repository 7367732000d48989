"""What is worked out once instead of once a pair or in one task, and results that stay the same by it."""

from pyspark.sql import functions as F

from panelyst.operators import blocking, catalog, graph, matching, raters, scoring
from panelyst.plans import feed_queries, matching_queries  # noqa: F401
from panelyst.plans.catalog_queries import QUERIES

from .conftest import DATA


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_look_up_what_names_say(spark, monkeypatch):
    """Pairs of items don't go through Python where names are few; features are those of each pair by itself."""
    assert "ArrowEvalPython" not in plan(QUERIES["pair_scores"](spark, DATA))
    names = ["red bolt", "red bolt SPF 30", "blue bolt 5%", "Éé", None]
    row = lambda i: (f"i{i:02}", [None, "Brand#1", "x"][i % 3], names[i % 5], f"{i % 4:012}" if i % 2 else None, [f"x{j}" for j in range(i % 3, 4 + i % 4)] if i % 7 else None, i % 5 + 0.3 * (i % 2), ["ml", "ML.", "", None][i % 4], i, f"i{i:02}")
    items = spark.createDataFrame([row(i) for i in range(50)], "id string, brand string, name string, gtin string, ingredients array<string>, size_value double, size_unit string, ord int, product_id string")
    c = blocking.prepared(items, spark.createDataFrame([("Brand#1", "Brand#1", [], 0)], "id string, name string, aliases array<string>, ord int")).cache()
    shown = lambda df: sorted(map(str, df.select("a", "b", *matching.FEATURES, F.round("score", 9)).collect()))
    want = shown(matching.scored_pairs(c))
    assert len(want) > 300 and shown(matching.every_scored_pair(c)) == want
    monkeypatch.setattr(matching, "TABLED", 2)
    assert shown(matching.every_scored_pair(c)) == want


def test_shelves_are_made_without_a_row_a_pair(spark, monkeypatch):
    """Each product's alternatives come from the beginning of its category's run; they are those of top_alternatives."""
    monkeypatch.setattr(catalog, "SHELF_BLOCK", 3)
    rows = [(f"p{i:02}", "ab"[i % 2] if i < 58 else None, [None, 10.0, 70.0][i % 3] if i % 5 else float(i), float(i * 7 % 60) if i % 4 else None) for i in range(60)]
    products = spark.createDataFrame([r[:2] for r in rows], "id string, category string")
    every = spark.createDataFrame([(r[0], axis, v) for r in rows for axis, v in zip(("ingredient_safety", "labor"), r[2:], strict=True)], "product_id string, axis string, representative double")
    for most in (None, 4):
        got = catalog.shelf_catalog(products, every, most).collect()
        flat = sorted(str((r.product_id, *a)) for r in got for a in r.alternatives)
        assert flat == sorted(str(tuple(r)) for r in catalog.top_alternatives(products, every, most).collect()) and len(flat) > 100
        assert all(r.n == len(r.alternatives) and [a.place for a in r.alternatives] == list(range(1, r.n + 1)) for r in got)
    assert "explode(sequence(1" not in plan(QUERIES["shelf_catalog"](spark, DATA))


def test_ingredient_lists_are_judged_where_they_stand(spark):
    """No row an ingredient, no grouping; scores and counts are those of hazard_matches."""
    known = ["Limonene", " d-limonene", "PARFUM", "Retinol", "lilial", "Linalool", "Citral", "Geraniol", "Eugenol", "Coumarin", "Aqua", " ", "--", "Limonene"]
    rows = [(f"p{i:02}", [known[(i * 5 + j * j) % 14] for j in range(i % 13)] if i % 9 else None) for i in range(40)]
    lists = spark.createDataFrame(rows, "product_id string, ingredients array<string>")
    scores = raters.hazard_scores(lists)
    assert "Generate" not in plan(scores) and "Aggregate" not in plan(scores)
    want = raters.hazard_matches(lists).groupBy("product_id").agg(F.sum("penalty").alias("cost"), F.count("*").alias("n")).collect()
    want = {r.product_id: (max(0.0, 100.0 - r.cost), r.n) for r in want}
    got = {r.product_id: (r.score, r.flagged) for r in scores.collect()}
    assert len(want) > 20 and got == {p: want.get(p, (100.0, 0)) for p, x in rows if x and any(i.strip() for i in x)}


def test_effects_are_made_in_one_row_a_product(spark):
    """The query groups ratings once a product and joins no pillar with its composite; effects are those of composites()."""
    assert plan(QUERIES["marginal_effects"](spark, DATA)).count("MergeJoin") + plan(QUERIES["marginal_effects"](spark, DATA)).count("HashJoin") <= 2
    values = [None, 10.0, 40.0, 70.0]
    rows = [(f"p{i}", axis, values[(i >> 2 * k) % 4]) for i in range(256) for k, axis in enumerate(scoring.AXES)]
    every = spark.createDataFrame(rows, "product_id string, axis string, representative double").withColumn("spread_min", F.lit(None).cast("double")).withColumn("spread_max", F.lit(None).cast("double"))
    for w in ([1.0, 1.0, 1.0, 1.0], [2.0, 0.0, float("nan"), 1.0], [0.0, 0.0, 0.0, 0.0]):
        weights = spark.createDataFrame(list(zip(scoring.AXES, w, strict=True)), "axis string, w double")
        overall = {r.product_id: r.overall for r in scoring.composites(every, weights).collect()}
        got = {(r.product_id, r.axis): r.effect for r in scoring.marginal_effects(every, weights).collect()}
        for p, axis, v in rows:
            o = overall.get(p)
            want = "unavailable" if v is None else "lifts" if o is None else "neutral" if abs(v - o) < 1e-9 else "lifts" if v > o else "drags"
            assert got[p, axis] == want
        assert len(got) == len(rows)


def test_components_send_no_table_of_nodes_through_the_driver(spark, monkeypatch):
    plans, write = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df, label: plans.append(plan(df)) or write(df, label))
    out = QUERIES["clusters_by_code"](spark, DATA)
    assert sum("SortMergeJoin" in x for x in plans) > 1 and not any("Broadcast" in x for x in [*plans, plan(out)])
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40) if i % 10], "a long, b long")
    assert {r.node: r.root for r in graph.connected(edges).collect()} == {i: (i - 1) // 10 * 10 + 1 for i in range(1, 41)}
