import pytest
from pyspark.sql import functions as F

from panelyst.functions import hashing
from panelyst.operators import agreement, blocking, catalog, generic_names, graph, matching, raters, scoring, training

from .conftest import DATA

SOURCES = [
    ("low", "Low", "ingredient_safety", 1.0, 10.0, "lower_is_better", "nonprofit"),
    ("high", "High", "ingredient_safety", 0.0, 100.0, "higher_is_better", "ad_supported"),
    ("third", "Third", "ingredient_safety", 0.0, 20.0, "higher_is_better", "independent"),
    ("eco", "Eco", "environmental", 0.0, 100.0, "higher_is_better", "nonprofit"),
    ("flat", "Flat", "labor", 5.0, 5.0, "higher_is_better", "nonprofit"),
]
RATINGS = [
    ("a", "low", 4.0, None, None, 1), ("a", "high", 90.0, 0.95, False, 2), ("a", "third", 13.0, 0.5, True, 3), ("a", "eco", 58.0, 0.5, False, 4),
    ("b", "eco", 150.0, None, None, 1), ("b", "nobody", 5.0, None, None, 2), ("c", "flat", 5.0, None, None, 1),
]


@pytest.fixture(scope="module")
def rated(spark):
    s = spark.createDataFrame(SOURCES, "id string, name string, axis string, scale_min double, scale_max double, scale_direction string, funding_model string")
    r = spark.createDataFrame(RATINGS, "product_id string, source_id string, score_raw double, match_confidence double, match_reviewed boolean, ord int").withColumn("match_method", F.lit("seed"))
    return scoring.normalized_ratings(r, s).cache()


def test_pillars_and_composites(spark, rated):
    found = scoring.pillars(rated).cache()
    p = {(r.product_id, r.axis): r for r in found.collect()}
    safety = p["a", "ingredient_safety"]
    assert safety.representative == pytest.approx((66.6666667 + 90 + 65) / 3) and safety.spread_min == pytest.approx(65) and safety.disagreement
    assert p["b", "environmental"].representative == 100 and p["b", "environmental"].spread_min is None and p["c", "labor"].representative == 0
    w = scoring.default_weights(spark)
    c = {r.product_id: r for r in scoring.composites(found, w).collect()}
    assert c["a"].overall == pytest.approx((safety.representative + 58) / 2) and c["a"].overall_min <= c["a"].overall <= c["a"].overall_max
    assert scoring.composites(found, w.withColumn("w", F.lit(0.0))).count() == 0
    top = {r.product_id: (r.axis, r.direction) for r in scoring.top_drivers(found, w).collect()}
    assert top == {"a": ("ingredient_safety", "lifts")}
    every = scoring.all_pillars(found, found)
    e = {(r.product_id, r.axis): r.effect for r in scoring.marginal_effects(every, w).collect()}
    assert len(e) == 12 and e["a", "environmental"] == "drags" and e["b", "environmental"] == "neutral" and e["b", "labor"] == "unavailable"
    own = scoring.stored_weights(spark, spark.createDataFrame([("labor", 3.0)], "axis string, w double")).collect()
    assert {r.axis: r.w for r in own} == {"ingredient_safety": 1.0, "environmental": 1.0, "labor": 3.0, "packaging": 1.0}


def test_splits_and_coverage(rated):
    d = agreement.disagreements(scoring.pillars(rated)).select("product_id", F.col("low.source_id").alias("l"), F.col("high.source_id").alias("h"), agreement.describe_disagreement().alias("t")).collect()
    assert [(r.product_id, r.l, r.h) for r in d] == [("a", "third", "high")]
    assert d[0].t == "High (ad_supported) scores 90 on ingredient safety; Third (independent) scores 65. Spread 25 points."
    c = {r.product_id: r for r in agreement.coverage(rated).collect()}
    assert (c["a"].source_count, c["a"].axes_covered, c["a"].weakest_tier, c["a"].has_unreviewed, c["a"].has_weak, c["a"].sparse) == (4, 2, "weak", True, True, True)
    assert (c["b"].source_count, c["b"].weakest_tier, c["b"].has_unreviewed) == (1, "verified", False)


@pytest.mark.parametrize(("score", "band"), [(85.0, "excellent"), (84.99, "good"), (70.0, "good"), (55.0, "fair"), (40.0, "poor"), (39.9, "bad"), (None, None), (float("nan"), None)])
def test_bands(spark, score, band):
    assert spark.createDataFrame([(score,)], "s double").select(scoring.verdict_band(F.col("s"))).first()[0] == band


# Hand-labelled pairs by their features and scores under the shipped model.
PAIRS = [
    (1, 0.758519, 1.0, 1, 1.0, 1, None, 0.997338), (None, 0.564672, 1.0, 1, 1.0, None, None, 0.955478), (None, 0.897297, 1.0, 1, None, 1, None, 0.955740),
    (None, 0.479798, 0.0, 1, 0.666667, None, None, 0.030171), (None, 0.658565, 0.5, 1, 1.0, None, None, 0.535708), (None, 0.522589, 0.0, 1, 0.5, 1, 1, 0.001688),
    (None, 0.991111, 0.875, 1, None, None, 1, 0.226263), (None, 1.0, 1.0, 0, 0.333333, None, None, 0.601512), (None, 0.693827, 0.25, 0, 0.5, None, None, 0.016082),
]


def test_shipped_model(spark):
    schema = "gtin_exact double, name_jaro_winkler double, name_token_set double, brand_match double, ingredients_overlap double, size_match double, variant_conflict double, want double"
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in p) for p in PAIRS], schema)
    m = matching.SHIPPED
    for r in df.select("want", matching.probability().alias("p"), matching.vector_probability(matching.feature_vector(), m).alias("q"), matching.hand_score().alias("h")).collect():
        assert r.p == pytest.approx(r.want, abs=5e-6) and r.q == pytest.approx(r.p) and -5 < r.h <= 1


GLOW = ["aqua", "ascorbic acid", "glycerin", "sodium hyaluronate", "tocopherol"]
REPAIR = ["water", "glycerin", "ceramide np", "niacinamide", "squalane"]
BARE = ["aqua", "glycerin", "ceramide np", "squalane", "panthenol"]
LISTINGS = [
    ("A-upcA", "BigA", "Daily Glow Serum 30ml", "012345678905", GLOW, 30.0, "ml"), ("A-ean13", "BigA", "Daily Glow Serum 30ml", "0012345678905", GLOW, 30.0, "ml"),
    ("A-gtin14", "BigA", "Daily Glow Serum 30ml", "00012345678905", GLOW, 30.0, "ml"), ("B-full", "BigB", "Ceramide Repair Cream 50ml", "098765432109", REPAIR, 50.0, "ml"),
    ("B-stripped", "BigB", "Repair Cream", None, REPAIR, None, None), ("C-name1", "Fern & Field", "Bare Ceramide Cream", None, BARE, None, None),
    ("C-name2", "fern and field", "Bare Ceramide Cream (fragrance-free)", None, BARE, None, None),
]
ITEM = "id string, brand string, name string, gtin string, ingredients array<string>, size_value double, size_unit string, ord int"
BRAND = "id string, name string, parent_id string, aliases array<string>, ord int"


def _brands(spark, alias=True):
    return spark.createDataFrame([("big-a", "BigA", None, [], 0), ("big-b", "BigB", None, [], 1), ("indie", "Fern & Field", None, ["fern field", *(["fern and field"] if alias else [])], 2)], BRAND)


def _items(spark, rows=LISTINGS):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ITEM)


def test_toy_corpus(spark):
    items = blocking.prepared(_items(spark), _brands(spark)).cache()
    scored = {(r.a, r.b): (r.via, r.score) for r in matching.scored_pairs(items).collect()}
    assert set(scored) == {("A-ean13", "A-upcA"), ("A-gtin14", "A-upcA"), ("A-ean13", "A-gtin14"), ("B-full", "B-stripped"), ("C-name1", "C-name2")}
    assert scored["A-ean13", "A-upcA"] == ("gtin:00012345678905", pytest.approx(0.997822, abs=1e-5))
    assert scored["B-full", "B-stripped"] == ("brand:big-b", pytest.approx(0.960335, abs=1e-5)) and scored["C-name1", "C-name2"] == ("brand+token:indie:bare", pytest.approx(0.966281, abs=1e-5))
    got, _ = matching.cluster_listings(items)
    groups = {}
    for r in got.collect():
        groups.setdefault(r.cluster_id, set()).add(r.id)
    assert sorted(map(len, groups.values())) == [2, 2, 3]
    other = blocking.prepared(_items(spark), _brands(spark, alias=False))
    c = {(r.a, r.b): r for r in matching.scored_pairs(other).collect()}["C-name1", "C-name2"]
    assert c.via == "ing:0:1y9b0o2" and c.score == pytest.approx(0.779764, abs=1e-5)


def test_resolve(spark):
    catalog_rows = [(f"cat-{i}", *LISTINGS[i][1:]) for i in (0, 3, 5)]
    c = blocking.prepared(_items(spark, catalog_rows).withColumn("product_id", F.concat(F.lit("p-"), "id")), _brands(spark))
    seen = blocking.prepared(_items(spark, [*LISTINGS, ("none", None, "", None, None, None, None)]), _brands(spark))
    got = {r.id: r for r in matching.resolve(seen, c).collect()}
    assert got["A-ean13"].product_id == "p-cat-0" and got["B-stripped"].product_id == "p-cat-3" and got["C-name2"].product_id == "p-cat-5"
    assert not any(r.ambiguous for r in got.values()) and "none" not in got
    twice = blocking.prepared(_items(spark, [*catalog_rows, ("cat-9", *LISTINGS[0][1:])]).withColumn("product_id", F.col("id")), _brands(spark))
    again = {r.id: r for r in matching.resolve(seen, twice).collect()}
    assert again["A-upcA"].product_id == "cat-0" and again["A-upcA"].ambiguous and "ambiguous vs cat-9" in again["A-upcA"].reason


def test_components(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(30)] + [("z", f"y{i}") for i in range(5)]
    got = {r.node: r.root for r in graph.connected(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert all(v == "n000" for k, v in got.items() if k[0] == "n") and all(v == "y0" for k, v in got.items() if k[0] in "yz") and len(got) == 37


@pytest.mark.parametrize(
    ("ingredients", "score"),
    [(["Aqua", "Phenoxyethanol"], 88), (["Limonene", "Linalool", "Citral", "Geraniol", "Eugenol", "Coumarin", "Farnesol", "Cinnamal", "Isoeugenol", "Citronellol"], 70), (["formaldehyde"], 45), (["Formaldehyde", "Hydroquinone", "Lead Acetate"], 0), (["limonene", "D-Limonene", "Limonene "], 88), ([" ", ""], None)],
)
def test_hazards(spark, ingredients, score):
    got = raters.hazard_scores(spark.createDataFrame([("p", ingredients)], "product_id string, ingredients array<string>")).collect()
    assert [r.score for r in got] == ([] if score is None else [score])


@pytest.mark.parametrize(
    ("materials", "score", "label"),
    [(["en:glass"], 92, "Excellent"), (["PVC"], 12, "Bad"), (["glass", "en:pp-pump"], 55, "Fair"), (["plastic", "polypropylene"], 55, "Fair"), (["bottle", "box"], None, None), ([], None, None)],
)
def test_packaging(spark, materials, score, label):
    got = raters.packaging_scores(spark.createDataFrame([("p", materials)], "product_id string, materials array<string>")).collect()
    assert [(r.score, r.label) for r in got] == ([] if score is None else [(score, label)])


def test_ethics(spark):
    b = spark.createDataFrame([("x", "X", "parent", ["E.L.F."], 0), ("y", "Y", "parent", [], 1), ("parent", "CeraVe", None, None, 2), ("z", "Z", None, [], 3)], BRAND)
    p = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "z")], "id string, brand_id string")
    assert {(r.product_id, r.score, r.via_parent) for r in raters.ethics_scores(p, b).collect()} == {("1", 92.0, False), ("2", 30.0, True)}


def test_generic_names(spark):
    names = ["Shampoo", "Hand Soap", "Shampoo", "Hand Soap", "Niacinamide Serum", "Daily Moisturizing Lotion", "...", "Shampoo Bar Deluxe", "Soap Hand"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: r.generic for r in generic_names.generic_names(df, 0.2).collect()}
    assert got["Shampoo"] and got["Hand Soap"] and not got["Niacinamide Serum"] and not got["Daily Moisturizing Lotion"] and not got["..."]
    assert {r.name for r in generic_names.match_context(df, 0.2).collect()} == {"Niacinamide Serum", "Daily Moisturizing Lotion", "Shampoo Bar Deluxe"}


def test_metrics_and_thresholds(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.4, 1), (0.2, 0)], "p double, label int")
    m = training.evaluate(rows, 0.5).first()
    assert (m.tp, m.fp, m.fn, m.tn, m.f1) == (1, 1, 1, 1, 0.5)
    assert training.best_threshold(rows).first().threshold == 0.4 and training.threshold_sweep(rows).count() == 6
    assert training.misclassified(rows, 0.5).count() == 2


def test_training(spark, tmp_path):
    rows = []
    for b in range(4):
        for k, word in enumerate(("Rose Cream", "Mint Serum SPF 30", "Plain Lotion 2%")):
            ing = [f"ing{(b * 5 + k * 3 + j) % 17} x" for j in range(7)]
            rows.append((f"i{b}{k}", f"Brand{b}", f"{word} {b}{k}", f"{b}{k}34567890", ing, 50.0 + k, "ml"))
    b = spark.createDataFrame([(f"b{i}", f"Brand{i}", None, [], i) for i in range(4)], BRAND)
    c = blocking.prepared(_items(spark, rows).withColumn("product_id", F.col("id")), b).cache()
    out = training.train_matcher(c, b, positives=4, negatives=3)
    assert out["test"]["f1"] > 0.7 and len(out["model"].weights) == 14
    training.write_model(spark, out["model"], f"file://{tmp_path}/model")
    assert training.read_model(spark, f"file://{tmp_path}/model") == out["model"]
    outcomes = training.measure_recall(c, c, b, cutoffs=(2, 3, 4))
    by = {r.bucket: r for r in training.recall_by_bucket(outcomes).collect()}
    assert by["mid"].total == 12 and by["tail"].total == 0 and by["tail"].recall == 0
    assert training.fairness_gap(training.recall_by_bucket(outcomes)).first().gap == 0
    assert {r.bucket: r.products for r in training.profile_by_bucket(c, (2, 3, 4)).collect()}["mid"] == 12
    assert training.stratified_probes(c, 5, cutoffs=(2, 3, 4)).count() == 5


def test_catalog_reads(spark, rated):
    found = scoring.pillars(rated, False)
    p = spark.createDataFrame([("a", "x", "Rose Cream", "cream", "012345678905", 1), ("b", "y", "Mint Balm", "cream", None, 2), ("c", "y", "Soap", "soap", None, 1000), ("d", "y", "Old", "cream", None, 1000)], "id string, brand_id string, display_name string, category string, gtin string, sort_index int")
    b = spark.createDataFrame([("x", "Lumen", None, [], 0), ("y", "Vela", None, [], 1)], BRAND)
    every = scoring.all_pillars(p.select(F.col("id").alias("product_id")), found)
    assert {(r.product_id, r.alt_id) for r in catalog.alternatives(p, every).collect()} == {("b", "a"), ("d", "a")}
    assert {(r.product_id, r.alt_id) for r in catalog.top_alternative(p, every).collect()} == {("b", "a"), ("d", "a")}
    assert [r.id for r in catalog.search_products(p, b, " VELA ").orderBy("id").collect()] == ["b", "c", "d"] and catalog.search_products(p, b, " ").count() == 0
    rated_ids = spark.createDataFrame([("c",)], "product_id string")
    assert [r.id for r in catalog.list_products(p, rated_ids).collect()] == ["a", "b", "c"]
    m, w = scoring.mean_of_pillars(found), scoring.max_spread(found)
    order = lambda how: [r.product_id for r in catalog.browse(p, m, w, how).collect()]
    assert order("best")[0] == "b" and order("worst")[0] == "c" and order("best")[-1] == order("worst")[-1] == "d" and order("contested")[0] == "a" and order("name") == ["b", "d", "a", "c"]
    v = {r.product_id: r for r in catalog.views(p, b, found).collect()}
    assert [x.axis for x in v["a"].pillars] == ["ingredient_safety", "environmental"] and v["a"].brand_name == "Lumen" and v["d"].pillars is None
    events = spark.createDataFrame([(1, f"i{i % 30}", i) for i in range(90)], "user_id int, item string, ts int")
    s = catalog.shelf(events).orderBy("place").collect()
    assert len(s) == 24 and s[0].item == "i29" and s[0].last_seen == 89


def test_registered_sightings_resolve_over_all_keys(spark, monkeypatch):
    from panelyst.plans import adapters
    from panelyst.plans import matching_queries  # noqa: F401
    from panelyst.plans.catalog_queries import QUERIES

    monkeypatch.setattr(blocking, "TILE_ROWS", 3)
    c = blocking.prepared(adapters.items(spark, DATA), adapters.brands(spark, DATA)).cache()
    seen = blocking.prepared(training.synthetic_sightings(adapters.items(spark, DATA)), adapters.brands(spark, DATA)).cache()
    keys = c.select(F.col("id").alias("b"), F.col("keys").alias("o_keys"))
    pairs = seen.select(F.col("id").alias("a"), "keys").join(keys, F.arrays_overlap("keys", "o_keys")).select("a", "b")
    scored = matching.with_features(matching.sided(pairs, seen, c)).withColumn("p", matching.probability()).where(F.col("p") >= matching.SHIPPED.threshold)
    hits = {}
    for r in scored.join(c.select(F.col("id").alias("b"), "ord"), "b").select("a", "b", "p", "ord").collect():
        hits.setdefault(r.a, []).append((-r.p, r.ord, r.b))
    want = {}
    for a, h in hits.items():
        h.sort()
        want[a] = (h[0][2], round(-h[0][0], 6), len(h) > 1 and h[1][0] - h[0][0] < matching.AMBIGUITY)
    assert {r.id: (r.product_id, r.confidence, r.ambiguous) for r in QUERIES["resolve_sightings"](spark, DATA).collect()} == want
    assert len(want) > 0.9 * c.count()


def test_pairs_of_a_brand_alone_stay_below_the_threshold():
    assert matching.brand_alone_most() == pytest.approx(0.329, abs=1e-3) and matching.brand_words_suffice(matching.SHIPPED)
    assert not matching.brand_words_suffice(matching.Model(matching.SHIPPED.weights, 5.0, 0.5))


def test_registered_pairs_and_clusters_over_all_keys(spark, monkeypatch):
    from panelyst.plans import adapters
    from panelyst.plans import matching_queries  # noqa: F401
    from panelyst.plans.catalog_queries import QUERIES

    monkeypatch.setattr(blocking, "TILE_ROWS", 3)
    rows = blocking.prepared(adapters.items(spark, DATA), adapters.brands(spark, DATA)).select("id", "keys").collect()
    keys = {r.id: set(r["keys"]) for r in rows}
    want = {(a, b) for a in keys for b in keys if a < b and keys[a] & keys[b]}
    scored = QUERIES["pair_scores"](spark, DATA).select("a", "b", "score").collect()
    assert len(scored) == len(want) and {(r.a, r.b) for r in scored} == want
    root = {i: i for i in keys}
    for r in scored:
        if r.score >= matching.SHIPPED.threshold and root[r.a] != root[r.b]:
            lo, hi = sorted((root[r.a], root[r.b]))
            root = {i: lo if x == hi else x for i, x in root.items()}
    assert {r.id: r.cluster_id for r in QUERIES["cluster_listings"](spark, DATA).collect()} == root


def test_shelves_of_a_stream_are_those_of_the_whole(spark, tmp_path):
    from panelyst.plans import adapters
    from panelyst.streaming.resolving import shelves_stream

    views = adapters.shelf_views(spark, DATA)
    days = [views.where(f"minute(ts) % 3 = {i}") for i in range(3)]
    for i, part in enumerate(days):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(views.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    latest: dict = {}

    def keep(batch, number):
        for r in batch.collect():
            latest.setdefault((number, r.user_id), []).append((r.place, r.item, r.last_seen))

    q = shelves_stream(stream, 5).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for (number, user), rows in sorted(latest.items()):
        last[user] = sorted(rows)
    assert len({n for n, _ in latest}) == 3
    want = {}
    for r in catalog.shelf(views, 5).collect():
        want.setdefault(r.user_id, []).append((r.place, r.item, r.last_seen.replace(tzinfo=None)))
    assert {u: [(p, i, t.replace(tzinfo=None)) for p, i, t in rows] for u, rows in last.items()} == {u: sorted(rows) for u, rows in want.items()}


def test_top_driver_ties_go_by_axis(spark):
    """Two axes that move the composite alike but for the last digit of a sum: the first of them, as SQL has it."""
    found = spark.createDataFrame([("p", "ingredient_safety", 1 / 3), ("p", "packaging", 76.0)], "product_id string, axis string, representative double")
    found = found.withColumn("spread_min", F.lit(None).cast("double")).withColumn("spread_max", F.lit(None).cast("double"))
    r = scoring.top_drivers(found, scoring.default_weights(spark)).first()
    assert (r.axis, r.direction) == ("ingredient_safety", "drags")


def test_copies_of_a_name_meet_once(spark):
    """Hits are those of all pairs; what names say is worked out once a pair of names, however many items have them."""
    row = lambda i, name, gtin, size: (f"i{i:03}", "Brand#1" if i % 7 else None, name, gtin, [f"x{j}" for j in range(i % 3, 6 + i % 3)], size, "ml" if i % 5 else None, i, f"i{i:03}")
    names = ["red bolt", "red bolt SPF 30", "blue bolt", "blue ring lavender"]
    rows = [row(i, names[i % 4], "00000000000017" if i % 11 == 0 else None, float(i % 9) + 0.3 * (i % 2)) for i in range(160)]
    items = spark.createDataFrame(rows, "id string, brand string, name string, gtin string, ingredients array<string>, size_value double, size_unit string, ord int, product_id string")
    brands = spark.createDataFrame([("Brand#1", "Brand#1", [], 0)], "id string, name string, aliases array<string>, ord int")
    c = blocking.prepared(items, brands).cache()
    pairs = lambda df: {(r.a, r.b, round(r.score, 9)) for r in df.collect()}
    every = pairs(matching.hits_among(matching.sided(blocking.candidate_pairs(c).select("a", "b"), c, c)))
    got = matching.hits(c, c, ordered=True).collect()
    assert {(r.a, r.b, round(r.score, 9)) for r in got} == every and len(got) == len(every) > 300
    both = matching.hits(c, c)
    assert pairs(both.where("a < b")) == every
    by_name = matching.names_of(matching.named(c))
    assert by_name.count() == 4 and matching.name_pairs(by_name, by_name).count() <= 16
    assert matching.names_lead(matching.SHIPPED) and not matching.names_lead(matching.Model(matching.SHIPPED.weights, 5.0, 0.5))


def test_bands_once_a_list(spark):
    """Band keys are worked out once a distinct list of ingredients: below the hash family there is an aggregate of lists."""
    sets = spark.range(300).select(F.col("id").cast("string").alias("id"), F.array(*[F.concat(F.lit(f"t{j}"), (F.col("id") % 3).cast("string")) for j in range(4)], F.lit("z")).alias("ingredient_set"))
    small = sets.withColumn("ingredient_set", F.slice("ingredient_set", 1, 2))
    out = blocking.with_bands(sets.unionByName(small))
    assert out.count() == 600 and out.where("size(bands) = 16").select("bands").distinct().count() == 3 and out.where("size(bands) = 0").count() == 300
    assert out.select(*blocking.with_bands(sets).columns).where(F.col("bands") != hashing.ingredient_keys(F.col("ingredient_set"))).count() == 0


def test_distinct_names_meet(spark):
    """name_similarities joins names, not the customers and suppliers that share them."""
    from panelyst.plans.feed_queries import name_similarities

    plan = name_similarities(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Join Inner") :].count("Aggregate [") == 2


def test_alternatives_in_tiles(spark):
    """One category of many products: those of every pair, and no task takes the whole category."""
    n = 2500
    p = spark.range(n).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), F.lit("cream").alias("category"))
    every = p.select(F.col("id").alias("product_id"), F.explode(F.array(F.lit("ingredient_safety"), F.lit("labor"))).alias("axis"), (F.substring("id", 2, 9).cast("int") % 50).cast("double").alias("representative"))
    every = every.withColumn("representative", F.when(F.col("axis") == "labor", 50 - F.col("representative")).otherwise(F.col("representative")))
    out = catalog.alternatives(p, every)
    got = out.groupBy(F.array_join("cleaner", ",").alias("c"), F.array_join("tradeoffs", ",").alias("t")).agg(F.count("*").alias("n"), F.count_distinct("product_id", "alt_id").alias("d")).collect()
    pairs = sum((n // 50) ** 2 for a in range(50) for b in range(50) if a > b)
    far = sum((n // 50) ** 2 for a in range(50) for b in range(50) if a - b >= 5)
    assert {(r.c, r.t): (r.n, r.d) for r in got} == {("ingredient_safety", "labor"): (far, far), ("", ""): (pairs - far, pairs - far)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join [" in x and "alt_id" in x]
    assert joins and all("_l#" in x and "_r#" in x for x in joins)


def test_sharing_makes_each_pair_once(spark):
    """Pairs that share any key, once each without a step that finds equal ones; brands, barcodes and lists may be absent."""
    row = lambda i: (f"i{i:03}", [None, "Brand#1", "Brand#2", "Other"][i % 4], ["red bolt", "red ring SPF 30", "blue bolt"][i % 3], f"{i % 7:014}" if i % 3 == 0 else None, [f"x{j}" for j in range(i % 5, 4 + i % 5 + i % 4)], 1.0, "ml", i, f"i{i:03}")
    items = spark.createDataFrame([row(i) for i in range(90)], "id string, brand string, name string, gtin string, ingredients array<string>, size_value double, size_unit string, ord int, product_id string")
    brands = spark.createDataFrame([("Brand#1", "Brand#1", ["other"], 0)], "id string, name string, aliases array<string>, ord int")
    c = blocking.prepared(items, brands).cache()
    keys = {r.id: set(r["keys"]) for r in c.collect()}
    want = sorted((x, y) for x in keys for y in keys if x != y and keys[x] & keys[y])
    got = lambda df: sorted((r.a, r.b) for r in df.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).collect())
    assert got(blocking.sharing(c, [])) == want and len(want) > 1000
    out = blocking.sharing(c, [], ordered=True)
    assert got(out) == [(x, y) for x, y in want if x < y]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_negatives_are_drawn_without_sorting_pairs(spark):
    """The least hash is kept in place: pairs go into an aggregate of longs, neither sorted nor moved."""
    from panelyst.plans import adapters as a

    c = graph.kept(blocking.prepared(a.items(spark, DATA), a.brands(spark, DATA)), "prepared")
    plan = training.labeled_sightings(c)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "partial_min" in plan and "min_by" not in plan
    n = blocking.numbered(c).select("number", "id").collect()
    assert sorted(r.number for r in n) == list(range(len(n))) and len({r.id for r in n}) == len(n)
