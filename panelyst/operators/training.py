"""Labelled pairs, logistic regression, thresholds, and how recall varies with the size of a brand.

Sampling goes by hashes of keys, so runs and engines agree; inputs are prepared catalogs (see blocking) with product_id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean, hash_32, hash_unit, name_tokens, pick
from ..functions.variants import mutate_variant_token
from .blocking import brand_or_own, cross_brand_others, keyed, numbered, prepared, same_block_others
from .graph import kept
from .matching import SHIPPED, Model, feature_vector, resolve, sided, vector_probability, with_features

# What listings append to names.
TAILS = ["For All Skin Types, Dermatologist Tested", "Hydrating, Fragrance Free, Non-Comedogenic", "Lightweight Daily Formula, Cruelty Free", ""]
BUCKETS = ["tail", "small", "mid", "head"]
CUTOFFS = (2, 5, 20)
OUTCOMES = ["correct", "ambiguous", "wrong", "unresolved"]
KEEP_GTIN = 0.4

ITEM = ["id", "brand", "name", "gtin", "ingredients", "size_value", "size_unit", "ord"]


def _tail(*key: Column) -> Column:
    return pick(F.array(*[F.lit(t) for t in TAILS]), hash_unit(F.lit("tail"), *key))


def _named(brand: Column, name: Column, tail: Column) -> Column:
    return clean(F.concat(F.coalesce(brand, F.lit("")), F.lit(" "), name, F.lit(" "), tail))


def _shortened(ingredients: Column, *key: Column) -> Column:
    """Every other list of more than five keeps a beginning of five or more."""
    n = F.size(ingredients)
    keep = (F.floor(hash_unit(F.lit("cut"), *key) * (n - 5)) + 5).cast("int")
    return F.when((n > 5) & (hash_unit(F.lit("halve"), *key) < 0.5), F.slice(ingredients, 1, keep)).otherwise(ingredients)


def synthetic_sightings(catalog: DataFrame, tail: str = TAILS[0], keep_gtin: bool = False) -> DataFrame:
    """A listing of each entry as a shop would write it; the barcode goes unless asked for."""
    gtin = F.col("gtin") if keep_gtin else F.lit(None).cast("string")
    return catalog.select("product_id", F.concat(F.lit("sighting-"), "product_id").alias("id"), "brand", _named(F.col("brand"), F.col("name"), F.lit(tail)).alias("name"), gtin.alias("gtin"), "ingredients", "size_value", "size_unit", "ord")


def degraded(pairs: DataFrame) -> DataFrame:
    """Noisy sightings of entries in rows that carry one and a salt: tails, cut ingredient lists, barcodes mostly lost.

    The id names the entry too: two entries may be compared with one and the same other.
    """
    k = (F.col("salt"), F.col("id"))
    gtin = F.when(hash_unit(F.lit("gtin"), *k) < KEEP_GTIN, F.col("gtin"))
    return pairs.select("entry", "label", "salt", F.concat_ws("-", F.lit("s"), "salt", "entry", "id").alias("id"), "brand", _named(F.col("brand"), F.col("name"), _tail(*k)).alias("name"), gtin.alias("gtin"), _shortened(F.col("ingredients"), *k).alias("ingredients"), "size_value", "size_unit", "ord")


def labeled_sightings(catalog: DataFrame, positives: int = 2, negatives: int = 2, cross: int = 1, variants: int = 1, brandless: int = 0, seed: str = "1") -> DataFrame:
    """(entry, label, id, item columns): sightings to compare with the entry; label 1 for its own, 0 for another product's.

    Own sightings; those of entries of its blocks; its own with a variant token changed, which makes another product; with
    brandless > 0 its own without brand and barcode; and those of another brand with the same first word, or any other brand.
    """
    c = catalog.select(*ITEM, "product_id")
    counted = numbered(catalog) if negatives or cross else None
    ids = counted.select("number", "id") if negatives or cross else None
    turns = lambda n, kind: F.explode(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit(f"{seed}-{kind}-"), i.cast("string"))))
    own = c.withColumn("entry", F.col("id"))
    parts = [degraded(own.withColumn("label", F.lit(1)).withColumn("salt", turns(positives, "p")))] if positives else []

    def of_others(others: DataFrame, n: int, kind: str) -> DataFrame:
        # each turn takes the other whose hash with the turn is least: 32 bits of hash and 31 of its number are one long, so that
        # the least one is kept in place, pair after pair, and no pairs are moved or sorted
        salts = [f"{seed}-{kind}-{i + 1}" for i in range(n)]
        drawn = [F.min(hash_32(F.lit(s), F.col("l.id"), F.col("r.id")) * (1 << 31) + F.col("r.number")).alias(s) for s in salts]
        least = others.groupBy(F.col("l.number").alias("number")).agg(*drawn)
        each = least.select("number", F.explode(F.array(*[F.struct(F.lit(s).alias("salt"), F.col(f"`{s}`").bitwiseAND((1 << 31) - 1).alias("other")) for s in salts])).alias("d"))
        chosen = each.join(ids, "number").select(F.col("id").alias("entry"), "d.salt", F.col("d.other").alias("number"))
        return degraded(chosen.join(ids, "number").drop("number").join(c, "id").withColumn("label", F.lit(0)))

    if negatives:
        parts.append(of_others(same_block_others(counted, ("number",)), negatives, "n"))
    if variants:
        changed = own.withColumn("name", mutate_variant_token(F.col("name"))).where("name IS NOT NULL").withColumn("label", F.lit(0)).withColumn("salt", turns(variants, "v"))
        k = (F.col("salt"), F.col("id"))
        parts.append(changed.select("entry", "label", "salt", F.concat_ws("-", F.lit("s"), *k).alias("id"), "brand", _named(F.col("brand"), F.col("name"), _tail(*k)).alias("name"), F.lit(None).cast("string").alias("gtin"), "ingredients", "size_value", "size_unit", "ord"))
    if brandless:
        bare = own.where(F.size("ingredients") >= 5).withColumn("label", F.lit(1)).withColumn("salt", turns(brandless, "b"))
        k = (F.col("salt"), F.col("id"))
        none = F.lit(None).cast("string")
        parts.append(bare.select("entry", "label", "salt", F.concat_ws("-", F.lit("s"), *k).alias("id"), none.alias("brand"), _named(F.lit(""), F.col("name"), _tail(*k)).alias("name"), none.alias("gtin"), _shortened(F.col("ingredients"), *k).alias("ingredients"), F.lit(None).cast("double").alias("size_value"), none.alias("size_unit"), "ord"))
    if cross:
        parts.append(of_others(cross_brand_others(counted, ("number",)), cross, "c"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_other_in_block(catalog: DataFrame) -> DataFrame:
    """(id) of entries that same_block_others() has a pair for: of each key, how many entries there are less those of the same product
    or barcode. No pair is made."""
    rows = kept(keyed(catalog).select("key", "id").distinct().join(catalog.select("id", "product_id", "gtin14"), "id"), "block-rows")
    out = rows
    for name, by in (("n", ["key"]), ("n_product", ["key", "product_id"]), ("n_gtin", ["key", "gtin14"]), ("n_both", ["key", "product_id", "gtin14"])):
        out = out.join(rows.groupBy(*by).agg(F.count("*").alias(name)), by, "left")
    # a barcode that is absent is nobody's, and finds no group
    none = lambda c: F.coalesce(c, F.lit(0))
    return out.where(F.col("n") - F.col("n_product") - none("n_gtin") + none("n_both") > 0).select("id").distinct()


def with_other_brand(catalog: DataFrame) -> DataFrame:
    """(id) of entries that cross_brand_others() has a pair for: those whose first word more than one brand has."""
    own = catalog.where("token IS NOT NULL").select("id", "token", brand_or_own(catalog).alias("bk"))
    ends = own.groupBy("token").agg(F.min("bk").alias("least"), F.max("bk").alias("most")).where("least <> most")
    return own.join(ends, "token").select("id").distinct()


def labeled_counts(catalog: DataFrame, positives: int = 2, negatives: int = 2, cross: int = 1, variants: int = 1, brandless: int = 0) -> DataFrame:
    """(label, kind, n): how many sightings of each kind labeled_sightings() gives, without drawing them: an entry with any other in its
    blocks, or of another brand, has one of these a turn, whichever it is."""
    changed = catalog.select(mutate_variant_token(F.col("name")).alias("changed")).where("changed IS NOT NULL")
    of = [
        (1, "p", positives, catalog), (1, "b", brandless, catalog.where(F.size("ingredients") >= 5)), (0, "n", negatives, with_other_in_block(catalog)),
        (0, "v", variants, changed), (0, "c", cross, with_other_brand(catalog)),
    ]
    out = None
    for label, kind, turns, entries in of:
        one = entries.agg((F.count("*") * turns).alias("n")).select(F.lit(label).alias("label"), F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def labeled_pairs(catalog: DataFrame, brands: DataFrame, **options) -> DataFrame:
    """(entry, id, label, features, vector) of labelled sightings."""
    # preparing reads them twice
    items = kept(prepared(kept(labeled_sightings(catalog, **options), "sightings"), brands), "labeled")
    pairs = sided(items.select(F.col("entry").alias("a"), F.col("id").alias("b"), "label"), catalog, items)
    return with_features(pairs).withColumn("vector", feature_vector()).drop("l", "r").withColumnsRenamed({"a": "entry", "b": "id"})


def split(rows: DataFrame, share: float = 0.8, seed: str = "1") -> tuple[DataFrame, DataFrame]:
    """Training and test rows by the hash of their id."""
    u = hash_unit(F.lit(f"split-{seed}"), F.col("id"))
    return rows.where(u < share), rows.where(u >= share)


#: Distinct (vector, label) pairs that gradient descent keeps on the driver at most; more are summed by jobs.
DISTINCT_MOST = 200_000


def train_logistic(rows: DataFrame, epochs: int = 600, rate: float = 0.3, l2: float = 1e-3, threshold: float = 0.5) -> Model:
    """Full-batch gradient descent from zero for a fixed number of epochs, the bias not shrunk. rows: vector, label.

    Vectors are few in kind, so they are counted first; beyond DISTINCT_MOST kinds each epoch is one aggregation.
    """
    kinds = rows.groupBy("vector", "label").agg(F.count("*").alias("n"))
    few = kinds.limit(DISTINCT_MOST + 1).cache()
    n_kinds = few.count()
    if not n_kinds:
        raise ValueError("no rows to train on")
    if n_kinds <= DISTINCT_MOST:
        got = few.toPandas().sort_values(["label", "vector"], key=lambda s: s.map(lambda v: tuple(v) if hasattr(v, "__len__") else v))
        x, y, n = np.array(got["vector"].tolist(), float), got["label"].to_numpy(float), got["n"].to_numpy(float)
        w, b = np.zeros(x.shape[1]), 0.0
        for _ in range(epochs):
            z = np.clip(x @ w + b, -700, 700)
            err = (1 / (1 + np.exp(-z)) - y) * n
            w, b = w - rate * (err @ x / n.sum() + l2 * w), b - rate * err.sum() / n.sum()
        few.unpersist()
        return Model(tuple(w.tolist()), float(b), threshold)
    few.unpersist()
    kinds = kinds.cache()
    dim = len(kinds.first()["vector"])
    total = kinds.agg(F.sum("n")).first()[0]
    model = Model((0.0,) * dim, 0.0, threshold)
    for _ in range(epochs):
        err = (vector_probability(F.col("vector"), model) - F.col("label")) * F.col("n")
        g = kinds.agg(*[F.sum(err * F.col("vector")[j]) for j in range(dim)], F.sum(err)).first()
        w = tuple(wj - rate * (g[j] / total + l2 * wj) for j, wj in enumerate(model.weights))
        model = Model(w, model.bias - rate * g[dim] / total, threshold)
    kinds.unpersist()
    return model


def confusion(tp: Column, fp: Column, tn: Column, fn: Column) -> list[Column]:
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    total = tp + fp + tn + fn
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [total.alias("total"), ratio(tp + tn, total).alias("accuracy"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn")]


def evaluate(rows: DataFrame, threshold: float) -> DataFrame:
    """One row of metrics of rows (p, label) at a threshold; ratios without a denominator are 0."""
    said, true = F.col("p") >= threshold, F.col("label") == 1
    c = rows.agg(*[F.count_if(x).alias(k) for k, x in {"tp": said & true, "fp": said & ~true, "tn": ~said & ~true, "fn": ~said & true}.items()])
    return c.select(F.lit(float(threshold)).alias("threshold"), *confusion(*[F.col(k) for k in ("tp", "fp", "tn", "fn")]))


#: Ranges of probabilities into which the sweep's running sums are dealt.
RANGES = 1000


def threshold_sweep(rows: DataFrame) -> DataFrame:
    """Metrics at every distinct probability and at 0.5 and 1.01, from running sums over distinct probabilities in two steps.

    Each of RANGES ranges of probabilities has its own running sums, and totals of ranges say what lies above; totals are met
    with one another, RANGES squared rows at most, so no step gathers all probabilities in one task.
    """
    spark = rows.sparkSession
    per = rows.where("p IS NOT NULL").groupBy("p").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    extra = spark.createDataFrame([(0.5, 0, 0), (1.01, 0, 0)], "p double, pos long, neg long")
    per = per.unionByName(extra).groupBy("p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # 0.5 and 1.01 may be the only rows; probabilities are from 0 to 1
    per = per.withColumn("range", F.floor(F.col("p") * RANGES).cast("int"))
    totals = per.groupBy("range").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    above = F.col("o.range") > F.col("r.range")
    some = lambda c, name: F.sum(F.when(above, F.col(f"o.{c}")).otherwise(F.lit(0))).alias(name)
    met = totals.select("range").alias("r").join(F.broadcast(totals.alias("o")))
    higher = met.groupBy("r.range").agg(some("pos", "pos_above"), some("neg", "neg_above"), F.sum("o.pos").alias("all_pos"), F.sum("o.neg").alias("all_neg"))
    within = Window.partitionBy("range").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    tp, fp = F.sum("pos").over(within) + F.col("pos_above"), F.sum("neg").over(within) + F.col("neg_above")
    c = per.join(F.broadcast(higher), "range").select(F.col("p").alias("threshold"), tp.alias("tp"), fp.alias("fp"), (F.col("all_neg") - fp).alias("tn"), (F.col("all_pos") - tp).alias("fn"))
    return c.select("threshold", *confusion(*[F.col(k) for k in ("tp", "fp", "tn", "fn")]))


def best_threshold(rows: DataFrame) -> DataFrame:
    """The sweep's row with the best F1, the higher threshold among equals."""
    return threshold_sweep(rows).orderBy(F.desc("f1"), F.desc("threshold")).limit(1)


def misclassified(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.where((F.col("p") >= threshold) != (F.col("label") == 1))


def train_matcher(catalog: DataFrame, brands: DataFrame, eval_pairs: DataFrame | None = None, seed: str = "1", **options) -> dict:
    """The training job: labelled pairs, split, fit, threshold on the training part, metrics on both held-out sets."""
    fit, test = split(labeled_pairs(catalog, brands, seed=seed, **options).select("id", "vector", "label"), seed=seed)
    model = train_logistic(fit)
    # to six places, as the threshold is kept
    scored = lambda rows: rows.select("label", F.round(vector_probability(F.col("vector"), model), 6).alias("p"))
    t = best_threshold(scored(fit)).first()["threshold"]
    model = Model(tuple(round(w, 6) for w in model.weights), round(model.bias, 6), round(t, 6))
    out = {"model": model, "test": evaluate(scored(test), model.threshold).first().asDict()}
    if eval_pairs is not None:
        out["eval"] = evaluate(scored(eval_pairs), model.threshold).first().asDict()
    return out


def write_model(spark: SparkSession, model: Model, path: str) -> None:
    """The model as a table of one row, weights to six places."""
    row = ([round(w, 6) for w in model.weights], round(model.bias, 6), round(model.threshold, 6))
    spark.createDataFrame([row], "weights array<double>, bias double, threshold double").coalesce(1).write.mode("overwrite").json(path)


def read_model(spark: SparkSession, path: str) -> Model:
    r = spark.read.schema("weights array<double>, bias double, threshold double").json(path).first()
    return Model(tuple(r["weights"]), r["bias"], r["threshold"])


def bucket(count: Column, cutoffs: tuple[int, int, int] = CUTOFFS) -> Column:
    small, mid, head = cutoffs
    return F.when(count >= head, "head").when(count >= mid, "mid").when(count >= small, "small").otherwise("tail")


def brand_sizes(catalog: DataFrame) -> DataFrame:
    """(product_id, brand_own, brand_size): how many products the product's brand has."""
    own = catalog.select("product_id", brand_or_own(catalog).alias("brand_own"))
    return own.join(own.groupBy("brand_own").agg(F.count("*").alias("brand_size")), "brand_own")


def outcome(product_id: Column, resolved: Column, ambiguous: Column) -> Column:
    return F.when(resolved.isNull(), "unresolved").when(resolved != product_id, "wrong").when(ambiguous, "ambiguous").otherwise("correct")


def measure_recall(probes: DataFrame, catalog: DataFrame, brands: DataFrame, model: Model = SHIPPED, cutoffs=CUTOFFS, **sighting) -> DataFrame:
    """(product_id, brand_size, bucket, outcome, confidence) of synthetic sightings of the probes against the catalog."""
    seen = kept(prepared(kept(synthetic_sightings(probes, **sighting), "probes"), brands), "probes")
    found = resolve(seen, catalog, model).select("id", F.col("product_id").alias("resolved"), "confidence", "ambiguous")
    out = seen.select("id", "product_id").join(found, "id", "left").join(brand_sizes(catalog).select("product_id", "brand_size"), "product_id", "left")
    size = F.coalesce("brand_size", F.lit(1))
    return out.select("product_id", size.alias("brand_size"), bucket(size, cutoffs).alias("bucket"), outcome(F.col("product_id"), F.col("resolved"), F.col("ambiguous")).alias("outcome"), "confidence")


def _spine(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b, i) for i, b in enumerate(BUCKETS)], "bucket string, bucket_ord int")


def recall_by_bucket(outcomes: DataFrame) -> DataFrame:
    """(bucket, bucket_ord, total, correct, ambiguous, wrong, unresolved, recall); empty buckets have 0 throughout."""
    sums = outcomes.groupBy("bucket").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    out = F.broadcast(_spine(outcomes.sparkSession)).join(sums, "bucket", "left").fillna(0, OUTCOMES)
    total = sum((F.col(o) for o in OUTCOMES), F.lit(0))
    return out.select("bucket", "bucket_ord", total.alias("total"), *OUTCOMES, F.when(total == 0, F.lit(0.0)).otherwise(F.col("correct") / total).alias("recall"))


def profile_by_bucket(catalog: DataFrame, cutoffs=CUTOFFS) -> DataFrame:
    """(bucket, bucket_ord, products, brands, gtin_coverage, mean_ingredients, mean_name_tokens); ingredients as listed."""
    sized = catalog.join(brand_sizes(catalog), "product_id").withColumn("bucket", bucket(F.col("brand_size"), cutoffs))
    sums = sized.groupBy("bucket").agg(
        F.count("*").alias("products"), F.count_distinct("brand_own").alias("brands"), F.avg(F.col("gtin14").isNotNull().cast("double")).alias("gtin_coverage"),
        F.avg(F.coalesce(F.size("ingredients"), F.lit(0)).cast("double")).alias("mean_ingredients"), F.avg(F.size(name_tokens(F.col("name"))).cast("double")).alias("mean_name_tokens"),
    )
    # four rows
    out = F.broadcast(_spine(catalog.sparkSession)).join(sums, "bucket", "left")
    return out.fillna(0, ["products", "brands"]).fillna(0.0, ["gtin_coverage", "mean_ingredients", "mean_name_tokens"])


def fairness_gap(by_bucket: DataFrame) -> DataFrame:
    """(best, worst, gap, most_ambiguous) over buckets that have probes."""
    some = by_bucket.where("total > 0")
    by = lambda sign: F.struct(F.col("recall"), F.col("bucket_ord") * sign)
    return some.agg(
        F.max_by("bucket", by(-1)).alias("best"), F.min_by("bucket", by(1)).alias("worst"), (F.max("recall") - F.min("recall")).alias("gap"),
        F.max_by("bucket", F.struct(F.col("ambiguous"), -F.col("bucket_ord"))).alias("most_ambiguous"),
    )


def stratified_probes(catalog: DataFrame, per_bucket: int, seed: str = "1", cutoffs=CUTOFFS) -> DataFrame:
    """At most ``per_bucket`` entries of each bucket, by the hash of their id: a sampling operator."""
    sized = catalog.join(brand_sizes(catalog).select("product_id", "brand_size"), "product_id").withColumn("bucket", bucket(F.col("brand_size"), cutoffs))
    order = Window.partitionBy("bucket").orderBy(hash_unit(F.lit(seed), F.col("product_id")), "product_id")
    return sized.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_bucket).drop("_r", "bucket", "brand_size")


def rate_check(probes: DataFrame, catalog: DataFrame, brands: DataFrame, rated: DataFrame) -> DataFrame:
    """(probes, resolved, resolved_to_rated, ambiguous): sightings without size against the catalog."""
    bare = synthetic_sightings(probes).withColumn("size_value", F.lit(None).cast("double")).withColumn("size_unit", F.lit(None).cast("string"))
    found = resolve(kept(prepared(bare, brands), "bare"), catalog).join(rated.select("product_id", F.lit(True).alias("rated")), "product_id", "left")
    sums = found.agg(F.count("*").alias("resolved"), F.count_if("rated").alias("resolved_to_rated"), F.count_if("ambiguous").alias("ambiguous"))
    return probes.agg(F.count("*").alias("probes")).crossJoin(F.broadcast(sums))
