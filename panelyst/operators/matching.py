"""Pair features, logistic scores, resolution against a catalog and clustering."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import jaro_winkler, jaro_winkler_most
from ..functions.text import overlap_coefficient, sizes_equal
from ..functions.variants import variants_conflict
from .blocking import blocked, candidate_pairs, met, numbered, sharing
from .graph import connected, kept

FEATURES = ["gtin_exact", "name_jaro_winkler", "name_token_set", "brand_match", "ingredients_overlap", "size_match", "variant_conflict"]
LEAST_INGREDIENTS = 5
AMBIGUITY = 0.04


@dataclass(frozen=True)
class Model:
    """Two weights a feature, of its value and of its presence; a bias and a decision threshold."""

    weights: tuple[float, ...]
    bias: float
    threshold: float


# The trained matcher, and the weights of the scorer by hand.
SHIPPED = Model(
    (1.120789, 1.120789, 0.83305, -1.118733, 6.00276, -1.118733, 2.09109, -2.268213, 1.389039, -0.661468, 1.861667, -1.405016, -1.58655, -1.58655),
    -1.719905,
    0.866257,
)
HAND_WEIGHTS = [6.0, 2.0, 1.5, 2.5, 3.0, 1.0, -4.0]

SIDE = ["norm_name", "name_chars", "name_words", "gtin14", "brand_key", "ingredients", "ingredient_set", "size_value", "size_unit", "variants"]


def sided(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs with what features need of both sides, as structs l and r."""
    one = lambda df, key, name: df.select(F.col("id").alias(key), F.struct(*SIDE).alias(name))
    return pairs.join(one(left, a, "l"), a).join(one(right, b, "r"), b)


def with_features(pairs: DataFrame) -> DataFrame:
    """The seven features of pairs with l and r; NULL where a side lacks what a feature compares.

    A common barcode is TRUE or NULL, a variant conflict too: neither's absence says anything.
    """
    return with_name_similarity(with_cheap_features(pairs))


def _both_named() -> Column:
    return F.col("l.norm_name").isNotNull() & F.col("r.norm_name").isNotNull()


def with_name_similarity(pairs: DataFrame) -> DataFrame:
    """The one feature that leaves the JVM."""
    return pairs.withColumn("name_jaro_winkler", F.when(_both_named(), jaro_winkler(F.col("l.norm_name"), F.col("r.norm_name"), once=True)))


def with_name_features(pairs: DataFrame) -> DataFrame:
    """What names alone say, but Jaro-Winkler."""
    out = pairs.withColumn("name_token_set", F.when(_both_named(), overlap_coefficient(F.col("l.name_words"), F.col("r.name_words"))))
    return out.withColumn("variant_conflict", F.when(variants_conflict(F.col("l.variants"), F.col("r.variants")), F.lit(True)))


def with_list_features(pairs: DataFrame) -> DataFrame:
    """What ingredient lists alone say."""
    lhs, rhs = F.col("l"), F.col("r")
    enough = lambda x: (F.size(x["ingredients"]) >= LEAST_INGREDIENTS) & (F.size(x["ingredient_set"]) >= LEAST_INGREDIENTS)
    return pairs.withColumn("ingredients_overlap", F.when(enough(lhs) & enough(rhs), overlap_coefficient(lhs["ingredient_set"], rhs["ingredient_set"])))


def with_cheap_features(pairs: DataFrame) -> DataFrame:
    """All features but Jaro-Winkler, of built-in functions."""
    lhs, rhs = F.col("l"), F.col("r")
    return (
        with_list_features(with_name_features(pairs)).withColumn("gtin_exact", F.when(lhs["gtin14"] == rhs["gtin14"], F.lit(True)))
        .withColumn("brand_match", lhs["brand_key"] == rhs["brand_key"])
        .withColumn("size_match", sizes_equal(lhs["size_value"], F.nullif(lhs["size_unit"], F.lit("")), rhs["size_value"], F.nullif(rhs["size_unit"], F.lit(""))))
    )


def feature_vector() -> Column:
    """14 numbers: value and presence of each feature; absent is (0, 0)."""
    parts = []
    for f in FEATURES:
        c = F.col(f).cast("double")
        parts += [F.coalesce(c, F.lit(0.0)), c.isNotNull().cast("double")]
    return F.array(*parts)


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def logit(model: Model = SHIPPED, name_similarity: Column | None = None) -> Column:
    """The model's sum over the feature columns; with ``name_similarity`` in place of the column name_jaro_winkler."""
    z = F.lit(0.0)
    for i, f in enumerate(FEATURES):
        c = (F.col(f) if name_similarity is None or f != "name_jaro_winkler" else name_similarity).cast("double")
        z = z + F.coalesce(c * F.lit(model.weights[2 * i]) + F.lit(model.weights[2 * i + 1]), F.lit(0.0))
    return z + F.lit(model.bias)


def probability(model: Model = SHIPPED) -> Column:
    """The match probability over the feature columns, as one sum that stays in generated code."""
    return sigmoid(logit(model))


def hits_among(sides: DataFrame, model: Model = SHIPPED) -> DataFrame:
    """Pairs with l and r whose probability reaches the threshold, with features and score.

    Jaro-Winkler is bounded first, by the characters that both names have and their common beginning, in built-in functions;
    pairs that stay below the threshold even so never reach the Arrow function.
    """
    return with_name_similarity(able(sides, model)).withColumn("score", probability(model)).where(F.col("score") >= model.threshold)


def able(sides: DataFrame, model: Model = SHIPPED) -> DataFrame:
    """Pairs with all features but Jaro-Winkler that could reach the threshold under its bounds.

    Those that couldn't even with equal names go first, which costs little; only of the rest are characters compared.
    """
    cheap = with_cheap_features(sides)
    weight = model.weights[2 * FEATURES.index("name_jaro_winkler")]
    bounds = [F.lit(0.0)]
    if weight >= 0:
        bounds = [F.lit(1.0), jaro_winkler_most(*[F.col(f"{side}.{c}") for c in ("norm_name", "name_chars") for side in "lr"])]
    for most in bounds:
        cheap = cheap.where(logit(model, F.when(_both_named(), most)) >= _least_logit(model))
    return cheap


def _least_logit(model: Model) -> float:
    """What a hit's sum is at least; a hair below, so that rounding loses nothing."""
    return math.log(model.threshold / (1 - model.threshold)) - 1e-9 if 0 < model.threshold < 1 else math.inf * (model.threshold - 0.5)


def brand_alone_most(model: Model = SHIPPED) -> float:
    """The highest probability of a pair of one brand without common barcode or name word, whatever else agrees or is absent."""
    w = dict(zip(FEATURES, zip(model.weights[::2], model.weights[1::2], strict=True), strict=True))
    most = lambda f: max(0.0, w[f][0]) + w[f][1]
    names = w["name_token_set"][1] + most("name_jaro_winkler")
    z = model.bias + sum(w["brand_match"]) + max(0.0, names) + max(0.0, most("ingredients_overlap")) + max(0.0, most("size_match")) + max(0.0, sum(w["variant_conflict"]))
    return 1 / (1 + math.exp(-z))


def other_brand_most(model: Model = SHIPPED) -> float:
    """The highest probability of a pair of two brands without common barcode, whatever else agrees or is absent."""
    w = dict(zip(FEATURES, zip(model.weights[::2], model.weights[1::2], strict=True), strict=True))
    most = lambda f: max(0.0, w[f][0]) + w[f][1]
    names = max(0.0, most("name_token_set") + most("name_jaro_winkler"))
    z = model.bias + w["brand_match"][1] + names + max(0.0, most("ingredients_overlap")) + max(0.0, most("size_match")) + max(0.0, sum(w["variant_conflict"]))
    return 1 / (1 + math.exp(-z))


def names_lead(model: Model) -> bool:
    """Whether hits() may go from names to items: brands meet by name words, and two brands by a barcode only."""
    return brand_words_suffice(model) and other_brand_most(model) < model.threshold


def brand_words_suffice(model: Model) -> bool:
    """Whether brands need to meet by name words only: pairs that this leaves out stay below the threshold."""
    return brand_alone_most(model) < model.threshold


#: What a name pair says of all pairs of items that have these names.
NAME = ["brand_key", "norm_name", "name_chars", "name_words", "variants"]


def named(items: DataFrame) -> DataFrame:
    """Items with a brand and a name, with name_id: the same for all that have both and their variant tokens in common."""
    known = items.where("brand_key IS NOT NULL AND norm_name IS NOT NULL")
    return known.withColumn("name_id", F.md5(F.to_json(F.struct("brand_key", "norm_name", "variants"))))


def names_of(items: DataFrame) -> DataFrame:
    """(name_id, NAME): each name of named() items once."""
    return items.groupBy("name_id").agg(*[F.first(c).alias(c) for c in NAME])


def name_words_of(names: DataFrame) -> DataFrame:
    """(key, word, id): the words by which names of a brand meet."""
    return names.select(F.col("brand_key").alias("key"), F.explode("name_words").alias("word"), F.col("name_id").alias("id"))


def name_pairs(left: DataFrame, right: DataFrame, model: Model = SHIPPED, pairs: DataFrame | None = None) -> DataFrame:
    """(a_name, b_name, name_token_set, name_jaro_winkler, variant_conflict, missing, unequal) of names of one brand that have a word in
    common and whose items could reach the threshold without a common barcode; ``missing`` where they could without a size on
    either side, ``unequal`` where they could with two sizes that differ.

    All that names say is worked out here, once a pair of names, however many items have them. ``pairs`` (a, b) are those that
    have a word in common, if they are known already.
    """
    pairs = met(name_words_of(left), name_words_of(right), ["key", "word"]).select("a", "b").distinct() if pairs is None else pairs
    one = lambda df, key, name: df.select(F.col("name_id").alias(key), F.struct(*NAME).alias(name))
    rows = pairs.join(one(left, "a", "l"), "a").join(one(right, "b", "r"), "b")
    rows = rows.withColumn("name_token_set", overlap_coefficient(F.col("l.name_words"), F.col("r.name_words")))
    rows = rows.withColumn("variant_conflict", F.when(variants_conflict(F.col("l.variants"), F.col("r.variants")), F.lit(True)))
    w = dict(zip(FEATURES, zip(model.weights[::2], model.weights[1::2], strict=True), strict=True))
    part = lambda f, c: F.coalesce(c.cast("double") * w[f][0] + w[f][1], F.lit(0.0))
    most = lambda f: max(0.0, max(0.0, w[f][0]) + w[f][1])
    others = part("name_token_set", F.col("name_token_set")) + part("variant_conflict", F.col("variant_conflict")) + F.lit(model.bias + sum(w["brand_match"]))
    by_names = lambda jw: others + part("name_jaro_winkler", jw)
    least, unequal = _least_logit(model), w["size_match"][1]
    best = most("ingredients_overlap") + most("size_match")
    bounds = [F.lit(0.0)]
    if w["name_jaro_winkler"][0] >= 0:
        bounds = [F.lit(1.0), jaro_winkler_most(*[F.col(f"{side}.{c}") for c in ("norm_name", "name_chars") for side in "lr"])]
    for bound in bounds:
        rows = rows.where(by_names(bound) + best >= least)
    rows = with_name_similarity(rows)
    z = by_names(F.col("name_jaro_winkler"))
    rows = rows.where(z + best >= least).withColumn("missing", z + most("ingredients_overlap") >= least).withColumn("unequal", z + (most("ingredients_overlap") + unequal) >= least)
    return rows.select(F.col("a").alias("a_name"), F.col("b").alias("b_name"), "name_token_set", "name_jaro_winkler", "variant_conflict", "missing", "unequal")


def name_members(items: DataFrame) -> DataFrame:
    """(name_id, id, m): what named() items compare beside their names."""
    listed = F.when((F.size("ingredients") >= LEAST_INGREDIENTS) & (F.size("ingredient_set") >= LEAST_INGREDIENTS), F.col("ingredient_set"))
    unit = F.regexp_replace(F.lower(F.nullif("size_unit", F.lit(""))), "[.]?$", "")
    return items.select("name_id", "id", F.struct("gtin14", listed.alias("listed"), "size_value", unit.alias("size_unit")).alias("m"))


def numbered_lists(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """name_members() of both sides with the lists' numbers in place of the lists, and (l_list, r_list, overlap) of all pairs of
    numbers; with more than TABLED lists as they were, and None."""
    lists = left.select("m.listed").union(right.select("m.listed")).where("listed IS NOT NULL").distinct()
    if lists.limit(TABLED + 1).count() > TABLED:
        return left, right, None
    # TABLED rows at most
    lists = kept(lists.select("listed", F.row_number().over(Window.orderBy("listed")).alias("no")), "lists")
    one = lambda side: lists.select(F.col("no").alias(f"{side}_list"), F.col("listed").alias(side))
    tasks = 4 * left.sparkSession.sparkContext.defaultParallelism
    pairs = one("l").repartition(tasks, "l_list").crossJoin(F.broadcast(one("r")))
    table = kept(pairs.select("l_list", "r_list", overlap_coefficient(F.col("l"), F.col("r")).alias("overlap")), "list-pairs")
    number = lambda df: df.join(F.broadcast(lists), F.col("m.listed") == F.col("listed"), "left").withColumn("m", F.col("m").withField("listed", F.col("no"))).drop("listed", "no")
    return number(left), number(right), table


def hits_by_names(left: DataFrame, right: DataFrame, by_name: DataFrame, model: Model = SHIPPED, ordered: bool = False, overlaps: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, features, score) of name_members() of both sides whose names are a pair of name_pairs() and that reach the threshold;
    pairs with a common barcode are not among them. ``overlaps`` is what numbered_lists() says of lists; ``also`` are further
    columns of either side to keep.

    Where sizes have to be equal, items meet by name and size: half units are a range, and what is less than half a unit away
    is in the same or the next one.
    """
    mine = left.select(F.col("name_id").alias("a_name"), F.col("id").alias("a"), F.col("m").alias("l"), *[c for c in also if c in left.columns])
    theirs = right.select(F.col("name_id").alias("b_name"), F.col("id").alias("b"), F.col("m").alias("r"), *[c for c in also if c in right.columns])
    asked = mine.join(by_name, "a_name").drop("a_name")
    unit = lambda x: F.col(f"{x}.size_unit").alias("unit")
    span = lambda x: F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), F.col(f"{x}.size_value") * 2)))
    has = lambda x: F.col(f"{x}.size_value").isNotNull() & F.col(f"{x}.size_unit").isNotNull()
    near = theirs.where(has("r")).select("*", unit("r"), F.explode(F.sequence(span("r") - 1, span("r") + 1)).alias("span"))
    pairs = asked.where(~F.col("unequal") & has("l")).select("*", unit("l"), span("l").alias("span")).join(near, ["b_name", "unit", "span"]).drop("unit", "span")
    for some, of in ((F.col("unequal") & has("l"), has("r")), (F.col("missing") & ~has("l"), F.lit(True)), (F.col("missing") & has("l"), ~has("r"))):
        pairs = pairs.unionByName(asked.where(some).join(theirs.where(of), "b_name"))
    pairs = pairs.where("NOT coalesce(l.gtin14 = r.gtin14, false)" + (" AND a < b" if ordered else ""))
    lhs, rhs = F.col("l"), F.col("r")
    overlap = F.when(lhs["listed"].isNotNull() & rhs["listed"].isNotNull(), overlap_coefficient(lhs["listed"], rhs["listed"])) if overlaps is None else F.col("overlap")
    if overlaps is not None:
        pairs = pairs.join(F.broadcast(overlaps), (lhs["listed"] == F.col("l_list")) & (rhs["listed"] == F.col("r_list")), "left")
    out = (
        pairs.withColumn("gtin_exact", F.lit(None).cast("boolean")).withColumn("brand_match", F.lit(True)).withColumn("ingredients_overlap", overlap)
        .withColumn("size_match", (lhs["size_unit"] == rhs["size_unit"]) & (F.abs(lhs["size_value"] - rhs["size_value"]) < 0.5))
    )
    out = out.where(logit(model) >= _least_logit(model)).withColumn("score", probability(model)).where(F.col("score") >= model.threshold)
    return out.select("a", "b", *FEATURES, "score", *also)


#: Scores from a half to one times this are whole numbers.
SCORE_UNITS = 1 << 53


def near_hits(mine: DataFrame, theirs: DataFrame, by_name: DataFrame, others: DataFrame, entries: DataFrame, model: Model = SHIPPED) -> DataFrame:
    """(a, b, score) of the hits that decide what an item resolves to: its best entry, and the best of any other product if that is
    within AMBIGUITY; the first of the catalog among equals.

    ``mine`` and ``theirs`` are name_members(), ``others`` the hits by other keys, ``entries`` the catalog. Hits of popular names grow
    with the square of their items, so they are made twice rather than moved: each time one number an item is kept in
    place, its score with the entry's place in the catalog.
    """
    places = kept(numbered(entries.select("id", "product_id", "ord").orderBy("ord", "id")), "places").select(F.col("id").alias("b"), F.col("product_id").alias("b_product"), "number")
    mine, theirs, overlaps = numbered_lists(mine, theirs.join(places.withColumnRenamed("b", "id"), "id"))
    others = kept(others.select("a", "b", "score").join(places, "b"), "other-hits")
    packed = (F.col("score") * SCORE_UNITS).cast("long").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(12,0)") + (F.lit((1 << 31) - 1) - F.col("number")).cast("decimal(12,0)")

    def first(rows: DataFrame) -> DataFrame:
        # a decimal is aggregated in place, as a struct is not
        top = kept(rows.groupBy("a").agg(F.max(packed).alias("top")), "top-hits")
        least = F.lit(1 << 31).cast("decimal(12,0)")
        rest = F.col("top") % least
        # without the rest, which a quotient of few digits would round up
        one = top.select("a", (((1 << 31) - 1) - rest.cast("long")).alias("number"), (((F.col("top") - rest) / least).cast("long").cast("double") / SCORE_UNITS).alias("score"))
        return kept(one.join(places, "number").drop("number"), "first-hits")

    has = ("b_product", "number")
    best = first(hits_by_names(mine, theirs, by_name, model, overlaps=overlaps, also=has).select("a", "score", *has).unionByName(others.select("a", "score", *has)))
    bar = best.select("a", F.col("score").alias("best"), F.col("b_product").alias("best_product"))
    again = hits_by_names(mine.join(bar.withColumnRenamed("a", "id"), "id"), theirs, by_name, model, overlaps=overlaps, also=(*has, "best", "best_product"))
    again = again.select("a", "score", *has, "best", "best_product").unionByName(others.join(bar, "a").select("a", "score", *has, "best", "best_product"))
    following = first(again.where((F.col("b_product") != F.col("best_product")) & (F.col("best") - F.col("score") < AMBIGUITY)))
    return best.unionByName(following).select("a", "b", "score")


def hits(left: DataFrame, right: DataFrame, model: Model = SHIPPED, fine_only: bool = False, ordered: bool = False) -> DataFrame:
    """(a, b, features, score) of all pairs of prepared items that share a key and reach the threshold; with ``ordered`` both tables
    are one, and a < b.

    Where names_lead, brands meet name by name and only items of names that can reach the threshold meet at all, so that the
    work goes with names and hits, not with the square of a brand or of an ingredient list's copies. Barcodes meet item by item,
    ingredient bands where one side has no brand: with two brands and no barcode no pair gets there.
    """
    if fine_only or not names_lead(model):
        words = brand_words_suffice(model)
        pairs = candidate_pairs(left, fine_only, words) if ordered else blocked(left, right, fine_only, words).withColumnsRenamed({"id": "a", "entry_id": "b"})
        return hits_among(sided(pairs.select("a", "b"), left, right), model).select("a", "b", *FEATURES, "score")
    mine, theirs, by_name = met_by_names(left, right, model, ordered)
    mine, theirs, overlaps = numbered_lists(mine, theirs)
    return hits_by_names(mine, theirs, by_name, model, ordered, overlaps=overlaps).unionByName(hits_without_names(left, right, model, ordered))


def met_by_names(left: DataFrame, right: DataFrame, model: Model = SHIPPED, ordered: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """name_members() of both tables and the name_pairs() between them."""
    mine = named(left)
    theirs = mine if ordered else named(right)
    my_names = kept(names_of(mine), "names")
    by_name = kept(name_pairs(my_names, my_names if ordered else kept(names_of(theirs), "names"), model), "name-pairs")
    return name_members(mine), name_members(theirs), by_name


def hits_without_names(left: DataFrame, right: DataFrame, model: Model = SHIPPED, ordered: bool = False) -> DataFrame:
    """The hits that names_lead leaves to other keys: a common barcode, or an ingredient band where a side has no brand."""
    coded = lambda df: df.where("gtin14 IS NOT NULL").select("gtin14", "id")
    turn = lambda pairs: pairs.select("a", "b").where("a < b") if ordered else pairs.select("a", "b")
    out = hits_among(sided(turn(met(coded(left), coded(right), ["gtin14"])), left, right), model).select("a", "b", *FEATURES, "score")
    banded = lambda df: df.select("brand_key", "id", F.explode(F.filter("keys", lambda k: k.startswith("ing:"))).alias("key"))
    bare, branded = F.col("brand_key").isNull(), F.col("brand_key").isNotNull()
    any_bare = lambda df: df.where(bare & (F.size("ingredient_set") >= LEAST_INGREDIENTS)).limit(1).count() > 0
    ways = [(bare, None)] if any_bare(left) else []
    ways += [(branded, bare)] if any_bare(right) else []
    for l_is, r_is in ways:
        lhs, rhs = banded(left).where(l_is), banded(right) if r_is is None else banded(right).where(r_is)
        pairs = turn(met(lhs.select("key", "id"), rhs.select("key", "id"), ["key"])).distinct()
        sides = sided(pairs, left, right).where("NOT coalesce(l.gtin14 = r.gtin14, false)")
        out = out.unionByName(hits_among(sides, model).select("a", "b", *FEATURES, "score"))
    return out


def vector_probability(vector: Column, model: Model) -> Column:
    return sigmoid(sum((vector[i] * F.lit(float(w)) for i, w in enumerate(model.weights)), F.lit(0.0)) + F.lit(model.bias))


def hand_score() -> Column:
    """Weighted mean of the present features by hand-made weights; 0 if they cancel out or none is present."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for f, w in zip(FEATURES, HAND_WEIGHTS, strict=True):
        c = F.col(f).cast("double")
        top, bottom = top + F.coalesce(c * w, F.lit(0.0)), bottom + F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
    return F.coalesce(top / F.nullif(bottom, F.lit(0.0)), F.lit(0.0))


def scored_pairs(items: DataFrame, model: Model = SHIPPED, fine_only: bool = False, brand_words: bool = False) -> DataFrame:
    """(a, b, via, features, score) of all candidate pairs of prepared items."""
    return with_features(sided(candidate_pairs(items, fine_only, brand_words), items, items)).withColumn("score", probability(model)).drop("l", "r")


#: Distinct names, or ingredient lists, of which all pairs are worked out beforehand and broadcast: a million rows at most.
TABLED = 1000


def tabled(items: DataFrame, number: str, columns: list[str], work) -> tuple[DataFrame, DataFrame] | None:
    """Items with a column ``number`` that is the same for rows equal in ``columns``, and (l_number, r_number, what ``work`` makes of
    these columns in structs l and r) of all pairs of numbers; None if there are more than TABLED of them."""
    spark = items.sparkSession
    key = F.md5(F.to_json(F.struct(*columns)))
    values = items.select(key.alias("_key"), *columns).dropDuplicates(["_key"])
    if values.select("_key").limit(TABLED + 1).count() > TABLED:
        return None
    # TABLED rows at most
    values = kept(values.withColumn(number, F.row_number().over(Window.orderBy("_key"))), number)
    one = lambda side: values.select(F.col(number).alias(f"{side}_{number}"), F.struct(*columns).alias(side))
    pairs = one("l").repartition(4 * spark.sparkContext.defaultParallelism, f"l_{number}").crossJoin(F.broadcast(one("r")))
    own = items.withColumn("_key", key).join(F.broadcast(values.select("_key", number)), "_key").drop("_key")
    return own, kept(work(pairs).drop("l", "r"), f"pairs-of-{number}")


def every_scored_pair(items: DataFrame, model: Model = SHIPPED) -> DataFrame:
    """(a, b, features, score) of all pairs of prepared items that share a key, a < b, each made once.

    What names say, Jaro-Winkler among it, is worked out once a pair of distinct names, and what ingredient lists say once a
    pair of lists, where there are few of them; a pair of items looks both up. Where there are many, it is worked out pair by pair.
    """
    bare = F.regexp_replace(F.lower(F.nullif("size_unit", F.lit(""))), "[.]?$", "")
    columns, tables, later = ["size_value", "unit"], {}, []
    items = items.withColumn("unit", bare)
    said = {
        "name_no": (["norm_name", "name_words", "variants"], lambda p: with_name_similarity(with_name_features(p))),
        "list_no": (["ingredients", "ingredient_set"], with_list_features),
    }
    for number, (of, work) in said.items():
        if (made := tabled(items, number, of, work)) is None:
            columns, later = columns + of, [*later, work]
        else:
            items, tables[number] = made
            columns = [*columns, number]
    items = kept(items.select("id", "brand_key", "gtin14", "keys", *columns), "numbered")
    pairs = sharing(items, columns, ordered=True)
    for number, table in tables.items():
        pairs = pairs.join(F.broadcast(table), (F.col(f"l.{number}") == F.col(f"l_{number}")) & (F.col(f"r.{number}") == F.col(f"r_{number}")))
    lhs, rhs = F.col("l"), F.col("r")
    pairs = pairs.withColumn("gtin_exact", F.when(lhs["gtin14"] == rhs["gtin14"], F.lit(True))).withColumn("brand_match", lhs["brand_key"] == rhs["brand_key"])
    pairs = pairs.withColumn("size_match", (lhs["unit"] == rhs["unit"]) & (F.abs(lhs["size_value"] - rhs["size_value"]) < 0.5))
    for work in later:
        pairs = work(pairs)
    return pairs.select(lhs["id"].alias("a"), rhs["id"].alias("b"), *FEATURES).withColumn("score", probability(model))


def cluster_listings(items: DataFrame, model: Model = SHIPPED, fine_only: bool = False, brand_words: bool = False) -> tuple[DataFrame, DataFrame]:
    """((id, cluster_id), scored pairs): single-link clusters over pairs at or above the threshold; singletons stay.

    Where brand_words_suffice, ``brand_words`` gives the same clusters and leaves pairs below the threshold out of the scored ones.
    """
    scored = scored_pairs(items, model, fine_only, brand_words)
    return clusters(items.select("id"), hits(items, items, model, fine_only, ordered=True)), scored


def clusters(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, cluster_id): connected components over links (a, b), named by their least id; singletons stay."""
    roots = connected(links.select("a", "b"))
    return ids.join(roots.select(F.col("node").alias("id"), "root").hint("merge"), "id", "left").select("id", F.coalesce("root", "id").alias("cluster_id"))


def resolve(items: DataFrame, catalog: DataFrame, model: Model = SHIPPED, fine_only: bool = False, pairs: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """(id, product_id, entry_id, confidence, ambiguous, reason) of items that resolve; prepared inputs, the catalog with product_id.
    ``pairs`` (id, entry_id) are the candidates if they are known already, ``found`` the hits, of which near_hits() are enough.

    The best entry at or above the threshold wins, the first of the catalog among equals; it is ambiguous if the best entry
    of any other product comes within 0.04.
    """
    entries = catalog.select(F.col("id").alias("entry_id"), "product_id", F.col("ord").alias("entry_ord"))
    if found is None:
        # the same hits as by whole brands, without their quadratic buckets
        if pairs is None and not fine_only and names_lead(model):
            found = near_hits(*met_by_names(items, catalog, model), hits_without_names(items, catalog, model), catalog, model)
        else:
            found = hits(items, catalog, model, fine_only) if pairs is None else hits_among(sided(pairs.withColumnsRenamed({"id": "a", "entry_id": "b"}), items, catalog), model)
    scored = found.select(F.col("a").alias("id"), F.col("b").alias("entry_id"), "score").join(entries, "entry_id")
    # the best of each product first: partial aggregation, so that popular items don't gather all their hits in a window
    by_product = scored.groupBy("id", "product_id").agg(F.max_by(F.struct("entry_id", "score", "entry_ord"), F.struct("score", -F.col("entry_ord"))).alias("h"))
    order = Window.partitionBy("id").orderBy(F.desc("h.score"), "h.entry_ord")
    two = by_product.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("h").over(order)).where("place = 1")
    close = F.coalesce(F.col("h.score") - F.col("next.score") < AMBIGUITY, F.lit(False))
    fixed = lambda c: F.format_number(c, 2)
    reason = F.concat(F.lit("matched "), F.col("h.entry_id"), F.lit(" at "), fixed(F.col("h.score")))
    full = F.when(close, F.concat(reason, F.lit(" (ambiguous vs "), F.col("next.entry_id"), F.lit(" "), fixed(F.col("next.score")), F.lit(")"))).otherwise(reason)
    return two.select("id", "product_id", F.col("h.entry_id").alias("entry_id"), F.col("h.score").alias("confidence"), close.alias("ambiguous"), full.alias("reason"))


def resolve_sightings(items: DataFrame, catalog: DataFrame, curated: DataFrame, **options) -> DataFrame:
    """Curated identities first (item column asin, table asin, product_id) at confidence 1, the rest by resolve(); items that
    resolve to nothing keep a row of NULLs."""
    known = items.select("id", F.upper("asin").alias("asin")).join(curated.select(F.upper("asin").alias("asin"), "product_id"), "asin")
    exact = known.select("id", "product_id", F.lit(None).cast("string").alias("entry_id"), F.lit(1.0).alias("confidence"), F.lit(False).alias("ambiguous"), F.lit("curated id").alias("reason"))
    rest = items.join(exact.select("id"), "id", "left_anti")
    fuzzy = resolve(rest, catalog, **options)
    return items.select("id").join(exact.unionByName(fuzzy), "id", "left")
