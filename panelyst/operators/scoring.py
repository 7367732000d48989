"""Pillars: normalised ratings by product and axis, and composites made at query time only.

Inputs: ratings (product_id, source_id, score_raw, match_confidence, match_method, match_reviewed, ord) and sources (id, name,
axis, scale_min, scale_max, scale_direction, funding_model). ``ord`` is the order of a product's ratings; ties go by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Axes in their order, their prose, the threshold of a split, demonstration sources.
AXES = ["ingredient_safety", "environmental", "labor", "packaging"]
AXIS_PHRASE = {"ingredient_safety": "ingredient safety", "environmental": "environmental impact", "labor": "labor practices", "packaging": "packaging"}
SPLIT_POINTS = 20
ILLUSTRATIVE = ["ewg", "yuka", "inci-beauty", "good-on-you", "how2recycle"]
#: Sources are broadcast up to so many rows.
BROADCAST_SOURCES = 200_000


def axis_rank(axis: Column) -> Column:
    return F.array_position(F.array(*[F.lit(a) for a in AXES]), axis)


def normalize_score(raw: Column, low: Column, high: Column, direction: Column) -> Column:
    """Clamped to the scale, on 0 to 100, higher being better; 0 on a scale without extent."""
    t = (F.greatest(low, F.least(high, raw)) - low) / F.nullif(high - low, F.lit(0.0))
    return F.when(high == low, F.lit(0.0)).when(direction == "higher_is_better", t * 100).otherwise((1 - t) * 100)


def verdict_band(score: Column) -> Column:
    """excellent from 85, good from 70, fair from 55, poor from 40, else bad; NULL for NULL and NaN."""
    bands = F.when(score >= 85, "excellent").when(score >= 70, "good").when(score >= 55, "fair").when(score >= 40, "poor").otherwise("bad")
    return F.when(score.isNotNull() & ~F.isnan(score), bands)


def is_illustrative(source_id: Column) -> Column:
    return source_id.isin(*ILLUSTRATIVE)


def default_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, 1.0) for a in AXES], "axis string, w double")


def stored_weights(spark: SparkSession, stored: DataFrame | None) -> DataFrame:
    """Weights that a user keeps, over the defaults; axes that are missing there have 1."""
    base = default_weights(spark)
    if stored is None:
        return base
    return base.select("axis").join(stored.select("axis", F.col("w").alias("own")), "axis", "left").select("axis", F.coalesce("own", F.lit(1.0)).alias("w"))


def normalized_ratings(ratings: DataFrame, sources: DataFrame) -> DataFrame:
    """Ratings with their source's name, axis and funding, and score; ratings of unknown sources go."""
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "axis", "scale_min", "scale_max", "scale_direction", "funding_model")
    joined = ratings.join(s, "source_id")  # broadcast or not as the optimiser finds the table small
    score = normalize_score(F.col("score_raw"), F.col("scale_min"), F.col("scale_max"), F.col("scale_direction"))
    return joined.withColumn("score", score).drop("scale_min", "scale_max", "scale_direction")


RATING_FIELDS = ("ord", "source_id", "source_name", "funding_model", "score", "score_raw", "match_confidence", "match_method", "match_reviewed")


def pillars(rated: DataFrame, keep_ratings: bool = True, ends: bool | None = None, in_order: bool = False) -> DataFrame:
    """(product_id, axis, representative, spread_min, spread_max, n, disagreement, ratings) of axes with ratings.

    The mean represents an axis; extremes are NULL below two ratings. Nothing blends axes here. ``ends`` adds first, low and
    high: the first rating, the first of the lowest and the last of the highest, which takes no list of all; it goes
    with the ratings unless it is said.

    Where ratings have ``at``, their place in the table, ties that ``ord`` leaves open go by it; ``in_order`` also sums the mean by
    it, so that its last digits, and what hangs on them, don't vary with how the table was dealt to tasks.
    """
    mean = F.avg("score")
    if in_order:
        mean = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "score"))), F.lit(0.0), lambda total, x: total + x["score"]) / F.count("*")
    aggs = [mean.alias("representative"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("*").alias("n")]
    ends = keep_ratings if ends is None else ends
    if keep_ratings:
        aggs.append(F.array_sort(F.collect_list(F.struct(*RATING_FIELDS))).alias("ratings"))
    if ends:
        one, by_score = F.struct(*RATING_FIELDS), F.struct("score", "ord", "source_name", "funding_model")
        aggs += [F.min_by(one, F.struct("ord", "at") if "at" in rated.columns else F.col("ord")).alias("first"), F.min_by(one, by_score).alias("low"), F.max_by(one, by_score).alias("high")]
    many = F.col("n") > 1
    out = rated.groupBy("product_id", "axis").agg(*aggs)
    return out.select(
        "product_id",
        "axis",
        "representative",
        F.when(many, F.col("lo")).alias("spread_min"),
        F.when(many, F.col("hi")).alias("spread_max"),
        "n",
        (many & (F.col("hi") - F.col("lo") >= SPLIT_POINTS)).alias("disagreement"),
        *(["ratings"] if keep_ratings else []),
        *(["first", "low", "high"] if ends else []),
    )


def all_pillars(products: DataFrame, found: DataFrame) -> DataFrame:
    """Every product with all four axes; those without ratings have NULL representatives and n = 0."""
    spine = products.select("product_id").distinct().withColumn("axis", F.explode(F.array(*[F.lit(a) for a in AXES])))
    joined = spine.join(found, ["product_id", "axis"], "left")
    return joined.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("disagreement", F.coalesce("disagreement", F.lit(False)))


def _weighted(found: DataFrame, weights: DataFrame) -> DataFrame:
    """Pillars that count towards a composite: a positive, finite weight and a representative."""
    usable = weights.where((F.col("w") > 0) & ~F.isnan("w") & (F.col("w") < float("inf")))
    # four rows by definition
    return found.where("representative IS NOT NULL").join(F.broadcast(usable), "axis")


def composites(found: DataFrame, weights: DataFrame) -> DataFrame:
    """(product_id, overall, overall_min, overall_max): weighted means of representatives and of extremes; no row without any."""
    rep = F.col("representative")
    mean = lambda c: F.sum(F.col("w") * c) / F.sum("w")
    return _weighted(found, weights).groupBy("product_id").agg(
        mean(rep).alias("overall"), mean(F.coalesce("spread_min", rep)).alias("overall_min"), mean(F.coalesce("spread_max", rep)).alias("overall_max")
    )


def top_drivers(found: DataFrame, weights: DataFrame) -> DataFrame:
    """(product_id, axis, direction, magnitude): the axis that moves the composite most; differences below 0.5 don't count,
    the first axis wins ties."""
    both = _weighted(found, weights).join(composites(found, weights).select("product_id", "overall"), "product_id")
    diff = F.col("representative") - F.col("overall")
    # sums in another order differ in their last digits, which would decide what is half a point, and break ties
    moved = both.where(F.round(F.abs(diff), 9) >= 0.5).withColumn("magnitude", F.abs(diff) * F.col("w"))
    order = F.struct(F.round("magnitude", 9), -axis_rank(F.col("axis")))
    best = moved.groupBy("product_id").agg(F.max_by(F.struct("axis", F.when(diff > 0, "lifts").otherwise("drags").alias("direction"), "magnitude"), order).alias("b"))
    return best.select("product_id", "b.axis", "b.direction", "b.magnitude")


def marginal_effects(every: DataFrame, weights: DataFrame) -> DataFrame:
    """(product_id, axis, effect) of every axis: unavailable, lifts, drags or neutral; lifts where no composite exists yet."""
    wide = every.groupBy("product_id").agg(*[F.max(F.when(F.col("axis") == a, F.col("representative"))).alias(a) for a in AXES])
    return effects_of_axes(wide, weights)


def axis_means(rated: DataFrame) -> DataFrame:
    """(product_id, AXES): the representatives of a product's axes side by side, NULL without ratings; one group a product."""
    return rated.groupBy("product_id").agg(*[F.avg(F.when(F.col("axis") == a, F.col("score"))).alias(a) for a in AXES])


def effects_of_axes(wide: DataFrame, weights: DataFrame) -> DataFrame:
    """marginal_effects of representatives that stand side by side: the composite is made in the row, so pillars need no join with it."""
    usable = weights.where((F.col("w") > 0) & ~F.isnan("w") & (F.col("w") < float("inf")))
    # one row
    both = wide.crossJoin(F.broadcast(usable.agg(*[F.max(F.when(F.col("axis") == a, F.col("w"))).alias(f"w_{a}") for a in AXES])))
    counts = lambda a, x: F.when(F.col(a).isNotNull() & F.col(f"w_{a}").isNotNull(), x).otherwise(0.0)
    top = sum((counts(a, F.col(a) * F.col(f"w_{a}")) for a in AXES), F.lit(0.0))
    overall = top / F.nullif(sum((counts(a, F.col(f"w_{a}")) for a in AXES), F.lit(0.0)), F.lit(0.0))

    def effect(a: str) -> Column:
        diff = F.col(a) - F.col("overall")
        return F.when(F.col(a).isNull(), "unavailable").when(F.col("overall").isNull(), "lifts").when(F.abs(diff) < 1e-9, "neutral").when(diff > 0, "lifts").otherwise("drags")

    each = F.array(*[F.struct(F.lit(a).alias("axis"), effect(a).alias("effect")) for a in AXES])
    return both.withColumn("overall", overall).select("product_id", F.explode(each).alias("e")).select("product_id", "e.axis", "e.effect")


def mean_of_pillars(found: DataFrame) -> DataFrame:
    return found.groupBy("product_id").agg(F.avg("representative").alias("mean"))


def max_spread(found: DataFrame) -> DataFrame:
    """(product_id, widest): the widest split, 0 without one."""
    width = F.when(F.col("disagreement"), F.col("spread_max") - F.col("spread_min"))
    return found.groupBy("product_id").agg(F.coalesce(F.max(width), F.lit(0.0)).alias("widest"))
