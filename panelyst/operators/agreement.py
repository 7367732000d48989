"""Splits between raters, how sure the matches are, and the prose about both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_round
from .scoring import AXES, AXIS_PHRASE, verdict_band

WEAK_BELOW = 0.9


def match_tier(confidence: Column, reviewed: Column) -> Column:
    """verified if reviewed or without a confidence, auto from 0.9, else weak."""
    return F.when(F.coalesce(reviewed, F.lit(False)) | confidence.isNull(), "verified").when(confidence >= WEAK_BELOW, "auto").otherwise("weak")


def rating_tier() -> Column:
    return match_tier(F.col("match_confidence"), F.col("match_reviewed"))


def disagreements(found: DataFrame) -> DataFrame:
    """(product_id, axis, spread, low, high) of split axes, of pillars with ends."""
    split = found.where(F.col("disagreement") & (F.col("n") > 1))
    return split.select("product_id", "axis", (F.col("spread_max") - F.col("spread_min")).alias("spread"), "low", "high")


def describe_disagreement() -> Column:
    """One line over the columns of disagreements()."""
    phrase = F.element_at(F.create_map(*[F.lit(x) for kv in AXIS_PHRASE.items() for x in kv]), F.col("axis"))
    point = lambda c: js_round(F.col(c)).cast("string")
    return F.concat(
        F.col("high.source_name"), F.lit(" ("), F.col("high.funding_model"), F.lit(") scores "), point("high.score"), F.lit(" on "), phrase, F.lit("; "),
        F.col("low.source_name"), F.lit(" ("), F.col("low.funding_model"), F.lit(") scores "), point("low.score"), F.lit(". Spread "), point("spread"), F.lit(" points."),
    )


def coverage(rated: DataFrame) -> DataFrame:
    """(product_id, source_count, axes_covered, weakest_tier, has_unreviewed, has_weak, sparse) over normalised ratings."""
    tier = rating_tier()
    rank = F.max(F.when(tier == "weak", 2).when(tier == "auto", 1).otherwise(0))
    out = rated.groupBy("product_id").agg(F.count("*").alias("source_count"), F.count_distinct("axis").alias("axes_covered"), rank.alias("rank"))
    return out.select(
        "product_id",
        "source_count",
        "axes_covered",
        F.element_at(F.array(F.lit("verified"), F.lit("auto"), F.lit("weak")), F.col("rank") + 1).alias("weakest_tier"),
        (F.col("rank") > 0).alias("has_unreviewed"),
        (F.col("rank") > 1).alias("has_weak"),
        (F.col("axes_covered") < len(AXES)).alias("sparse"),
    )


def provenance_notes(covered: DataFrame) -> DataFrame:
    """(product_id, notes): what to tell a reader about matches and coverage."""
    notes = F.array(
        F.when(F.col("has_weak"), F.lit("Some ratings rest on weak matches.")),
        F.when(F.col("has_unreviewed") & ~F.col("has_weak"), F.lit("Some matches were made automatically.")),
        F.when(F.col("sparse"), F.concat(F.lit("Only "), F.col("axes_covered").cast("string"), F.lit(f" of {len(AXES)} axes are rated."))),
    )
    return covered.select("product_id", F.filter(notes, lambda x: x.isNotNull()).alias("notes"))


def describe_driver(drivers: DataFrame, found: DataFrame) -> DataFrame:
    """(product_id, text): the top driver with its split's ends, or else the first rater; of pillars with ends."""
    joined = drivers.join(found.select("product_id", "axis", "disagreement", "first", "low", "high"), ["product_id", "axis"])
    phrase = F.element_at(F.create_map(*[F.lit(x) for kv in AXIS_PHRASE.items() for x in kv]), F.col("axis"))
    named = F.when(F.col("disagreement"), F.concat(F.col("low.source_name"), F.lit(" and "), F.col("high.source_name"))).otherwise(F.col("first.source_name"))
    return joined.select("product_id", F.concat(phrase, F.lit(" "), F.col("direction"), F.lit(" the score most: "), named).alias("text"))


def narrate_weight_change(axis: Column, before: Column, after: Column) -> Column:
    """A true line about what a weight change did to the composite: less than half a point is negligible, a crossed band is named."""
    phrase = F.element_at(F.create_map(*[F.lit(x) for kv in AXIS_PHRASE.items() for x in kv]), axis)
    was, now, diff = verdict_band(before), verdict_band(after), after - before
    moved = F.concat(F.lit("Weighing "), phrase, F.when(diff > 0, " lifts").otherwise(" drops"), F.lit(" it to "), js_round(after).cast("string"))
    return (
        F.when(before.isNull() | after.isNull(), F.lit("Not enough ratings to tell."))
        .when(F.abs(diff) < 0.5, F.concat(F.lit("Weighing "), phrase, F.lit(" barely moves it.")))
        .when(was != now, F.concat(moved, F.lit(", from "), was, F.lit(" to "), now, F.lit(".")))
        .otherwise(F.concat(moved, F.lit(".")))
    )


def greet(overall: Column) -> Column:
    band = verdict_band(overall)
    return F.when(band.isNull(), F.lit("No score yet.")).otherwise(F.concat(F.lit("This one looks "), band, F.lit(".")))
