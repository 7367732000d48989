"""What the last digits of sums, or an order that leaves ties open, must not decide."""

import functools
import operator

from pyspark.sql import functions as F

from panelyst.operators import scoring

RATED = "product_id string, axis string, score double, score_raw double, match_confidence double, match_method string, match_reviewed boolean, source_id string, source_name string, funding_model string, ord int, at long"


def rating(score, ord_, at, name="n"):
    return ("p", "labor", score, score, 1.0, "seed", False, f"s{name}", name, "independent", ord_, at)


def test_half_a_point_counts_whatever_the_last_digits(spark):
    rows = [("p", "ingredient_safety", 60.0), ("p", "labor", 60.99999999999996), ("q", "ingredient_safety", 60.0), ("q", "labor", 60.99999)]
    found = spark.createDataFrame(rows, "product_id string, axis string, representative double").withColumns({c: F.lit(None).cast("double") for c in ("spread_min", "spread_max")})
    top = scoring.top_drivers(found, scoring.default_weights(spark)).collect()
    assert [(r.product_id, r.axis, r.direction) for r in top] == [("p", "ingredient_safety", "drags")]


def test_first_low_and_high_of_equal_ratings(spark):
    """Equal orders go by the place in the table; equal scores of one order by the rater's name."""
    rows = [rating(40.0, 1, 2, "c"), rating(40.0, 1, 1, "d"), rating(70.0, 2, 3, "a"), rating(70.0, 2, 4, "b")]
    for some in (rows, rows[::-1]):
        r = scoring.pillars(spark.createDataFrame(some, RATED).coalesce(1), False, True).first()
        assert (r["first"].source_name, r.low.source_name, r.high.source_name) == ("d", "c", "b")


def test_means_are_sums_in_the_order_of_the_table(spark):
    scores = [0.1 * i * (-1) ** i + 1e3 * (i % 3) for i in range(60)]
    want = functools.reduce(operator.add, scores, 0.0) / len(scores)
    rated = spark.createDataFrame([rating(x, 60 - i, i) for i, x in enumerate(scores)], RATED)
    for n in (1, 2, 5, 7):
        assert scoring.pillars(rated.repartition(n, "score"), False, in_order=True).first().representative == want
