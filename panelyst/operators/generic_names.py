"""Names that say nothing: document frequencies of tokens and the filter over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_tokens, normalize_name

GENERIC_SHARE = 0.004
GENERIC_TOKENS = 2


def token_frequencies(names: DataFrame) -> DataFrame:
    """(token, df): in how many names a token occurs. names: name."""
    return names.select(F.explode(F.array_distinct(name_tokens(F.col("name")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def generic_names(names: DataFrame, share: float = GENERIC_SHARE, most: int = GENERIC_TOKENS) -> DataFrame:
    """(name, generic) of distinct names: few tokens, all of them in at least ``share`` of all names. Empty names are not generic.

    Only names short enough to be generic are exploded for the join.
    """
    df = token_frequencies(names)
    total = names.agg(F.count("*").alias("total"))
    each = names.select("name").distinct().withColumn("tokens", name_tokens(F.col("name")))
    short = each.where(F.size("tokens").between(1, most)).select("name", F.explode("tokens").alias("token"))
    judged = short.join(df, "token", "left").crossJoin(F.broadcast(total)).groupBy("name").agg(F.bool_and(F.coalesce(F.col("df"), F.lit(0)) / F.col("total") >= share).alias("generic"))
    return each.join(judged, "name", "left").select("name", F.coalesce("generic", F.lit(False)).alias("generic"))


def match_context(catalog: DataFrame, share: float = GENERIC_SHARE) -> DataFrame:
    """The catalog that matching uses: entries whose names have letters or digits and aren't generic."""
    named = catalog.where(normalize_name(F.col("name")) != "")
    generic = generic_names(named.select("name"), share).where("generic")
    return named.join(generic.select("name"), "name", "left_anti")
