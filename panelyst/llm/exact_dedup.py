"""Exact deduplication by content hash, with bytes compared inside groups; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def without_space(text: Column) -> Column:
    """The text without U+0020 and U+0009..U+000D; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digest128(text: Column) -> Column:
    """16 bytes of MD5."""
    return F.unhex(F.md5(text))


def _rank(n_chars: Column, doc_id: Column, tie: Column) -> Column:
    """What orders the rows of a group; the least stays."""
    return F.struct((-n_chars).alias("less"), doc_id.isNull().alias("none"), doc_id.alias("doc_id"), tie.alias("tie"))


def collided(docs: DataFrame, normal: Callable[[Column], Column] = without_space, digest: Callable[[Column], Column] = digest128) -> DataFrame:
    """(digest): digests that texts of different bytes share.

    Texts are compared whole, inside the groups of their digests: rows equal in digest and bytes become one, in each task
    before anything moves and again after the exchange, so a text that a third of all rows have moves once from a task.
    """
    texts = docs.select(normal(F.col("text")).alias("normal")).select(digest(F.col("normal")).alias("digest"), "normal")
    return texts.distinct().groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")


def copies(docs: DataFrame, normal: Callable[[Column], Column] = without_space, digest: Callable[[Column], Column] = digest128) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row: which rows are equal, and which of them stays.

    Rows are equal if their normalised texts are; of equal rows that with the most code points in its own text stays, then
    that with the smallest doc_id. A light table (ids, lengths, digests) is written once; groups of two and more are made of
    it by digest, the minimum that names the row that stays being taken in each task before rows move. Digests that differing texts share
    are found by comparing bytes (``collided``); rows of such digests, and only those, are grouped by their texts instead.

    Nulls: a null text is an empty one; a null doc_id comes after all others. Rows equal in doc_id and text are separate
    rows of which one stays. Texts without anything but space are equal. An empty table gives none. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # doc_id, text and what is made of them: other columns may be called anything
    light = docs.select("doc_id", F.char_length(text).cast("long").alias("n_chars"), normal(F.col("text")).alias("normal"))
    light = light.select("doc_id", "n_chars", digest(F.col("normal")).alias("digest"), F.sha2("normal", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("tie"))
    light = written(light, "exact-light")
    shared = written(collided(docs, normal, digest), "exact-collided")
    rank = _rank(F.col("n_chars"), F.col("doc_id"), F.col("tie"))

    def decided(rows: DataFrame, key: str) -> DataFrame:
        groups = rows.groupBy(key).agg(F.count("*").alias("group_size"), F.min(rank).alias("first")).where("group_size > 1")
        # read from a table, so that adaptive execution can split the rows of a hot key
        groups = written(groups, "exact-groups").alias("g")
        same = rows.alias("r").join(groups, F.col(f"r.{key}") == F.col(f"g.{key}"), "left")
        alone = F.col("g.group_size").isNull()
        return same.select(
            "r.doc_id",
            F.when(alone, F.col("r.doc_id")).otherwise(F.col("g.first.doc_id")).alias("keep_id"),
            F.coalesce("g.group_size", F.lit(1).cast("long")).alias("group_size"),
            (alone | (F.col("r.tie") == F.col("g.first.tie"))).alias("kept"),
            "r.text_sha256",
        )

    if shared.isEmpty():
        return decided(light, "digest")
    alone = decided(light.join(shared, "digest", "left_anti"), "digest")
    texts = docs.select("doc_id", F.char_length(text).cast("long").alias("n_chars"), normal(F.col("text")).alias("normal"))
    texts = texts.withColumn("digest", digest(F.col("normal"))).join(shared, "digest", "left_semi")
    texts = texts.select("doc_id", "n_chars", "normal", F.sha2("normal", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("tie"))
    return alone.unionByName(decided(written(texts, "exact-texts"), "normal"))


def deduplicated(docs: DataFrame, normal: Callable[[Column], Column] = without_space, digest: Callable[[Column], Column] = digest128) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; by digest and bytes in one grouping, without a join.

    Of rows equal in doc_id and length too, the least hash of the original text decides; further equal ones are alike.
    """
    row = F.struct("*")
    made = docs.select(row.alias("row"), F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    made = made.withColumn("normal", normal(F.col("text"))).withColumn("digest", digest(F.col("normal")))
    rank = _rank(F.char_length("text"), F.col("doc_id"), F.xxhash64("text"))
    best = made.groupBy("digest", "normal").agg(F.min_by("row", rank).alias("row"))
    return best.select(*[F.col("row")[c].alias(c) for c in docs.columns])
