"""Target-distribution importance resampling over hashed n-grams of a table of word positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Java pattern of what parts words: ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["doc_id", "text_hash"]


def _lowered(word: Column) -> Column:
    """A-Z alone in lower case; lower() does that, and faster, where all characters are ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def positions(docs: DataFrame, orders: int = 1) -> DataFrame:
    """The position table: doc_id, text_hash, copies, pos, word and, for orders above one, the n-grams that begin there.

    ``grams`` holds one n-gram for each order whose words don't end before: lead() over the document's positions gives the
    words that follow. Rows equal in doc_id and text become one with its number of copies first, which puts each document
    into one place, so that posexplode and the windows need no exchange of words. With one order nothing follows, texts stay
    where they are, and copies is 1. A document without words has one row without position.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    if orders > 1:
        rows = rows.groupBy(*KEY).agg(F.count("*").alias("copies"), F.min("text").alias("text"))
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    words = F.filter(F.split("text", BETWEEN), lambda w: w != "")
    at = rows.select(*KEY, "copies", F.posexplode_outer(words).alias("pos", "word")).withColumn("word", _lowered(F.col("word")))
    if orders == 1:
        return at.withColumn("grams", F.array("word"))
    run = Window.partitionBy(*KEY).orderBy("pos")
    nexts = [F.lead("word", k).over(run).alias(f"next{k}") for k in range(1, orders)]
    at = at.select("*", *nexts)
    grams = [F.concat_ws(" ", "word", *[f"next{k}" for k in range(1, n)]) for n in range(1, orders + 1)]
    whole = [F.when(F.col("word" if n == 1 else f"next{n - 1}").isNotNull(), g) for n, g in enumerate(grams, 1)]
    return at.select(*KEY, "copies", "pos", "word", F.array_compact(F.array(*whole)).alias("grams"))


def features(docs: DataFrame, orders: int, buckets: int) -> DataFrame:
    """(doc_id, text_hash, copies, pos, first, bucket): one row for each n-gram; one without bucket for a document without words.

    ``first`` marks the first row of a position, so that positions can be counted among n-grams.
    """
    at = positions(docs, orders)
    bucket = lambda gram: F.pmod(F.crc32(gram.cast("binary")), F.lit(buckets)).cast("int")
    if orders == 1:
        return at.select(*KEY, "copies", "pos", F.lit(True).alias("first"), bucket(F.col("word")).alias("bucket"))
    each = at.select(*KEY, "copies", "pos", F.posexplode_outer("grams").alias("nth", "gram"))
    return each.select(*KEY, "copies", "pos", (F.coalesce("nth", F.lit(0)) == 0).alias("first"), bucket(F.col("gram")).alias("bucket"))


def bucket_gains(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) of every bucket: thousandths of the log of how much likelier the target makes it, rounded down.

    Both sides count one more in each bucket. The table has ``buckets`` rows whatever the data, so it can be broadcast.
    """

    def counts(df: DataFrame, name: str) -> DataFrame:
        return features(df, orders, buckets).where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("copies").alias(name))

    # equal target texts may meet, as their counts add up
    wanted = target.select(F.lit(0).alias("doc_id"), "text")
    both = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(counts(docs, "s"), "bucket", "left").join(counts(wanted, "t"), "bucket", "left").fillna(0, ["s", "t"])
    every = Window.partitionBy()  # ``buckets`` rows
    d = lambda c: c.cast("double")
    ratio = d(F.col("t") + 1) * d(F.sum("s").over(every) + buckets) / (d(F.col("s") + 1) * d(F.sum("t").over(every) + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = 10_000) -> DataFrame:
    """(doc_id, text_hash, n_words, n_features, weight) of every row of docs: sums of gains over its n-grams."""
    gains = F.broadcast(written(bucket_gains(docs, target, orders, buckets), "gains"))
    scored = features(docs, orders, buckets).join(gains, "bucket", "left")
    begins = F.col("first") & (F.coalesce("pos", F.lit(0)) == 0)
    count = lambda on: F.sum(F.when(on, F.col("copies")).otherwise(F.lit(0)))
    # a document's words lie together, so sums are nearly whole before they move
    sums = scored.groupBy(*KEY).agg(
        count(begins).alias("rows"),
        count(F.col("first") & F.col("pos").isNotNull()).alias("n_words"),
        count(F.col("bucket").isNotNull()).alias("n_features"),
        F.sum(F.coalesce(F.col("gain"), F.lit(0)) * F.col("copies")).alias("weight"),
    )
    # rows equal in doc_id and text were summed together: each has its share, which is whole
    share = [F.expr(f"{c} div rows").alias(c) for c in ("n_words", "n_features", "weight")]
    return sums.select(*KEY, *share, F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("col")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate that doc_id and seed decide, rounded down; a null id counts as 'null'."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, orders: int = 2, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """(doc_id, text_hash, n_words, n_features, weight, score, rank) of every row of docs.

    The score is the weight plus a Gumbel variate, so that the highest scores are a draw without replacement in proportion to
    e to the weight / 1000. Of the N rows with ``least_words`` words and more, floor(percent N / 100) with the highest scores get
    ranks from 1, ties going to the smaller doc_id, null last, then to what else the row has; the others have no rank.

    Ranks come from range partitions of the scores: rows stand in order in each, and the sizes of the partitions, as many
    rows as there are, say where each begins. A null text has no words and weight 0. Equal rows are separate rows. An empty
    table gives none; an empty target still has one count in each bucket. Other columns are ignored.
    """
    rows = weights(docs, target, orders, buckets).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "text_hash"]
    able = F.col("n_words") >= least_words
    ordered = rows.withColumn("able", able).repartitionByRange(F.col("able").desc(), *order).withColumn("range", F.spark_partition_id())
    ordered = written(ordered, "resample-scores")
    in_ranges = ordered.where("able")
    sizes = in_ranges.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    drawn = sizes.agg((F.coalesce(F.sum("n"), F.lit(0)) * percent / 100).cast("long").alias("k")).first()["k"]
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("before")
    # ranges that begin after the last draw are not sorted; as many rows as there are ranges are broadcast
    ranked = in_ranges.join(F.broadcast(before.where(F.col("before") < drawn)), "range").withColumn("rank", place.cast("long"))
    columns = [*KEY, "n_words", "n_features", "weight", "score"]
    ranked = ranked.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    rest = ordered.join(F.broadcast(before.where(F.col("before") < drawn)), [ordered["range"] == before["range"], ordered["able"]], "left_anti")
    return ranked.unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns. Of rows equal in doc_id and text as many stay as are drawn,
    all like one of them."""
    took = resample(docs, target, **options).where("rank IS NOT NULL").groupBy(*KEY).agg(F.count("*").alias("times")).alias("t")
    row = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    one = row.dropDuplicates(KEY).alias("d").join(took, F.expr("d.doc_id <=> t.doc_id AND d.text_hash = t.text_hash"))
    return one.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(*[F.col("row")[c].alias(c) for c in docs.columns])
