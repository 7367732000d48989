"""Distributed difference-cover suffix sorting (the positions 1 and 2 of every 3), and repeated strings by adjacent suffixes.

Sampled triples are sorted and named; while names recur, the string of names is ranked the same way; the remaining suffixes are
merged by their first symbol and the rank of the sampled suffix behind it; adjacent suffixes then share the longest prefixes.
DataFrame functions only. Every byte of text is several rows of each round, so this is for tables of some megabytes: see the
README for what it takes, and substring_dedup for the way that keeps within bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Bytes that stand for the ends of texts begin here; a symbol is the byte plus 1, and 0 is what lies behind the whole string.
ENDS = 257


def numbered(df: DataFrame, *keys: str | Column) -> DataFrame:
    """The rows with n, their place from 0 in the order of the keys: ranges are sorted apart, and counts of ranges added up."""
    key = F.monotonically_increasing_id()
    ordered = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("in_range", key), "ordered")
    part = F.shiftright("in_range", 33)
    # as many rows as there are ranges
    counts = ordered.groupBy(part.alias("part")).count().orderBy("part").collect()
    before, total = [], 0
    for r in counts:
        before.append((r["part"], total))
        total += r["count"]
    starts = df.sparkSession.createDataFrame(before, "part long, start long")
    joined = ordered.withColumn("part", part).join(F.broadcast(starts), "part")
    return joined.withColumn("n", F.col("start") + F.col("in_range").bitwiseAND((1 << 33) - 1)).drop("part", "start", "in_range")


def _following(string: DataFrame, many: int) -> DataFrame:
    """(pos, s0, s1, ...): each symbol with those behind it, 0 beyond the end."""
    shifts = F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    spread = string.select("pos", "s", shifts.alias("k")).select((F.col("pos") - F.col("k")).alias("pos"), "k", "s").where("pos >= 0")
    return spread.groupBy("pos").agg(*[F.coalesce(F.max(F.when(F.col("k") == i, F.col("s"))), F.lit(0)).cast("long").alias(f"s{i}") for i in range(many)])


def ranks(string: DataFrame, size: int, depth: int | None = None) -> DataFrame:
    """(pos, rank) of all suffixes of a string (pos from 0, s above 0) of ``size`` symbols.

    ``depth``: symbols that need to be told apart; suffixes that agree in more may have equal or any ranks next to each other.
    """
    triples = written(_following(string, 3), "triples")
    sampled = triples.where("pos % 3 <> 0")
    names = numbered(sampled.select("s0", "s1", "s2").distinct(), "s0", "s1", "s2").withColumn("name", F.col("n") + 1).drop("n")
    first = -(-(size - 1) // 3)  # sampled positions 1, 4, ...
    place = F.when(F.col("pos") % 3 == 1, F.floor(F.col("pos") / 3)).otherwise(F.floor(F.col("pos") / 3) + first + 1)
    named = written(sampled.join(names, ["s0", "s1", "s2"]).select("pos", place.alias("at"), "name"), "names")
    many, kinds = named.agg(F.count("*"), F.count_distinct("name")).first()
    rest = None if depth is None else -(-depth // 3)
    if many == kinds or (rest is not None and rest <= 1):
        rank = named.select("pos", F.col("name").alias("rank"))
    else:
        # one symbol parts those of positions 1, 4, ... from those of 2, 5, ...; it is behind all others
        gap = string.sparkSession.createDataFrame([(first, 1)], "pos long, s long")
        inner = ranks(named.select(F.col("at").alias("pos"), (F.col("name") + 1).alias("s")).unionByName(gap), many + 1, rest)
        rank = named.join(inner.withColumnRenamed("pos", "at"), "at").select("pos", "rank")
    rank = written(rank, "ranks")
    behind = rank.select((F.col("pos") - 1).alias("pos"), F.col("rank").alias("r1")).unionByName(string.sparkSession.createDataFrame([(size - 1, 0)], "pos long, r1 long") if size % 3 != 0 else rank.limit(0).select("pos", F.col("rank").alias("r1")))
    after = rank.select((F.col("pos") - 2).alias("pos"), F.col("rank").alias("r2")).unionByName(string.sparkSession.createDataFrame([(p, 0) for p in (size - 1, size - 2) if p >= 0], "pos long, r2 long"))
    whole = triples.join(behind.groupBy("pos").agg(F.max("r1").alias("r1")), "pos", "left").join(after.groupBy("pos").agg(F.max("r2").alias("r2")), "pos", "left").join(rank, "pos", "left")
    whole = written(whole.select("pos", "s0", "s1", F.coalesce("r1", F.lit(0)).alias("r1"), F.coalesce("r2", F.lit(0)).alias("r2"), "rank"), "merging")
    # a remaining suffix goes before or behind a sampled one by (symbol, rank) or (symbol, symbol, rank), as is sampled in both
    counts = []
    for kind, keys in ((1, ["s0", "r1"]), (2, ["s0", "s1", "r2"])):
        both = whole.where(f"pos % 3 in (0, {kind})")
        order = numbered(both.select("pos", *keys), *keys, "pos").select("pos", "n")
        alone = numbered(both.where("pos % 3 = 0").select("pos", *keys), *keys, "pos").select("pos", F.col("n").alias("own"))
        mine = numbered(both.where(f"pos % 3 = {kind}").select("pos", *keys), *keys, "pos").select("pos", F.col("n").alias("own"))
        counts.append(order.join(alone.unionByName(mine), "pos").select("pos", (F.col("n") - F.col("own")).alias("across")))
    across = counts[0].unionByName(counts[1]).groupBy("pos").agg(F.sum("across").alias("across"))
    # those of the sample among each other stand by their ranks
    sample = numbered(rank, "rank", "pos").select("pos", F.col("n").alias("own"))
    zero = numbered(whole.where("pos % 3 = 0").select("pos", "s0", "r1"), "s0", "r1", "pos").select("pos", F.col("n").alias("own"))
    out = written(across.join(sample.unionByName(zero), "pos").select("pos", (F.col("own") + F.col("across") + 1).alias("rank")), "suffixes")
    for table in (triples, named, rank, whole):
        discard(table)
    return out


def repeated_starts(docs: DataFrame, length: int) -> DataFrame:
    """(doc, start): where strings of ``length`` bytes begin that also begin elsewhere; doc numbers rows by (doc_id, text).

    docs: doc_id, text; a null text has no bytes, strings never cross documents, an empty table gives none.
    """
    texts = numbered(docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("bytes")), "doc_id", "bytes").withColumnRenamed("n", "doc")
    texts = written(texts.withColumn("size", F.octet_length("bytes").cast("long")), "texts")
    if texts.isEmpty():
        return texts.select("doc", F.lit(0).cast("long").alias("start"))
    place = (F.col("i") + 1).cast("int")
    code = F.conv(F.hex(F.substr("bytes", place, F.lit(1))), 16, 10).cast("long")
    each = texts.select("doc", "bytes", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size"))).alias("i"))
    # an end of its own behind each text
    symbol = F.when(F.col("i") < F.col("size"), code + 1).otherwise(F.lit(ENDS) + F.col("doc"))
    string = written(numbered(each.select("doc", "i", symbol.alias("s")), "doc", "i").withColumnRenamed("n", "pos"), "symbols")
    order = ranks(string.select("pos", "s"), string.count(), length)
    window = F.when(F.col("i") + length <= F.col("size"), F.sha2(F.substr("bytes", place, F.lit(length)), 256))
    windows = each.select("doc", "i", window.alias("w")).where("w IS NOT NULL").join(string.select("doc", "i", "pos"), ["doc", "i"])
    placed = numbered(windows.join(order, "pos").select("doc", "i", "w", "rank"), "rank")
    nearby = placed.select("n", "w").withColumn("n", F.explode(F.array(F.col("n") - 1, F.col("n") + 1))).distinct()
    return placed.join(nearby, ["n", "w"], "left_semi").select("doc", F.col("i").alias("start"))
