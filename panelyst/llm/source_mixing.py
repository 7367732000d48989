"""Mixing sources to target weights by systematic sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, unit, written

#: Weights dealt to the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more than so many times.
MAX_REPEATS = 3
#: Seeded offsets that a source tries.
TRIES = 128


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, share: float = 1.0) -> DataFrame:
    """(source, source_size, target): words that the mix takes of each source.

    sizes: source, source_size; one row a source, null being a source of its own, which comes last. Targets are in
    proportion to the weights and add up to ``share`` of all sizes, but stop at max_repeats times the source's size;
    what that frees goes to the others by weight until none is above. Closed form: in order of limit / weight, the
    first k sources are at their limits, k being the first for which the rest stay within theirs.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    dealt = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), ((F.row_number().over(order) - 1) % n + 1).cast("int")))
    dealt = dealt.withColumn("limit", F.col("source_size") * F.lit(max_repeats).cast("long"))
    by_ratio = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        dealt.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("limits_before", F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("budget") - F.col("limits_before")) / F.col("weights_left"))
        .withColumn("free", F.col("level") <= F.col("limit") / F.col("weight"))
    )
    level = F.min(F.when(F.col("free"), F.struct(F.col("limits_before"), F.col("level")))).over(whole)
    return ranked.withColumn("rest", level).select(
        "source",
        "source_size",
        F.when((F.col("limits_before") < F.col("rest.limits_before")) | F.col("rest").isNull(), F.col("limit").cast("double"))
        .otherwise(F.least(F.col("limit").cast("double"), F.col("rest.level") * F.col("weight")))
        .alias("target"),
    )


def _offsets(source: Column, tries: int, seed: int) -> Column:
    """array<struct<k, u, f>>: tries of a source, each with a random offset u; every other also varies the expected copies by f."""
    key = F.coalesce(source, F.lit("\x00null"))

    def one(k: Column) -> Column:
        vary = F.when(k % 2 == 1, 0.5 + 2 * unit(F.lit(str(seed)), F.lit("f"), k.cast("string"), key)).otherwise(F.lit(1.0))
        return F.struct(k.alias("k"), unit(F.lit(str(seed)), k.cast("string"), key).alias("u"), vary.alias("f"))

    return F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), one)


def systematic_copies(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 17, tries: int = TRIES) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, order_key): how often the mix takes each document.

    Within a source, documents stand in order of (size, md5 of doc_id), each with the same expected number of copies,
    target / source_size. Their prefix sums plus one random offset of the source cross integers; a document is taken once
    for each integer that it crosses. Standing by size makes the words taken come near the target of a large source. Of
    ``tries`` seeded offsets a source takes the one whose words come nearest, the first among equals; every other try also
    takes the expected copies from 0.5 to 2.5 times, up to max_repeats, which is what small sources with a few long documents need.

    Ranks are row numbers within (source, size, first two hex digits of the md5) plus what lies before, summed in two steps,
    over bands of sizes and within each, so a source with a third of all rows never meets in one task. How many words a try
    takes follows from the ranks of whole sizes. Nulls: a null text has size 0, a null source is a source of its own, null
    doc_ids rank as the text 'null'. Rows with equal doc_id are separate documents. An empty table gives none.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    sized = written(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("order_key", key), "mix-sizes"
    ).withColumn("cell", F.substring("order_key", 1, 2))
    # a band has about as many sizes as there are bands
    cells = sized.groupBy("source", "size", "cell").agg(F.count("*").alias("n")).withColumn("band", F.floor(F.sqrt("size")))
    first = Window.unboundedPreceding
    bands = cells.groupBy("source", "band").agg(F.sum("n").alias("n"))
    bands = bands.select("source", "band", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("band").rowsBetween(first, -1)), F.lit(0)).alias("band_before"))
    within = Window.partitionBy("source", "band").orderBy("size", "cell").rowsBetween(first, -1)
    cells = cells.withColumn("inner_before", F.coalesce(F.sum("n").over(within), F.lit(0)))
    cells = cells.alias("c").join(bands.alias("b"), F.expr("c.source <=> b.source AND c.band = b.band"))
    cells = cells.select("c.source", "c.size", "c.cell", "c.n", (F.col("inner_before") + F.col("band_before")).alias("before"))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("expected", expected)
    steps = cells.groupBy("source", "size").agg(F.min("before").alias("before"), F.sum("n").alias("n")).alias("s")
    tried = steps.join(targets.alias("t"), F.expr("s.source <=> t.source")).select("s.*", "t.target", "t.expected", F.explode(_offsets(F.col("s.source"), tries, seed)).alias("o"))
    rate = F.least(F.col("expected") * F.col("o.f"), F.lit(float(max_repeats)))
    words = F.col("size") * (F.floor((F.col("before") + F.col("n")) * rate + F.col("o.u")) - F.floor(F.col("before") * rate + F.col("o.u")))
    totals = tried.groupBy("source", "o", "target", "expected").agg(F.sum(words).alias("words"))
    best = totals.groupBy("source").agg(F.min_by(F.struct(F.col("o.u").alias("u"), rate.alias("rate")), F.struct(F.abs(F.col("words") - F.col("target")), F.col("o.k"))).alias("o"))
    chosen = targets.alias("t").join(best.alias("x"), F.expr("t.source <=> x.source")).select("t.source", "source_size", "target", "x.o.u", "x.o.rate")
    cells = cells.alias("c").join(chosen.alias("t"), F.expr("c.source <=> t.source")).select("c.source", "c.size", "c.cell", "c.before", "source_size", "target", "u", "rate")
    ranked = sized.withColumn("row", F.row_number().over(Window.partitionBy("source", "size", "cell").orderBy("order_key", "doc_id"))).alias("d")
    same = F.expr("d.source <=> c.source AND d.size = c.size AND d.cell = c.cell")
    placed = ranked.join(cells.alias("c"), same).select("d.doc_id", "d.source", "d.size", "d.order_key", "source_size", "target", "u", "rate", (F.col("d.row") + F.col("c.before")).alias("rank"))
    copies = F.floor(F.col("rank") * F.col("rate") + F.col("u")) - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("u"))
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), "order_key")


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 17) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as it is taken, and copy_no from 1.

    Rows with equal doc_id, source and size are told apart by their rank among themselves. A column copy_no is replaced.
    """
    docs = docs.drop("copy_no")
    taken = systematic_copies(docs, weights, max_repeats, seed)
    same = Window.partitionBy("doc_id", "source", "size").orderBy("size")
    # the row is one struct, so that its columns' names meet none of these
    a = docs.select(F.struct("*").alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("nth", F.row_number().over(same)).alias("a")
    t = taken.where("copies > 0").withColumn("nth", F.row_number().over(same)).select("doc_id", "source", "size", "nth", "copies").alias("t")
    joined = a.join(t, F.expr("a.doc_id <=> t.doc_id AND a.source <=> t.source AND a.size = t.size AND a.nth = t.nth"))
    return joined.select(*[F.col("a.row")[c].alias(c) for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col("t.copies"))).alias("copy_no"))
