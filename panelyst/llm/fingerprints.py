"""Document fingerprints: bottom-k sketches of shingle hashes; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE

#: Hashes that a sketch keeps.
K = 128
SHINGLE = 5


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """array<long>: the k smallest distinct hashes of the text's word shingles, ascending.

    Words are lower-cased and parted by U+0020 and U+0009..U+000D. A text of fewer words than a shingle has one, its whole
    sequence; a null text or one without words has an empty sketch. All of the text counts, however long.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        several = F.transform(
            F.sequence(F.lit(1), F.size(h) - (shingle - 1)),
            lambda i: F.xxhash64(*[F.element_at(h, (i + j).cast("int")) for j in range(shingle)]),
        )
        return F.when(F.size(h) >= shingle, several).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    # the one-element outer array binds the hashes, which every shingle reads, to a variable
    made = F.element_at(F.transform(F.array(hashes), shingles), 1)
    return F.slice(F.sort_array(F.array_distinct(made)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, by: list[str], column: str, k: int = K, fan: int = 64) -> DataFrame:
    """(by, column): the sketch of all rows of each group. About ``fan`` sketches meet at a time and are cut to k hashes, as
    often as the largest group needs, so no task gathers a group. A null sketch adds nothing; an empty table gives none."""
    of = lambda c: F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))), 1, k)
    rows = df.select(*by, F.col(column).alias("sketch"))
    largest = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    while largest > fan:
        slots = -(-largest // fan)
        slot = F.pmod(F.monotonically_increasing_id(), F.lit(slots))
        rows = rows.withColumn("slot", slot).groupBy(*by, "slot").agg(of("sketch").alias("sketch")).drop("slot")
        largest = slots
    return rows.groupBy(*by).agg(of("sketch").alias(column))


def _share(part: Column, whole: Column) -> Column:
    return F.size(part) / F.size(whole).cast("double")


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two empty sketches are alike."""
    union = merged(a, b, k)
    shared = F.array_intersect(F.array_intersect(a, b), union)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(_share(shared, union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    top = F.element_at(a, -1).cast("double") + F.lit(2.0**63)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit((k - 1) * 2.0**64) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too, 0 to 1; 1 if a has none."""
    both = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def from_text(s: Column) -> Column:
    """The sketch that as_text wrote."""
    many = F.sequence(F.lit(0), (F.length(s) / 16).cast("int") - 1)
    half = lambda i, at: F.conv(F.substr(s, (i * 16 + at).cast("int"), F.lit(8)), 16, 10).cast("long")
    joined = F.transform(many, lambda i: F.shiftleft(half(i, 1), 32).bitwiseOR(half(i, 9)))
    return F.when(F.length(s) > 0, joined).otherwise(F.array().cast("array<bigint>"))


def fingerprint(docs: DataFrame, k: int = K) -> DataFrame:
    """``docs`` and the column fingerprint (an existing one is replaced)."""
    return docs.withColumn("fingerprint", as_text(sketch(F.col("text"), k)))


def successors(docs: DataFrame, per_bin: int = 1000) -> DataFrame:
    """(doc_id, text, bin, helper): documents dealt out so that with_successor() finds the one after each, in descending
    order of (doc_id, text), cyclically.

    Bins of about ``per_bin`` rows between quantiles of doc_id (at most 10,000; on tables beyond that their rows grow)
    are ordered apart from each other. The upper bounds of the bins are ids of the table; rows that have such an id also
    go to the bin above, as the successors of its last row, and those with the greatest id to the lowest bin. Null doc_ids
    come last, null texts count as empty. A single document is its own successor. An empty table gives none.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    stats = base.agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).first()
    bins = max(1, min(10_000, stats["n"] // per_bin))
    bounds = []
    if bins > 1 and stats["top"] is not None:
        found = base.agg(F.percentile_approx("doc_id", [i / bins for i in range(1, bins)], 100 * bins).alias("q")).first()["q"]
        bounds = sorted(set(found) - {stats["top"]})
    id_ = F.col("doc_id")
    # bin 0 also has the nulls; two-level search keeps the lookup short
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    if bounds:
        heads = F.array(*[F.lit(g[-1]) for g in groups])
        at = F.size(F.filter(heads, lambda b: b < id_))
        lists = F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups])
        inner = F.coalesce(F.size(F.filter(F.get(lists, at), lambda b: b < id_)), F.lit(0))
        bin_ = F.coalesce(at * width + F.greatest(inner, F.lit(0)), F.lit(0))
        bin_ = F.when(id_.isNull(), F.lit(0)).otherwise(F.least(bin_, F.lit(len(bounds))))
        on_bound = F.coalesce(F.array_contains(F.get(lists, F.least(at, F.lit(len(groups) - 1))), id_), F.lit(False))
    else:
        bin_, on_bound = F.lit(0), F.lit(False)
    last = (id_ == F.lit(stats["top"])) if stats["top"] is not None else F.lit(True)
    dealt = base.select(
        "*",
        F.explode(
            F.filter(
                F.array(
                    F.struct(bin_.cast("int").alias("bin"), F.lit(0).alias("helper")),
                    F.when(on_bound, F.struct((bin_ + 1).cast("int").alias("bin"), F.lit(1).alias("helper"))),
                    F.when(last, F.struct(F.lit(0).alias("bin"), F.lit(2).alias("helper"))),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("at"),
    ).select("doc_id", "text", F.col("at.bin").alias("bin"), F.col("at.helper").alias("helper"))
    return dealt.repartition(F.col("bin"))


def with_successor(dealt: DataFrame, carried: list[str]) -> DataFrame:
    """next_<column> of every document, from a table that successors() dealt out."""
    order = Window.partitionBy("bin").orderBy(F.col("helper").asc(), F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    return dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).where("helper = 0")


def compared_with_edit(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of documents, of an edited text of each, and their likeness.

    Gives doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, est_shingles and
    contained_in_edited. Edited: the last n_chars / 3 code points replaced by the first as many of the next document in
    descending doc_id. One shuffle deals the texts to bins of neighbours; sketches are made after it, once a text.
    """
    dealt = successors(docs).withColumn("sk", sketch(F.col("text"), k)).withColumn("n", F.length("text"))
    paired = with_successor(dealt, ["text", "sk"])
    cut = F.floor(F.col("n") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n") - cut), F.substr("next_text", F.lit(1), cut))
    made = paired.select("doc_id", F.col("n").cast("long").alias("n_chars"), "sk", "next_sk", edited.alias("edited"))
    made = made.select("doc_id", "n_chars", "sk", "next_sk", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited"), k).alias("esk"))
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("sk")).alias("fingerprint"),
        as_text(F.col("esk")).alias("edited_fingerprint"),
        resemblance(F.col("sk"), F.col("esk"), k).alias("near_edited"),
        resemblance(F.col("sk"), F.col("next_sk"), k).alias("near_next"),
        distinct_count(F.col("sk"), k).alias("est_shingles"),
        containment(F.col("sk"), F.col("esk"), k).alias("contained_in_edited"),
    )
