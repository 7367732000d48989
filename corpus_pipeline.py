"""The corpus pipeline: five stages over ``documents``, each one of the numbered operators.

A stage takes (spark, docs, sf_dir) and gives a DataFrame, which run() writes into the shared folder and reads again as the
next one's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyst.llm import decontamination, ngram_join, quality_classifier, source_mixing, token_blocks
from panelyst.llm.common import free_name, small_batches, written
from panelyst.llm.queries import table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; of rows with one doc_id, all stay or go by the worst of them."""
    judged = quality_classifier.classify(docs, table(spark, sf_dir, "labels"))
    rejected = judged.where(~F.col("keep")).select("doc_id").distinct().alias("r")
    return docs.alias("d").join(rejected, F.expr("d.doc_id <=> r.doc_id"), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join, that with its smallest doc_id; null ids come last, and among
    equal ids a hash of the text decides. Rows equal in doc_id and text count once, any of them.

    Documents without words are components of their own and all stay.
    """
    small_batches(spark)
    found = ngram_join.similar_components(docs)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    heads = found.where("node <> 0").groupBy("root").agg(F.min(first).alias("h")).select("h.doc_id", "h.text_hash")
    wordless = found.where("node = 0").select("doc_id", "text_hash").distinct().alias("w")
    text_hash = free_name(docs, "text_hash")
    hashed = docs.withColumn(text_hash, F.xxhash64(F.coalesce("text", F.lit("")))).alias("d")
    same = f"d.doc_id <=> {{0}}.doc_id AND d.`{text_hash}` = {{0}}.text_hash"
    kept = hashed.join(heads.alias("h"), F.expr(same.format("h")), "left_semi").dropDuplicates(["doc_id", text_hash])
    return kept.unionByName(hashed.join(wordless, F.expr(same.format("w")), "left_semi")).drop(text_hash)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights: documents as often as the mix takes them."""
    small_batches(spark)
    return source_mixing.mix_sources(docs).drop("copy_no")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token segments of the documents, read back: doc_id, start, n_tokens, ids_crc32."""
    small_batches(spark)
    return token_blocks.read_tokens(spark, token_blocks.write_tokens(docs, tokenizer_path(), end_id=0))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]

#: SQL expresses neither the classifier, the decontamination nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
