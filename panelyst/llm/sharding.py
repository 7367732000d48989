"""Sharding by a two-pass external shuffle: scatter into memory-sized buckets, then shuffle each bucket and write it."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import textscan
from .common import free_name, new_path

#: Bytes of text that one bucket is meant to hold; a task shuffles one bucket in memory.
BUCKET_BYTES = 16 << 20


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def shard_of(key: Column, shards: int, seed: int = 0) -> Column:
    """The shard of a key: the last shard j whose seeded hash draws j among the first j + 1, hence a uniform choice.

    Each further shard wins a row with probability 1 / (j + 1) whatever came before, so that a table of n + 1 shards takes
    rows only into its new shard. A null key counts as the text 'null'.
    """
    text = F.coalesce(key.cast("string"), F.lit("null"))
    at = F.lit(0)
    for j in range(1, shards):
        draw = F.pmod(F.xxhash64(text, F.lit(seed), F.lit(j)), F.lit(j + 1).cast("long"))
        at = F.when(draw == 0, F.lit(j)).otherwise(at)
    return at.cast("int")


def _fisher_yates(seed: int, keys: list[str], out: pa.Schema):
    def shuffle(key: tuple, table: pa.Table) -> pa.Table:
        shard, bucket = key[0].as_py(), key[1].as_py()
        table = table.take(pa.compute.sort_indices(table, sort_keys=[(k, "ascending") for k in keys]))
        order = np.arange(table.num_rows)
        np.random.default_rng([seed, shard, bucket]).shuffle(order)
        table = table.take(pa.array(order))
        table = table.append_column("pos", pa.array(np.arange(len(order), dtype=np.int64)))
        return table.select(out.names).cast(out)

    return shuffle


def write_shards(docs: DataFrame, shards: int = 24, seed: int = 0, bucket_bytes: int = BUCKET_BYTES, path: str | None = None, columns: dict[str, Column] | None = None) -> DataFrame:
    """Write ``docs`` into shards and read them back: all columns and shard, bucket, pos (order within the bucket), slot.

    Pass one scatters the records by seeded hashes: doc_id and the number of shards decide the shard, and within it a
    second hash of doc_id and text decides the bucket, of which there are as many as keep one near ``bucket_bytes``. Pass
    two orders each bucket by its hash keys, so that the result doesn't depend on how rows arrived, shuffles it with a
    Fisher-Yates shuffle seeded by shard and bucket, and writes it, in the layout shard=/part files. ``slot`` numbers the
    records of a shard from 0: buckets in turn, then pos.

    Nulls: a null doc_id counts as the text 'null', a null text as no bytes. Rows that are equal in doc_id and text share a
    bucket, in any order among themselves. An empty table gives empty shards. Columns called shard, bucket, pos or slot
    are replaced. ``columns``: what the returned table has in place of the columns of ``docs``.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "bucket", "pos", "slot")
    total = docs.agg(F.sum(record_size(F.col("text"))).alias("n")).first()["n"] or 0
    per_shard = max(1, math.ceil(total / shards / bucket_bytes))
    by_id, by_text = free_name(docs, "by_id"), free_name(docs, "by_text")
    id_hash = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(seed + 1))
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.lit(seed + 2))
    scattered = (
        docs.withColumn("shard", shard_of(F.col("doc_id"), shards, seed))
        .withColumn(by_id, id_hash)
        .withColumn(by_text, text_hash)
        .withColumn("bucket", F.pmod(F.xxhash64(by_id, by_text), F.lit(per_shard).cast("long")).cast("int"))
    )
    schema = scattered.drop(by_id, by_text).withColumn("pos", F.lit(0).cast("long")).schema
    shuffled = scattered.groupBy("shard", "bucket").applyInArrow(textscan.tidied(_fisher_yates(seed, [by_id, by_text], to_arrow_schema(schema))), schema)
    path = path or new_path(spark, "shards")
    shuffled.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return read_shards(spark, path, schema, columns)


def read_shards(spark, path: str, schema, columns: dict[str, Column] | None = None) -> DataFrame:
    """Read shards written by write_shards, with slot; ``columns`` are made before texts would have to move."""
    rows = spark.read.schema(schema).parquet(path)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    run = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = free_name(rows, "bucket_start")
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(run), F.lit(0)).alias(start))
    if columns is not None:
        rows = rows.select("shard", "bucket", "pos", *[c.alias(k) for k, c in columns.items()])
    return rows.join(starts, ["shard", "bucket"]).withColumn("slot", F.col("pos") + F.col(start)).drop(start)
