"""Shared folder, written tables, graph components and small column helpers."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_folder

#: Java pattern of what separates words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Let batches between JVM and Python have at most ``most`` bytes of rows, unless the session already says less.

    By default a batch has 10,000 rows whatever their size, and texts of some kilobytes then take several copies of tens of
    megabytes in each task.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    said = re.fullmatch(r"(-?\d+)\s*([kmg]?)i?b?", spark.conf.get(key).strip().lower())
    now = int(said[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[said[2]] if said else -1
    if now <= 0 or now > most:
        spark.conf.set(key, str(most))


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/panelyst/{label}-{uuid.uuid4().hex}"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the same with underscores behind it, whichever the table has no column of in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, label: str, path: str | None = None, **options: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by written(), once nothing lazy reads them any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/panelyst/" in folder:
            at = jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unit(*keys: Column) -> Column:
    """A uniform number in [0, 1) made from the keys alone; DuckDB gets the same from md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *keys)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components: (node, root) for every node with a link, root the smallest node of its component.

    edges: columns a, b of one orderable type. Alternates large-star and small-star steps; each round is written to the
    shared folder, so lineage stays short. Minima are pre-aggregated before the shuffle, and the joins that follow can be
    split by adaptive execution, so a hub with a third of all links isn't gathered in one task.
    """

    def fingerprint(e: DataFrame):
        return e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()

    now = written(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = fingerprint(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        large = large.distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        nxt = written(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct(), "edges")
        got = fingerprint(nxt)
        same = got == seen
        discard(now)
        now, seen = nxt, got
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    heads = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(heads)
