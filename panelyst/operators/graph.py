"""Connected components over large edge tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where it is unset and Spark local."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="panelyst-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def kept(df: DataFrame, label: str) -> DataFrame:
    """The table, written into the shared folder: short lineage, and whole after lost executors."""
    path = f"{shared_folder(df.sparkSession)}/panelyst/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) of nodes with an edge (a, b); the root is the component's least node.

    Every node points at a smaller one; in each round it points where the least of its neighbours' targets points. Rounds
    double the reach, and each is written, so a chain of n nodes takes about log n of them. Joins are by merging: tables of nodes
    that are just small enough to be broadcast would go through the driver in every round.
    """
    pairs = edges.where("a <> b").select("a", "b")
    both = kept(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    at = kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots")
    for _ in range(rounds):
        near = both.join(at.select(F.col("node").alias("b"), F.col("root").alias("seen")).hint("merge"), "b").groupBy("a").agg(F.min("seen").alias("seen"))
        best = at.join(near.withColumnRenamed("a", "node").hint("merge"), "node").select("node", "root", F.least("root", "seen").alias("hook"))
        # hook the old root too, so that whole trees move
        moved = best.groupBy(F.col("root").alias("node")).agg(F.min("hook").alias("via_root"))
        hooked = best.join(moved.hint("merge"), "node", "left").select("node", F.col("root").alias("was"), F.least("hook", F.coalesce("via_root", "hook")).alias("root"))
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
        nxt = kept(hooked.join(jump.hint("merge"), "root", "left").select("node", "was", F.coalesce("next", "root").alias("root")), "roots")
        changed = nxt.where("root <> was").limit(1).count()
        at = nxt.select("node", "root")
        if not changed:
            return at
    raise RuntimeError("components did not settle")
