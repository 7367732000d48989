"""Substring search over products by a table of trigram postings; what it finds is what a scan with contains() finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that are searched.
FIELDS = ("display_name", "brand_name", "gtin")
GRAM = 3


def _grams(text: Column) -> Column:
    """Distinct trigrams; none of a text of fewer characters."""
    n = F.char_length(text) - (GRAM - 1)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(GRAM)))
    return F.when(n >= 1, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def _lowered(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


class SearchIndex:
    """Folders ``postings`` (gram, id; a folder a shard, files sorted by gram) and ``sizes`` (gram, n) under a path."""

    def __init__(self, spark: SparkSession, path: str, shards: int = 64):
        self.spark, self.path, self.shards = spark, path, shards

    def _shard(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.shards).cast("long")).cast("int")

    def build(self, named: DataFrame) -> SearchIndex:
        """Write the postings of products (id and FIELDS)."""
        grams = F.array_distinct(F.flatten(F.array(*[_grams(_lowered(c)) for c in FIELDS])))
        rows = named.select("id", F.explode(grams).alias("gram")).withColumn("shard", self._shard(F.col("gram")))
        # a trigram that all names have is dealt by id too
        rows.repartition("shard", F.pmod(F.xxhash64("id"), F.lit(8).cast("long"))).sortWithinPartitions("shard", "gram").write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/postings")
        self.postings().groupBy("shard", "gram").agg(F.count("*").alias("n")).write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/sizes")
        return self

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def candidates(self, query: str) -> DataFrame:
        """(id) of products that may hold a query of three characters and more: postings of its trigrams, no others, are read."""
        q = query.strip().lower()
        grams = sorted({q[i : i + GRAM] for i in range(len(q) - GRAM + 1)})
        shards = [r[0] for r in self.spark.createDataFrame([(g,) for g in grams], "gram string").select(self._shard(F.col("gram"))).distinct().collect()]
        lists = self.postings().where(F.col("shard").isin(shards) & F.col("gram").isin(grams))
        return lists.groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("id")

    def search(self, named: DataFrame, query: str) -> DataFrame:
        """Products whose name, brand or barcode holds the trimmed query, whatever the case. A blank query finds none, one of fewer
        than three characters scans."""
        q = query.strip().lower()
        if not q:
            return named.where(F.lit(False))
        some = named.join(self.candidates(q), "id", "left_semi") if len(q) >= GRAM else named
        return some.where(holds(F.lit(q)))

    def search_all(self, named: DataFrame, queries: DataFrame) -> DataFrame:
        """(query, id) of all queries (column query) of three characters and more at once; shorter ones are left out.

        Each query is looked up by its rarest trigram alone, and what that finds is verified; a query with a trigram that no
        product has finds none.
        """
        wanted = queries.select("query", F.lower(F.trim("query")).alias("q")).where(F.char_length("q") >= GRAM).distinct()
        each = wanted.select("query", "q", F.explode(_grams(F.col("q"))).alias("gram")).withColumn("shard", self._shard(F.col("gram")))
        sizes = self.spark.read.parquet(f"{self.path}/sizes")
        rarest = each.join(sizes, ["shard", "gram"], "left").groupBy("query", "q").agg(F.min_by(F.struct("gram", "shard", "n"), F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("r"))
        found = rarest.select("query", "q", "r.gram", "r.shard").join(self.postings(), ["shard", "gram"]).select("query", "q", "id")
        return found.join(named.select("id", *FIELDS), "id").where(holds(F.col("q"))).select("query", "id")


def holds(q: Column) -> Column:
    """Whether one of the searched columns has the lower-cased text in it."""
    test = F.lit(False)
    for c in FIELDS:
        test = test | F.contains(_lowered(c), q)
    return test
