"""A blocking index that stays: key and entry tables bucketed by what they are joined on, so that a micro-batch of items meets the
catalog without the catalog being shuffled."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocking import brand_word_keyed, keyed
from .graph import kept, shared_folder
from .matching import SHIPPED, Model, brand_words_suffice, hits_without_names, name_members, name_pairs, name_words_of, named, names_lead, names_of, near_hits, resolve


class BlockIndex:
    """Tables ``<name>_entries``, bucketed by id, and ``<name>_keys``, bucketed by key: what a prepared catalog is looked up by.

    Keys are those of resolve(): barcodes, brand and first word, ingredient bands, and brands, which meet by name words
    wherever the model lets them. A key table's bucket holds whole keys, sorted.

    Where names_lead there are also ``<name>_names`` and ``<name>_members``, bucketed by name_id, and ``<name>_words``, bucketed by
    key: each name of a brand once, the entries that have it, and its words. resolve() then goes from names to entries.
    """

    def __init__(self, spark: SparkSession, name: str, model: Model = SHIPPED):
        self.spark, self.name, self.model = spark, name, model
        self.by_words = brand_words_suffice(model)

    def _keyed(self, items: DataFrame) -> DataFrame:
        """(key, id); a brand's name words are keys of their own."""
        rows = keyed(items, fine_only=self.by_words).select("key", "id")
        if self.by_words:
            worded = brand_word_keyed(items).select(F.concat(F.lit("word:"), "key", F.lit(":"), "word").alias("key"), "id")
            rows = rows.unionByName(worded)
        return rows.distinct()

    def build(self, catalog: DataFrame, buckets: int = 64) -> BlockIndex:
        """Write the index of a prepared catalog into the shared folder; one of this name is replaced. Each table is dealt once, by
        its bucket."""
        self._save(catalog, "entries", "id", buckets)
        self._save(self._keyed(self.entries()).select("key", F.col("id").alias("entry_id")), "keys", "key", buckets)
        if names_lead(self.model):
            theirs = named(self.entries())
            self._save(names_of(theirs), "names", "name_id", buckets)
            self._save(name_members(theirs), "members", "name_id", buckets)
            self._save(name_words_of(self._table("names")).withColumnRenamed("id", "b"), "words", "key", buckets)
        return self

    def _save(self, df: DataFrame, table: str, by: str, buckets: int) -> None:
        name = f"{self.name}_{table}"
        path = f"{shared_folder(self.spark)}/panelyst/{name}-{uuid.uuid4().hex}"
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(name)

    def entries(self) -> DataFrame:
        return self._table("entries")

    def _table(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{table}")

    def candidates(self, items: DataFrame) -> DataFrame:
        """(id, entry_id): distinct entries that share a key with a prepared item; only the items' keys are moved."""
        mine = self._keyed(items)
        return mine.join(self.spark.table(f"{self.name}_keys"), "key").select("id", "entry_id").distinct()

    def resolve(self, items: DataFrame) -> DataFrame:
        """What matching.resolve() gives for the items and the catalog of the index."""
        if not names_lead(self.model):
            return resolve(items, self.entries(), self.model, pairs=self.candidates(items))
        mine = named(items)
        names = kept(names_of(mine), "names")
        words = name_words_of(names).withColumnRenamed("id", "a")
        pairs = words.join(self._table("words"), ["key", "word"]).select("a", "b").distinct()
        by_name = kept(name_pairs(names, self._table("names"), self.model, pairs), "name-pairs")
        others = hits_without_names(items, self.entries(), self.model)
        return resolve(items, self.entries(), self.model, found=near_hits(name_members(mine), self._table("members"), by_name, others, self.entries(), self.model))
