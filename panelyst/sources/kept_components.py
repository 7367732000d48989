"""Connected components that are kept in a store and grow by links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected, kept
from .store import Merge, Store

#: Tables in the store and their keys.
TABLES = {"node": "node", "root": "first"}


class KeptComponents:
    """Union-find in two tables: ``node`` has the component that a node was first put in, and never changes; ``root`` has where
    such components stand now, for those that were joined to a lesser one. New links are a graph of roots, which is small
    however large the components are; only rows of ``root`` that lead to a root that moves are written again.
    """

    def __init__(self, store: Store, kind: str = "string"):
        self.store, self.kind = store, kind

    def _root(self) -> DataFrame:
        return self.store.read("root", f"first {self.kind}, root {self.kind}")

    def read(self) -> DataFrame:
        """(node, root) of all nodes, root being the least node of the component."""
        node = self.store.read("node", f"node {self.kind}, first {self.kind}")
        return node.join(self._root(), "first", "left").select("node", F.coalesce("root", "first").alias("root"))

    def add(self, links: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Put in links (a, b); a link of a node to itself makes it a node, nulls are no links. False if ``batch`` is in already."""
        if batch is not None and batch[1] <= self.store.applied(batch[0]):
            return False
        links = kept(links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct(), "new-links")
        nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        ends = kept(nodes.join(self.read(), "node", "left").select("node", F.col("root").isNull().alias("fresh"), F.coalesce("root", "node").alias("root")), "link-ends")
        of = lambda end: ends.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).where("a <> b").distinct()
        moved = connected(between).where("node <> root").select("node", F.col("root").alias("to"))
        root = self._root()
        led = root.join(moved, F.col("root") == F.col("node")).select("first", F.col("to").alias("root"))
        rows = kept(led.unionByName(moved.select(F.col("node").alias("first"), F.col("to").alias("root"))), "moved-roots")
        fresh = ends.where("fresh").select("node", F.col("node").alias("first"))
        return self.store.merge({"node": Merge(fresh), "root": Merge(rows)}, batch)
