"""Stored rows, whose lists are JSON texts, to tables and back, and seeding a store with curated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import AXES
from .store import Merge, Store

#: Curated tables and their keys.
KEYS = {"source": "id", "brand": "id", "product": "id", "listing": "id", "match": "listing_id", "rating": "id", "flag": "id"}
#: Columns that are lists, by table, and what their members are.
LISTS = {
    "brand": {"aliases": "string"},
    "product": {"ingredients": "string"},
    "listing": {"raw_ingredients": "string"},
    "flag": {"positions": "struct<body: string, stance: string>", "notes": "string"},
}
# What these columns may hold.
ENUMS = {
    "axis": AXES,
    "scale_direction": ["higher_is_better", "lower_is_better"],
    "funding_model": ["nonprofit", "independent", "ad_supported", "subscription"],
}


def list_of(text: Column, kind: str) -> Column:
    """The list in a JSON text; empty where the text is absent, null or broken."""
    return F.coalesce(F.from_json(text, f"array<{kind}>"), F.from_json(F.lit("[]"), f"array<{kind}>"))


def from_rows(table: str, rows: DataFrame) -> DataFrame:
    """Stored rows as the table that operators take: lists from JSON; all other columns, nulls too, as they are."""
    for c, kind in LISTS.get(table, {}).items():
        rows = rows.withColumn(c, list_of(F.col(c), kind))
    return rows


def to_rows(table: str, df: DataFrame) -> DataFrame:
    """A table as stored rows: lists as JSON, an absent one as []."""
    for c in LISTS.get(table, {}):
        df = df.withColumn(c, F.coalesce(F.to_json(c), F.lit("[]")))
    return df


def unknown_values(sources: DataFrame) -> DataFrame:
    """(id, column, value) of sources whose axis, direction or funding is none that is known; they are read all the same."""
    out = None
    for c, known in ENUMS.items():
        one = sources.where(F.col(c).isNull() | ~F.col(c).isin(*known)).select("id", F.lit(c).alias("column"), F.col(c).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def seed(store: Store, tables: dict[str, DataFrame]) -> DataFrame:
    """Replace whole tables of a store, all with one manifest, and count them: (table, n). Products stand in the order of their
    sort_index; the store holds stored rows."""
    merges = {}
    for name, df in tables.items():
        rows, key = to_rows(name, df), KEYS[name]
        old = store.read(name, rows.schema).select(key)
        merges[name] = Merge(rows, replaced=old.unionByName(rows.select(key)))
    store.merge(merges)
    counts = [store.read(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name in tables]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
