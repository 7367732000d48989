"""Sightings as a stream: each micro-batch resolves against a catalog snapshot read anew."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.blocking import prepared
from ..operators.catalog import SHELF_CAP
from ..operators.matching import resolve
from ..sources.pages import classify_cosmetic


def resolved_batch(batch: DataFrame, snapshot: Callable[[], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(id, cosmetic, product_id, confidence, ambiguous) of a batch of items with category; what isn't cosmetic isn't resolved."""
    catalog, brands = snapshot()
    judged = batch.withColumn("cosmetic", classify_cosmetic(F.col("name"), F.col("category"))["cosmetic"])
    found = resolve(prepared(judged.where("cosmetic").drop("cosmetic", "category"), brands), catalog)
    return judged.select("id", "cosmetic").join(found.select("id", "product_id", "confidence", "ambiguous"), "id", "left")


def resolve_stream(items: DataFrame, snapshot: Callable[[], tuple[DataFrame, DataFrame]], out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write verdicts of a stream of items to ``out``, a folder a batch, so that a batch that is run again replaces itself.

    ``snapshot`` gives (prepared catalog, brands) and is called for each batch: a catalog that grows meanwhile is seen.
    """

    def write(batch: DataFrame, number: int) -> None:
        resolved_batch(batch, snapshot).write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q).start()


def shelf_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(user_id, item, day, last_seen): the last view of an item by user and day, late events within the watermark counted."""
    seen = events.withWatermark("ts", late)
    return seen.groupBy(F.window("ts", "1 day").alias("w"), "user_id", "item").agg(F.max("ts").alias("last_seen")).select("user_id", "item", F.col("w.start").alias("day"), "last_seen")


def shelves_stream(events: DataFrame, cap: int = SHELF_CAP) -> DataFrame:
    """(user_id, item, last_seen, place): in update mode, the whole shelf of each user who saw anything in a batch.

    A user's state has the ``cap`` items seen last, newest first; an item that is seen again moves to the front. What falls
    off can only come back by being seen again, so the state never needs more, and late events change nothing below it.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = dict(zip(*state.get, strict=True)) if state.exists else {}
        for frame in frames:
            for item, at in frame.groupby("item")["micros"].max().items():
                seen[item] = max(int(at), seen.get(item, int(at)))
        top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:cap]
        state.update(([i for i, _ in top], [at for _, at in top]))
        yield pd.DataFrame({"user_id": key[0], "item": [i for i, _ in top], "micros": [at for _, at in top], "place": range(1, len(top) + 1)})

    views = events.where("user_id IS NOT NULL AND item IS NOT NULL AND ts IS NOT NULL").select("user_id", "item", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    shelves = views.groupBy("user_id").applyInPandasWithState(step, "user_id long, item string, micros long, place long", "items array<string>, seen array<long>", "update", GroupStateTimeout.NoTimeout)
    return shelves.select("user_id", "item", F.timestamp_micros("micros").alias("last_seen"), "place")
