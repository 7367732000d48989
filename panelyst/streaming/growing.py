"""A catalog that grows while a stream of feed answers runs: each micro-batch resolves, mints and is put in once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..sources import feed
from ..sources.store import Store


def grow_stream(landed: DataFrame, store: Store, checkpoint: str, now: Callable[[], str], name: str = "feed", envelope: bool = True, quarantine: str | None = None, once: bool = False) -> StreamingQuery:
    """Ingest a stream of landed answers (column raw) into ``store``.

    A micro-batch sees all that earlier ones minted. Its tables and its number, under ``name``, get into the store with one
    manifest: a batch that is run again after a stop in between is found there and changes nothing, and one that was stopped
    before leaves no trace. The numbers are the checkpoint's, so another checkpoint needs another name. Rows that are no valid
    answers go to ``quarantine``, a folder a batch.
    """

    def put_in(batch: DataFrame, number: int) -> None:
        batch = batch.select("raw")
        if number <= store.applied(name):
            return
        good, bad = feed.parsed(batch, envelope)
        if quarantine is not None:
            bad.write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        feed.ingest_into(store, good, now(), (name, number))

    q = landed.writeStream.foreachBatch(put_in).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q).start()
