"""Predictions stored as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetlens.operators import store
from fleetlens.sources.versions import Version, VersionedTables

TABLE = "predictions"


def store_batch(tables: VersionedTables, batch: DataFrame, stream: str, batch_id: int, force: bool = False) -> Version:
    """Merge one batch of results by :func:`fleetlens.operators.store.upsert_predictions`.

    Only buckets with a result that did not fail are rewritten. The batch number is published with the rows, so a batch that
    is run again after a crash, before or after its version came out, changes nothing more.
    """
    # the rows are read for the keys and for the merge, and a batch may be recomputed differently in between
    batch = batch.persist()
    try:
        return tables.change(
            {TABLE: (batch.where("NOT failed"), batch)}, lambda old, _, new: store.upsert_predictions(old, new, force), batch=(stream, batch_id)
        )
    finally:
        batch.unpersist()


def run_upserts(results: DataFrame, tables: VersionedTables, stream: str, checkpoint: str, force: bool = False) -> None:
    """Drain the stream of ``results`` into the table; started again with the same ``checkpoint`` it goes on where it stopped."""
    query = (
        results.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda batch, batch_id: store_batch(tables, batch, stream, batch_id, force) and None).start()
    )
    query.awaitTermination()
