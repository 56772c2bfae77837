"""Continuous ingest: a stream of change rows becomes layers of a stored index, one per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..index import Index, Store, apply_changes, changed_keys


def ingest(changes: DataFrame, store: Store, build_index: Callable[[DataFrame], Index], checkpoint: str, empty: DataFrame, key: str = "match_key", once: bool = True, errors_to: str | None = None, layers: int = 16) -> StreamingQuery:
    """Merges every micro-batch of (action, at, key, …) rows into the store: only records that the batch touches are read and analysed.

    ``empty`` gives the records' columns before the first version. Refused changes are added to the Parquet table
    ``errors_to`` with their batch. After so many ``layers`` the store is compacted. With ``once`` the query ends when
    the input is used up. A batch that is replayed gives the same records again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        columns = empty.columns
        try:
            old, first = store.read().records, False
        except FileNotFoundError:
            old, first = empty, True
        touched = old.join(batch.select(key).distinct(), key, "left_semi")
        new, errors = apply_changes(touched.select(*columns), batch, key)
        if errors_to:
            errors.withColumn("batch", F.lit(number)).write.mode("append").parquet(errors_to)
        index = build_index(new)
        if first:
            store.write(index)
        else:
            gone = touched.join(changed_keys(batch, errors, key), key, "left_semi").select("db", "sysno")
            kept = changed_keys(batch, errors, key)
            store.merge(build_index(new.join(kept, key, "left_semi")), gone)
            if len(store.manifests.latest()[1]["layers"]) > layers:
                store.compact()
        batch.unpersist()

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
