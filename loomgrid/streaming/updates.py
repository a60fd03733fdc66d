"""A stream of manifest texts merged into a registrar, one update a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomgrid.registrar import Registrar


def merge_stream(texts: DataFrame, registrar: Registrar, checkpoint: str, time_column: str | None = None, **trigger) -> StreamingQuery:
    """Merge rows (key, yaml) of a stream; the batch number, or the batch's greatest
    ``time_column``, is the time of an update. Merging a batch again changes nothing, as rows
    that are there already aren't added, so a batch may be repeated after a failure."""

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.collect()  # manifests are schema-sized; tables come in by Registrar.overwrite
        if rows:
            time = max((r[time_column] for r in rows if r[time_column] is not None), default=number) if time_column else number
            registrar.update(yaml_strings={r.key: r.yaml for r in rows}, time=time)

    writer = texts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start() if trigger else writer.start()
