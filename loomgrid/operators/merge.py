"""Merging a batch into accumulated tables, with a write order for changing components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.tables import aligned, col, settle, union_distinct

#: Beyond this many new rows the write order is given by ranges, not by one sorted partition.
ONE_PARTITION_ROWS = 100_000


def numbered(df: DataFrame, name: str, start: int, order: list[str]) -> DataFrame:
    """``df`` with ``start``, ``start`` + 1, ... in a total order: by ``order``, then by all
    columns, so the numbers don't depend on partitions.

    Few rows are numbered by one window. Many are sorted by ranges; each partition's count
    gives the offset of the next, so no task ever holds all rows.
    """
    keys = [col(c) for c in order] + [F.xxhash64(*[col(c) for c in df.columns])]
    if df.limit(ONE_PARTITION_ROWS + 1).count() <= ONE_PARTITION_ROWS:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*keys)) + (start - 1)).cast("bigint"))
    ranged = settle(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"__p": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = {r[0]: r[1] for r in ranged.groupBy("__p").count().collect()}
    offsets, at = [], start
    for p in sorted(sizes):
        offsets.append((p, at))
        at += sizes[p]
    side = F.broadcast(df.sparkSession.createDataFrame(offsets, "__p int, __o bigint"))
    return ranged.join(side, "__p").withColumn(name, (F.col("__at") + F.col("__o")).cast("bigint")).drop("__p", "__at", "__o")


def initial_sequence(df: DataFrame, name: str) -> DataFrame:
    return numbered(df, name, 1, [c for c in ("entity_id", "component_index") if c in df.columns])


def merge_with_sequence(existing: DataFrame, incoming: DataFrame, name: str) -> DataFrame:
    """Existing rows keep their number; rows that are new, nulls being equal, follow the last."""
    a, b = aligned(existing.drop(name) if name in existing.columns else existing, incoming.drop(name))
    if name in existing.columns:
        a = aligned(existing, incoming.drop(name))[0].select(*a.columns, name)
    else:
        a = initial_sequence(a, name)
    top = a.agg(F.max(name)).first()[0] or 0
    fresh = settle(b.subtract(a.drop(name)))
    return a.unionByName(numbered(fresh, name, top + 1, [c for c in ("entity_id", "component_index") if c in b.columns]))


def merge_plain(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Distinct union with columns aligned by name."""
    return union_distinct(existing, incoming)


def latest(df: DataFrame, time: str | None) -> DataFrame:
    """The row of each entity with the latest time, nulls last, then the last written. The
    rank filter lets Catalyst keep one row a key before the shuffle."""
    if time is None or time not in df.columns:
        return df
    order = [col(time).desc_nulls_last()]
    if f"_seq_{time}" in df.columns:
        order.append(col(f"_seq_{time}").desc_nulls_last())
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy("entity_id").orderBy(*order))).where("__rank = 1").drop("__rank")
