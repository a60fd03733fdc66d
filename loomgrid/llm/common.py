"""Shared helpers: the shared work folder, sized joins, row identity, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows times their width stay below this.
BROADCAST_BYTES = 48 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``, or a new one in local mode."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomgrid-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder, parted by some columns, and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized_join(left: DataFrame, right: DataFrame, on, how: str, rows: int, row_bytes: int) -> DataFrame:
    """Join that broadcasts ``right`` when its counted size is small, else shuffles both."""
    if rows * row_bytes <= BROADCAST_BYTES:
        right = F.broadcast(right)
    else:
        right = right.hint("shuffle_merge")
    return left.join(right, on, how)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with ``_`` added until no column of ``df`` has it."""
    while name.lower() in [c.lower() for c in df.columns]:
        name += "_"
    return name


def clear_names(columns: list[str], taken: tuple[str, ...]) -> list[str]:
    """The columns, renamed ``orig_...`` where they clash with the taken names in any case."""
    out: list[str] = []
    for c in columns:
        name = c
        while name.lower() in taken or (name != c and name.lower() in {x.lower() for x in [*columns, *out]}):
            name = f"orig_{name}"
        out.append(name)
    return out


def row_key(*cols: str) -> Column:
    """64-bit identity of a row by the named columns; a null differs from an empty text."""
    parts = [x for c in cols for x in (F.col(c), F.col(c).isNull())]
    return F.xxhash64(*parts)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one slice hold about ``most_bytes`` (one row at least)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        arr = b.column(b.schema.get_field_index(column))
        kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
        off = np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
        lo = 0
        while lo < b.num_rows:
            hi = int(np.searchsorted(off, off[lo] + most_bytes, "right")) - 1
            hi = min(max(hi, lo + 1), b.num_rows)
            yield b.slice(lo, hi - lo)
            lo = hi


def connected_components(edges: DataFrame, most_rounds: int = 30) -> DataFrame:
    """(node, root) of an undirected edge table (a, b): alternating large and small stars.

    Every round is a partial aggregate and a join, so a star with very many leaves
    is never held by one task. ``root`` is the least node of the component. Nodes
    without an edge, loops and null ends are left out.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "cc")
    last = None
    for _ in range(most_rounds):
        sym = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")
        )
        e = materialize(small.select("x.u", "x.v").where("u <> v").distinct(), "cc")
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("the components did not settle; raise most_rounds")
    return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
