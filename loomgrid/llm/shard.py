"""Two-pass external shuffle into shards.

Pass one scatters rows uniformly over memory-sized buckets by a seeded hash of the
whole row, pass two puts each bucket in a fixed order and applies a seeded
Fisher-Yates shuffle to it. The bucket count follows from the measured bytes, so that a
bucket fits in memory; any one source or key is spread over all buckets. Copies of one row
share a bucket, in which they are held once a batch, with their places. The order depends on the rows and the seed only, not on partitions, so a
bucket that is computed again after an executor is lost comes out the same.

Cases: null values and empty texts are hashed as they are; rows that are equal in all
columns fall in the same bucket and keep their count; an empty table gives no rows. Arrays,
structs and maps are hashed by their content.
Columns that clash with ``shard`` or ``position`` are renamed ``orig_...`` in the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomgrid.llm.common import clear_names, free_name

BUCKET_BYTES = 24 << 20
SEED = 20240
#: Partitions at most; beyond that a partition holds several buckets, one after the other.
MOST_PARTS = 20_000


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation of n by Fisher-Yates: position i swaps with a uniform j <= i, from the end."""
    g = np.random.Generator(np.random.PCG64(seed & (2**64 - 1)))
    out = list(range(n))
    if n > 1:
        draw = g.integers(0, np.arange(n, 1, -1)).tolist()
        for i, j in zip(range(n - 1, 0, -1), draw):
            out[i], out[j] = out[j], out[i]
    return np.array(out, np.int64)


def buckets_for(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets that hold ``bucket_bytes`` each, by the bytes of the strings, 8 an element of an
    array of numbers, the length as JSON of other nested columns, and 16 a row and column."""
    width = F.lit(16 * max(1, len(docs.columns)))
    for name, kind in docs.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        elif kind.startswith("array<") and kind[6:-1] in ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "boolean"):
            width = width + 8 * F.greatest(F.size(F.col(f"`{name}`")), F.lit(0))
        elif kind.startswith(("array<", "struct<", "map<")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0))
    total = docs.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0]
    return max(1, math.ceil(total / bucket_bytes))


def _shuffle(seed: int, names: list[str], bucket: str, keys: list[str]):
    def finish(held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]], shard: int) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches([b for b, _, _ in held]).combine_chunks()
        start = np.cumsum([0, *(b.num_rows for b, _, _ in held)])
        row = np.concatenate([at + s for (_, at, _), s in zip(held, start)])
        key = np.concatenate([k for _, _, k in held], 1)
        n = len(row)
        place = row[np.lexsort((key[1], key[0]))][fisher_yates(n, seed * 1_000_003 + shard)]
        for lo in range(0, n, 2048):
            part = t.take(pa.array(place[lo : lo + 2048])).select(names)
            part = part.append_column("shard", pa.array(np.full(part.num_rows, shard, np.int64))).append_column("position", pa.array(np.arange(lo, lo + part.num_rows)))
            yield from part.to_batches()

    def distinct(b: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        """Rows, the row of each place, and the places' keys; rows that are equal are held once."""
        key = np.stack([b.column(k).to_numpy() for k in keys])
        o = np.lexsort((key[1], key[0]))
        new = np.concatenate([[True], (key[:, o[1:]] != key[:, o[:-1]]).any(0)])
        if 2 * new.sum() > len(o):
            return b, np.arange(len(o)), key
        at = np.empty(len(o), np.int64)
        at[o] = np.cumsum(new) - 1
        return b.take(pa.array(o[new])), at, key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = [], -1
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(b.schema.get_field_index(bucket)).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if held and shard != ids[lo]:
                    yield from finish(held, shard)
                    held = []
                shard = int(ids[lo])
                held.append(distinct(b.slice(lo, hi - lo)))
        if held:
            yield from finish(held, shard)

    return run


def shard(docs: DataFrame, buckets: int | None = None, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows with ``shard`` and ``position``: the shuffled place of each row."""
    n = buckets or buckets_for(docs, bucket_bytes)
    names = clear_names(docs.columns, ("shard", "position"))
    renamed = docs.toDF(*names)
    cols = []
    for c, kind in renamed.dtypes:
        x = F.col(f"`{c}`")
        cols += [F.array_sort(F.map_entries(x)) if kind.startswith("map<") else x, x.isNull()]
    bucket, *keys = (free_name(renamed, x) for x in ("__bucket", "__key", "__key2"))
    keyed = renamed.select(
        *[F.col(f"`{c}`") for c in names],
        F.xxhash64(F.lit(seed), *cols).alias(keys[0]),
        F.xxhash64(F.lit(seed + 1), *cols).alias(keys[1]),
    ).withColumn(bucket, F.pmod(keys[0], F.lit(n)).cast("int"))
    schema = StructType([*renamed.schema.fields, StructField("shard", LongType()), StructField("position", LongType())])
    parts = min(n, MOST_PARTS)
    near = keyed.repartitionById(parts, F.pmod(bucket, F.lit(parts)))
    if n > parts:
        near = near.sortWithinPartitions(bucket)
    return near.mapInArrow(_shuffle(seed, names, bucket, keys), schema)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write one folder a shard, rows in their shuffled order."""
    shard(docs, **options).write.mode("overwrite").partitionBy("shard").parquet(path)
