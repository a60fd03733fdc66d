"""Entity ids and the resolution of references to entities.

An id is the first twelve hex digits of the SHA-256 of ``file:path``. References resolve in
tiers: an exact id, else an exact alias, else every path that holds the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Basename of a file that documents the manifest format with example entities.
FORMAT_GUIDE = "format_guide.yaml"


def dhash(text: str) -> str:
    """Id of a text."""
    digest = hashlib.sha256(text.encode())
    return digest.hexdigest()[:12]


def get_id(file_id: str, path: str) -> str:
    """Id of an entity by its source and its path there."""
    return dhash(f"{file_id}:{path}")


def hash_column(text: Column) -> Column:
    """``dhash`` of a string column, JVM-side."""
    return F.substring(F.sha2(text, 256), 1, 12)


def name_part(path: Column) -> Column:
    """What follows the first colon of a path; the path itself without one."""
    return F.when(F.contains(path, F.lit(":")), F.regexp_extract(path, r"(?s)^[^:]*:(.*)$", 1)).otherwise(path)


def alias_column(path: Column, key: Column) -> Column:
    """The last two dotted segments of an entity's name, or its key at top level."""
    parts = F.split(name_part(path), r"\.")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(key)


def candidates(ref: str, spine: Iterable[dict]) -> list[str]:
    """Ids a reference may mean, from rows of the spine; of the first tier with any."""
    rows = list(spine)
    for hit in (
        [r["value"] for r in rows if r["value"] == ref],
        [r["value"] for r in rows if r.get("alias") is not None and r["alias"] == ref],
    ):
        if hit:
            return hit
    return [r["value"] for r in rows if r["path"] is not None and ref in r["path"]]


def reference_candidates(refs: DataFrame, spine: DataFrame, few: int = 100_000) -> DataFrame:
    """(ref, entity_id, tier) of all candidates of the distinct texts in column ``ref``.

    Tiers 1 and 2 are equi-joins; only texts that neither resolves meet the paths in a
    substring join, whose counted side is broadcast if it has ``few`` rows at most.
    """
    refs = refs.select("ref").where("ref is not null").distinct()
    exact = refs.join(spine.select(F.col("value").alias("ref"), F.col("value").alias("entity_id")), "ref").withColumn("tier", F.lit(1))
    left = refs.join(exact.select("ref"), "ref", "left_anti")
    if "alias" in spine.columns:
        named = left.join(spine.select(F.col("alias").alias("ref"), F.col("value").alias("entity_id")), "ref").withColumn("tier", F.lit(2))
        left = left.join(named.select("ref"), "ref", "left_anti")
        exact = exact.unionByName(named)
    if left.limit(few + 1).count() <= few:
        left = F.broadcast(left)
    within = spine.join(left, F.contains(F.col("path"), F.col("ref"))).select("ref", F.col("value").alias("entity_id"), F.lit(3).alias("tier"))
    return exact.unionByName(within)


def unique_references(refs: DataFrame, spine: DataFrame) -> DataFrame:
    """(ref, entity_id) of the texts with exactly one candidate row."""
    hits = reference_candidates(refs, spine).groupBy("ref").agg(F.count("*").alias("n"), F.min("entity_id").alias("entity_id"))
    return hits.where("n = 1").select("ref", "entity_id")


def non_format_guide_ids(spine: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``ids`` (entity_id) whose entity isn't from the format guide's file."""
    if "filepath" not in spine.columns:
        return ids
    guide = spine.where(F.col("filepath").endswith(FORMAT_GUIDE)).select(F.col("value").alias("entity_id"))
    return ids.join(guide, "entity_id", "left_anti")
