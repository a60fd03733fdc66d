"""Registries as folders: a versioned Parquet table a type and a small manifest file.

A save writes new versions beside the old ones and then adds a manifest with the next number;
a reader looks at the greatest one first. So it never sees half a save or none, and a plan
that still reads an older version goes on working. Other places are JDBC URLs.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from loomgrid.registry import Registry

MANIFEST = r"registry-([0-9]+)[.]json"
#: manifests before the last that stay, for readers that have just found them
KEPT = 3


def _path(spark: SparkSession, text: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """Numbers and paths of the manifests, in order."""
    path, fs = _path(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted((int(m.group(1)), f"{folder}/{n}") for n in names if (m := re.fullmatch(MANIFEST, n)))


def _read(spark: SparkSession, folder: str) -> dict | None:
    found = _versions(spark, folder)
    if not found:
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(found[-1][1], wholetext=True).collect()))


def _write(spark: SparkSession, folder: str, data: dict) -> None:
    """Add a manifest with the next number. Two writers can't both have it: a rename onto an
    existing file fails."""
    found = _versions(spark, folder)
    number = found[-1][0] + 1 if found else 1
    path, fs = _path(spark, f"{folder}/registry-{number:09d}.json")
    part, _ = _path(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(data, indent=1).encode()))
    out.close()
    if fs.exists(path) or not fs.rename(part, path):
        fs.delete(part, False)
        raise RuntimeError(f"another save to {folder} came between; load it and save again")
    for _, old in found[:-KEPT]:
        fs.delete(_path(spark, old)[0], False)


def _jdbc_name(spark: SparkSession, url: str, kind: str) -> str:
    return spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(kind)


def jdbc_tables(spark: SparkSession, url: str, properties: dict[str, str] | None = None) -> list[str]:
    """Names of all tables of a database."""
    jvm = spark.sparkContext._jvm
    options = jvm.java.util.Properties()
    for k, v in (properties or {}).items():
        options.setProperty(k, v)
    con = jvm.java.sql.DriverManager.getConnection(url, options)
    try:
        rows, out = con.getMetaData().getTables(con.getCatalog(), None, "%", None), []
        while rows.next():
            if rows.getString("TABLE_TYPE") in ("TABLE", "BASE TABLE"):
                out.append(rows.getString("TABLE_NAME"))
        return sorted(out)
    finally:
        con.close()


def save(registry: Registry, url: str, properties: dict[str, str] | None = None) -> None:
    """Write all types, schemas of types without data included."""
    spark = registry.spark
    if url.startswith("jdbc:"):
        for kind, df in registry.tables.items():
            df.write.jdbc(url, _jdbc_name(spark, url, kind), "overwrite", properties or {})
        return
    tables = {}
    for kind, df in registry.tables.items():
        place = f"{uuid.uuid4().hex}"
        df.write.parquet(f"{url}/tables/{place}")
        tables[kind] = {"place": place, "schema": df.schema.json()}
    _write(spark, url, {"tables": tables, "schemas": {k: s.json() for k, s in registry.schemas.items()}})


def load(spark: SparkSession, url: str, kinds: list[str] | None = None, properties: dict[str, str] | None = None) -> Registry:
    """Read a saved registry, or the named types of it; a folder without one is an empty registry."""
    if url.startswith("jdbc:"):
        names = jdbc_tables(spark, url, properties) if kinds is None else kinds
        return Registry(spark, {k: spark.read.jdbc(url, _jdbc_name(spark, url, k), properties=properties or {}) for k in names})
    found = _read(spark, url) or {"tables": {}, "schemas": {}}
    read = lambda t: spark.read.schema(StructType.fromJson(json.loads(t["schema"]))).parquet(f"{url}/tables/{t['place']}")
    tables: dict[str, DataFrame] = {k: read(t) for k, t in found["tables"].items() if kinds is None or k in kinds}
    return Registry(spark, tables, {k: StructType.fromJson(json.loads(s)) for k, s in found["schemas"].items()})
