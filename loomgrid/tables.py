"""Types, empty tables, alignment, and where intermediate tables are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, NullType, StringType, StructField, StructType

#: Declared field types that are coerced; any other stays as loaded.
ENGINE_TYPES: dict[str, DataType] = {"str": StringType(), "bool": BooleanType(), "int": LongType(), "float": DoubleType(), "rating": DoubleType()}
SPINE = StructType([StructField(c, StringType()) for c in "value path alias entity_key filepath".split()])
META = StructType([
    StructField("entity_id", StringType()), StructField("component_index", LongType()), StructField("component_type", StringType()),
    StructField("modifier", StringType()), StructField("derived", BooleanType()), StructField("skip_on_export", BooleanType()),
])
PARENT = StructType([
    StructField("entity_id", StringType()), StructField("component_index", LongType()), StructField("modifier", StringType()),
    StructField("parent_eid", StringType()), StructField("is_primary", BooleanType()),
])
VIOLATION = StructType([
    StructField("entity_id", StringType()), StructField("component_index", LongType()), StructField("component_type", StringType()),
    StructField("field", StringType()), StructField("value", StringType()), StructField("error_type", StringType()),
])
KEYS = ("entity_id", "component_index", "modifier")
#: A plan estimated below this is kept as rows on the driver, else as a table in the shared folder.
LOCAL_BYTES = 4 << 20
#: The estimate knows nothing of what an explode or a join yields, so rows are counted up to here.
LOCAL_ROWS = 20_000


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    return F.col(quoted(name))


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a new local folder only where a local session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomgrid-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: as driver rows if Catalyst estimates few bytes and there are
    few rows indeed, else as a table in the folder all executors share, so that losing one
    loses nothing."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= LOCAL_BYTES:
        rows = df.limit(LOCAL_ROWS + 1).toArrow()
        if rows.num_rows <= LOCAL_ROWS:
            return spark.createDataFrame(rows, df.schema)
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without_null_types(df: DataFrame, known: StructType | None = None) -> DataFrame:
    """Columns without a type get the type they had in ``known``, else string."""
    types = {f.name: f.dataType for f in known.fields} if known else {}
    fix = {f.name: col(f.name).cast(types.get(f.name, StringType())) for f in df.schema.fields if isinstance(f.dataType, NullType)}
    return df.withColumns(fix) if fix else df


def aligned(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the same columns, sorted by name, missing ones null. Types that differ
    raise: a silent cast would fail at run time or change values."""
    a, b = {f.name: f.dataType for f in left.schema.fields}, {f.name: f.dataType for f in right.schema.fields}
    kinds: dict[str, DataType] = {}
    for name in sorted({*a, *b}):
        x, y = a.get(name), b.get(name)
        pair = [t for t in (x, y) if t is not None and not isinstance(t, NullType)]
        if len(pair) == 2 and pair[0] != pair[1]:
            raise ValueError(f"Column {name!r} is {pair[0].simpleString()} in one table and {pair[1].simpleString()} in the other.")
        kinds[name] = pair[0] if pair else StringType()

    def shaped(df: DataFrame, have: dict[str, DataType]) -> DataFrame:
        return df.select(*[(col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    return shaped(left, a), shaped(right, b)


def union_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = aligned(left, right)
    return a.union(b).distinct()


def register_table(df: DataFrame, component_type: str, key: list[str], file_id: str, order: list[str] | None = None, index: bool = True) -> tuple[DataFrame, DataFrame]:
    """Any table as a component type: (spine, components).

    The entity of a row is ``file_id:<type>.<key>`` and its component_index the row's place
    among the entity's rows by ``order``. With ``index`` off every index is 0 and no
    shuffle is needed.
    """
    from pyspark.sql import Window

    from loomgrid.ids import alias_column, hash_column

    name = F.concat_ws("_", *[col(k).cast("string") for k in key])
    path = F.concat(F.lit(f"{file_id}:{component_type}."), name)
    keyed = df.withColumns({"__path": path, "__key": name})
    spine = keyed.select(hash_column(F.col("__path")).alias("value"), F.col("__path").alias("path"), alias_column(F.col("__path"), F.col("__key")).alias("alias"), F.col("__key").alias("entity_key"), F.lit(file_id).alias("filepath")).distinct()
    at = F.row_number().over(Window.partitionBy("__path").orderBy(*[col(c) for c in order or key])).cast("long") - 1 if index else F.lit(0).cast("long")
    return spine, keyed.select(hash_column(F.col("__path")).alias("entity_id"), at.alias("component_index"), F.lit(None).cast("string").alias("modifier"), *[col(c) for c in df.columns])
