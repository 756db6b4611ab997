"""Tables that the engine writes for itself: in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows up to which Spark may choose to broadcast a table. Its size on disk or in a shuffle is that of compressed columns and says little of its size in a driver's memory.
FEW_ROWS = 100_000
#: Least buckets of a stored table, and rows beyond which a bucket is one too few: a bucket is sorted by one task, which spills what it can't hold.
FEW_BUCKETS, BUCKET_ROWS = 16, 500_000


@cache
def _on_one_machine() -> str:
    return "file://" + tempfile.mkdtemp(prefix="deltascope-")


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in spark.checkpoint.dir. Without that setting there is one only where all of Spark runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(base or _on_one_machine()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of known size, which Spark may broadcast under its own threshold; a lost executor costs no recomputation. It stays for the cluster's own clean-up."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Rows that the driver has, as a table in the plan: no Python process makes them again in every job."""
    schema = T.StructType.fromDDL(ddl)
    return spark.createDataFrame(pa.table({f.name: [r[i] for r in rows] for i, f in enumerate(schema)}, schema=to_arrow_schema(schema)), schema)


def many(df: DataFrame) -> bool:
    """Whether df has more than FEW_ROWS rows, counted up to there."""
    return df.limit(FEW_ROWS + 1).count() > FEW_ROWS


def by_shuffle(df: DataFrame, asked: bool = True) -> DataFrame:
    """df, whose joins are by shuffle, whatever Spark makes of its size."""
    return df.hint("merge") if asked else df


def buckets_for(n_rows: int) -> int:
    """Buckets for a table of so many rows: FEW_BUCKETS, and more where a bucket would hold over BUCKET_ROWS."""
    return max(FEW_BUCKETS, -(-n_rows // BUCKET_ROWS))


def bucketed(rows: DataFrame, path: str, made: dict[str, Column], columns: list[str], buckets: int) -> DataFrame:
    """The columns that `made` makes of rows, written to `path` in files by hash of some of them and sorted by these: tables that are stored alike are joined and grouped on them without a shuffle. Rows are dealt out as they are, and columns made afterwards."""
    name = f"deltascope_{uuid.uuid4().hex}"
    dealt = rows.repartition(buckets, *[made[c] for c in columns]).select(*[column.alias(c) for c, column in made.items()])
    dealt.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, *columns).sortBy(*columns).saveAsTable(name)
    return rows.sparkSession.table(name)


def open_bucketed(spark: SparkSession, path: str, columns: list[str], buckets: int) -> DataFrame:
    """What `bucketed` wrote, in any later session."""
    name, schema = f"deltascope_{uuid.uuid4().hex}", spark.read.parquet(path).schema
    quoted = ", ".join(f"`{c}`" for c in columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY ({quoted}) SORTED BY ({quoted}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
