"""What the operators share of Spark: tables, the shared folder, and Arrow map steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of an Arrow batch: texts of some MB, which the kernels cut further.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset, a local master (as in tests) gets a
    temporary one; a cluster has no folder that could stand in for it, so that is an error."""
    context = spark.sparkContext
    if (folder := context.getConf().get("spark.checkpoint.dir")) or (folder := spark.conf.get("spark.checkpoint.dir", None)):
        return folder
    if not (set_to := context._jsc.sc().getCheckpointDir()).isEmpty():
        return set_to.get()
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = f"{tempfile.gettempdir()}/checkpoints"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, so that a lost executor costs a reread and not a rerun."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/catalogsmith/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def removed(df: DataFrame) -> None:
    """Deletes a table that written() made and that no plan needs any more."""
    if path := getattr(df, "_written", None):
        deleted(df.sparkSession, path)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def mapped(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches small enough for long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return df.mapInArrow(step, schema)


def keyed(df: DataFrame, id_col: str, text_col: str, keep: bool = False) -> DataFrame:
    """The two columns that a text operator works on, under names of its own, so that names of other columns don't matter;
    with keep, all of df's columns come along in the struct row."""
    row = [F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("row")] if keep else []
    return df.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"), *row)


def quoted(name: str) -> str:
    """A column's name as one that may hold any character."""
    return "`" + name.replace("`", "``") + "`"


def with_row(fields: str, df: DataFrame, keep: bool = True) -> StructType:
    """The fields of a DDL string, then row as keyed() makes it of df: built as types, since names may hold any character."""
    out = StructType.fromDDL(fields)
    if keep:
        out.add("row", StructType(df.schema.fields), False)
    return out
