"""Table readers: parquet with projection, CSV with a fixed schema, uploads, multi-line JSON, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import keep, ship


def table(spark: SparkSession, folder: str, name: str, *columns: str | Column) -> DataFrame:
    """The parquet table `name`; with columns given, only those reach the scan."""
    ship(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def csv_table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A CSV file with a header row and a fixed schema; cells that do not parse become null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def csv_upload(spark: SparkSession, path: str, most: int = 2000) -> DataFrame:
    """An uploaded CSV: every column a string, a byte-order mark stripped from the first header,
    and only the first `most` rows (the limit is the feature: an upload form, not a batch source)."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns]).limit(most)


def json_document(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document spread over many lines."""
    return spark.read.option("multiLine", True).json(path)


def rules(path: str) -> dict:
    """A YAML rules document, parsed on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def folders_with(spark: SparkSession, root: str, name: str) -> list[str]:
    """The folders under root that hold the table `name`, sorted."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/*/{name}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().getParent().toString() for s in found or [])


def in_memory(spark: SparkSession, rows: list, schema: str, name: str | None = None) -> DataFrame:
    """Rows of the driver as a DataFrame, registered as a temporary view where a name is given."""
    df = spark.createDataFrame(rows, schema)
    if name:
        df.createOrReplaceTempView(name)
    return df


def with_ordinal(df: DataFrame, order: list, name: str = "unique_id") -> DataFrame:
    """A dense id 0..n-1 in the given total order, without one global sort task: range partitions are
    sorted, counted, and each partition's ids start at the counts before it."""
    from pyspark.sql import Window as W

    # written once: a range exchange that ran twice could draw its bounds differently
    part = keep(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ordinal")
    local = part.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    counts = part.groupBy("_p").count()
    starts = counts.withColumn("_s", F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)))
    return (
        local.join(F.broadcast(starts.select("_p", F.coalesce("_s", F.lit(0)).alias("_s"))), "_p")
        .withColumn(name, (F.col("_s") + F.col("_r") - 1).cast("long"))
        .drop("_p", "_r", "_s")
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """An appended log, all its files; the order of its entries is their number's, not the files'."""
    return spark.read.parquet(path)
