"""Sinks: parquet by partition, small CSV, one JSON document, appended log."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """A full rebuild (overwrite) or an appended slice of a table, partitioned by low-cardinality columns."""
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One quoted CSV file with a header, for sample-sized frames."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_json(document: dict, path: str) -> None:
    """A small driver-side document (a model, a summary)."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(document, f, ensure_ascii=False, indent=1, default=str)


def append_log(df: DataFrame, path: str) -> None:
    """Append-only: existing files are never rewritten."""
    df.write.mode("append").parquet(path)


def write_bucketed(df: DataFrame, name: str, by: list[str], buckets: int) -> None:
    """A table of the catalogue whose rows lie in buckets by key: joins and aggregations of such tables by that key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by).format("parquet").saveAsTable(name)


def write_warehouse(parts: dict[str, DataFrame], path: str) -> None:
    """The rows of all districts in one table, a folder to each; a column that a district lacks is null, those it has are kept."""
    frames = [df.withColumn("district", F.lit(d)) for d, df in parts.items()]
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    out.write.mode("overwrite").partitionBy("district").parquet(path)
