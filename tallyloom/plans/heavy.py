"""Problem 3: per-key results of `standard` where a few keys hold most records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.keyed_totals import heavy_keys, keyed_totals
from tallyloom.sources.tables import table

FIELDS = ["skel_first", "panchayat_key", "aadhaar_token"]
SHARE = 0.025


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return heavy_keys(table(spark, sf, "standard", *FIELDS), FIELDS, SHARE).select("field", "key_value")


def p3_keys(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "standard", *FIELDS, "birth_year", "birth_exact")
    return keyed_totals(df, FIELDS, ["birth_year", "birth_exact"]).select(
        "field", "key_value", "n", F.col("n_birth_year").alias("with_year"), F.col("sum_birth_year").alias("year_sum"), F.col("sum_birth_exact").alias("exact")
    )


QUERIES = {"p3_found": p3_found, "p3_keys": p3_keys}

_EACH = "SELECT '{f}' AS field, {f} AS key_value, count(*) AS n, count(birth_year) AS with_year, coalesce(sum(birth_year), 0)::BIGINT AS year_sum, coalesce(sum(birth_exact::INT), 0)::BIGINT AS exact FROM standard WHERE {f} IS NOT NULL GROUP BY {f}"
ORACLE = {
    "p3_found": " UNION ALL ".join(
        f"SELECT '{f}' AS field, {f} AS key_value FROM standard WHERE {f} IS NOT NULL GROUP BY {f} HAVING count(*) >= {SHARE} * (SELECT count({f}) FROM standard)" for f in FIELDS
    ),
    "p3_keys": " UNION ALL ".join(_EACH.format(f=f) for f in FIELDS),
}
