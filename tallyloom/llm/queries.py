"""Queries of the problems whose operators live in this subpackage, and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.encode import encode_corpus
from tallyloom.llm.entities import match_people
from tallyloom.llm.groups import consolidate
from tallyloom.llm.names import link_mentions
from tallyloom.llm.pack import CAPACITY, fill_containers
from tallyloom.llm.places import map_places
from tallyloom.llm.reading import DEMANDING, reading_levels
from tallyloom.llm.survivor import retained_values, survivors
from tallyloom.session import keep
from tallyloom.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    def part(src: str, place: str) -> DataFrame:
        t = table(spark, sf, src, "record_id", place, "block")
        return t.select(F.lit(src).alias("src"), "record_id", F.col(place).alias("value"), "block", F.lit(src == "standard").alias("is_key"))

    typed = part("pension", "gram_panchayat").unionByName(part("ration", "village")).unionByName(part("standard", "panchayat_key"))
    return map_places(typed, table(spark, sf, "units"))


def p1_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """The report of what means no listed unit: records per table."""
    return p1_found(spark, sf).groupBy("src").agg(F.count("*").alias("typed"), F.count_if(F.col("unit_id") < 0).alias("unmatched"))


def p2_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The matches with their confidence."""
    return match_people(spark, sf)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_matches(spark, sf).select("record_id_l", "record_id_r")


def p4_survivors(spark: SparkSession, sf: str) -> DataFrame:
    return survivors(
        table(spark, sf, "standard", "unique_id", "record_id", "register", "birth_date", "birth_year", "birth_exact", "loaded_at"),
        table(spark, sf, "clusters", "unique_id", "cluster_id"), table(spark, sf, "register_info", "register", "trust"),
    )


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    x = p4_survivors(spark, sf).filter("several AND birth_exact")
    return x.select("cluster_id", F.date_format("birth_date", "yyyy-MM-dd").alias("birth_date"))


def p4_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The Aadhaar tokens of each group that are judged to be its person's own; there may be several or none."""
    return retained_values(
        table(spark, sf, "standard", "unique_id", "register", "aadhaar_token"), table(spark, sf, "clusters", "unique_id", "cluster_id"), table(spark, sf, "register_info", "register", "trust")
    ).withColumnRenamed("value", "aadhaar_token")


def p5_links(spark: SparkSession, sf: str) -> DataFrame:
    """The links with their confidence."""
    return link_mentions(spark, sf)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_links(spark, sf).select("mention_l", "mention_r")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return consolidate(
        table(spark, sf, "pairs", "unique_id_l", "unique_id_r", "match_probability", "via"),
        table(spark, sf, "clusters", "unique_id", "cluster_id"),
    )


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(table(spark, sf, "documents", "doc_id", "text"))


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    sizes = encode_corpus(table(spark, sf, "documents", "doc_id", "text"), out="n_tokens", lengths_only=True)
    return fill_containers(sizes)


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers are: one row, with the least number of containers that the tokens need."""
    x = keep(p8_containers(spark, sf), "filled")
    per = x.filter("container IS NOT NULL").groupBy("container").agg(F.sum("size").alias("fill"))
    return per.agg(
        F.count("*").alias("containers"), F.sum("fill").alias("tokens"), F.max("fill").alias("fullest"),
        F.ceil(F.sum("fill") / CAPACITY).alias("least_containers"), F.round(F.sum("fill") / (F.count("*") * CAPACITY), 6).alias("share_filled"),
    )


def p9_levels(spark: SparkSession, sf: str) -> DataFrame:
    return reading_levels(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "reading_labels", "doc_id", "grade"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_levels(spark, sf).filter(F.col("level") >= DEMANDING).select("doc_id")


def p9_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus by language (as written, folded to two letters and script), source and kind."""
    d = table(spark, sf, "documents", "doc_id", "lang", "source", "doc_kind")
    code = F.lower("lang")
    lang = F.when(code.isin("en", "eng"), "en").when(code.isin("hi", "hin"), "hi").otherwise(code)
    x = d.join(p9_levels(spark, sf), "doc_id").groupBy(lang.alias("lang"), "source", "doc_kind")
    return x.agg(
        F.count("*").alias("documents"), F.count("level").alias("rated"), F.round(F.avg("level"), 4).alias("mean_level"),
        F.count_if(F.col("level") >= DEMANDING).alias("demanding"), F.sum("words").alias("words"),
    )


QUERIES = {"p1_found": p1_found, "p1_unmatched": p1_unmatched, "p9_found": p9_found, "p9_levels": p9_levels, "p9_profile": p9_profile, "p2_found": p2_found, "p2_matches": p2_matches, "p4_found": p4_found, "p4_survivors": p4_survivors, "p4_tokens": p4_tokens, "p5_found": p5_found, "p5_links": p5_links, "p6_found": p6_found, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_fill": p8_fill}
ORACLE = {
    "p6_found": """
WITH RECURSIVE e AS (
  SELECT unique_id_l a, unique_id_r b FROM pairs WHERE match_probability >= 0.9 OR via = 'household'
  UNION SELECT unique_id, min(unique_id) OVER (PARTITION BY cluster_id) FROM clusters WHERE cluster_id IS NOT NULL),
s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r(v, g) AS (SELECT DISTINCT a, a FROM s UNION SELECT s.b, r.g FROM r JOIN s ON s.a = r.v)
SELECT v AS unique_id, min(g) AS group_id FROM r GROUP BY v""",
}
