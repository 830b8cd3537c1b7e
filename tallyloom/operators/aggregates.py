"""Aggregations and window-like operations over records of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def most_common(df: DataFrame, key: str, value: str, out: str | None = None) -> DataFrame:
    """(key, value, n): each key's most frequent non-null value, the smallest of equals. Two aggregations, both combined
    before their shuffle; no key's rows are ever gathered."""
    n = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    # the largest count, then the smallest value
    best = n.groupBy(key).agg(F.max("n").alias("n")).join(n, [key, "n"]).groupBy(key, "n").agg(F.min(value).alias(out or value))
    return best.select(key, out or value, "n")


def first_in_order(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The first row per key in the given total order, by min_by over a struct: combined map-side, unlike a window."""
    names = [f"_o{i}" for i in range(len(order))]
    x = df.withColumns(dict(zip(names, order)))
    return x.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*names)).alias("_r")).select(*keys, "_r.*")


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str = "nth") -> DataFrame:
    """Each row's 0-based place within its key (all but 0 are repeats), and the size of its key."""
    w = W.partitionBy(*keys)
    return df.withColumns({out: F.row_number().over(w.orderBy(*order)) - 1, "size": F.count("*").over(w)})


def center(df: DataFrame, key: str, year: str) -> DataFrame:
    """(key, sources, spread, median_even): non-null values, their range, and their median rounded half to even."""
    return df.filter(F.col(year).isNotNull()).groupBy(key).agg(
        F.count("*").alias("sources"), (F.max(year) - F.min(year)).cast("double").alias("spread"), F.bround(F.median(year), 0).cast("long").alias("median_even")
    )


def shared_by(df: DataFrame, value: str, holder: str, least: int) -> DataFrame:
    """(value, holders): values that at least so many distinct holders have."""
    return df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count_distinct(holder).alias("holders")).filter(F.col("holders") >= least)


def overlap(df: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """Long form of the upper triangle with diagonal of a flag matrix: (by, a, b, n), zeros kept; one scan, one aggregation."""
    names = list(flags)
    cells = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    x = df.select(*by, *[c.alias(n) for n, c in flags.items()]).filter(" AND ".join(f"{c} IS NOT NULL" for c in by) if by else "true")
    agg = x.groupBy(*by).agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(cells)])
    long = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("n")) for i, (a, b) in enumerate(cells)])).alias("x")
    return agg.select(*by, long).select(*by, "x.*")


def once_on_both_sides(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose left and whose right value occur in no other pair; both counts are over all pairs."""
    l, r = (pairs.groupBy(c).count().filter("count = 1").select(c) for c in (left, right))  # noqa: E741
    return pairs.join(l, left, "left_semi").join(r, right, "left_semi").select(*pairs.columns)


def linked_groups(members: DataFrame, group: str, member: str, least: int = 2) -> DataFrame:
    """(d1, d2, shared): pairs of groups that share at least `least` distinct members. Members of one group only can link
    nothing and are dropped before the join."""
    m = members.select(group, member).distinct()
    m = m.join(m.groupBy(member).count().filter("count > 1").select(member), member, "left_semi")
    a, b = m.select(F.col(group).alias("d1"), member), m.select(F.col(group).alias("d2"), member)
    return a.join(b, member).filter("d1 < d2").groupBy("d1", "d2").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)


def pair_counts(df: DataFrame, predicted: str, true: str) -> DataFrame:
    """One row of pairwise counts: true, predicted and common pairs by sum of s*(s-1)/2; no pair is made."""
    cells = df.groupBy(predicted, true).agg(F.count("*").alias("s"))
    pairs = lambda x: x.agg(F.coalesce(F.sum(F.expr("s * (s - 1) div 2")), F.lit(0)).cast("long").alias("n"))
    tp = pairs(cells).withColumnRenamed("n", "common_pairs")
    p = pairs(cells.groupBy(predicted).agg(F.sum("s").alias("s"))).withColumnRenamed("n", "predicted_pairs")
    t = pairs(cells.groupBy(true).agg(F.sum("s").alias("s"))).withColumnRenamed("n", "true_pairs")
    # three rows of one number each
    return tp.join(F.broadcast(p), F.lit(True)).join(F.broadcast(t), F.lit(True)).select(
        "true_pairs", "predicted_pairs", "common_pairs", F.round(F.col("common_pairs") / F.col("predicted_pairs"), 4).alias("precision"), F.round(F.col("common_pairs") / F.col("true_pairs"), 4).alias("recall")
    )
