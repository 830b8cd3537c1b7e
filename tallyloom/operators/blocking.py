"""Candidate pairs by blocking rules, comparison levels, and near misses."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.text import jaro_winkler as _jw


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity; repeated pairs of a batch are computed once."""
    seen: dict = {}
    out = []
    for p in zip(a, b):
        if p not in seen:
            seen[p] = None if p[0] is None or p[1] is None else _jw(*p)
        out.append(seen[p])
    return pd.Series(out, dtype="float64")


#: Records of a key that one tile pairs with as many others; says who does the work, not what comes out.
TILE = 1000


def _implied(rule: tuple, by: tuple) -> bool:
    """Whether every pair of `rule` is one of `by`: it agrees on all keys of `by`, and the column that `by` bounds is one of its own
    keys or bounded at least as closely."""
    (keys, _, *near), (more, residual, *bound) = rule, by
    return residual is None and set(more) <= set(keys) and all(c in keys or any(c == d and r <= reach for d, r in near) for c, reach in bound)


def _holds(rule: tuple) -> Column:
    """Whether the aliases x and y are a pair of the rule; never null."""
    keys, residual, *near = rule
    c = reduce(lambda a, b: a & b, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys])
    for n, reach in near:
        c = c & (F.abs(F.col(f"x.{n}") - F.col(f"y.{n}")) <= reach)
    return F.coalesce(c if residual is None else c & residual, F.lit(False))


def block_joins(df: DataFrame, id_: str, rules: list[tuple], tile: int = TILE) -> list[DataFrame]:
    """For each rule that no other one implies, its pairs of rows under the aliases x and y, x.id < y.id: those that agree on all
    keys and pass the residual. A pair of several rules comes with the first of them only, which is seen from the two rows, so that
    no pair is shuffled to be compared with others; rows aren't shuffled but once a rule and side. Null keys never match.

    A rule is (keys, residual) or (keys, residual, (column, reach)): then the values of a numeric column are at most `reach`
    apart as well. A key of more than `tile` records (their table is broadcast: a row for `tile` records at most) is dealt to buckets
    of about `tile`, two of which, or one with itself, are joined by one task, and by bands of that reach, so that records far
    apart never meet: a key that a third of all records have has no long task. The two sides are joined by a merge join: dealt out,
    a side is many times what the planner takes it for by the size of its files, and isn't to be built in the driver.
    """
    own = [r for i, r in enumerate(rules) if not any(_implied(r, o) and (j < i or not _implied(o, r)) for j, o in enumerate(rules) if j != i)]
    parts = []
    for i, rule in enumerate(own):
        keys, _, *near = rule
        rows = df.dropna(subset=[*keys, *[c for c, _ in near]])
        hot = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > tile)
        rows = rows.join(F.broadcast(hot), keys, "left").withColumn("_t", F.coalesce(F.ceil(F.col("_n") / tile), F.lit(1)).cast("int"))
        rows = rows.withColumn("_b", F.pmod(F.xxhash64(id_), F.col("_t")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_t") - 1)))
        rows = rows.withColumns({"_i": F.least("_b", "_o"), "_j": F.greatest("_b", "_o")}).select(*df.columns, "_b", "_i", "_j", "_t")
        x, y = rows, rows
        on = [*keys, "_i", "_j"]
        for c, reach in near:
            band = F.floor(F.col(c) / max(1, reach))
            few = F.col("_t") == 1
            x = x.withColumn("_y", F.when(few, F.lit(0).cast("long")).otherwise(band))
            y = y.withColumn("_y", F.explode(F.when(few, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(band - 1, band + 1))))
            on.append("_y")
        x, y = x.alias("x"), y.alias("y")
        cond = (F.col(f"x.{id_}") < F.col(f"y.{id_}")) & ((F.col("x._i") == F.col("x._j")) | (F.col("x._b") != F.col("y._b")))
        j = x.join(y.hint("merge"), reduce(lambda a, b: a & b, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in on]) & cond)
        parts.append(j.filter(reduce(lambda a, r: a & ~_holds(r), own[:i], _holds(rule))))
    return parts


def block_rows(df: DataFrame, id_: str, rules: list[tuple], tile: int = TILE) -> list[DataFrame]:
    """The pairs of block_joins as rows: l and r, the ids, and every other column of both, ending in _l and _r."""
    side = lambda a, s: [F.col(f"{a}.{c}").alias(c + s) for c in df.columns if c != id_]
    return [j.select(F.col(f"x.{id_}").alias("l"), F.col(f"y.{id_}").alias("r"), *side("x", "_l"), *side("y", "_r")) for j in block_joins(df, id_, rules, tile)]


def block_pairs(df: DataFrame, id_: str, rules: list[tuple], tile: int = TILE) -> DataFrame:
    """(l, r) with l < r: pairs that agree on all keys of one rule at least and pass its residual (over the aliases x and y), each
    once; see block_joins. Only where an id has several rows are the pairs shuffled to make them distinct."""
    out = reduce(DataFrame.unionByName, [j.select(F.col(f"x.{id_}").alias("l"), F.col(f"y.{id_}").alias("r")) for j in block_joins(df, id_, rules, tile)])
    return out if df.groupBy(id_).count().filter("count > 1").isEmpty() else out.distinct()


def levels(null: Column, *conditions: Column) -> Column:
    """A comparison as an ordered level: -1 where null, else the number counted from the bottom of the first that holds, 0 for
    none. A condition that is null doesn't hold."""
    out = F.when(null, -1)
    for i, c in enumerate(conditions):
        out = out.when(F.coalesce(c, F.lit(False)), len(conditions) - i)
    return out.otherwise(0).cast("tinyint")


def pair_gammas(left: str = "_l", right: str = "_r", jw: float = 0.88) -> dict[str, Column]:
    """The comparison levels of two records whose columns end in _l and _r; <col>_jw is a similarity computed before."""
    a, b = (lambda c: F.col(c + left)), (lambda c: F.col(c + right))

    def name(c: str, skel: str, *more: Column) -> Column:
        initial = ((F.length(a(c)) == 1) | (F.length(b(c)) == 1)) & (F.substring(a(c), 1, 1) == F.substring(b(c), 1, 1))
        return levels(a(c).isNull() | b(c).isNull(), a(c) == b(c), *more, a(skel) == b(skel), F.col(f"{c}_jw") >= jw, initial)

    join = lambda x: F.concat(x("name_first"), F.replace(F.coalesce(x("name_middle"), F.lit("")), F.lit(" "), F.lit("")))
    compound = (join(a) == b("name_first")) | (join(b) == a("name_first"))
    gap = F.abs(a("birth_year") - b("birth_year"))
    exact = lambda c: levels(a(c).isNull() | b(c).isNull(), a(c) == b(c))
    return {
        "gamma_first_name": name("name_first", "skel_first", compound), "gamma_surname": name("name_last", "skel_last"), "gamma_relation_name": name("rel_first", "rel_skel"),
        "gamma_middle": exact("name_middle"), "gamma_sex": exact("sex"), "gamma_aadhaar_token": exact("aadhaar_token"), "gamma_account_token": exact("account_token"),
        "gamma_birth": levels(gap.isNull(), a("birth_exact") & b("birth_exact") & (a("birth_date") == b("birth_date")), gap == 0, gap <= 2, gap <= 6),
        "gamma_place": levels(a("block").isNull() | b("block").isNull(), a("panchayat_key") == b("panchayat_key"), a("block") == b("block")),
        "gamma_same_document": levels(a("doc_key").isNull() | b("doc_key").isNull() | (a("register") != b("register")), a("doc_key") == b("doc_key")),
    }


def near_misses(left: DataFrame, right: DataFrame, id_: str, keys: list[str], exact: str, text: str, year: str, years: int, jw: float = 0.88) -> DataFrame:
    """The ids of left that have a near miss in right: equal keys and another id, and either the same `exact` with years at
    most `years` apart (unknown years pass), or the same first letter, years at most 2 apart and a similarity of at least jw.

    Distinct values are compared, not rows: each side is first reduced to its values, those of right with their least and largest
    id. Another id than its own is there unless both are its own. The similarity is computed last, the second way by bands of years."""
    letter = F.substring(exact, 1, 1)
    values = lambda df, *cols: df.select(*dict.fromkeys([*keys, exact, text, year, id_]), letter.alias("_c")).groupBy(*keys, *cols)
    ends = lambda g: g.agg(F.min(id_).alias("_lo"), F.max(id_).alias("_hi"))
    same = lambda cols: reduce(lambda p, q: p & q, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in cols])
    gap = F.abs(F.col(f"x.{year}") - F.col(f"y.{year}"))

    def ids(pairs: DataFrame, by: list[str]) -> DataFrame:
        """The ids of left whose values `by` meet another id."""
        met = pairs.groupBy(*[F.col(f"x.{c}").alias(f"_{i}") for i, c in enumerate(by)]).agg(F.min("y._lo").alias("_lo"), F.max("y._hi").alias("_hi"))
        on = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)])
        return left.withColumn("_c", letter).join(met, on).filter((F.col(id_) != F.col("_lo")) | (F.col(id_) != F.col("_hi"))).select(id_)

    by = [*keys, exact, year]
    x, y = values(left, exact, year).agg(F.lit(1)).alias("x"), ends(values(right, exact, year)).alias("y")
    one = ids(x.join(y, same([*keys, exact]) & (F.coalesce(gap, F.lit(0)) <= years)), by)
    by = [*keys, "_c", year, text]
    band = F.floor(F.col(year) / 2)
    x = values(left, "_c", year, text).agg(F.lit(1)).withColumn("_y", band).alias("x")
    y = ends(values(right, "_c", year, text)).withColumn("_y", F.explode(F.sequence(band - 1, band + 1))).alias("y")
    near = x.join(y, same([*keys, "_c", "_y"]) & (gap <= 2)).filter(jaro_winkler(F.col(f"x.{text}"), F.col(f"y.{text}")) >= jw)
    return one.unionByName(ids(near, by)).distinct()
