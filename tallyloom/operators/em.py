"""The linkage model: prior, u by sampling, m by expectation-maximisation over distinct level vectors, weights, explanation.

Records never reach the driver: pairs are counted by their vector of levels first, and the vectors are bounded by the product
of the levels. The estimator is this module's own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-6


def gamma_counts(pairs: DataFrame, gammas: list[str]) -> DataFrame:
    """Pairs by vector; a column n, where there is one, says how many pairs a row stands for."""
    return pairs.groupBy(*gammas).agg((F.sum("n") if "n" in pairs.columns else F.count("*")).alias("n"))


def sample_of(df: DataFrame, id_: str, rows: int, seed: int) -> DataFrame:
    """The `rows` rows with the smallest keyed hash of their id: the same sample whatever the partitions (a sampling operator)."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_).cast("string")), 256)).limit(rows)


def level_shares(counts: list[dict], gammas: list[str]) -> dict[str, dict[int, float]]:
    """Share of each level among the non-null ones."""
    out = {}
    for g in gammas:
        n: dict[int, float] = {}
        for r in counts:
            if r[g] >= 0:
                n[r[g]] = n.get(r[g], 0) + r["n"]
        total = sum(n.values()) or 1.0
        out[g] = {k: max(FLOOR, v / total) for k, v in sorted(n.items())}
    return out


def prior(matches_by_rule: int, records: int, recall: float = 0.8) -> float:
    """Probability that two random records match, from the pairs that a strict rule finds and its recall."""
    pairs = records * (records - 1) / 2
    return min(0.5, max(1e-12, matches_by_rule / recall / pairs)) if pairs else 0.5


def fit(counts: list[dict], gammas: list[str], u: dict[str, dict[int, float]], lam: float, rounds: int = 25, tolerance: float = 1e-4) -> dict[str, dict[int, float]]:
    """m by expectation-maximisation with u fixed. A null level says nothing. Levels that never occur keep no entry."""
    levels = {g: sorted({r[g] for r in counts if r[g] >= 0} | set(u.get(g, {}))) for g in gammas}
    m = {g: {k: max(FLOOR, (i + 1.0) / sum(range(1, len(ks) + 1))) for i, k in enumerate(ks)} for g, ks in levels.items()}
    n = np.array([r["n"] for r in counts], float)
    for _ in range(rounds):
        like_m, like_u = np.full(len(counts), np.log(lam)), np.full(len(counts), np.log(1 - lam))
        for g in gammas:
            like_m += np.array([np.log(m[g][r[g]]) if r[g] >= 0 else 0.0 for r in counts])
            like_u += np.array([np.log(max(FLOOR, u[g].get(r[g], FLOOR))) if r[g] >= 0 else 0.0 for r in counts])
        post = 1 / (1 + np.exp(np.clip(like_u - like_m, -500, 500)))
        total = (n * post).sum()
        lam = min(1 - 1e-9, max(1e-12, total / max(n.sum(), 1.0)))
        change = 0.0
        for g, ks in levels.items():
            w = {k: sum(x * p for x, p, r in zip(n, post, counts) if r[g] == k) for k in ks}
            s = sum(w.values())
            if s > 0:
                new = {k: max(FLOOR, v / s) for k, v in w.items()}
                change = max(change, max(abs(new[k] - m[g][k]) for k in ks))
                m[g] = new
        if change < tolerance:
            break
    return m


def average(models: list[dict[str, dict[int, float]]]) -> dict[str, dict[int, float]]:
    """The mean of m over the training sessions that have a comparison."""
    out: dict[str, dict[int, float]] = {}
    for g in {g for m in models for g in m}:
        own = [m[g] for m in models if g in m]
        out[g] = {k: float(np.mean([m[k] for m in own if k in m])) for k in sorted({k for m in own for k in m})}
    return out


def bits(gammas: list[str], m: dict, u: dict) -> dict[str, dict[int, float]]:
    """log2(m/u) of each level of each comparison."""
    return {g: {k: float(np.log2(m[g][k] / max(FLOOR, u[g].get(k, FLOOR)))) for k in m.get(g, {})} for g in gammas}


def weight(table: dict[str, dict[int, float]], lam: float) -> Column:
    """log2 prior odds plus the bits of each level; null levels add nothing."""
    out = F.lit(float(np.log2(lam / (1 - lam))))
    for g, levels in table.items():
        c = F.lit(0.0)
        for k, v in levels.items():
            c = F.when(F.col(g) == k, v).otherwise(c)
        out = out + c
    return out


def probability(w: Column) -> Column:
    return F.pow(F.lit(2.0), w) / (1 + F.pow(F.lit(2.0), w))


def term_adjustment(level: Column, top: int, u_exact: float, tf_l: Column, tf_r: Column) -> Column:
    """log2(u_exact / larger term frequency) where the level is the exact one, else 0."""
    return F.when(level == top, F.log2(F.lit(u_exact) / F.greatest(tf_l, tf_r))).otherwise(0.0)


def explain(pairs: DataFrame, gammas: list[str], m: dict, u: dict) -> DataFrame:
    """(l, r, comparison, level, bits) of each non-null comparison of the pairs, by a join with the small level table."""
    rows = [(g, k, round(float(np.log2(v / max(FLOOR, u[g].get(k, FLOOR)))), 1)) for g in gammas for k, v in m.get(g, {}).items()]
    table = pairs.sparkSession.createDataFrame(rows, "comparison string, level int, bits double")
    long = pairs.select("l", "r", F.explode(F.array(*[F.struct(F.lit(g).alias("comparison"), F.col(g).cast("int").alias("level")) for g in gammas])).alias("x")).select("l", "r", "x.*")
    return long.join(F.broadcast(table), ["comparison", "level"])  # bounded by the number of levels
