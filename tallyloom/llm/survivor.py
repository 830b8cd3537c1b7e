"""Problem 4: the surviving person of each duplicate group, by a latent two-sided quality model of the sources.

A fact is a possible date of birth of a group: each date that a record states, and what such a date may be a slip of (day
and month exchanged; the year one, nine or ten off). Every register that has a birth claim in the group either supports a
fact to some degree (the same date; a date that is a slip away; the same year; an age that fits) or denies it. A register
has a sensitivity (how it speaks of true facts) and a specificity (how it speaks of false ones), both unknown, as is
which facts are true; expectation-maximisation finds them together with the share of true facts among plain dates,
first-of-January dates, impossible dates and slips. Registers that a table of trust ranks higher start better.
Every date judged true is retained in `dates`; the most probable one is the birth date of the survivor.

At most one date of a group is true, so the facts of a group share one probability; a field that may have several values
is judged fact by fact (single=False). A group is held as its set of distinct claims, which the calendar and the number of
registers bound, however many records it has. Each round of the model is one pass that returns sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import keep

#: Kinds of facts (three of stated dates, then slips of ten, nine and one years and of day with month) and degrees of
#: support; 0 is "says nothing".
PLAIN, FIRST, IMPOSSIBLE, TEN, NINE, ONE, SWAP = range(7)
KINDS = 7
SAME, NEAR, YEAR, NOT = 1, 2, 3, 4
ROUNDS, TOLERANCE, PRIOR_WEIGHT = 12, 0.002, 50.0
#: Log odds of a group of which no fact is true.
NONE = 0.0
#: Nobody is born before this year, or after the claim arrived.
EARLIEST = 1905
_EPOCH = date(1970, 1, 1)
_DDL = "cluster_id string, records int, claims array<struct<reg:string,day:int,year:int,late:int>>"


def slips(d: date) -> list[tuple[date, int]]:
    """Dates of which d may be a slip, with the kind of slip."""
    out = []
    for y, k in ((-10, TEN), (10, TEN), (-9, NINE), (9, NINE), (-1, ONE), (1, ONE)):
        try:
            out.append((d.replace(year=d.year + y), k))
        except ValueError:
            pass
    if d.day <= 12 and d.day != d.month:
        out.append((date(d.year, d.day, d.month), SWAP))
    return out


def _kind(d: date, latest: int) -> int:
    if d.year < EARLIEST or (d - _EPOCH).days > latest:
        return IMPOSSIBLE
    return FIRST if d.month == 1 and d.day == 1 else PLAIN


class Facts:
    """The facts of a group's claims with their patterns of support."""

    def __init__(self, registers: list[str]):
        self.at = {r: i for i, r in enumerate(registers)}

    def of(self, claims: list[tuple]) -> list[tuple[date, int, tuple]]:
        """[(date, kind and origin, degrees by register)] from [(register, day or None, year or None, latest day)]."""
        exact: dict[date, set] = {}
        years: dict[int, set] = {}
        ages: dict[int, set] = {}
        who: set = set()
        latest = max((c[3] for c in claims), default=0)
        for reg, day, year, _ in claims:
            r = self.at.get(reg)
            if r is None:
                continue
            if day is not None:
                d = _EPOCH + timedelta(days=day)
                exact.setdefault(d, set()).add(r)
                years.setdefault(d.year, set()).add(r)
                who.add(r)
            elif year is not None:
                ages.setdefault(year, set()).add(r)
                who.add(r)
        facts = {d: _kind(d, latest) for d in exact}
        # the register that brings a fact up; what it says of it is in the share of true facts of its kind, not evidence
        origin = {d: min(rs) for d, rs in exact.items()}
        near: dict[date, set] = {}
        for d in list(exact):
            if facts[d] != PLAIN:
                continue
            for s, how in slips(d):
                near.setdefault(s, set()).update(exact[d])
                if s not in facts and _kind(s, latest) == PLAIN:
                    facts[s] = how
                    origin[s] = origin[d]
        out = []
        for d, kind in facts.items():
            p = [0] * len(self.at)
            for r in who:
                p[r] = NOT
            for dy, deg in ((2, YEAR), (1, NEAR), (0, SAME)):
                for y in {d.year - dy, d.year + dy}:
                    for r in ages.get(y, ()):
                        p[r] = min(deg, p[r])
            for r in years.get(d.year, ()):
                p[r] = min(YEAR, p[r])
            for r in near.get(d, ()):
                p[r] = min(NEAR, p[r])
            for r in exact.get(d, ()):
                p[r] = SAME
            p[origin[d]] = 0
            out.append((d, kind * len(self.at) + origin[d], tuple(p)))
        return out


def first_model(trust: list[int]) -> dict:
    """Where the model starts: a register of higher trust states true dates more often."""
    start = {1: (0.7, 0.12, 0.08, 0.1), 2: (0.78, 0.1, 0.05, 0.07), 3: (0.88, 0.06, 0.03, 0.03)}
    true = np.array([start[min(3, max(1, t))] for t in trust]).reshape(len(trust), 4)
    return with_ratio({"true": true, "false": np.tile([0.03, 0.35, 0.12, 0.5], (len(trust), 1)), "share": np.repeat([0.9, 0.3, 0.002, 0.02, 0.02, 0.005, 0.02], len(trust))})


def with_ratio(m: dict) -> dict:
    """Adds the weight of evidence of each degree (0 where a register says nothing) and the prior log odds of each kind."""
    share = np.clip(m["share"], 1e-6, 1 - 1e-6)
    ratio = np.log(np.maximum(m["true"], 1e-9)) - np.log(np.maximum(m["false"], 1e-9))
    return m | {"ratio": np.concatenate([np.zeros((len(ratio), 1)), ratio], axis=1), "prior": np.log(share / (1 - share))}


def odds(kinds: np.ndarray, pats: np.ndarray, model: dict) -> np.ndarray:
    """Log odds of each fact by itself."""
    return model["prior"][kinds] + model["ratio"][np.arange(pats.shape[1]), pats].sum(1)


def posterior(score: np.ndarray, group: np.ndarray, single: bool) -> np.ndarray:
    """Probability of each fact being true. single: at most one fact of a group is (group: its number, ascending);
    else each fact stands for itself, so that a field may keep several values."""
    if not single:
        return 1 / (1 + np.exp(-np.clip(score, -500, 500)))
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    top = np.maximum(np.maximum.reduceat(score, starts), NONE) if len(starts) else np.empty(0)
    at = np.cumsum(np.diff(group, prepend=group[0] if len(group) else 0) != 0) if len(group) else group
    e = np.exp(score - top[at])
    return e / (np.add.reduceat(e, starts) + np.exp(NONE - top))[at]


def expected(kinds: np.ndarray, pats: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Expected counts, flat: (register, degree) of true facts, of false facts, then true and all facts by kind."""
    n_reg = pats.shape[1]
    t, f = np.zeros((n_reg, 5)), np.zeros((n_reg, 5))
    for r in range(n_reg):
        t[r] = np.bincount(pats[:, r], post, 5)
        f[r] = np.bincount(pats[:, r], 1 - post, 5)
    return np.concatenate([t[:, 1:].ravel(), f[:, 1:].ravel(), np.bincount(kinds, post, KINDS * n_reg), np.bincount(kinds, minlength=KINDS * n_reg)])


def improved(counts: np.ndarray, first: dict) -> dict:
    """The next model; pseudo-counts of PRIOR_WEIGHT facts hold rare registers and kinds near the first one."""
    n, n_reg = first["true"].size, len(first["true"])
    t, f = (PRIOR_WEIGHT * first[k] + counts[i * n : (i + 1) * n].reshape(-1, 4) for i, k in enumerate(("true", "false")))
    true, all_ = np.split(counts[2 * n :], 2)
    share = (PRIOR_WEIGHT * first["share"] + true) / (PRIOR_WEIGHT + all_)
    # few slips are undone in a round, and so each round would undo fewer: their share stays at the first one at least
    share[TEN * n_reg :] = np.maximum(share, first["share"])[TEN * n_reg :]
    return with_ratio({"true": t / t.sum(1, keepdims=True), "false": f / f.sum(1, keepdims=True), "share": share})


def _matrix(b: pa.RecordBatch, n_reg: int) -> tuple[np.ndarray, np.ndarray]:
    pats = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, n_reg + 1)
    return pats[:, 0].astype(np.int64), pats[:, 1:].astype(np.int64)


def learn(facts: DataFrame, trust: list[int], single: bool) -> dict:
    """Expectation-maximisation over `facts` (group rows with the binary column `facts`: for each fact its kind with the
    register that brings it up and its degrees by register, a byte each). Each round is one pass that returns a few hundred sums per task."""
    first = model = first_model(trust)
    n_reg = len(trust)
    for _ in range(ROUNDS if trust else 0):
        held = facts.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((8 + 2 * KINDS) * n_reg)
            for b in batches:
                kinds, pats = _matrix(b, n_reg)
                if len(kinds):
                    sizes = np.array([len(x) // (n_reg + 1) for x in b.column(1).to_pylist()])
                    total += expected(kinds, pats, posterior(odds(kinds, pats, held.value), np.repeat(np.arange(len(sizes)), sizes), single))
            yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

        # one row per task, added up in the order of their values so that the sum doesn't depend on the order of tasks
        parts = facts.select("cluster_id", "facts").mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.array_sort(F.collect_list("x")).alias("x"))
        sums = np.zeros((8 + 2 * KINDS) * n_reg)
        for r in parts.select("i", F.aggregate("x", F.lit(0.0), lambda a, y: a + y).alias("s")).collect():
            sums[r["i"]] = r["s"]
        nxt = improved(sums, first)
        change = max(np.abs(nxt["true"] - model["true"]).max(), np.abs(nxt["false"] - model["false"]).max())
        model = nxt
        if change < TOLERANCE:
            break
    return model


def claims_of(standard: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per group: its number of distinct records and its set of distinct claims."""
    c = clusters.select("unique_id", "cluster_id").dropna()
    s = standard.select("unique_id", "record_id", "register", "birth_date", "birth_year", "birth_exact", "loaded_at")
    x = c.join(s, "unique_id")
    day = F.when(F.col("birth_exact"), F.datediff(F.to_date("birth_date"), F.lit("1970-01-01").cast("date")))
    # a claim counts as late as the last day of the month in which it arrived, so that arrivals make few distinct claims
    late = F.datediff(F.last_day(F.to_date("loaded_at")), F.lit("1970-01-01").cast("date"))
    claim = F.struct(F.col("register").alias("reg"), day.cast("int").alias("day"), F.when(day.isNull(), F.col("birth_year")).cast("int").alias("year"))
    one = x.select("cluster_id", "record_id", claim.alias("c"), F.coalesce(late, F.lit(0)).alias("late"))
    # two steps, so that the set of a group is built from distinct claims however many records it has
    per = one.groupBy("cluster_id", "c").agg(F.max("late").alias("late"), F.count_distinct("record_id").alias("n"), F.min("record_id").alias("r1"), F.max("record_id").alias("r2"))
    return per.groupBy("cluster_id").agg(
        # exact up to 2: a group has two records if its claims have two different smallest or largest ones
        F.when(F.min("r1") < F.max("r2"), 2).otherwise(1).cast("int").alias("records"),
        F.collect_list(F.struct("c.reg", "c.day", "c.year", "late")).alias("claims"),
    )


def survivors(standard: DataFrame, clusters: DataFrame, register_info: DataFrame) -> DataFrame:
    """(cluster_id, birth_date, birth_year, birth_exact, confidence, dates, several) of every group with a row of standard.

    birth_date is the most probable date (earliest of equals), birth_exact true and birth_year its year; confidence its
    probability; dates every date judged true (probability above a half). A group without an exact claim has a null
    birth_date, birth_exact false and the median of its stated years, or null; several: has two distinct records at least.
    Redelivered records count once per claim. Rows without a group are no part of it; unknown registers are ignored.
    """
    spark = standard.sparkSession
    # a handful of rows: one per register
    info = sorted((r["register"], int(r["trust"] or 1)) for r in register_info.select("register", "trust").filter("register IS NOT NULL").collect())
    names, trust = [r for r, _ in info], [t for _, t in info]
    held = keep(claims_of(standard, clusters), "claims")

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Facts(names)
        for b in batches:
            facts, days, years = [], [], []
            for claims in b.column(2).to_pylist():
                rows = [tuple(c.values()) for c in claims]
                got = f.of(rows)
                facts.append(b"".join(bytes([k, *p]) for _, k, p in got))
                days.append([d for d, _, _ in got])
                ys = sorted(r[2] for r in rows if r[2] is not None)
                years.append(ys[(len(ys) - 1) // 2] if ys else None)
            yield pa.record_batch([b.column(0), pa.array(facts, pa.binary()), pa.array(days, pa.list_(pa.date32())), pa.array(years, pa.int64()), pa.array([n > 1 for n in b.column(1).to_pylist()])], names=["cluster_id", "facts", "days", "year", "several"])

    held = keep(held.mapInArrow(patterns, "cluster_id string, facts binary, days array<date>, year bigint, several boolean"), "facts")
    model = spark.sparkContext.broadcast(learn(held, trust, single=True))
    n_reg = len(names)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, pats = _matrix(b, n_reg)
            sizes = np.array([len(x) // (n_reg + 1) for x in b.column(1).to_pylist()], np.int64)
            post = posterior(odds(kinds, pats, model.value), np.repeat(np.arange(len(sizes)), sizes), True)
            at, days, sure, dates = 0, [], [], []
            for ds, n in zip(b.column(2).to_pylist(), sizes):
                best = sorted(zip(-post[at : at + n], ds))
                at += n
                days.append(best[0][1] if best else None)
                sure.append(-float(best[0][0]) if best else None)
                dates.append([d for q, d in best if q < -0.5])
            yield pa.record_batch(
                [b.column(0), pa.array(days, pa.date32()), pa.array([d.year if d else y for d, y in zip(days, b.column(3).to_pylist())], pa.int64()), pa.array([d is not None for d in days]), pa.array(sure, pa.float64()), pa.array(dates, pa.list_(pa.date32())), b.column(4)],
                names=["cluster_id", "birth_date", "birth_year", "birth_exact", "confidence", "dates", "several"],
            )

    return held.mapInArrow(choose, "cluster_id string, birth_date date, birth_year bigint, birth_exact boolean, confidence double, dates array<date>, several boolean")


def retained_values(standard: DataFrame, clusters: DataFrame, register_info: DataFrame, value: str = "aadhaar_token") -> DataFrame:
    """(cluster_id, value, probability, retained): the values of a field that may have several, each judged by itself.

    A fact is a value of a group; a register that states it supports it, one that states other values only denies it, one
    that states none says nothing. Values that stand in one group, in two to five, or in more are three kinds, so that
    fillers and borrowed numbers are told from a person's own. retained: probability above a half. Null values and groups
    are no facts. Sets here hold registers only, so no group is gathered, however many records or values it has.
    """
    spark = standard.sparkSession
    info = sorted((r["register"], int(r["trust"] or 1)) for r in register_info.select("register", "trust").filter("register IS NOT NULL").collect())
    names, trust = [r for r, _ in info], [t for _, t in info]
    known = F.col("register").isin(*names) if names else F.lit(False)
    s = standard.filter(known).select("unique_id", "register", F.col(value).cast("string").alias("value")).dropna()
    x = clusters.select("unique_id", "cluster_id").dropna().join(s, "unique_id")
    facts = keep(x.groupBy("cluster_id", "value").agg(F.collect_set("register").alias("by")), "values")
    speaks = facts.select("cluster_id", F.explode("by").alias("r")).groupBy("cluster_id").agg(F.collect_set("r").alias("all"))
    groups = facts.groupBy("value").agg(F.count("*").alias("groups"))
    rows = facts.join(speaks, "cluster_id").join(groups, "value").select("cluster_id", "value", "by", "all", "groups")
    at = {r: i for i, r in enumerate(names)}

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for by, all_, n in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                p = [0] * len(at)
                for r in all_:
                    p[at[r]] = NOT
                for r in by:
                    p[at[r]] = SAME
                first = min(at[r] for r in by)
                p[first] = 0
                out.append(bytes([(PLAIN if n == 1 else FIRST if n <= 5 else IMPOSSIBLE) * len(at) + first, *p]))
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary()), b.column(1)], names=["cluster_id", "facts", "value"])

    held = keep(rows.mapInArrow(patterns, "cluster_id string, facts binary, value string"), "facts")
    model = spark.sparkContext.broadcast(learn(held, trust, single=False))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, pats = _matrix(b, len(names))
            post = posterior(odds(kinds, pats, model.value), kinds, False)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(post), pa.array(post > 0.5)], names=["cluster_id", "value", "probability", "retained"])

    return held.mapInArrow(choose, "cluster_id string, value string, probability double, retained boolean")
