"""Probabilistic linkage of standard records: candidates, comparison levels, model, edges, households, groups."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.tokens import clk, dice, token
from tallyloom.operators import em
from tallyloom.operators.aggregates import once_on_both_sides
from tallyloom.operators.blocking import block_rows, jaro_winkler, levels, pair_gammas
from tallyloom.operators.components import components
from tallyloom.session import keep, release, small, tidy

COLS = ["unique_id", "record_id", "register", "name_first", "name_middle", "name_last", "skel_first", "skel_last", "rel_first", "rel_skel", "sex", "birth_date", "birth_year", "birth_exact", "panchayat_key", "block", "aadhaar_token", "account_token", "doc_key"]
# fixed values: thresholds of the linkage
KEEP, ACCEPT, STRONG, YEARS_APART, HOUSEHOLD_EDGE, SHARED, BAND, HOUSEHOLD_JW = 0.2, 0.9, 4.0, 10, 0.5, 2, 6, 0.85
#: Weights that aren't learnt: two lines of one document are two people.
FIXED = {"gamma_same_document": ({1: 0.01 / 2**12, 0: 0.03}, {1: 0.01, 0: 1.0})}
LEARNT = ["gamma_first_name", "gamma_surname", "gamma_relation_name", "gamma_middle", "gamma_sex", "gamma_birth", "gamma_place", "gamma_aadhaar_token", "gamma_account_token"]


#: A token that stands beside more given names (skeletons) than this is no person's: a filler, an office's or a bank's.
STRANGERS = 10


def own_tokens(recs: DataFrame, columns: tuple[str, ...] = ("aadhaar_token", "account_token"), most: int = STRANGERS) -> DataFrame:
    """recs with the tokens that strangers share set to null: those that stand beside more than `most` distinct skeletons of given
    names. One person, a household or a borrowed number gives a few; a filler as many as there are names. Such tokens give no
    block, no agreement and no part in training. Few tokens are of this kind, but their number isn't bounded, so they are counted
    before they are broadcast."""
    out = recs
    for c in columns:
        # the skeletons of a token are counted in two steps, combined before each shuffle, however many rows a token has
        bad = recs.filter(F.col(c).isNotNull() & F.col("skel_first").isNotNull()).groupBy(c, "skel_first").agg(F.lit(1).alias("one")).groupBy(c).agg(F.count("*").alias("names"))
        bad = keep(bad.filter(F.col("names") > most).select(c, F.lit(True).alias("_bad")), "strangers")
        out = out.join(small(bad), c, "left").withColumn(c, F.when(F.col("_bad").isNull(), F.col(c))).drop("_bad")
    return out.select(*recs.columns)


def blocking_rules() -> list:
    return [
        (["aadhaar_token"], None), (["account_token"], None), (["skel_first", "skel_last", "panchayat_key"], None), (["skel_first", "skel_last", "birth_year"], None),
        (["skel_first", "rel_skel", "block"], None), (["skel_last", "rel_skel", "panchayat_key"], None), (["skel_first", "panchayat_key", "birth_year"], None),
        (["skel_first", "panchayat_key"], None, ("birth_year", 3)), (["skel_last", "panchayat_key", "sex"], None, ("birth_year", 2)),
    ]


def compare(pairs: DataFrame, recs: DataFrame) -> DataFrame:
    """Pairs (l, r) with all comparison levels."""
    return compared(beside(pairs, recs, COLS))


def beside(pairs: DataFrame, recs: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (l, r) with the columns of both records, ending in _l and _r."""
    side = lambda k, s: recs.select(F.col("unique_id").alias(k), *[F.col(c).alias(c + s) for c in columns if c != "unique_id"])
    return pairs.join(side("l", "_l"), "l").join(side("r", "_r"), "r")


def unlike(c: str) -> Column:
    """Whether two names are filled, differ and have skeletons that differ: only of such the similarity says anything."""
    return (F.col(f"{c}_l") != F.col(f"{c}_r")) & ~F.coalesce(F.col(f"{NAMES[c]}_l") == F.col(f"{NAMES[c]}_r"), F.lit(False))


def compared(x: DataFrame) -> DataFrame:
    """Rows of two records with all comparison levels."""
    return x.withColumns({f"{c}_jw": F.when(unlike(c), jaro_winkler(f"{c}_l", f"{c}_r")) for c in NAMES}).withColumns(pair_gammas())


NAMES = {"name_first": "skel_first", "name_last": "skel_last", "rel_first": "rel_skel"}
FUZZY = dict(zip(NAMES.items(), ("gamma_first_name", "gamma_surname", "gamma_relation_name")))


def blind(standard: DataFrame, secret: bytes) -> DataFrame:
    """Standard records without clear names: each name part becomes a keyed token with its Bloom filter in <part>_clk, each
    skeleton a keyed token. Every distinct name is encoded once and joined back."""
    x = standard
    for c, skel in NAMES.items():
        code = x.select(c).filter(F.col(c).isNotNull()).distinct().select(c, clk(F.col(c), secret, c[0]).alias(f"{c}_clk"))
        x = x.join(code, c, "left").withColumns({c: token(F.col(c), secret, 16), skel: token(F.col(skel), secret, 16)})
    return x.withColumn("name_middle", token(F.col("name_middle"), secret, 16)).drop("name", "name_fold")


def encode(standard: DataFrame, secret: bytes) -> tuple[DataFrame, dict[str, DataFrame]]:
    """What `blind` makes, in two: the records with keyed tokens for names, and by name part its distinct tokens with their filters,
    which are many times as wide."""
    codes = {}
    for c in NAMES:
        names = standard.select(c).filter(F.col(c).isNotNull()).distinct()
        # in two steps: in one select the filter would be that of the token, which has the name's name
        codes[c] = names.withColumn(f"{c}_clk", clk(F.col(c), secret, c[0])).withColumn(c, token(F.col(c), secret, 16)).dropna()
    return standard.withColumns({c: token(F.col(c), secret, 16) for c in [*NAMES, *NAMES.values(), "name_middle"]}).drop("name", "name_fold"), codes


#: The level of a comparison of blinded names from their Dice similarity d: null, equal, d >= 0.85, equal skeletons, d >= 0.7, else.
CLOSE, NEAR = 0.85, 0.7


def blinded_gammas(similar: dict[str, Column]) -> dict[str, Column]:
    """The comparison levels of two blinded records; similar: the Dice similarity by name part."""
    gammas = pair_gammas()
    for (c, skel), g in FUZZY.items():
        a, b = F.col(f"{c}_l"), F.col(f"{c}_r")
        gammas[g] = levels(a.isNull() | b.isNull(), a == b, similar[c] >= CLOSE, F.col(f"{skel}_l") == F.col(f"{skel}_r"), similar[c] >= NEAR)
    return gammas


def compare_blinded(pairs: DataFrame, recs: DataFrame) -> DataFrame:
    """Pairs with all comparison levels, names compared by the Dice similarity of their Bloom filters."""
    x = beside(pairs, recs, [*COLS, *[f"{c}_clk" for c in NAMES]]).withColumns({f"{c}_jw": F.lit(0.0) for c in NAMES})
    return x.withColumns(blinded_gammas({c: dice(F.col(f"{c}_clk_l"), F.col(f"{c}_clk_r")) for c in NAMES}))


def unsettled(x: DataFrame, blinded: bool) -> DataFrame:
    """Rows of two records with all comparison levels as if no two unequal names were similar: all but the lower levels of names are
    final."""
    x = x.withColumns({f"{c}_jw": F.lit(0.0) for c in NAMES})
    return x.withColumns(blinded_gammas({c: F.lit(0.0) for c in NAMES}) if blinded else pair_gammas())


def best(table: dict[str, dict[int, float]], blinded: bool) -> dict[str, dict[int, float]]:
    """The bits of a comparison's levels as `unsettled` gives them, each with the most that the similarity may yet make of it."""
    rise = {0: (1, 3), 2: (3,)} if blinded else {0: (2,), 1: (2,)}
    out = {g: dict(x) for g, x in table.items()}
    for g in FUZZY.values():
        for k, more in rise.items():
            out[g][k] = max(table[g].get(i, 0.0) for i in (k, *more))
    return out


def settle(x: DataFrame, codes: dict[str, DataFrame], parts: list[str]) -> DataFrame:
    """Blinded pairs with the final levels of names: x, a kept table, holds the two tokens of a name that is unequal in <part>_l and
    <part>_r, and null where its level is final. Each two tokens are compared once."""
    for c in parts:
        name = FUZZY[c, NAMES[c]]
        g = F.col(name)
        ends = [f"{c}_l", f"{c}_r"]
        two = x.select(*ends).dropna().distinct()
        for s in ("_l", "_r"):
            two = two.join(codes[c].select(F.col(c).alias(c + s), F.col(f"{c}_clk").alias(f"_clk{s}")), c + s)
        two = two.select(*ends, dice(F.col("_clk_l"), F.col("_clk_r")).alias("_d"))
        x = x.join(two, ends, "left")
        x = x.withColumn(name, F.when(F.col("_d") >= CLOSE, 3).when(g == 2, 2).when(F.col("_d") >= NEAR, 1).otherwise(g).cast("tinyint")).drop("_d", *ends)
    return x


def frequencies(recs: DataFrame, c: str) -> DataFrame:
    """Share of each value of c among the records that have one."""
    n = recs.filter(F.col(c).isNotNull())
    return n.groupBy(c).count().join(F.broadcast(n.agg(F.count("*").alias("total"))), F.lit(True)).select(c, (F.col("count") / F.col("total")).alias("tf"))


def equal_pairs(recs: DataFrame, keys: list[str], within: str | None = None) -> int:
    """Pairs of records that agree on all keys, none null, from the counts of their values: no pair is made."""
    x = recs.dropna(subset=keys) if within is None else recs.filter(within).dropna(subset=keys)
    return int(x.groupBy(*keys).agg(F.count("*").alias("s")).agg(F.coalesce(F.sum(F.expr("s * (s - 1) div 2")), F.lit(0))).first()[0])


def compound_pairs(recs: DataFrame) -> tuple[int, int]:
    """Pairs of which one first name is the other's first and middle name together, but not the same: all, and those with an
    equal skeleton, from counts."""
    both = F.concat("name_first", F.replace(F.coalesce("name_middle", F.lit("")), F.lit(" "), F.lit("")))
    a = recs.select(both.alias("both"), "name_first", F.col("skel_first").alias("skel")).filter("both <> name_first").groupBy("both", "skel").agg(F.count("*").alias("na"))
    b = recs.filter("name_first IS NOT NULL").groupBy(F.col("name_first").alias("both"), "skel_first").agg(F.count("*").alias("nb"))
    n = F.col("na") * F.col("nb")
    r = a.join(b, "both").agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.sum(F.when(F.col("skel") == F.col("skel_first"), n)), F.lit(0))).first()
    return int(r[0]), int(r[1])


def exact_shares(recs: DataFrame, blinded: bool = False) -> dict[str, dict[int, float]]:
    """Share of each level that is an equality among all pairs of records, by comparison; birth and place wholly so."""
    out = {}

    def put(g: str, filled: str, pairs: dict[int, int], rest: bool) -> None:
        n = recs.filter(filled).count()
        total = n * (n - 1) // 2
        if rest:
            pairs = pairs | {0: total - sum(pairs.values())}
        out[g] = {k: v / total for k, v in pairs.items() if v} if total else {}

    for c in ("name_middle", "sex", "aadhaar_token", "account_token"):
        put({"name_middle": "gamma_middle"}.get(c, f"gamma_{c}"), f"{c} IS NOT NULL", {1: equal_pairs(recs, [c])}, True)
    for (c, skel), g in FUZZY.items():
        same = equal_pairs(recs, [c])
        if blinded:
            pairs = {4: same}
        else:
            alike = equal_pairs(recs.filter(F.col(c).isNotNull()), [skel]) - equal_pairs(recs, [c, skel])
            pairs = {4: same, 3: alike}
            if c == "name_first":
                more, more_alike = compound_pairs(recs)
                pairs = {5: same, 4: more, 3: alike - more_alike}
        put(g, f"{c} IS NOT NULL", pairs, False)
    keyed = equal_pairs(recs, ["panchayat_key"], "block IS NOT NULL")
    put("gamma_place", "block IS NOT NULL", {2: keyed, 1: equal_pairs(recs, ["block"]) - equal_pairs(recs, ["block", "panchayat_key"])}, True)
    born = recs.filter("birth_year IS NOT NULL")
    years = {int(r[0]): r[1] for r in born.groupBy("birth_year").count().collect()}  # bounded by the calendar
    gaps = lambda lo, hi: sum(n * years.get(y + d, 0) for y, n in years.items() for d in range(lo, hi + 1))
    dated = {y: equal_pairs(born, ["birth_date", *y], "birth_exact") for y in ((), ("birth_year",))}
    zero = sum(n * (n - 1) // 2 for n in years.values())
    # an equal date beside unequal years is no case of valid records
    put("gamma_birth", "birth_year IS NOT NULL", {4: dated[()], 3: zero - dated["birth_year",], 2: gaps(1, 2), 1: gaps(3, 6)}, True)
    return out


def sessions(recs: DataFrame, codes: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The pairs of the two training sessions, each of one blocking rule, with their levels: those of an equal Aadhaar token, and
    those of equal names in one place. Blinded ones are counted by their vector and the names it leaves open (n) first."""
    out = []
    for k, without in (AADHAAR, PERSON):
        (x,) = block_rows(recs.select(*COLS), "unique_id", [(k, None)])
        if codes is None:
            out.append(compared(x))
            continue
        parts = [c for (c, _), g in FUZZY.items() if g not in without]
        own = [g for g in LEARNT if g not in without]
        x = unsettled(x, True).select(*own, *[F.when(F.col(f"{c}_l") != F.col(f"{c}_r"), F.col(c + s)).alias(c + s) for c in parts for s in ("_l", "_r")])
        out.append(settle(keep(em.gamma_counts(x, x.columns), "session"), codes, parts))
    return tuple(out)


#: The training sessions: the rule they are blocked on and the comparisons it takes out of them.
AADHAAR = (["aadhaar_token"], {"gamma_aadhaar_token"})
PERSON = (["skel_first", "skel_last", "panchayat_key"], {"gamma_first_name", "gamma_surname", "gamma_place"})


def train(scored: DataFrame | tuple[DataFrame, DataFrame], recs: DataFrame, compare=compare, seed: int = 2026, sample: int = 2829, codes: dict[str, DataFrame] | None = None) -> tuple[dict, dict, float]:
    """(m, u, prior). scored: the pairs of `sessions`, or pairs that hold those of both. u of equalities from the value counts of all
    records; how the pairs beyond are shared out among the fuzzy levels from all pairs of a hash sample of records (4 million, as many
    as the reference's); m from two sessions, each without the comparisons of the columns it is blocked on."""
    some = em.sample_of(recs, "unique_id", sample, seed)
    for c, code in (codes or {}).items():
        some = some.join(code, c, "left")
    some = keep(some, "sample")
    # bounded by the sample: its pairs are made and compared without a shuffle
    ids = some.select(F.col("unique_id").alias("l")).repartition(4 * recs.sparkSession.sparkContext.defaultParallelism)
    rand = compare(ids.join(F.broadcast(some.select(F.col("unique_id").alias("r"))), F.col("l") < F.col("r")), F.broadcast(some))
    exact = exact_shares(recs, compare is compare_blinded)
    fuzzy = list(FUZZY.values())
    counts = [r.asDict() for r in em.gamma_counts(rand, fuzzy).collect()]
    u = {g: {k: max(em.FLOOR, v) for k, v in sorted(exact[g].items())} for g in LEARNT}
    for g in fuzzy:
        counted = {5, 4, 3} if compare is not compare_blinded else {4}
        shares = em.level_shares([r for r in counts if r[g] not in counted], [g])[g]
        beyond = max(0.0, 1 - sum(exact[g].values()))
        u[g] = dict(sorted((u[g] | {k: max(em.FLOOR, beyond * v) for k, v in shares.items()}).items()))
    if isinstance(scored, DataFrame):
        same = lambda keys: reduce(lambda a, b: a & b, [F.col(f"{k}_l") == F.col(f"{k}_r") for k in keys])
        scored = tuple(scored.filter(same(k)) for k, _ in (AADHAAR, PERSON))
    n, matches, models = recs.count(), 0, []
    for x, (keys, without) in zip(scored, (AADHAAR, PERSON)):
        own = [g for g in LEARNT if g not in without]
        counts = [r.asDict() for r in em.gamma_counts(x, own).collect()]
        if keys == AADHAAR[0]:
            matches = sum(r["n"] for r in counts)
        if counts:
            models.append(em.fit(counts, own, u, 0.5))
    lam = em.prior(matches, n)
    m = em.average(models) if models else {g: dict(u[g]) for g in LEARNT}
    for g, (mm, uu) in FIXED.items():
        m[g], u[g] = dict(mm), dict(uu)
    return m, u, lam


#: Of a scored pair: what later steps read, besides its levels.
ENDS = ["birth_year_l", "birth_year_r", "doc_key_l", "doc_key_r"]


def score(recs: DataFrame, m: dict, u: dict, lam: float, codes: dict[str, DataFrame] | None = None) -> DataFrame:
    """The candidate pairs with a match probability of KEEP at least, with their levels. Candidates are never written nor shuffled:
    each rule's are weighed where its join makes them, and names are compared only of pairs that reach KEEP should they be as similar
    as can be. A rule's shuffle files are deleted before the next one's are written."""
    blinded = codes is not None
    all_ = [*LEARNT, *FIXED]
    table = em.bits(all_, m, u)
    x = recs.drop("record_id")
    tops = (("name_first", "gamma_first_name", 4 if blinded else 5), ("name_last", "gamma_surname", 4))
    for c, _, _ in tops:
        x = x.join(small(keep(frequencies(recs, c).withColumnRenamed("tf", f"{c}_tf"), "tf")), c, "left")
    x = keep(x, "weighed")

    def weight(levels: dict) -> Column:
        w = em.weight(levels, lam)
        for c, g, top in tops:
            # the level is that of equal names, which have one frequency
            w = w + F.coalesce(em.term_adjustment(F.col(g), top, u.get(g, {}).get(top, em.FLOOR), F.col(f"{c}_tf_l"), F.col(f"{c}_tf_l")), F.lit(0.0))
        return w

    def kept(x: DataFrame) -> DataFrame:
        x = x.withColumn("match_weight", weight(table))
        x = x.withColumn("match_probability", em.probability(F.col("match_weight"))).filter(F.col("match_probability") >= KEEP)
        return keep(x.select("l", "r", *ENDS, *all_, "match_weight", "match_probability"), "pairs")

    # a thousandth of a bit for rounding
    least = float(np.log2(KEEP / (1 - KEEP))) - 1e-3
    parts = []
    for pairs in block_rows(x, "unique_id", blocking_rules()):
        may = unsettled(pairs, blinded).filter(weight(best(table, blinded)) >= least)
        if blinded:
            names = [F.when(F.col(f"{c}_l") != F.col(f"{c}_r"), F.col(c + s)).alias(c + s) for c in NAMES for s in ("_l", "_r")]
            parts.append(keep(may.select("l", "r", *ENDS, *all_, *[f"{c}_tf_l" for c, _, _ in tops], *names), "open"))
        else:
            parts.append(kept(compared(may)))
    release(x)
    out = reduce(DataFrame.unionByName, parts)
    if not blinded:
        return out
    pairs = kept(settle(out, codes, list(NAMES)))
    release(out)
    return pairs


def strong(scored: DataFrame) -> DataFrame:
    """Edges of the first pass: likely, with an agreeing identifier, relation, exact birth or overwhelming weight, and neither
    two Aadhaar tokens nor birth years more than ten apart."""
    c = F.col
    sure = (c("match_weight") >= STRONG) | (c("gamma_aadhaar_token") == 1) | (c("gamma_account_token") == 1) | (c("gamma_relation_name") >= 3) | (c("gamma_birth") == 4)
    never = (c("gamma_aadhaar_token") == 0) | F.coalesce(F.abs(c("birth_year_l") - c("birth_year_r")) > YEARS_APART, F.lit(False))
    return scored.filter((c("match_probability") >= ACCEPT) & sure & ~never)


def households(scored: DataFrame, recs: DataFrame, blinded: bool = False) -> DataFrame:
    """(l, r, shared): members of two documents of different registers that share at least two likely members, alike in first
    name, sex and birth band. A member that meets several, over all document pairs, takes none."""
    r = recs.filter("doc_key IS NOT NULL").select("unique_id", "doc_key", "name_first", "skel_first", "sex", "birth_year", "aadhaar_token")
    e = scored.filter(F.col("match_probability") >= HOUSEHOLD_EDGE).select("l", "r", F.col("doc_key_l").alias("a"), F.col("doc_key_r").alias("b"))
    other = F.split_part("a", F.lit(":"), F.lit(1)) != F.split_part("b", F.lit(":"), F.lit(1))
    ld = e.filter(other).groupBy(F.least("a", "b").alias("d1"), F.greatest("a", "b").alias("d2")).agg(F.count_distinct("l").alias("shared")).filter(F.col("shared") >= SHARED)
    side = lambda d, s: r.select(F.col("doc_key").alias(d), *[F.col(c).alias(c + s) for c in r.columns if c != "doc_key"])
    x = ld.join(side("d1", "_l"), "d1").join(side("d2", "_r"), "d2")
    gap = F.abs(F.col("birth_year_l") - F.col("birth_year_r"))
    x = x.filter((F.col("sex_l") == F.col("sex_r")) & (gap.isNull() | (gap <= BAND)) & ~F.coalesce(F.col("aadhaar_token_l") != F.col("aadhaar_token_r"), F.lit(False)))
    same = F.col("skel_first_l") == F.col("skel_first_r")
    if blinded:
        x = x.filter(same)
    else:
        x = x.withColumn("jw", F.when(~same, jaro_winkler("name_first_l", "name_first_r"))).filter(same | (F.col("jw") >= HOUSEHOLD_JW))
    x = keep(x.select(F.col("unique_id_l").alias("l"), F.col("unique_id_r").alias("r"), "shared", "d1", "d2"), "households")
    return once_on_both_sides(x, "l", "r").select("l", "r", "shared")


def model_document(model: dict) -> dict:
    """The model as a document to be written: the prior and, per comparison, its levels with m, u and bits."""
    m, u = model["m"], model["u"]
    bits = lambda g, k: float(np.log2(m[g][k] / max(em.FLOOR, u[g].get(k, em.FLOOR))))
    return {"prior": model["prior"], "prior_bits": model["prior_bits"], "comparisons": [{"comparison": g, "levels": [{"level": k, "m": m[g][k], "u": u[g].get(k, em.FLOOR), "bits": bits(g, k)} for k in sorted(m[g])]} for g in sorted(m)]}


def link(standard: DataFrame, code: str = "R", codes: dict[str, DataFrame] | None = None, household: bool = True) -> tuple[DataFrame, DataFrame, dict]:
    """(pairs, clusters, model) of standard records; a record without partners is its own group, named by the smallest id.
    codes: the name filters of `encode`, whose records these are. household=False leaves the household pass out: the groups of the
    first pass."""
    # the comparison of two records makes methods longer than 8,000 bytes, which the JVM would interpret, were they not cut up
    with tidy(standard.sparkSession, codegen_hugeMethodLimit="8000"):
        blinded = codes is not None
        if blinded:
            codes = {c: keep(x, "codes") for c, x in codes.items()}
        one = keep(standard.select(*COLS), "records")
        recs = keep(own_tokens(one), "recs")
        release(one)
        how = compare_blinded if blinded else compare
        m, u, lam = train(sessions(recs, codes), recs, how, codes=codes)
        pairs = score(recs, m, u, lam, codes)
        more = households(pairs, recs, blinded=blinded)
        first = strong(pairs).select("l", "r")
        edges = first.unionByName(more.select("l", "r")) if household else first
        cc = components(edges, "l", "r")
    c = recs.select("unique_id", "record_id").join(cc.withColumnRenamed("vertex", "unique_id"), "unique_id", "left")
    clusters = c.select("unique_id", "record_id", F.concat(F.lit(code + "-"), F.coalesce("root", "unique_id").cast("string")).alias("cluster_id"))
    out = pairs.select("l", "r", "match_weight", "match_probability", *LEARNT, *FIXED).withColumn("via", F.lit("first_pass"))
    out = out.unionByName(more.select("l", "r").withColumn("via", F.lit("household")), allowMissingColumns=True)
    return out, clusters, {"m": m, "u": u, "prior": lam, "prior_bits": float(np.log2(lam / (1 - lam)))}
