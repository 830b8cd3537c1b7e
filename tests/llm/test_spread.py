import glob
import math
import random

from tallyloom.llm import entities as N2
from tallyloom.session import shared_dir


def spread(pairs, rounds):
    """The rounds, pair by pair: (l, r, src_l, src_r, doc_l, doc_r, s0) -> log odds."""
    s = {(x[0], x[1]): x[6] for x in pairs}
    for k in range(rounds):
        p = {e: 1 / (1 + math.exp(-v)) for e, v in s.items()}
        likely = {**{e: v for e, v in p.items() if v >= 0.5}, **{e[::-1]: v for e, v in p.items() if v >= 0.5}}
        up = {}
        for l, r, _, _, dl, dr, s0 in pairs:
            house = sum(p[x[0], x[1]] for x in pairs if dl and dr and x[4:6] == (dl, dr) and (x[0], x[1]) != (l, r) and p[x[0], x[1]] >= 0.5)
            third = max((min(likely[l, t], likely[r, t]) for v, t in likely if v == l and (r, t) in likely), default=0)
            up[l, r] = s0 + 1.8 * min(house, 2) + 2.5 * third
        new = {}
        for l, r, sl, sr, *_ in pairs:
            best = max(up[x[0], x[1]] for x in pairs if (x[0], x[3]) == (l, sr) or (x[1], x[2]) == (r, sl))
            new[l, r] = up[l, r] - min(0.7 * max(best - up[l, r] - 1, 0), 8)
        now = {e: s[e] + (new[e] - s[e]) * min(1, 2 / (k + 1)) for e in s}
        turned = any((now[e] >= 0) != (s[e] >= 0) for e in s)
        s = now
        if not turned:
            break
    return s, k + 1


def test_spread_is_that_of_the_pairs_one_by_one_and_leaves_one_table(spark):
    """Households, third records and rivals, with and without documents; the tables of earlier rounds are deleted."""
    rnd = random.Random(3)
    src = {i: "abcd"[i % 4] for i in range(60)}
    doc = {i: f"{src[i]}{i // 12}" if src[i] in "bc" else None for i in src}
    pairs = sorted({(l, r) for l, r in ((rnd.randrange(60), rnd.randrange(60)) for _ in range(700)) if l < r and src[l] != src[r]})
    pairs = [(l, r, src[l], src[r], doc[l], doc[r], rnd.uniform(-6, 5)) for l, r in pairs]
    df = spark.createDataFrame(pairs, "l long, r long, src_l string, src_r string, doc_l string, doc_r string, s0 double")
    want, rounds = spread(pairs, N2.ROUNDS)
    assert rounds > 2 and any(dl and dr for _, _, _, _, dl, dr, _ in pairs)
    tables = lambda: set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/tables/scored-*"))
    before = tables()
    got = {(x["l"], x["r"]): x["s"] for x in N2.spread(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-6 for e in want)
    assert len(tables() - before) == 1
