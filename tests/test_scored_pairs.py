import pytest
from pyspark.sql import functions as F

from tallyloom.operators import em
from tallyloom.operators.blocking import block_pairs
from tallyloom.plans import link as L
from tallyloom.plans.relational import DEMO_KEY, delivered_once
from tallyloom.session import keep


@pytest.mark.parametrize("blinded", [False, True])
def test_only_pairs_that_may_match_are_written(spark, folder, monkeypatch, blinded):
    one = keep(delivered_once(spark, folder))
    rows, codes = L.encode(one, DEMO_KEY) if blinded else (one, None)
    written = {}

    def watched(df, name="t"):
        out = keep(df, name)
        if {"l", "r", "match_weight"} <= set(out.columns) or name == "gammas":
            written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(L, "keep", watched)
    pairs, _, model = L.link(rows, codes=codes)
    m, u, lam = (model[k] for k in ("m", "u", "prior"))
    recs = L.own_tokens(L.blind(one, DEMO_KEY) if blinded else rows)
    # every candidate compared and weighed by itself
    x = (L.compare_blinded if blinded else L.compare)(block_pairs(recs, "unique_id", L.blocking_rules()), recs)
    w = em.weight(em.bits([*L.LEARNT, *L.FIXED], m, u), lam)
    for c, g, top in (("name_first", "gamma_first_name", 4 if blinded else 5), ("name_last", "gamma_surname", 4)):
        tf = L.frequencies(recs, c).select(F.col(c).alias(f"{c}_l"), F.col("tf").alias(f"{c}_tf"))
        w, x = w + F.coalesce(em.term_adjustment(F.col(g), top, u[g].get(top, em.FLOOR), F.col(f"{c}_tf"), F.col(f"{c}_tf")), F.lit(0.0)), x.join(tf, f"{c}_l", "left")
    x = x.withColumn("w", w).filter(em.probability(F.col("w")) >= L.KEEP)
    want = {(r["l"], r["r"]): r for r in x.select("l", "r", "w", *L.LEARNT).collect()}
    got = pairs.filter("via = 'first_pass'").collect()
    assert len(got) == len(want) and {(r["l"], r["r"]) for r in got} == set(want)
    for r in got:
        t = want[r["l"], r["r"]]
        assert r["match_weight"] == pytest.approx(t["w"], abs=1e-9) and [r[g] for g in L.LEARNT] == [t[g] for g in L.LEARNT]
    assert written == {"pairs": len(want)}
