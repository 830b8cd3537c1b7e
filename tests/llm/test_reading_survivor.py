from datetime import date, datetime

import numpy as np
import pytest

from tallyloom.llm import reading as R
from tallyloom.llm import survivor as S


@pytest.mark.parametrize("w,n", [("cat", 1), ("table", 2), ("made", 1), ("wanted", 2), ("jumped", 1), ("reconciliation", 6), ("the", 1), ("people", 2), ("घर", 1), ("कमला", 3), ("विद्यालय", 4), ("नमस्ते", 3)])
def test_syllables(w, n):
    assert abs(R.syllables(w) - n) <= (w in ("reconciliation", "विद्यालय"))


def test_counts_skip_forms_and_nothing():
    w = R.Words()
    for t in (None, "", " \n\t", "123 456", "Name: Ram\nAge: 45\nWard: 3", "नाम: राम\nआयु: ४५"):
        assert w.count(t) is None
    words, sentences, *_ = w.count("The boy went home. He was tired! Was he?")[0]
    assert (words, sentences) == (9, 2)  # a sentence has three words at least
    assert w.count("<b>The boy</b> &amp; the girl went")[0][0] == 5
    assert w.count("word " * 20000)[0][0] == 20000
    assert w.count("ＴＨＥ ＢＯＹ ＳＡＴ")[0][2] == 9


def test_levels_rank_hard_above_easy(spark):
    easy = ["The boy fed the cow today.", "We took the bus then.", "My mother made tea at noon and she sat.", "He lost the card."]
    hard = [
        "Consequent upon the reconciliation of departmental databases, responsibility for the unauthorised disbursement has been provisionally attributed to inadequate supervision.",
        "The competent authority is requested to reconsider the eligibility determination and communicate its decision expeditiously notwithstanding contradictory correspondence.",
    ]
    docs = [(i, easy[i % 4] + " " + easy[(i * 3 + 1) % 4] if i % 2 else hard[i // 2 % 2] + " " + hard[(i // 2 + 1) % 2], "x") for i in range(80)] + [(100, None, "x"), (101, " ", "x"), (102, hard[0] * 2000, "x"), (1, easy[0], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, level string")
    labels = spark.createDataFrame([(i, 1 if i % 2 else 5) for i in range(0, 60)] + [(None, 1), (3, None), (999, 2)], "doc_id long, grade int")
    got = {}
    for r in R.reading_levels(df, labels).collect():
        got.setdefault(r["doc_id"], []).append(r["level"])
    assert sum(map(len, got.values())) == len(docs) and got[100] == [None] == got[101]
    assert all((got[i][0] >= R.DEMANDING) == (i % 2 == 0) for i in range(60, 80)) and got[102][0] >= R.DEMANDING
    # without ratings the formulas stand on their published bands
    bare = R.reading_levels(df, labels.limit(0)).filter("level IS NOT NULL")
    assert bare.count() == R.reading_levels(df, labels).filter("level IS NOT NULL").count() and bare.filter("level NOT BETWEEN 1 AND 5").count() == 0
    assert R.reading_levels(df.limit(0), labels).count() == 0


def test_posterior_of_groups():
    score = np.array([0.0, 0.0, 5.0, -5.0])
    p = S.posterior(score, np.array([0, 0, 1, 1]), True)
    assert np.allclose(p[:2], 1 / 3) and p[2] > 0.99 and p[3] < 0.01
    assert np.allclose(S.posterior(score, np.array([0, 0, 1, 1]), False)[2], 1 / (1 + np.exp(-5)))
    assert len(S.posterior(np.empty(0), np.empty(0, int), True)) == 0


def test_facts_of_claims():
    f = S.Facts(["a", "b"])
    day = (date(1950, 3, 7) - date(1970, 1, 1)).days
    got = {d: (k, p) for d, k, p in f.of([("a", day, None, 20000), ("b", None, 1950, 20000), ("z", day, None, 0)])}
    assert got[date(1950, 3, 7)] == (S.PLAIN * 2, (0, S.SAME))
    assert got[date(1950, 7, 3)][0] == S.SWAP * 2 and date(1960, 3, 7) in got
    assert f.of([]) == []


def test_survivors(spark):
    at = datetime(2024, 1, 1)
    rec, std, k = [], [], 0
    for c in range(120):
        true = datetime(1940 + c % 40, 3, 5 + c % 20)
        wrong = datetime(1900, 1, 2)
        for reg, d in (("good", true), ("bad", true if c % 3 else wrong), ("age", None)):
            std.append((k, f"{reg}:{c}", reg, d, true.year, d is not None, at, "x"))
            rec.append((k, f"c{c}"))
            k += 1
    std += [(k, "bad:x", "bad", None, 1950, False, at, "x"), (k + 1, "bad:y", "bad", None, None, False, None, "x"), (k + 2, "?", None, datetime(1950, 2, 3), 1950, True, at, "x")]
    rec += [(k, "only-age"), (k + 1, "nothing"), (k + 2, "no-register"), (None, "c0"), (k, None), (99999, "gone")]
    s = spark.createDataFrame(std, "unique_id long, record_id string, register string, birth_date timestamp, birth_year long, birth_exact boolean, loaded_at timestamp, cluster_id string")
    c = spark.createDataFrame(rec, "unique_id long, cluster_id string")
    info = spark.createDataFrame([("good", 3), ("bad", 1), ("age", None)], "register string, trust int")
    got = {r["cluster_id"]: r for r in S.survivors(s, c, info).collect()}
    assert set(got) == {*(f"c{i}" for i in range(120)), "only-age", "nothing", "no-register"}
    for i in range(120):
        r = got[f"c{i}"]
        assert r["birth_date"] == date(1940 + i % 40, 3, 5 + i % 20) and r["several"] and r["birth_exact"] and r["dates"][:1] == [r["birth_date"]]
    assert got["only-age"]["birth_year"] == 1950 and not got["only-age"]["birth_exact"] and not got["only-age"]["several"]
    assert got["nothing"]["birth_year"] is None and got["no-register"]["birth_date"] is None
    assert S.survivors(s.limit(0), c, info).count() == 0 == S.survivors(s, c.limit(0), info).count()
    assert S.survivors(s, c, info.limit(0)).filter("birth_exact").count() == 0


def test_retained_values_tell_fillers_and_slips_from_own_numbers(spark):
    std, rec, k = [], [], 0
    for c in range(200):
        for reg in ("good", "bad", "age"):
            v = f"own{c}"
            if reg == "bad" and c % 5 == 0:
                v = f"slip{c}"
            if reg == "age" and c % 4 == 0:
                v = "filler"
            std.append((k, reg, v, "x"))
            rec.append((k, f"c{c}"))
            k += 1
    std += [(k, "good", None, "x"), (k + 1, None, "v", "x"), (k + 2, "other", "v", "x")]
    rec += [(k, "a"), (k + 1, "b"), (k + 2, "c"), (0, None)]
    s = spark.createDataFrame(std, "unique_id long, register string, aadhaar_token string, value string")
    c = spark.createDataFrame(rec, "unique_id long, cluster_id string")
    info = spark.createDataFrame([("good", 3), ("bad", 1), ("age", None)], "register string, trust int")
    got = {(r["cluster_id"], r["value"]): r["retained"] for r in S.retained_values(s, c, info).collect()}
    assert len(got) == 200 + 40 + 50
    # a number that one register states and two deny (every twentieth group) may go either way
    assert all(got[f"c{i}", f"own{i}"] for i in range(200) if i % 20) and not any(v for (_, t), v in got.items() if t == "filler")
    assert S.retained_values(s.limit(0), c, info).count() == 0 == S.retained_values(s, c, info.limit(0)).count()


def test_scales_are_monotone_and_forms_are_told():
    import numpy as np

    x, y = R.monotone(np.array([3.0, 1.0, 2.0, 4.0]), np.array([2.0, 1.0, 3.0, 5.0]))
    assert list(y) == [1.0, 2.5, 5.0] and np.interp(2.5, x, y) <= 2.5
    assert R.is_field("Name: Ram Lal") and R.is_field(" Date : ") and not R.is_field("Name: one two three") and not R.is_field("one two three: x") and not R.is_field("no colon")
    # a long line is read whole: its tail makes it no field
    assert not R.is_field("Name: " + "x " * 500)
