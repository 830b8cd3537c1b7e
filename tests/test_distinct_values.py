import random

from tallyloom.functions.text import jaro_winkler
from tallyloom.operators.blocking import near_misses
from tallyloom.plans.queries import QUERIES


def below_python(df):
    """The part of the optimized plan below its first Python evaluation."""
    return df._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython")[1]


def near(x, y):
    gap = None if None in (x[4], y[4]) else abs(x[4] - y[4])
    if x[1] is None or x[1] != y[1] or x[0] == y[0] or None in (x[2], y[2]):
        return False
    return (x[2] == y[2] and (gap or 0) <= 5) or (x[2][0] == y[2][0] and gap is not None and gap <= 2 and None not in (x[3], y[3]) and jaro_winkler(x[3], y[3]) >= 0.88)


def test_near_misses_compare_values_not_rows(spark):
    r = random.Random(5)
    one = lambda n: [(r.randrange(n), r.choice(["p", "q", None]), r.choice(["abc", "abd", "xy", None]), r.choice(["martha", "marhta", "jones", None]), r.choice([None, *range(1900, 2000, 3)])) for _ in range(n)]
    kind = "id int, k string, e string, x string, y int"
    for n in (3, 12, 60):
        a, b = one(n), one(n)
        left, right = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)
        out = near_misses(left, right, "id", ["k"], "e", "x", "y", 5)
        assert sorted(t["id"] for t in out.collect()) == sorted({x[0] for x in a if any(near(x, y) for y in b)})
    below = below_python(out)
    # both sides of the join are reduced to their values
    assert "Aggregate" in below.split("Join", 1)[1]


def test_near_miss_anti_compares_values_and_is_the_rest(spark, folder):
    anti, semi = QUERIES["near_miss_anti"](spark, folder), QUERIES["near_miss_semi"](spark, folder)
    assert "Aggregate" in below_python(anti).split("Join", 1)[1]
    assert anti.intersect(semi).count() == 0 and anti.count() + semi.count() == spark.read.parquet(f"{folder}/part.parquet").count()


def test_gamma_vectors_compare_two_names_once(spark, folder):
    assert "Aggregate" in below_python(QUERIES["gamma_vectors"](spark, folder)).split("Join")[0]
