from pyspark.sql import functions as F

from tallyloom.operators.blocking import block_pairs, block_rows
from tallyloom.plans.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_several_rules_come_once_and_are_not_shuffled(spark):
    rows = [(i, "hot" if i % 3 else None, i % 4, i * 7 % 31 if i % 10 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, k string, m int, y int")
    rules = [(["m", "y"], None), (["k", "y"], None), (["k"], F.col("x.m") == F.col("y.m"), ("y", 2)), (["k"], None, ("y", 3)), (["m"], F.col("x.y") < F.col("y.y"))]

    def pair(a, b):
        k, m, y = a[1] is not None and a[1] == b[1], a[2] == b[2], None not in (a[3], b[3])
        return y and ((m and a[3] == b[3]) or (k and abs(a[3] - b[3]) <= 3) or (m and a[3] < b[3]))

    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and pair(a, b))
    for tile in (5, 40, 1000):
        out = block_pairs(df, "id", rules, tile)
        assert sorted(map(tuple, out.collect())) == want
        # a union of joins, with no aggregation of the pairs above it
        assert "Union" in plan(out) and "HashAggregate" not in plan(out).split("Union")[0]
        both = [r for part in block_rows(df, "id", rules, tile) for r in part.collect()]
        assert sorted((r["l"], r["r"]) for r in both) == want and all((r["k_l"], r["m_r"]) == (rows[r["l"]][1], rows[r["r"]][2]) for r in both)


def test_pairs_of_ids_with_several_rows_come_once(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "a")], "id long, k string")
    assert [tuple(r) for r in block_pairs(df, "id", [(["k"], None)]).collect()] == [(1, 2)]


def test_a_side_dealt_out_is_not_broadcast(spark, folder):
    # tables of a few kilobytes, far below the threshold for broadcasts
    for name, joins in (("blocking_pairs", 2), ("gamma_vectors", 1)):
        got = plan(QUERIES[name](spark, folder))
        # the tables of hot keys alone are broadcast, one for each side
        assert got.count("SortMergeJoin") == joins and got.count("BroadcastHashJoin") == 2 * joins
