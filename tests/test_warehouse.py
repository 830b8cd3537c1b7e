from tallyloom.operators.govern import Role, catalogue
from tallyloom.session import forget, keep, shared_dir
from tallyloom.sources import sinks, tables


def test_districts_make_one_table(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "id int, a string"), spark.createDataFrame([(2, 3.0)], "id int, b double")
    sinks.write_warehouse({"A": a, "B": b}, f"{tmp_path}/w")
    got = sorted((r["id"], r["a"], r["b"], r["district"]) for r in spark.read.parquet(f"{tmp_path}/w").collect())
    assert got == [(1, "x", None, "A"), (2, None, 3.0, "B")]


def test_bucketed_tables_join_without_a_shuffle(spark):
    for n in ("bucketed_l", "bucketed_r"):
        sinks.write_bucketed(spark.range(100).withColumnRenamed("id", "k"), n, ["k"], 4)
    plan = spark.table("bucketed_l").hint("merge").join(spark.table("bucketed_r"), "k")
    assert plan.count() == 100 and "Exchange hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString().split("HashAggregate")[-1]
    for n in ("bucketed_l", "bucketed_r"):
        spark.sql(f"DROP TABLE {n}")


def test_a_log_is_read_whole(spark, tmp_path):
    for n in (1, 2):
        sinks.append_log(spark.createDataFrame([(n,)], "seq int"), f"{tmp_path}/log")
    assert sorted(r["seq"] for r in tables.read_log(spark, f"{tmp_path}/log").collect()) == [1, 2]


def test_kept_tables_are_deleted(spark):
    import os

    keep(spark.range(3), "forgotten")
    folder = shared_dir(spark).removeprefix("file:") + "/tables"
    assert any(f.startswith("forgotten-") for f in os.listdir(folder))
    assert forget(spark) >= 1 and not any(f.startswith("forgotten-") for f in os.listdir(folder))


def test_roles_are_listed(spark):
    got = catalogue(spark, [Role("officer", blocks=("A",), people=True), Role("reader")]).collect()
    assert [(r["name"], r["blocks"], r["people"], r["min_cell"]) for r in got] == [("officer", ["A"], True, 10), ("reader", None, False, 10)]
