import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import aggregates as A
from tallyloom.operators import em
from tallyloom.operators.blocking import block_pairs, levels, near_misses
from tallyloom.operators.components import components
from tallyloom.operators.govern import GovernedSession, Refused, Role
from tallyloom.operators.keyed_totals import heavy_keys, keyed_totals
from tallyloom.sources import sinks, tables
from tallyloom.streaming.events import hourly, run_once, stream


def test_keyed_totals_against_a_count(spark):
    r = random.Random(1)
    rows = [(r.choice([None, "", "hot", "hot", "hot", f"k{r.randint(0, 50)}", "क"]), r.choice(["x", None]), r.choice([None, 1, 2**40]), r.random() < 0.5, "clash") for _ in range(3000)]
    df = spark.createDataFrame(rows, "a string, b string, m long, f boolean, field string").repartition(7)
    got = {(x["field"], x["key_value"]): (x["n"], x["sum_m"], x["n_m"], x["sum_f"]) for x in keyed_totals(df, ["a", "b"], ["m", "f"]).collect()}
    want = {}
    for a, b, m, f, _ in rows:
        for k in (("a", a), ("b", b)):
            if k[1] is not None:
                n, s, c, t = want.get(k, (0, 0, 0, 0))
                want[k] = (n + 1, s + (m or 0), c + (m is not None), t + f)
    assert got == want
    assert {(x["field"], x["key_value"]) for x in heavy_keys(df, ["a", "b"], 0.3).collect()} == {("a", "hot"), ("b", "x")}
    assert keyed_totals(df.limit(0), ["a"], ["m"]).count() == 0 == heavy_keys(df.limit(0), ["a"]).count()


def test_heavy_share_is_inclusive(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), (None,)], "k string")
    assert {r["key_value"] for r in heavy_keys(df, ["k"], 0.5).collect()} == {"a", "b"}


def test_most_common_takes_the_smaller_of_equals(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c"), (2, "c"), (3, None)], "k int, v string")
    assert {tuple(r) for r in A.most_common(df, "k", "v").collect()} == {(1, "a", 1), (2, "c", 2)}


def test_once_on_both_sides_counts_all_pairs(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (4, 5), (6, 3)], "l int, r int")
    assert [tuple(r) for r in A.once_on_both_sides(df, "l", "r").collect()] == [(4, 5)]


def test_components_of_random_graphs(spark):
    for seed in range(3):
        r = random.Random(seed)
        edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(None, 3), (5, 5)]
        up = {}

        def find(x):
            up.setdefault(x, x)
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            if a is not None and a != b:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
        got = {tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
        assert got == {(v, find(v)) for v in list(up)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_levels_and_blocking(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, None), (None, None)], "a int, b int")
    got = [r[0] for r in df.select(levels(F.col("a").isNull(), F.col("a") == F.col("b"), F.col("b") > 1)).collect()]
    assert got == [2, 1, 0, -1]
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "a", 9), (4, None, 1), (5, None, 1)], "id int, k string, y int")
    pairs = block_pairs(df, "id", [(["k"], F.abs(F.col("x.y") - F.col("y.y")) <= 2), (["k"], F.abs(F.col("x.y") - F.col("y.y")) <= 1)])
    assert [tuple(r) for r in pairs.collect()] == [(1, 2)]


def test_near_misses_pass_unknown_years(spark):
    df = spark.createDataFrame([(1, "p", "abc", "t", 1950), (2, "p", "abc", "t", None), (3, "p", "abd", "t", 1960), (4, "q", "abc", "t", 1950)], "id int, k string, e string, x string, y int")
    got = {r["id"] for r in near_misses(df, df, "id", ["k"], "e", "x", "y", 5).collect()}
    assert got == {1, 2}


def test_em_finds_the_matching_share():
    r = random.Random(3)
    counts = Counter()
    for _ in range(4000):
        match = r.random() < 0.2
        counts[tuple(int(r.random() < (0.9 if match else 0.1)) for _ in range(4))] += 1
    rows = [{**{f"g{i}": x for i, x in enumerate(k)}, "n": n} for k, n in counts.items()]
    g = [f"g{i}" for i in range(4)]
    u = {x: {0: 0.9, 1: 0.1} for x in g}
    m = em.fit(rows, g, u, 0.3, rounds=100)
    assert all(abs(m[x][1] - 0.9) < 0.08 for x in g)
    assert em.prior(0, 1) == 0.5 and 0 < em.prior(10, 100) < 0.01


def test_roles(spark):
    df = spark.createDataFrame([("A", "x ", 1), ("A", "Y", 2), ("B", "x", 3)], "district string, block string, v int")
    g = GovernedSession(spark, {"t": df, "u": df.select("v")}, Role("r", districts=("A",), blocks=("X",), min_cell=2))
    assert g.scoped("t").count() == 1 and g.refused("t") == 2
    assert [tuple(r) for r in g.totals("t", ["district"], {"s": "v"}).collect()] == [("A", None, None)]
    with pytest.raises(Refused):
        g.scoped("u")
    with pytest.raises(Refused):
        g.page("t", {}, ["v"])


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "u.csv"
    p.write_text('﻿Name,Age\n"A, B",1\nC,\n', encoding="utf-8")
    assert tables.csv_upload(spark, str(p)).columns == ["Name", "Age"]
    assert tables.csv_upload(spark, str(p), 1).count() == 1
    got = [r["Age"] for r in tables.csv_table(spark, str(p), "Name string, Age int").collect()]
    assert got == [1, None]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, district string")
    sinks.write_parquet(df, str(tmp_path / "w/d.parquet"), ["district"])
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    assert [f.rsplit("/", 1)[1] for f in tables.folders_with(spark, str(tmp_path), "d.parquet")] == ["w"]
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_json({"a": 1}, str(tmp_path / "j.json"))
    assert tables.json_document(spark, str(tmp_path / "j.json")).first()["a"] == 1
    assert [r["unique_id"] for r in tables.with_ordinal(df, ["v"]).orderBy("v").collect()] == [0, 1]


def test_a_stream_gives_the_rows_of_the_table(spark, folder, tmp_path):
    e = tables.table(spark, folder, "events")
    src = str(tmp_path / "src")
    e.repartition(3).write.parquet(src)
    run_once(hourly(stream(spark, src, 3), "400 days").select("hour", "event_type", "n"), str(tmp_path / "cp"), str(tmp_path / "out"))
    # the watermark trails the last event, so hours within it stay open
    assert spark.read.parquet(str(tmp_path / "out")).count() <= hourly(e).count()
