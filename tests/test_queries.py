import os

import duckdb
import pytest

from tallyloom.plans.queries import ORACLE, QUERIES


def rows(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple("" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, folder, name):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    got, want = QUERIES[name](spark, folder).toPandas(), c.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for k in got.columns:
        if want[k].dtype.kind in "fiu" and got[k].dtype.kind in "fiu":
            got[k], want[k] = got[k].astype(float), want[k].astype(float)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["linkage", "linkage_blinded"])
def test_linkage_gives_every_record_a_group(spark, folder, name):
    out = QUERIES[name](spark, folder)
    n = spark.read.parquet(f"{folder}/standard.parquet").select("record_id").distinct().count()
    assert out.count() == out.select("unique_id").distinct().count() == n
    assert out.select("cluster_id").distinct().count() < n


@pytest.mark.parametrize("name", ["split_names", "place_keys", "bloom_dice", "standardise_registers"])
def test_queries_without_sql_run(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0
