import pytest
from pyspark.sql import functions as F

from tallyloom.operators import em
from tallyloom.operators.blocking import block_pairs
from tallyloom.plans import link as L


@pytest.mark.parametrize("blinded", [False, True])
def test_chance_of_equalities_is_that_of_all_pairs(spark, folder, blinded):
    """However small the sample, u of a level that is an equality is its share among all pairs of records."""
    x = spark.read.parquet(f"{folder}/standard.parquet").orderBy("unique_id").limit(250)
    # compound first names, so that this level occurs
    x = x.withColumns({"name_middle": F.when(F.col("unique_id") % 3 == 0, F.lit("dev")).otherwise(F.col("name_middle")), "name_first": F.when(F.col("unique_id") % 7 == 0, F.lit("ramdev")).when(F.col("unique_id") % 5 == 0, F.lit("ram")).otherwise(F.col("name_first"))})
    x = (L.blind(x, b"k" * 32) if blinded else x).cache()
    recs = x.select(*L.COLS, *[f"{c}_clk" for c in L.NAMES if blinded])
    how = L.compare_blinded if blinded else L.compare
    pairs = how(block_pairs(recs.withColumn("one", F.lit(1)), "unique_id", [(["one"], None)]), recs).cache()
    want = em.level_shares([r.asDict() for r in em.gamma_counts(pairs, L.LEARNT).collect()], L.LEARNT)
    _, u, _ = L.train(pairs, recs, how, sample=30)
    whole = {g for g in L.LEARNT if "name" not in g} | {"gamma_middle"}
    for g in L.LEARNT:
        for k, v in want[g].items():
            if g in whole or k >= (4 if blinded else 3):
                assert u[g][k] == pytest.approx(v, rel=1e-9), (g, k)
        assert not want[g] or sum(u[g].values()) == pytest.approx(1, abs=1e-4)
