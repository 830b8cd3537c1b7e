from tallyloom.operators.blocking import block_pairs
from tallyloom.operators.chain import checked, digest
from tallyloom.operators.components import components
from tallyloom.plans.link import own_tokens
from pyspark.sql import functions as F


def test_a_filler_is_nobodys_number(spark):
    # a number beside forty given names, one of a person in two spellings, a null one
    rows = [(i, "000011112222", f"s{i}", "a") for i in range(40)] + [(100, "1", "kml", None), (101, "1", "kmr", None), (102, None, "kml", None)]
    df = spark.createDataFrame(rows, "unique_id long, aadhaar_token string, skel_first string, account_token string")
    got = {r["unique_id"]: r["aadhaar_token"] for r in own_tokens(df).collect()}
    assert len(got) == 43 and got[100] == got[101] == "1" and got[102] is None and {got[i] for i in range(40)} == {None}
    # the account stands beside forty names as well
    assert own_tokens(df).filter("account_token IS NOT NULL").count() == 0
    assert own_tokens(df.limit(0)).count() == 0


def test_tiles_and_bands_make_the_same_pairs(spark):
    rows = [(i, "hot" if i % 3 else None, i * 7 % 31 if i % 10 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, k string, y int")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] and a[1] == b[1] and None not in (a[2], b[2]) and abs(a[2] - b[2]) <= 3}
    for tile in (5, 40, 1000):
        got = [tuple(r) for r in block_pairs(df, "id", [(["k"], None, ("y", 3))], tile).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        every = {tuple(r) for r in block_pairs(df, "id", [(["k"], F.col("x.y") == F.col("y.y")), (["k"], None)], tile).collect()}
        assert every == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] and a[1] == b[1]}
    assert block_pairs(df.limit(0), "id", [(["k"], None)]).count() == 0


def test_components_of_a_hub_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (7, None), (1000, 1020)]
    got = {r["vertex"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(200)}, **{i: 1000 for i in range(1000, 1041)}}


def test_chain_finds_gaps_and_changes(spark):
    import hashlib
    import json

    rows, prev = [], "0" * 64
    for n in range(1, 8):
        own = hashlib.sha256(json.dumps([str(n), f"e{n}"], ensure_ascii=False).encode()).hexdigest()
        rows.append((n, f"e{n}", prev, own))
        prev = own
    log = spark.createDataFrame(rows, "n long, what string, prev string, own string")
    tell = lambda x: {r["n"]: r["reason"] for r in checked(x, "n", "prev", "own", ["n", "what"]).collect() if r["reason"]}
    assert tell(log) == {}
    assert tell(log.filter("n <> 4")) == {5: "chain broken"}
    assert tell(log.filter("n > 1")) == {2: "chain broken"}
    assert tell(log.withColumn("what", F.when(F.col("n") == 6, "x").otherwise(F.col("what")))) == {6: "entry altered"}
    assert tell(log.limit(0)) == {}
