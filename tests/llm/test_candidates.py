import math

from tallyloom.llm import entities as N2


def test_an_attribute_of_many_records_counts_once_whatever_its_size(spark):
    """Pairs of a block of 151 or more weigh the sum over their shared attributes of log2(n/df), and none is missing."""
    rows = [(i, "xy"[i % 2], ["ramat", "sunil"] if i % 5 else ["ramat"], ["gopal"], 7, "kasipur", 1960 + i % 3, None, None, None) for i in range(170)]
    p = spark.createDataFrame(rows, "id long, src string, toks array<string>, rtoks array<string>, unit int, blk string, byear int, aadhaar string, account string, mobile string")
    a = N2.attributes(p)
    keys = {r["id"]: set(r["keys"]) for r in a.select("id", "keys").collect()}
    df = {}
    for ks in keys.values():
        for k in ks:
            df[k] = df.get(k, 0) + 1
    assert max(df.values()) > 150
    want = {}
    for x in keys:
        for y in keys:
            if x < y and (x - y) % 2 and keys[x] & keys[y]:
                want[x, y] = sum(math.log2(170 / df[k]) for k in keys[x] & keys[y])
    for got in (N2.candidates(a), N2.candidates(a, 7)):
        got = {(r["l"], r["r"]): r["w"] for r in got.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
