import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import dates, masks, tokens
from tallyloom.operators import chain


def one(spark, c, *values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")
    return [r["x"] for r in df.select("i", c(F.col("v")).alias("x")).orderBy("i").collect()]


def test_tokens_equal_hmac(spark):
    for key in (b"k", b"long" * 40):
        got = one(spark, lambda v: tokens.token(v, key), "123412341234", "बल", "", None)
        want = [hmac.new(key, x.encode(), hashlib.sha256).hexdigest()[:20] for x in ("123412341234", "बल")]
        assert got == [*want, None, None]


def test_a_missing_key_is_refused(monkeypatch):
    monkeypatch.delenv("NO_SUCH_KEY", raising=False)
    with pytest.raises(RuntimeError):
        tokens.key("NO_SUCH_KEY")


def test_clk_and_dice(spark):
    df = spark.createDataFrame([("kamla", "kamla"), ("kamla", "kamala"), ("kamla", "zyx")], "a string, b string")
    got = [r["d"] for r in df.select(tokens.dice(tokens.clk(F.col("a"), b"k", "f"), tokens.clk(F.col("b"), b"k", "f")).alias("d")).collect()]
    assert got[0] == 1.0 and got[0] > got[1] > 0.6 > got[2]
    bits = one(spark, lambda v: tokens.clk(v, b"k", "f"), "ab")[0]

    def brute(s):
        out = 0
        for g in {f"_{s}_"[i : i + 2] for i in range(len(s) + 1)}:
            h = [int.from_bytes(hmac.new(b"k", (n + "f" + g).encode(), hashlib.sha256).digest()[:8], "big") for n in "12"]
            for i in range(20):
                out |= 1 << (h[0] + i * h[1]) % 1024
        return out

    assert sum((b & (2**64 - 1)) << 64 * i for i, b in enumerate(bits)) == brute("ab")


def test_masks(spark):
    assert one(spark, masks.mask_name, "Kamla Devi Bisht", "", None, " A ") == ["K•••• D••• B••••", "", None, "A••"]
    assert one(spark, masks.mask_number, "234567891234", "123", None, "nan") == ["••••••••1234", "•••", None, None]
    assert one(spark, masks.mask_date, "12-03-1950", None) == ["••-••-1950", None]
    assert one(spark, masks.mask_digits, "card 123456789012 of 12345", "none", None) == ["card •••••••••012 of 12345", "none", None]
    m = one(spark, lambda v: masks.mask_fields(F.create_map(F.lit("aadhaar"), v, F.lit("member_name"), F.lit("Kamla")), F.lit(False)), "234567891234")[0]
    assert m == {"aadhaar": "••••••••1234", "member_name": "K••••"}
    closed = F.create_map(*[x for k, v in {"udid_no": "UK-123456", "card_no": "12345", "dob": "12-03-1950", "name": "राम सिंह", "aadhaar": "234567891234", "status": "nan"}.items() for x in (F.lit(k), F.lit(v))])
    got = [spark.range(1).select(masks.mask_fields(closed, F.lit(o)).alias("m")).first()["m"] for o in (False, True)]
    assert got[0] == {"udid_no": "•••456", "card_no": "••345", "dob": "••-••-1950", "name": "र•• स•••", "aadhaar": "••••••••1234", "status": None}
    assert got[1] == {"udid_no": "UK-123456", "card_no": "12345", "dob": "12-03-1950", "name": "राम सिंह", "aadhaar": "••••••••1234", "status": None}
    assert one(spark, lambda v: masks.suppress(v, 10), 0, 1, 9, 10, None, kind="int") == [0, None, None, 10, None]


def test_dates(spark):
    assert [str(d) for d in one(spark, dates.parse_day, "31-01-2020", "31-02-2020", "1-2-2020", "", None)] == ["2020-01-31", "None", "None", "None", "None"]
    assert [str(d) for d in one(spark, dates.parse_any, "1/2/1950", "01.02.1950x", "1950-02-01", None)] == ["1950-02-01", "1950-02-01", "None", "None"]
    b = one(spark, lambda v: dates.birth(v, None, None), "01-01-1950", "02-01-1950", "x", None)
    assert [(r["birth_year"], r["birth_exact"], r["age_only"]) for r in b] == [(1950, False, False), (1950, True, False), (None, False, False), (None, False, False)]
    b = one(spark, lambda v: dates.birth(None, F.lit(30), v), "2020", "15-06-2020", "?", None)
    assert [(r["birth_year"], r["age_only"]) for r in b] == [(1990, True), (1990, True), (None, False), (None, False)]


def test_hash_chain_finds_the_altered_entry(spark):
    log = []
    for i in range(5):
        log.append(chain.append(log, {"ts": f"t{i}", "role": "क", "action": 'a"b', "object": "o", "detail": "d\\"}))
    keys = ["seq", "prev_hash", "hash", "ts", "role", "action", "object", "detail"]
    check = lambda rows: chain.verify(spark.createDataFrame([tuple(r[k] for k in keys) for r in rows], "seq int, prev_hash string, hash string, ts string, role string, action string, object string, detail string"), "seq", "prev_hash", "hash", keys[3:]).first()
    assert tuple(check(log)) == (5, None, None)
    log[2] = {**log[2], "detail": "other"}
    assert tuple(check(log)) == (5, 3, "entry altered")
    log[2] = {**log[2], "prev_hash": "x"}
    assert check(log)["reason"] == "chain broken"
    assert chain.latest(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "o string, s int, v string"), "o", "s", "v").first()["v"] == "y"
