import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import encode as E
from tallyloom.llm import pack as P


@pytest.fixture(scope="module")
def enc():
    return E.encoding(E.TOKENIZERS, E.NAME)


def ids(c, texts):
    flat, ends = c(texts)
    return [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=80), st.text(" \n\t\r  \x1c\x85a'sél9क्षि!‍😀", max_size=80)), max_size=5), st.sampled_from([2, 4, 32]))
def test_ids_are_those_of_the_whole_text(enc, texts, mean):
    c = E.ChunkEncoder(enc, mean)
    for _ in range(2):
        assert ids(c, texts) == [enc.encode_ordinary(t) if t else [] for t in texts]


def test_reuse_and_eviction(enc):
    r = random.Random(0)
    words = ["pension", " card", " of  the", "\nward", "’s don't", " हुकीखेत", " 12345", ".", " <|endoftext|>", "   "]
    texts = ["".join(r.choice(words) for _ in range(400)) for _ in range(60)]
    c = E.ChunkEncoder(enc, 16, most=3000)
    for i in range(0, 60, 7):
        assert ids(c, texts[i : i + 7]) == [enc.encode_ordinary(t) for t in texts[i : i + 7]]
    a, b = E.cuts(texts[0]), E.cuts("moved " + texts[0])
    # borders move with the text
    assert set((a + 6).tolist()) <= set(b.tolist()) | set(range(30))


def test_encode_corpus(spark, enc):
    long = "नाम Kamla, ward 12.\n" * 4000
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, " ", 5), (4, long, 5), (4, long, 5), (None, "a", 5)], "doc_id long, text string, ids int")
    out = E.encode_corpus(df)
    assert out.columns == ["doc_id", "ids"] and out.count() == 6
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert got[1] == [] == got[2] and got[3] == enc.encode_ordinary(" ") and got[4] == enc.encode_ordinary(long) and got[None] == enc.encode_ordinary("a")
    assert enc.decode(got[4]) == long
    n = {r["doc_id"]: r["n"] for r in E.encode_corpus(df, out="n", lengths_only=True).collect()}
    assert n[4] == len(got[4]) and n[1] == 0
    assert E.encode_corpus(df.limit(0)).count() == 0


def test_place_puts_every_item_once_and_fills_well():
    r = random.Random(1)
    for cap in (10, 100, 2048):
        h = {s: r.randint(0, 400) for s in range(1, cap + 1) if r.random() < 0.5}
        out, made = P.place(h, cap)
        fill = np.zeros(made, int)
        seen = {}
        for s, rank, n, first in out:
            assert rank == seen.get(s, 0)
            seen[s] = rank + n
            fill[first : first + n] += s
        assert seen == {s: n for s, n in h.items() if n} and fill.max(initial=0) <= cap and (fill > 0).all()
        total = sum(s * n for s, n in h.items())
        assert made <= 1.2 * -(-total // cap) + sum(n for s, n in h.items() if s > cap // 2)
    assert P.place({}, 10) == ([], 0)


def test_fill_containers(spark):
    r = random.Random(4)
    rows = [(i, r.choice([0, 0, 1, 3, 3, 3, 7, 10, 25, None])) for i in range(500)] + [(1, 3), (None, 7), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int").withColumn("size", F.lit("clash"))
    got = P.fill_containers(df, capacity=10).collect()
    fill, pieces = {}, {}
    for x in got:
        if x["size"]:
            fill[x["container"]] = fill.get(x["container"], 0) + x["size"]
        else:
            assert x["container"] is None
        pieces.setdefault(x["doc_id"], []).append((x["piece"], x["size"]))
    total = sum(n or 0 for _, n in rows)
    assert max(fill.values()) <= 10 and sum(fill.values()) == total and len(fill) <= 1.1 * total / 10 + 1
    assert sorted(fill) == list(range(len(fill)))
    for i, n in rows[:500]:
        if i != 1:
            assert sorted(pieces[i]) == [(k, min(10, (n or 0) - 10 * k)) for k in range(max(1, -(-(n or 0) // 10)))]
    assert P.fill_containers(df.limit(0)).count() == 0
