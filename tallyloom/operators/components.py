"""Connected components of an edge table, in DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import keep, release


def forest(edges: DataFrame) -> DataFrame:
    """The edges (a, b) without those that close a circle within their partition: union-find over each partition, which keeps
    as many edges as it has vertices at most, so that a hub's edges shrink before anything is shuffled by vertex."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(v):
            while (p := up.get(v, v)) != v:
                up[v] = up.get(p, p)
                v = p
            return v

        for b in batches:
            out: tuple[list, list] = ([], [])
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p, q = root(x), root(y)
                if p != q:
                    up[max(p, q)] = min(p, q)
                    out[0].append(x)
                    out[1].append(y)
            yield pa.record_batch([pa.array(out[0], b.schema.field(0).type), pa.array(out[1], b.schema.field(1).type)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, f"a {kind}, b {kind}")


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(vertex, root) of all vertices of non-loop edges: root is the smallest vertex of the component.

    Large-star and small-star alternate, each a minimum per vertex that is combined before its shuffle, until nothing
    changes. Each round is written to the shared folder, where the one before is deleted. Null ends link nothing.
    """
    e = keep(forest(edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).filter("a <> b")).distinct(), "cc")
    start = e

    def star(x: DataFrame, only_larger: bool) -> DataFrame:
        # every vertex u with its neighbours; the least of them and itself becomes the centre of those larger than u, or of all smaller ones
        both = x.select("a", "b").unionByName(x.select(F.col("b").alias("a"), F.col("a").alias("b"))) if only_larger else x
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        j = both.join(low, "a")
        if only_larger:
            return j.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        own = low.filter("m < a").select("a", F.col("m").alias("b"))
        return j.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).distinct()

    # exceptAll both ways would shuffle twice; two rounds are equal if their sizes and hashes are
    sign = lambda x: x.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    before = sign(e)
    while True:
        last, e = e, keep(star(star(e, True), False), "cc")
        now = sign(e)
        if last is not start:
            release(last)
        if now == before:
            break
        before = now
    every = start.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
    return every.join(e.select(F.col("a").alias("vertex"), F.col("b").alias("root")), "vertex", "left").select("vertex", F.coalesce("root", "vertex").alias("root"))
