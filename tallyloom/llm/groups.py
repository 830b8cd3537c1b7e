"""Problem 6: one group per record from pairwise links, by union-find in edge partitions and merged spanning forests.

Every edge partition runs union-find and keeps a spanning forest only: one row (child, parent) per vertex that isn't the
smallest of its local component. Forests are merged level by level: rows are spread over bounded partitions by their
child, each partition runs union-find over the forests that meet there and keeps a forest again. A vertex with two
parents joins the parents' trees; once no vertex has two, the rows are one rooted forest, parents being smaller than
children, and pointer doubling leads every vertex to its root, the smallest id it reaches. A vertex with any number of
links costs one row per edge partition, so no hot vertex or group is gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.session import keep

#: Edges that one partition of a merge level holds, about; sets the number of partitions.
BOUND = 1_000_000
#: A parent with more than 1/HEAVY of all rows is looked up by a broadcast of at most HEAVY rows.
HEAVY = 64

_FOREST = pa.schema([("child", pa.int64()), ("parent", pa.int64()), ("again", pa.bool_())])
_DDL = "child bigint, parent bigint, again boolean"


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(children, roots): each vertex that isn't the smallest of its component, with that smallest vertex.

    Union-find over whole arrays: roots are hooked under smaller roots, then paths are compressed, until no edge joins
    two trees.
    """
    ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    up, n = np.arange(len(ids)), len(a)
    x, y = code[:n], code[n:]
    while True:
        rx, ry = up[x], up[y]
        open_ = rx != ry
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        rx, ry = rx[open_], ry[open_]
        np.minimum.at(up, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:
            nxt = up[up]
            if (nxt == up).all():
                break
            up = nxt
    child = up != np.arange(len(ids))
    return ids[child], ids[up[child]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spanning forest of a partition; holds a forest and one piece of edges at a time."""
    child = root = np.empty(0, np.int64)
    held: list[pa.RecordBatch] = []
    n, again = 0, False

    def merge() -> None:
        nonlocal child, root, again, n
        a = np.concatenate([h.column(0).to_numpy() for h in held])
        b = np.concatenate([h.column(1).to_numpy() for h in held])
        hi, lo = np.concatenate([child, np.maximum(a, b)]), np.concatenate([root, np.minimum(a, b)])
        if not again:
            edges = np.unique(np.stack([hi, lo]), axis=1)
            again = bool((edges[0, 1:] == edges[0, :-1]).any())
        child, root = spanning_forest(hi, lo)
        held.clear()
        n = 0

    for x in batches:
        if x.num_rows:
            held.append(x)
            n += x.num_rows
        if n >= BOUND:
            merge()
    if held:
        merge()
    if len(child):
        yield pa.record_batch([pa.array(child), pa.array(root), pa.array(np.full(len(child), again))], schema=_FOREST)


def _reps(key: str, vertex: str):
    """Within a split: each member with its group's smallest member there, and one row per group with that member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = [x for x in batches if x.num_rows]
        if not t:
            return
        t = pa.Table.from_batches(t)
        d = t[key].combine_chunks().dictionary_encode()
        v = t[vertex].to_numpy()
        low = np.full(len(d.dictionary), np.iinfo(np.int64).max)
        code = d.indices.to_numpy()
        np.minimum.at(low, code, v)
        other = low[code] != v
        yield pa.record_batch([pa.array(v[other]), pa.array(low[code][other]), pa.nulls(int(other.sum()), pa.string())], names=["a", "b", "grp"])
        yield pa.record_batch([pa.array(low), pa.array(low), d.dictionary.cast(pa.string())], names=["a", "b", "grp"])

    return run


def edges_of_groups(df: DataFrame, key: str, vertex: str) -> DataFrame:
    """The edges (a, b) that join the members of each group: within a split to the smallest there, then across splits.
    A group gives at most one row per split to the exchange. Rows without key or vertex give none."""
    slim = df.select(F.col(key).cast("string").alias(key), F.col(vertex).cast("long").alias(vertex)).dropna()
    both = keep(slim.mapInArrow(_reps(key, vertex), "a bigint, b bigint, grp string"), "reps")
    across = both.filter("grp IS NOT NULL").select("a", F.min("a").over(W.partitionBy("grp")).alias("b"))
    return both.filter("grp IS NULL").select("a", "b").unionByName(across).filter("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex of `edges` (its first two columns, bigint) that has another vertex in its component.

    Edges may repeat, be turned round or point at themselves; those with a null end link nothing. No edges, no rows.
    """
    a, b = edges.columns[:2]
    spark = edges.sparkSession
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    forest = keep(plain.mapInArrow(_local, _DDL), "forest")
    while True:
        n = forest.count()
        if not n:
            return forest.select(F.col("child").alias("vertex"), F.col("parent").alias("root"))
        parts = max(base, -(-n // BOUND))
        forest = keep(forest.select("child", "parent").repartition(parts, "child").mapInArrow(_local, _DDL), "forest")
        if not forest.filter("again").limit(1).count():
            break
    # no partition saw a child with two parents, so each has one: a rooted forest
    up = forest.select("child", "parent")
    n = up.count()
    while True:
        heavy = up.groupBy("parent").count().filter(F.col("count") > n / HEAVY).select("parent")  # fewer than HEAVY rows
        old = up.select(F.col("child").alias("parent"), F.col("parent").alias("top"))
        tops = old.join(F.broadcast(heavy), "parent", "left_semi")
        marked = up.join(F.broadcast(heavy.withColumn("hot", F.lit(True))), "parent", "left")
        hot = marked.filter("hot").drop("hot").join(F.broadcast(tops), "parent", "left")
        cold = marked.filter("hot IS NULL").drop("hot").join(old, "parent", "left")
        nxt = keep(hot.unionByName(cold).select("child", F.coalesce("top", "parent").alias("parent"), F.col("top").isNotNull().alias("moved")), "roots")
        up = nxt.select("child", "parent")
        if not nxt.filter("moved").limit(1).count():
            break
    roots = up.select(F.col("parent").alias("vertex")).distinct()
    return up.select(F.col("child").alias("vertex"), F.col("parent").alias("root")).unionByName(roots.select("vertex", F.col("vertex").alias("root")))


def consolidate(pairs: DataFrame, clusters: DataFrame, least: float = 0.9, sure_via: str = "household") -> DataFrame:
    """(unique_id, group_id) of every record in a group of at least two: group_id is the smallest unique_id reached.

    A pair links if its match_probability is at least `least` or its via is `sure_via`; a pair without one side, or with
    a null probability and another via, links nothing. Members of one non-null cluster_id are linked.
    """
    ok = pairs.filter((F.col("match_probability") >= least) | (F.col("via") == sure_via))
    edges = ok.select(F.col("unique_id_l").alias("a"), F.col("unique_id_r").alias("b")).unionByName(edges_of_groups(clusters, "cluster_id", "unique_id"))
    return components(edges).select(F.col("vertex").alias("unique_id"), F.col("root").alias("group_id"))
