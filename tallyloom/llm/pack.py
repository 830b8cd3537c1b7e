"""Problem 8: filling containers of fixed capacity, by shortest-pack-first over the length histogram.

Only the histogram of sizes (at most `capacity` rows) comes to the driver. It is placed there longest size first: each
size goes to the shortest packs that still have room, all packs with the same filling at once, and opens new packs when
none has. Packs of one pattern are a run of container numbers, so a placement is (size, first rank, number, first
container). Every item then finds its container from its rank among the items of its size. Ranks come from counts per
hash bucket and size, so a size that most items share is ranked in as many tasks as there are buckets.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.session import keep

CAPACITY = 2048


def place(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """([(size, first rank, number, first container)], containers) for {size: items}; sizes from 1 to capacity."""
    heap: list[tuple[int, int, int]] = []  # (filling, first container, number of containers), shortest pack first
    out, made = [], 0
    for size in sorted((s for s, n in histogram.items() if n), reverse=True):
        left, rank, filled = histogram[size], 0, []
        while left and heap and heap[0][0] + size <= capacity:
            fill, first, n = heapq.heappop(heap)
            k = min(n, left)
            out.append((size, rank, k, first))
            filled.append((fill + size, first, k))
            if k < n:
                heapq.heappush(heap, (fill, first + k, n - k))
            left, rank = left - k, rank + k
            # packs that were just filled may take further items of this size once the shorter ones are used up
            if left and not (heap and heap[0][0] + size <= capacity):
                for x in filled:
                    heapq.heappush(heap, x)
                filled = []
        if left:
            per = capacity // size
            # new packs take as many of this size as fit, the last one the rest
            full, rest = divmod(left, per)
            for j in range(per):
                n = full + (j < rest)
                if n:
                    out.append((size, rank, n, made))
                    rank += n
            if full:
                # the first `full` packs hold `per` items; pack `full`, if any, holds `rest`
                heapq.heappush(heap, (per * size, made, full))
            if rest:
                # placements above gave pack number `full` one item in each of the first `rest` rounds
                heapq.heappush(heap, (rest * size, made + full, 1))
            made += full + (rest > 0)
        for x in filled:
            heapq.heappush(heap, x)
    return out, made


def fill_containers(sizes: DataFrame, item: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """(item, piece, size, container): every item in a container, no container above the capacity.

    An item above the capacity is cut into pieces 0, 1, ... of full capacity and a last one of what is left; all others
    are one piece, 0, and stay whole. An item of size 0 or null takes no room: size 0 and a null container. Items with
    one id and equal size are exchangeable; ids may be null. Other columns of `sizes` are ignored. No items, no rows.
    """
    spark = sizes.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    c = F.lit(capacity)
    x = sizes.select(F.col(f"`{item}`").alias("item"), F.greatest(F.coalesce(F.col(f"`{size}`"), F.lit(0)), F.lit(0)).cast("long").alias("n"))
    x = x.select("item", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / c) - 1, F.lit(0)).cast("long"))).alias("piece"))
    x = x.select("item", F.col("piece").cast("int").alias("piece"), F.least(c, F.col("n") - F.col("piece") * c).cast("int").alias("size"))
    x = keep(x.withColumn("bucket", F.pmod(F.xxhash64("item", "piece"), F.lit(buckets)).cast("int")), "pieces")
    counts = keep(x.filter("size > 0").groupBy("size", "bucket").count(), "counts")
    # at most `capacity` rows
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("count").alias("n")).collect()}
    placed, _ = place(histogram, capacity)
    by_size: dict[int, tuple[list, list]] = {}
    for s, rank, _, first in placed:
        a, b = by_size.setdefault(s, ([], []))
        a.append(rank)
        b.append(first)
    slots = spark.createDataFrame([(s, *ab) for s, ab in by_size.items()], "size int, ranks array<bigint>, firsts array<bigint>")
    offsets = counts.withColumn("off", F.coalesce(F.sum("count").over(W.partitionBy("size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    ranked = x.filter("size > 0").withColumn("r", F.row_number().over(W.partitionBy("size", "bucket").orderBy("item", "piece")) - 1)
    # one row per size, at most `capacity`: a bounded broadcast
    got = ranked.join(offsets, ["size", "bucket"]).withColumn("rank", F.col("r") + F.col("off")).join(F.broadcast(slots), "size")
    k = F.size(F.filter("ranks", lambda y: y <= F.col("rank")))
    got = got.withColumn("container", F.element_at("firsts", k) + F.col("rank") - F.element_at("ranks", k))
    none = x.filter("size = 0").withColumn("container", F.lit(None).cast("long"))
    cols = [F.col("item").alias(item), "piece", "size", F.col("container").cast("long").alias("container")]
    return got.select(*cols).unionByName(none.select(*cols))
