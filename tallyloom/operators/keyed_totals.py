"""Per-key results that no heavy key can slow down: dense accumulator arrays.

Each task takes its input split (splits are equal in bytes, whatever the keys), dictionary-encodes the key columns and
adds counts and measures into dense arrays with numpy.bincount. What leaves the split is one array block per field and
block: the split's keys of that block beside their accumulators. A second stage adds the blocks of all splits by
scatter-add. A key that holds a third of all rows is one array slot in every split, so it weighs as much as a key seen
once; rows themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task adds up before it emits array blocks; bounds its memory, not the result.
FLUSH_ROWS = 2_000_000


def _blocks(fields: list[str], measures: list[str], n_blocks: int):
    lists = ["n", *[f"sum_{m}" for m in measures], *[f"n_{m}" for m in measures]]
    schema = pa.schema(
        [("field", pa.string()), ("block", pa.int32()), ("keys", pa.list_(pa.string()))]
        + [(c, pa.list_(pa.int64())) for c in lists]
    )

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        sums = {}
        for m in measures:
            col = t[m].combine_chunks().cast(pa.int64())
            sums[m] = (col.fill_null(0).to_numpy(zero_copy_only=False), ~np.asarray(col.is_null()))
        for f in fields:
            d = t[f].combine_chunks().cast(pa.string()).dictionary_encode()
            k = len(d.dictionary)
            if not k:
                continue
            # null keys go to one slot past the dictionary, which is cut off
            codes = d.indices.fill_null(k).to_numpy(zero_copy_only=False)
            acc = {"n": np.bincount(codes, minlength=k + 1)[:k]}
            for m, (v, known) in sums.items():
                total = np.zeros(k + 1, np.int64)
                np.add.at(total, codes, v)
                acc[f"sum_{m}"] = total[:k]
                acc[f"n_{m}"] = np.bincount(codes[known], minlength=k + 1)[:k]
            keys = d.dictionary
            block = (pd.util.hash_array(np.asarray(keys.to_pylist(), object), categorize=False) % np.uint64(n_blocks)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            ids, starts = np.unique(block[order], return_index=True)
            off = pa.array(np.append(starts, k).astype(np.int32))
            take = pa.array(order)
            yield pa.record_batch(
                [pa.array([f] * len(ids)), pa.array(ids), pa.ListArray.from_arrays(off, keys.take(take))]
                + [pa.ListArray.from_arrays(off, pa.array(acc[c][order].astype(np.int64))) for c in lists],
                schema=schema,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= FLUSH_ROWS:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return run, lists


def _add(lists: list[str]):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        d = pa.chunked_array([c.flatten() for c in t["keys"].chunks], pa.string()).combine_chunks().dictionary_encode()
        at = d.indices.to_numpy()
        out = {"field": pa.array([key[0].as_py()] * len(d.dictionary), pa.string()), "key_value": d.dictionary}
        for c in lists:
            flat = np.concatenate([x.flatten().to_numpy() for x in t[c].chunks])
            acc = np.zeros(len(d.dictionary), np.int64)
            np.add.at(acc, at, flat)
            out[c] = pa.array(acc)
        return pa.table(out)

    return run


def keyed_totals(df: DataFrame, fields: list[str], measures: list[str] = (), n_blocks: int | None = None) -> DataFrame:
    """Per field and non-null key: n (rows), and for each integer or boolean measure its sum and its non-null rows.

    Columns: field, key_value, n, sum_<measure>..., n_<measure>.... Null keys are no keys and give no row; an empty
    table gives no row; a null measure adds nothing; keys compare by bytes, so case and blanks count. Other columns of
    df are ignored, whatever their names. The number of blocks follows the number of input splits.
    """
    measures = list(measures)
    slim = df.select(*[F.col(f).cast("string").alias(f) for f in fields], *[F.col(m).cast("long").alias(m) for m in measures])
    blocks = n_blocks or max(8, 2 * slim.rdd.getNumPartitions())
    run, lists = _blocks(list(fields), measures, blocks)
    ddl = "field string, block int, keys array<string>, " + ", ".join(f"{c} array<bigint>" for c in lists)
    out = "field string, key_value string, " + ", ".join(f"{c} bigint" for c in lists)
    return slim.mapInArrow(run, ddl).groupBy("field", "block").applyInArrow(_add(lists), out)


def heavy_keys(df: DataFrame, fields: list[str], share: float = 0.025) -> DataFrame:
    """The keys that hold at least `share` of the rows in which their field isn't null: field, key_value, n, total.

    Ties at the bound are kept; an empty field has no heavy key.
    """
    totals = df.agg(*[F.count(f).alias(f) for f in fields])
    # one row per field: the broadcast is bounded by the number of fields
    long = totals.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("total")) for f in fields])).alias("x")).select("x.*")
    return keyed_totals(df, fields).join(F.broadcast(long), "field").filter(F.col("n") >= F.lit(share) * F.col("total")).select("field", "key_value", "n", "total")
