"""An append-only log whose entries carry the hash of the one before."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The hash before the first entry (a fixed value).
GENESIS = "0" * 64


def append(entries: list[dict], event: dict) -> dict:
    """The next entry after `entries` for an event (ts, role, action, object, detail); one writer."""
    prev = entries[-1]["hash"] if entries else GENESIS
    body = [prev, *(event[k] for k in ("ts", "role", "action", "object", "detail"))]
    text = json.dumps(body, ensure_ascii=False)
    return {"seq": len(entries) + 1, **event, "prev_hash": prev, "hash": hashlib.sha256(text.encode()).hexdigest()}


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts as a JSON list, parted by a comma and a blank."""
    quoted = [F.regexp_extract(F.to_json(F.array(F.coalesce(p.cast("string"), F.lit("")))), "^\\[(.*)\\]$", 1) for p in parts]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *quoted), F.lit("]")), 256)


def checked(log: DataFrame, seq: str, prev: str, own: str, parts: list[str], first: str = GENESIS) -> DataFrame:
    """log with `reason`: null for a sound entry, 'entry altered' where the digest of `parts` isn't the stored one, 'chain broken'
    where the stored link isn't the digest of the entry numbered one less (or, for the first entry of all, `first`). A missing
    entry thus breaks the one after it. Digests are recomputed in parallel and links compared by an equality join on the number,
    so that no task sees the whole log. An empty log gives no rows; null numbers link to nothing."""
    before = log.select((F.col(seq) + 1).alias(seq), F.col(own).alias("_before"))
    start = log.agg(F.min(seq).alias("_start"))  # one row
    x = log.join(before, seq, "left").join(F.broadcast(start))
    link = F.coalesce(F.col(prev) == F.when(F.col(seq) == F.col("_start"), F.coalesce("_before", F.lit(first))).otherwise(F.col("_before")), F.lit(False))
    sound = F.coalesce(digest(*[F.col(p) for p in parts]) == F.col(own), F.lit(False))
    return x.withColumn("reason", F.when(~link, "chain broken").when(~sound, "entry altered")).drop("_before", "_start")


def verify(log: DataFrame, seq: str, prev: str, own: str, parts: list[str]) -> DataFrame:
    """(entries, broken_at, reason): the first entry whose link or digest fails, or nulls. A digest covers the stored link and
    the parts."""
    bad = F.when(F.col("reason").isNotNull(), F.struct(F.col(seq).alias("at"), F.col("reason").alias("why")))
    x = checked(log, seq, prev, own, [prev, *parts])
    return x.agg(F.count("*").alias("entries"), F.min(bad).alias("b")).select("entries", F.col("b.at").alias("broken_at"), F.col("b.why").alias("reason"))


def latest(log: DataFrame, object_: str, seq: str, value: str) -> DataFrame:
    """(object, value): the value of each object's newest entry."""
    return log.groupBy(object_).agg(F.max_by(value, seq).alias(value))
