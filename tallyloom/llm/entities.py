"""Problem 2: records of one person across tables without a common key, by collective graph linkage.

Candidates are a graph: two records of different tables are joined by an edge for every rare attribute that they share
(an identifier; two name skeletons with a place, a block or a birth band; a name skeleton with a relation's skeleton), and
the edge weighs the more, the rarer the attributes are. Every attribute counts once, however many records share it: all its
pairs are edges, and those of an attribute that many records share are made in tiles, by several tasks. Meta-blocking prunes
edges that weigh less than the mean edge of both their records. What is left is compared field by field, and the similarity then spreads: a pair gains from
other matched members of the two households, from a third record that both match, and loses to a better partner of either
record in the other's table. This is repeated until no pair changes sides.
"""

from __future__ import annotations

import warnings
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.text import skeleton
from tallyloom.llm.people import people, skeletons
from tallyloom.session import keep, release, tidy

#: Records of an attribute that one tile pairs with as many others; says who does the work, not what comes out.
TILE = 500
#: Pairs that meet, edges, and edges compared, for each record, that a slice holds: what is on disk at once beside the tables.
PAIRS, EDGES, LINES = 6.0, 4.0, 1.0
#: Log odds at which a pair is a match, and below which it is no longer followed.
MATCH, FOLLOW = 0.0, -6.0
#: Rounds of spreading after which it is given up, with a warning; it ends when no pair changes sides.
ROUNDS = 25


def _pairs_of(a: Column) -> Column:
    """All pairs of an array's distinct elements, each in order, as 'x+y'."""
    d = F.array_sort(F.array_distinct(a))
    return F.flatten(F.transform(d, lambda x: F.transform(F.filter(d, lambda y: y > x), lambda y: F.concat(x, F.lit("+"), y))))


def _tag(tag: str, a: Column) -> Column:
    return F.transform(a, lambda x: F.concat(F.lit(tag), x))


def _cross(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, F.lit("|"), y))))


def attributes(p: DataFrame) -> DataFrame:
    """Each record with its array `keys` of blocking attributes."""
    one = lambda c: F.array_compact(F.array(c))
    sk, rsk = skeletons(F.col("toks")), skeletons(F.col("rtoks"))
    p = p.withColumns({"sk": sk, "rsk": rsk})
    p = p.withColumn("two", _pairs_of(F.col("sk")))
    unit, blk = one(F.col("unit").cast("string")), one(F.col("blk"))
    bands = F.array_compact(F.array(F.floor(F.col("byear") / 4).cast("string"), F.concat(F.lit("h"), F.floor((F.col("byear") + 2) / 4).cast("string"))))
    keys = F.concat(
        _tag("a:", one(F.col("aadhaar"))), _tag("c:", one(F.col("account"))), _tag("m:", one(F.col("mobile"))),
        _tag("n:", _cross(F.col("two"), unit)), _tag("b:", _cross(F.col("two"), blk)), _tag("y:", _cross(F.col("two"), bands)),
        _tag("r:", _cross(_cross(F.col("sk"), F.col("rsk")), unit)), _tag("s:", _cross(_cross(F.col("sk"), unit), bands)),
    )
    return p.withColumn("keys", F.array_distinct(keys))


def _sliced(n: float, share: float) -> int:
    """Slices of n rows of which each holds `share` at most."""
    return max(1, ceil(n / max(share, 1.0)))


def _of(slices: int, s: int, c: str) -> Column:
    """Whether the record c is one of slice s."""
    return F.pmod(F.hash(c), F.lit(slices)) == s


def candidates(p: DataFrame, tile: int = TILE, share: float = PAIRS) -> DataFrame:
    """(l, r, w, src_l, src_r, near): pairs of record numbers (`id`) of different `src` with the weight of the attributes they
    share, and whether that is at least the mean weight of l's pairs with the other's table. Numbers ascend with `src`: else l may
    have pairs with that table on the other side as well, which its mean leaves out.

    All pairs of an attribute's records are made. They are dealt to buckets of about `tile` records, and two buckets, or one
    with itself, are a tile; so a pair meets in one tile, and an attribute that many records share has no long task. The pairs are
    made in slices of the records l, of about `share` pairs for each record there is, and written before the next slice is."""
    n = p.count()
    k = p.select("id", "src", F.explode("keys").alias("key"))
    # counted where they are, as attributes are dear to make and to move
    rows = k.withColumn("df", F.count("*").over(W.partitionBy("key"))).filter("df > 1").withColumn("tiles", F.ceil(F.col("df") / tile).cast("int"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = keep(rows.select("id", "src", "key", "df", "tiles", "bucket", F.least("bucket", "other").alias("i"), F.greatest("bucket", "other").alias("j")), "keys")
    met = rows.agg(F.sum((F.col("df") - 1) / (2 * F.col("tiles")))).first()[0] or 0
    slices = _sliced(met, share * n)
    y = rows.select("id", "src", "key", "bucket", "i", "j").alias("y")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    once = (F.col("x.i") == F.col("x.j")) | (F.col("x.bucket") != F.col("y.bucket"))
    w = F.log2(F.lit(float(max(n, 2))) / F.col("x.df"))
    parts = []
    for s in range(slices):
        x = rows.filter(_of(slices, s, "id")).alias("x")
        j = x.join(y, meet & once & (F.col("x.id") < F.col("y.id")) & (F.col("x.src") != F.col("y.src")))
        j = j.select(F.col("x.id").alias("l"), F.col("y.id").alias("r"), F.col("x.src").alias("src_l"), F.col("y.src").alias("src_r"), w.alias("w"))
        # moved by the left record once, for the sums and their mean
        e = j.repartition("l").groupBy("l", "r", "src_l", "src_r").agg(F.sum("w").alias("w"))
        parts.append(keep(e.withColumn("near", F.col("w") >= F.avg("w").over(W.partitionBy("l", "src_r")) - 1e-9), "edges"))
    release(rows)
    return reduce(DataFrame.unionByName, parts)


def prune(edges: DataFrame, n: int, share: float = EDGES) -> DataFrame:
    """Weighted node pruning: an edge (of `candidates`, of n records) stays if it weighs at least the mean edge of one of its
    records to the other's table. In slices of the records r, of about `share` edges for each record there is."""
    slices = _sliced(edges.count(), share * n)
    parts = []
    for s in range(slices):
        e = edges.filter(_of(slices, s, "r")).repartition("r")
        e = e.withColumn("mean", F.avg("w").over(W.partitionBy("r", "src_l")))
        parts.append(keep(e.filter(F.col("near") | (F.col("w") >= F.col("mean") - 1e-9)).select("l", "r", "w"), "pruned"))
    return reduce(DataFrame.unionByName, parts)


def word_likeness(x: Column, y: Column) -> Column:
    """Likeness of two folded words, 0 to 1: equal, equal skeleton, one or two edits, one the other's initial or start."""
    d = F.levenshtein(x, y)
    short = F.least(F.length(x), F.length(y))
    return (
        F.when(x == y, 1.0).when(short == 1, F.when(F.substring(x, 1, 1) == F.substring(y, 1, 1), 0.55).otherwise(0.0)).when(skeleton(x) == skeleton(y), 0.92)
        .when((d == 1) & (short >= 3), 0.85).when((d == 2) & (short >= 5), 0.7).when((short == 2) & (x.startswith(y) | y.startswith(x)), 0.55).when((short >= 3) & (x.startswith(y) | y.startswith(x)), 0.65).otherwise(0.0)
    )


def name_likeness(a: Column, b: Column) -> Column:
    """struct(best, second): the two best likenesses of words of the shorter name to words of the other, in any order;
    -1 where the shorter name has no such word."""
    s, t = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    m = F.sort_array(F.transform(s, lambda x: F.coalesce(F.array_max(F.transform(t, lambda y: word_likeness(x, y))), F.lit(-1.0))), asc=False)
    x, y = F.array_join(a, ""), F.array_join(b, "")
    # blanks put in or left out: the same letters, but for one edit
    one = (F.size(a) != F.size(b)) & (F.length(x) > 5) & (F.levenshtein(x, y) <= 1)
    best, second = F.coalesce(F.get(m, F.lit(0)), F.lit(-1.0)), F.coalesce(F.get(m, F.lit(1)), F.lit(-1.0))
    return F.struct(F.when(one, F.greatest(best, F.lit(0.92))).otherwise(best).alias("best"), F.when(one, F.greatest(second, F.lit(0.92))).otherwise(second).alias("second"))


#: Fields that a comparison reads.
FIELDS = ["src", "toks", "rtoks", "sex", "byear", "bdate", "unit", "blk", "aadhaar", "account", "mobile", "doc"]


def agreement(e: DataFrame, names: bool = True) -> DataFrame:
    """e with the degrees of agreement of the fields that both sides have as <field>_l and <field>_r; without names, e has the
    likeness of the names as n1 and n2."""
    eq = lambda c: F.when(F.col(f"{c}_l").isNull() | F.col(f"{c}_r").isNull(), 0).when(F.col(f"{c}_l") == F.col(f"{c}_r"), 1).otherwise(-1)
    near = F.when(F.levenshtein("aadhaar_l", "aadhaar_r") <= 2, 0.5)
    e = e.withColumn("rl", name_likeness(F.col("rtoks_l"), F.col("rtoks_r")))
    if names:
        e = e.withColumn("nm", name_likeness(F.col("toks_l"), F.col("toks_r"))).withColumns({"n1": F.col("nm.best"), "n2": F.col("nm.second")})
    return e.withColumns({
        "r1": F.col("rl.best"), "r2": F.col("rl.second"), "sx": eq("sex"), "un": eq("unit"), "bk": eq("blk"),
        "ad": F.coalesce(F.when(eq("aadhaar") == -1, F.coalesce(near, F.lit(-1.0))), eq("aadhaar").cast("double")), "ac": eq("account"), "mo": eq("mobile"),
        "bd": eq("bdate"), "gap": F.abs(F.col("byear_l") - F.col("byear_r")),
    }).drop("nm", "rl")


def compared(edges: DataFrame, p: DataFrame, slices: int = 1, s: int = 0) -> DataFrame:
    """The pairs of a slice of the records l with the degrees of agreement of both records' fields."""
    side = lambda p, s, k: p.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}_{s}") for c in FIELDS])
    e = edges.filter(_of(slices, s, "l")).join(side(p.filter(_of(slices, s, "id")), "l", "l"), "l").join(side(p, "r", "r"), "r")
    return agreement(e).select("l", "r", "w", "src_l", "src_r", "doc_l", "doc_r", "n1", "n2", "r1", "r2", "sx", "un", "bk", "ad", "ac", "mo", "bd", "gap")


def evidence() -> Column:
    """Log odds of a pair from its degrees of agreement."""
    c = F.col
    n1 = F.when(c("n1") >= 0.99, 1.5).when(c("n1") >= 0.9, 1.2).when(c("n1") >= 0.8, 0.3).when(c("n1") >= 0.6, -1.0).when(c("n1") >= 0.5, -2.0).otherwise(-7.0)
    n2 = F.when(c("n2") >= 0.99, 3.0).when(c("n2") >= 0.9, 2.5).when(c("n2") >= 0.8, 1.5).when(c("n2") >= 0.6, 0.5).when(c("n2") >= 0.5, 0.0).when(c("n2") < 0, -1.0).otherwise(-4.0)
    rel = F.when(c("r1") < 0, 0.0).when(c("r1") >= 0.9, F.when(c("r2") >= 0.8, 3.5).when(c("r2") < 0, 2.0).otherwise(0.0)).when(c("r1") >= 0.7, F.when(c("r2") >= 0.8, 2.0).otherwise(0.0)).when(c("r1") >= 0.5, 0.0).otherwise(-2.5)
    born = F.when(c("gap").isNull(), 0.0).when(c("bd") == 1, 6.0).when(c("gap") <= 1, 2.5).when(c("gap") <= 2, 2.0).when(c("gap") <= 4, 0.5).when(c("gap") <= 6, -1.0).when(c("gap") <= 11, -3.0).otherwise(-6.0)
    sex = F.when(c("sx") == 1, 0.3).when(c("sx") == -1, -4.0).otherwise(0.0)
    place = F.when(c("un") == 1, 2.5).when(c("un") == -1, -3.5).when(c("bk") == 1, 0.7).when(c("bk") == -1, -4.0).otherwise(0.0)
    block = F.when(c("bk") == -1, -1.0).otherwise(0.0)
    ids = F.when(c("ad") == 1, 9.0).when(c("ad") == 0.5, 4.0).when(c("ad") == -1, -4.0).otherwise(0.0) + F.when(c("ac") == 1, 6.0).when(c("ac") == -1, -0.7).otherwise(0.0) + F.when(c("mo") == 1, 4.0).when(c("mo") == -1, -0.7).otherwise(0.0)
    return n1 + n2 + rel + born + sex + place + block + ids - 7.0


def spread(pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pairs (l, r, src_l, src_r, doc_l, doc_r, s0) with the final log odds s, after similarity has spread until no pair changes
    sides. From round to round less of a change is taken over, so that pairs that swing come to rest; should some still turn
    after `rounds`, a warning says how many. A table of `keep` that pairs reads is deleted."""
    # two households are told by the first of the pairs that have them; one pair alone in them is moved by none
    h, two = W.partitionBy("doc_l", "doc_r"), F.col("doc_l").isNotNull() & F.col("doc_r").isNotNull()
    first = F.when(F.count("*").over(h) > 1, F.min(F.struct("l", "r")).over(h))
    x = pairs.filter(two).withColumn("h", first).unionByName(pairs.filter(~two), allowMissingColumns=True)
    base = keep(x.select("l", "r", "src_l", "src_r", F.col("h.l").alias("hl"), F.col("h.r").alias("hr"), "s0", F.col("s0").alias("s")), "scored")
    release(pairs)
    for k in range(rounds):
        prob = 1 / (1 + F.exp(-F.col("s")))
        cur = base.withColumn("p", prob)
        likely = cur.filter("p >= 0.5")
        # other matched members of the two households; who has none isn't moved
        own = F.when(F.col("p") >= 0.5, F.col("p")).otherwise(0.0)
        house = F.least(F.sum(own).over(W.partitionBy("hl", "hr")) - own, F.lit(2.0))
        x = cur.filter("hl IS NOT NULL").withColumn("house", house).unionByName(cur.filter("hl IS NULL").withColumn("house", F.lit(0.0))).drop("p")
        # a third record that both ends match: any two records of different tables that match it
        end = lambda v, t: likely.select(F.col(v).alias("v"), F.col(t).alias("t"), F.col(f"src_{v}").alias("src"), "p")
        ends = end("l", "r").unionByName(end("r", "l"))
        y, z = ends.alias("y"), ends.alias("z").hint("merge")
        third = y.join(z, (F.col("y.t") == F.col("z.t")) & (F.col("y.src") != F.col("z.src"))).select(F.col("y.v").alias("l"), F.col("z.v").alias("r"), F.least("y.p", "z.p").alias("third"))
        # moved by the left record once, for this join and the first of the windows
        third = third.repartition("l").groupBy("l", "r").agg(F.max("third").alias("third"))
        x = x.repartition("l").join(third.hint("merge"), ["l", "r"], "left")
        x = x.withColumn("up", F.col("s0") + 1.8 * F.greatest(F.col("house"), F.lit(0.0)) + 2.5 * F.coalesce(F.col("third"), F.lit(0.0)))
        # a better partner of either record in the other's table
        best = lambda v, s: F.max("up").over(W.partitionBy(v, s))
        x = x.withColumns({"bl": best("l", "src_r"), "br": best("r", "src_l")})
        lose = F.greatest(F.col("bl"), F.col("br")) - F.col("up")
        x = x.withColumn("new", F.col("up") - F.least(F.lit(0.7) * F.greatest(lose - 1.0, F.lit(0.0)), F.lit(8.0)))
        x = x.withColumn("new", F.col("s") + (F.col("new") - F.col("s")) * min(1.0, 2.0 / (k + 1)))
        with tidy(pairs.sparkSession, requireAllClusterKeysForCoPartition="false"):
            nxt = keep(x.select(*base.columns[:-1], F.col("new").alias("s"), ((F.col("new") >= MATCH) != (F.col("s") >= MATCH)).alias("turned")), "scored")
        release(base)
        base = nxt.drop("turned")
        turned = nxt.filter("turned").count()
        if not turned:
            return base
    if rounds:
        warnings.warn(f"{turned} pairs still change sides after {rounds} rounds", stacklevel=2)
    return base


def match_people(spark: SparkSession, sf: str) -> DataFrame:
    """(record_id_l, record_id_r, confidence) of the records of two different tables among pension, ration, mgnrega and kisan
    that describe one person; the smaller record_id first, confidence the probability.

    Redelivered records count once. Missing fields say nothing for or against a pair; a record without any usable attribute
    meets nobody. Equal scores are kept alike. Empty tables give no rows.
    """
    registers = ["pension", "ration", "mgnrega", "kisan"]
    read = people(spark, sf, *registers)
    # numbers ascend with the register, so that all of a record's pairs with another table have it on the same side
    src = F.array_position(F.array(*map(F.lit, registers)), F.col("src"))
    p = keep(read.withColumns({"id": F.shiftleft(src, 60) + F.monotonically_increasing_id(), "src": src.cast("tinyint")}), "numbered")
    release(read)
    n = p.count()
    e = candidates(attributes(p))
    kept = prune(e, n)
    release(e)
    slices = _sliced(kept.count(), LINES * n)
    scored = lambda x: x.withColumn("s0", evidence() + F.col("w") * 0.05).filter(F.col("s0") >= FOLLOW).select("l", "r", "src_l", "src_r", "doc_l", "doc_r", "s0")
    pairs = reduce(DataFrame.unionByName, [keep(scored(compared(kept, p, slices, s)), "compared") for s in range(slices)])
    release(kept)
    ids = keep(p.select("id", "record_id"), "ids")
    release(p)
    s = spread(pairs).filter(F.col("s") >= MATCH)
    m = s.join(ids.select(F.col("id").alias("l"), F.col("record_id").alias("a")), "l").join(ids.select(F.col("id").alias("r"), F.col("record_id").alias("b")), "r")
    return m.select(F.least("a", "b").alias("record_id_l"), F.greatest("a", "b").alias("record_id_r"), (1 / (1 + F.exp(-F.col("s")))).alias("confidence"))
