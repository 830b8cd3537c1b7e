"""One layout for the person records of the registers, for the linking operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import MIDDLE_FOLDED, PREFIX_FOLDED, STOP_FOLDED, fold_word, skeleton, to_roman
from tallyloom.llm.places import with_unit
from tallyloom.session import keep
from tallyloom.sources.tables import table

#: register -> (name, relation's name, place, block, sex, Aadhaar, account, mobile, household document, birth: a date, or an
#: age and the year or date it holds for)
REGISTERS = {
    "pension": ("applicant_name", "father_husband_name", "gram_panchayat", "block", "gender", "aadhaar", "bank_account", "mobile", None, ("dob",)),
    "ration": ("member_name", "head_of_family", "village", "block", "gender", "aadhaar", None, "mobile", "card_no", ("member_age", "age_as_on")),
    "mgnrega": ("worker_name", "father_husband_name", "village", "block", "gender", "aadhaar", "account", None, "job_card_no", ("age", "registered")),
    "kisan": ("farmer_name", "father_husband_name", "village", "block", "gender", "aadhaar", "account", None, None, ("dob",)),
    "death": ("deceased_name", "father_husband_name", "village", "block", "gender", "aadhaar", None, None, None, ("age_at_death", "date_of_death")),
}
#: Words before a name: honorifics, prefixes and their abbreviations, folded (fixed values).
_BEFORE = "srimati srim sr srimat ku kumr swa sva sb mrs smt"
#: Words after a given name that distinguish nobody: middle names and their abbreviations, folded (fixed values).
_AFTER = "sih parsad parsd kumar kumr kr ku pd pr pra si sinh sing de dv deb dev la na"
BEFORE = sorted(STOP_FOLDED | PREFIX_FOLDED | set(_BEFORE.split()))
AFTER = sorted(STOP_FOLDED | MIDDLE_FOLDED | set(_AFTER.split()))
#: What a middle name and its abbreviations stand for, folded (fixed values).
MIDDLE_KINDS = {
    "s": "sing sinh sin sih si s", "k": "kumar kumr kr ku k", "p": "prasad parsad parsd pd pr pra p", "c": "candr candra cand candar candro c",
    "l": "lal la l", "m": "md mohd mo mohamad mohamed muhamad mohmad mohamad muhamad", "d": "dat dut", "r": "ram", "n": "nat",
}


def _parts(c: Column) -> Column:
    """All folded words of a name."""
    apart = F.regexp_replace(c, "(?<=[a-z]{2})(?=[A-Z])", " ")
    # a weak word written together with the one before it is taken off
    cut = lambda w: F.regexp_replace(fold_word(w), "(?<=[a-z]{3})(?:kumar|prasad|parsad|candr|debi|devi|sing|candar)$", "")
    return F.filter(F.transform(F.split(to_roman(apart), "[\\s.\\-,/0-9()]+"), cut), lambda w: w != "")


def words(c: Column) -> Column:
    """The folded words of a name without those that distinguish nobody; single letters stay, and what could abbreviate a
    given name stays where it is the first word. A name of such words only keeps them."""
    all_ = _parts(c)
    left = _telling(all_)
    return F.when(F.size(left) > 0, left).otherwise(all_)


def _telling(parts: Column) -> Column:
    """The words of a name's parts that are left without those that distinguish nobody."""
    # honorifics fall away in front; after the first word left, middle names do
    front = F.filter(parts, lambda w: ~w.isin(*BEFORE))
    return F.filter(front, lambda w, i: ((i == 0) & (F.length(w) < 3)) | ~w.isin(*AFTER))


def middles(c: Column) -> Column:
    """The kinds of middle names in a name, without order; a word that may be the given name's initial is none."""
    return _kinds(_parts(c))


def _kinds(parts: Column) -> Column:
    kinds = {w: k for k, ws in MIDDLE_KINDS.items() for w in ws.split()}
    of = F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*map(F.lit, kinds.values())))
    front = F.filter(parts, lambda w: ~w.isin(*[x for x in BEFORE if x not in PREFIX_FOLDED]))
    return F.array_distinct(F.filter(F.transform(front, lambda w, i: F.when((i > 0) | w.isin(*sorted(PREFIX_FOLDED)), F.try_element_at(of, w))), lambda k: k.isNotNull()))


def birth_date(c: Column) -> Column:
    """A date in any of the layouts that clerks use, day before month; null where it is none."""
    d, y = "^\\s*(\\d{1,2})[-/. ](\\d{1,2})[-/. ](\\d{4})\\s*$", "^\\s*(\\d{4})[-/.](\\d{1,2})[-/.](\\d{1,2})\\s*$"
    iso = F.when(c.rlike(d), F.regexp_replace(c, d, "$3-$2-$1")).when(c.rlike(y), F.regexp_replace(c, y, "$1-$2-$3"))
    return F.try_to_timestamp(iso, F.lit("y-M-d")).cast("date")


def people(spark: SparkSession, sf: str, *registers: str) -> DataFrame:
    """A row per distinct record: src, record_id, name, rel (as typed), toks, rtoks (their words), mids, rmids (kinds of their middle names), sex, byear, bdate (null
    for first-of-January and impossible dates), unit, blk, aadhaar (null for fillers of one digit and wrong lengths),
    account (without leading zeros), mobile, doc. A redelivered record counts once.

    The rows read a table of `keep` for each register, which `release` of them deletes once they are written."""
    # as many tasks for each register, whose rows are little data, but dear to bring into this layout
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts = []
    for src in registers:
        name, rel, place, block, sex, aadhaar, account, mobile, doc, birth = REGISTERS[src]
        col = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
        cols = [c for c in (name, rel, place, block, sex, aadhaar, account, mobile, doc, *birth) if c]
        more = ["relation_to_head"] if src == "ration" else []
        t = table(spark, sf, src, "record_id", *cols, *more, "loaded_at")
        if more:
            # a card names no father or husband, but it lists him: the head's husband is her relation and her children's
            him = t.filter(F.upper("relation_to_head") == "HUSBAND").groupBy(doc).agg(F.max(name).alias("him"))
            t = t.join(him.hint("merge"), doc, "left").withColumn(rel, F.when(F.upper("relation_to_head").isin("SELF", "SON", "DAUGHTER"), F.col("him"))).drop("him")
        if len(birth) == 1:
            bdate = birth_date(col(birth[0]))
            byear = F.year(bdate)
        else:
            bdate = F.lit(None).cast("date")
            on = F.when(col(birth[1]).rlike("^\\d{4}$"), col(birth[1]).cast("int")).otherwise(F.year(birth_date(col(birth[1]))))
            byear = on - F.col(birth[0])
        byear = F.when(byear.between(1905, 2026), byear)
        t = t.select(
            F.lit(src).alias("src"), "record_id", col(name).alias("name"), col(rel).alias("rel"), col(place).alias("place"), col(block).alias("block"),
            F.when(F.upper(F.substring(col(sex), 1, 1)).isin("M", "पु"[0]), "M").when(F.upper(F.substring(col(sex), 1, 1)).isin("F", "म"), "F").alias("sex"),
            byear.alias("byear"), F.when(byear.isNotNull() & ~((F.month(bdate) == 1) & (F.dayofmonth(bdate) == 1)), bdate).alias("bdate"),
            F.when(col(aadhaar).rlike("^(\\d)(?!\\1+$)\\d{11}$"), col(aadhaar)).alias("aadhaar"),
            F.nullif(F.regexp_replace(col(account), "^0+|\\D", ""), F.lit("")).alias("account"), F.when(F.length(col(mobile)) == 10, col(mobile)).alias("mobile"),
            F.concat(F.lit(src + ":"), col(doc)).alias("doc"), "loaded_at",
        )
        # one row per record: deliveries differ in loaded_at only. Two passes read them (with_unit), and a register's shuffle ends with it
        t = t.filter("record_id IS NOT NULL").repartition(tasks, "record_id").groupBy("src", "record_id").agg(F.min_by(F.struct(*[c for c in t.columns if c not in ("src", "record_id", "loaded_at")]), F.struct("loaded_at", "name")).alias("r"))
        parts.append(keep(t.select("src", "record_id", "r.*"), "register"))
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    x = with_unit(x, "place", "block", table(spark, sf, "units"))
    # a name's parts are dear to make and read several times
    x = x.withColumns({"_n": _parts(F.col("name")), "_r": _parts(F.col("rel"))})
    x = x.withColumns({"_nt": _telling(F.col("_n")), "_rt": _telling(F.col("_r"))})
    blk = fold_word(F.regexp_replace(to_roman(F.col("block")), "[^a-z]", ""))
    none = F.array().cast("array<string>")
    return x.withColumns({
        "toks": F.when(F.size("_nt") > 0, F.col("_nt")).otherwise(F.col("_n")), "rtoks": F.coalesce(F.when(F.size("_rt") > 0, F.col("_rt")).otherwise(F.col("_r")), none),
        "mids": F.coalesce(_kinds(F.col("_n")), none), "rmids": F.coalesce(_kinds(F.col("_r")), none), "blk": F.when(blk != "", blk),
    }).drop("place", "block", "_n", "_r", "_nt", "_rt")


def skeletons(c: Column) -> Column:
    """Consonant skeletons of the words that have two letters at least."""
    return F.filter(F.transform(F.filter(c, lambda w: F.length(w) > 1), skeleton), lambda s: F.length(s) > 0)
