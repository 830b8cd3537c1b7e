"""Core queries over linked records: persons and their links, lists and logs as roles see them, evaluation, formatted texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import masks
from tallyloom.functions.dates import full_years
from tallyloom.functions.text import titled
from tallyloom.operators import aggregates as A
from tallyloom.operators import em
from tallyloom.operators.blocking import levels
from tallyloom.operators.govern import GovernedSession, Role
from tallyloom.plans.relational import DEMO_KEY, _sql_name, query
from tallyloom.plans.upload import match_upload
from tallyloom.session import TODAY, keep
from tallyloom.sources.tables import table, with_ordinal

DAY = f"DATE '{TODAY.isoformat()}'"
#: The blocks of a demonstration role.
BLOCKS = ("VISHUM", "SATUB", "BIRMI")
_IN_BLOCKS = "upper(trim(block)) IN ('VISHUM', 'SATUB', 'BIRMI')"


def linked(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The records that have a group, with its name."""
    c = table(spark, sf, "clusters", "unique_id", "cluster_id").filter("cluster_id IS NOT NULL")
    return table(spark, sf, "standard", "unique_id", *columns).join(c, "unique_id")


# ---- persons -------------------------------------------------------------------------------------------------------


@query(f"SELECT cluster_id, unique_id, record_id, register, department, {_sql_name('name')} AS name, birth_year, block FROM standard JOIN clusters USING (unique_id, record_id) WHERE {_IN_BLOCKS}")
def person_records(spark: SparkSession, sf: str) -> DataFrame:
    """Every record of every person in a role's blocks, names masked."""
    x = table(spark, sf, "standard", "unique_id", "record_id", "register", "department", "name", "birth_year", "block").join(table(spark, sf, "clusters"), ["unique_id", "record_id"])
    g = GovernedSession(spark, {"records": x}, Role("officer", blocks=BLOCKS, people=True))
    return g.scoped("records").select("cluster_id", "unique_id", "record_id", "register", "department", masks.mask_name(F.col("name")).alias("name"), "birth_year", "block")


_PREFER = "CASE register WHEN 'pension' THEN 0 WHEN 'parivar' THEN 1 WHEN 'death' THEN 2 ELSE 9 END"


@query(f"""
SELECT cluster_id, count(*) AS records, string_agg(register, ',' ORDER BY register) AS registers, arg_min(birth_year, ({_PREFER})::BIGINT * 1000000000000 + unique_id) FILTER (WHERE birth_year IS NOT NULL) AS preferred_year,
 string_agg(register || ': about ' || birth_year, '; ' ORDER BY unique_id) FILTER (WHERE birth_year IS NOT NULL AND register <> 'pension') AS others,
 concat_ws(', ', CASE WHEN bool_or(register = 'pension') THEN 'pension' END, CASE WHEN bool_or(register = 'ration') THEN 'ration card' END, CASE WHEN bool_or(register = 'mgnrega') THEN 'work' END, CASE WHEN bool_or(register = 'kisan') THEN 'land' END) AS receives
FROM standard JOIN clusters USING (unique_id) WHERE cluster_id IS NOT NULL GROUP BY 1""")
def person_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """A person's registers with repeats, the birth year by order of preference, the years that others state, what he receives."""
    prefer = F.coalesce(F.create_map(*[F.lit(x) for kv in {"pension": 0, "parivar": 1, "death": 2}.items() for x in kv])[F.col("register")], F.lit(9))
    has = lambda r, text: F.when(F.bool_or(F.col("register") == r), text)
    listed = F.when(F.col("birth_year").isNotNull() & (F.col("register") != "pension"), F.struct("unique_id", F.concat("register", F.lit(": about "), "birth_year").alias("t")))
    x = linked(spark, sf, "register", "birth_year").groupBy("cluster_id").agg(
        F.count("*").alias("records"), F.array_join(F.array_sort(F.collect_list("register")), ",").alias("registers"),
        F.min_by("birth_year", F.when(F.col("birth_year").isNotNull(), F.struct(prefer, "unique_id"))).alias("preferred_year"),
        F.array_sort(F.collect_list(listed)).alias("o"),
        F.concat_ws(", ", has("pension", "pension"), has("ration", "ration card"), has("mgnrega", "work"), has("kisan", "land")).alias("receives"),
    )
    return x.select("cluster_id", "records", "registers", "preferred_year", F.nullif(F.array_join(F.transform("o", lambda s: s["t"]), "; "), F.lit("")).alias("others"), "receives")


@query("""
WITH n AS (SELECT cluster_id, count(DISTINCT register) AS registers, count(*) AS records, min(unique_id) AS first_record FROM standard JOIN clusters USING (unique_id) WHERE cluster_id IS NOT NULL GROUP BY 1)
SELECT unique_id, cluster_id, register, registers, records, first_record FROM standard JOIN clusters USING (unique_id) JOIN n USING (cluster_id)""")
def registers_of_person(spark: SparkSession, sf: str) -> DataFrame:
    """Each record with the number of its person's registers and records and the first of them: aggregated and joined back, so
    that no person's records are gathered."""
    x = linked(spark, sf, "register")
    n = x.groupBy("cluster_id").agg(F.count_distinct("register").alias("registers"), F.count("*").alias("records"), F.min("unique_id").alias("first_record"))
    return x.join(n, "cluster_id").select("unique_id", "cluster_id", "register", "registers", "records", "first_record")


@query("""
SELECT cluster_id, count(*) AS n, min(birth_year) AS least, max(birth_year) AS most, median(birth_year) AS middle FROM standard JOIN clusters USING (unique_id)
WHERE cluster_id IS NOT NULL AND birth_year IS NOT NULL AND register <> 'pension' GROUP BY 1 HAVING max(birth_year) - min(birth_year) > 2""")
def year_disagreement(spark: SparkSession, sf: str) -> DataFrame:
    """Persons whose other registers state years of birth more than two apart."""
    x = linked(spark, sf, "register", "birth_year").filter("birth_year IS NOT NULL AND register <> 'pension'").groupBy("cluster_id")
    return x.agg(F.count("*").alias("n"), F.min("birth_year").alias("least"), F.max("birth_year").alias("most"), F.median("birth_year").alias("middle")).filter("most - least > 2")


@query(f"SELECT unique_id, year({DAY}) - year(birth_date) - CASE WHEN month(birth_date) * 100 + day(birth_date) > month({DAY}) * 100 + day({DAY}) THEN 1 ELSE 0 END AS age FROM standard WHERE birth_date IS NOT NULL")
def full_ages(spark: SparkSession, sf: str) -> DataFrame:
    """Ages in full years on the fixed day."""
    return table(spark, sf, "standard", "unique_id", "birth_date").filter("birth_date IS NOT NULL").select("unique_id", full_years(F.col("birth_date"), F.lit(TODAY)).alias("age"))


@query("""
SELECT w.unique_id AS woman, m.unique_id AS man, m.register = 'death' AS died FROM standard w JOIN standard m ON w.doc_key = m.doc_key AND w.rel_first = m.name_first
JOIN clusters c ON c.unique_id = w.unique_id JOIN clusters d ON d.unique_id = m.unique_id WHERE w.sex = 'F' AND m.sex = 'M' AND c.cluster_id <> d.cluster_id""")
def husbands_in_family(spark: SparkSession, sf: str) -> DataFrame:
    """Women with the men of their document who bear the name of their named relative, other groups than theirs."""
    x = linked(spark, sf, "doc_key", "rel_first", "name_first", "sex", "register")
    w = x.filter("sex = 'F'").select("doc_key", F.col("rel_first").alias("first"), F.col("unique_id").alias("woman"), F.col("cluster_id").alias("cw"))
    m = x.filter("sex = 'M'").select("doc_key", F.col("name_first").alias("first"), F.col("unique_id").alias("man"), F.col("cluster_id").alias("cm"), (F.col("register") == "death").alias("died"))
    return w.join(m, ["doc_key", "first"]).filter("cw <> cm").select("woman", "man", "died")


@query("""
SELECT doc_key, count(*) AS members, count(DISTINCT panchayat_key) AS places, arg_min(panchayat_key, unique_id) FILTER (WHERE panchayat_key IS NOT NULL) AS place,
 arg_min(block, unique_id) FILTER (WHERE block IS NOT NULL) AS block FROM standard WHERE doc_key IS NOT NULL GROUP BY 1""")
def household_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """The first non-null value of each field of a household, in the order of its records."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("unique_id"))).alias(c if c == "block" else "place")
    x = table(spark, sf, "standard", "unique_id", "doc_key", "panchayat_key", "block").filter("doc_key IS NOT NULL").groupBy("doc_key")
    return x.agg(F.count("*").alias("members"), F.count_distinct("panchayat_key").alias("places"), first("panchayat_key"), first("block"))


# ---- links ---------------------------------------------------------------------------------------------------------


def _sure_links(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pairs", "unique_id_l", "unique_id_r", "match_weight", "match_probability", "via").distinct()
    c = table(spark, sf, "clusters", "unique_id", "cluster_id")
    x = p.join(c.select(F.col("unique_id").alias("unique_id_l"), "cluster_id"), "unique_id_l").join(c.select(F.col("unique_id").alias("unique_id_r"), F.col("cluster_id").alias("other")), "unique_id_r")
    x = x.filter("cluster_id = other AND unique_id_l <> unique_id_r").drop("other")
    # two branches into one table: what was compared and is likely, and what the households add
    return x.filter("via = 'first_pass' AND match_probability >= 0.5").unionByName(x.filter("via = 'household'"))


_SURE = """SELECT DISTINCT unique_id_l, unique_id_r, match_weight, match_probability, via, c.cluster_id FROM pairs JOIN clusters c ON c.unique_id = unique_id_l JOIN clusters d ON d.unique_id = unique_id_r
 WHERE c.cluster_id = d.cluster_id AND unique_id_l <> unique_id_r AND (via = 'household' OR via = 'first_pass' AND match_probability >= 0.5)"""


@query(_SURE)
def person_links(spark: SparkSession, sf: str) -> DataFrame:
    """The links within each person, from both passes."""
    return _sure_links(spark, sf).select("unique_id_l", "unique_id_r", "match_weight", "match_probability", "via", "cluster_id")


@query(f"""
SELECT cluster_id, unique_id_l, unique_id_r, round(match_weight, 1) AS match_weight, nth FROM (
SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY match_weight DESC NULLS LAST, unique_id_l, unique_id_r, via, match_probability) AS nth FROM ({_SURE})) WHERE nth <= 40""")
def strongest_links(spark: SparkSession, sf: str) -> DataFrame:
    """The forty strongest links of each person, unknown weights last (the limit is the report's)."""
    w = W.partitionBy("cluster_id").orderBy(F.desc_nulls_last("match_weight"), "unique_id_l", "unique_id_r", "via", "match_probability")
    return _sure_links(spark, sf).withColumn("nth", F.row_number().over(w)).filter("nth <= 40").select("cluster_id", "unique_id_l", "unique_id_r", F.round("match_weight", 1).alias("match_weight"), "nth")


#: A small model for the explanation query: comparison -> level -> m, u.
_M = {"gamma_sex": {1: 0.98, 0: 0.02}, "gamma_year": {2: 0.6, 1: 0.3, 0: 0.1}, "gamma_skeleton": {1: 0.85, 0: 0.15}}
_U = {"gamma_sex": {1: 0.5, 0: 0.5}, "gamma_year": {2: 0.02, 1: 0.08, 0: 0.9}, "gamma_skeleton": {1: 0.01, 0: 0.99}}
_EXPLAINED = """SELECT unique_id_l AS l, unique_id_r AS r, CASE WHEN a.sex IS NULL OR b.sex IS NULL THEN -1 WHEN a.sex = b.sex THEN 1 ELSE 0 END AS gamma_sex,
 CASE WHEN a.birth_year IS NULL OR b.birth_year IS NULL THEN -1 WHEN a.birth_year = b.birth_year THEN 2 WHEN abs(a.birth_year - b.birth_year) <= 2 THEN 1 ELSE 0 END AS gamma_year,
 CASE WHEN a.skel_first IS NULL OR b.skel_first IS NULL THEN -1 WHEN a.skel_first = b.skel_first THEN 1 ELSE 0 END AS gamma_skeleton
 FROM (SELECT DISTINCT unique_id_l, unique_id_r FROM pairs) JOIN standard a ON a.unique_id = unique_id_l JOIN standard b ON b.unique_id = unique_id_r"""


@query(f"WITH g AS ({_EXPLAINED}) SELECT g.l, g.r, t.comparison, t.level, t.bits FROM g JOIN (VALUES " + ", ".join(f"('{g}', {k}, round(log2({_M[g][k]}::DOUBLE / {_U[g][k]}), 1))" for g in _M for k in _M[g]) + ") t(comparison, level, bits) ON t.level = CASE t.comparison " + " ".join(f"WHEN '{g}' THEN g.{g}" for g in _M) + " END")
def link_explanation(spark: SparkSession, sf: str) -> DataFrame:
    """Why two records were linked: the bits of each comparison, by level."""
    s = table(spark, sf, "standard", "unique_id", "sex", "birth_year", "skel_first")
    side = lambda k: s.select(F.col("unique_id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("sex", "birth_year", "skel_first")])
    p = table(spark, sf, "pairs", F.col("unique_id_l").alias("l"), F.col("unique_id_r").alias("r")).distinct().join(side("l"), "l").join(side("r"), "r")
    null = lambda c: F.col(f"{c}_l").isNull() | F.col(f"{c}_r").isNull()
    eq = lambda c: F.col(f"{c}_l") == F.col(f"{c}_r")
    near = F.abs(F.col("birth_year_l") - F.col("birth_year_r")) <= 2
    g = p.select("l", "r", levels(null("sex"), eq("sex")).alias("gamma_sex"), levels(null("birth_year"), eq("birth_year"), near).alias("gamma_year"), levels(null("skel_first"), eq("skel_first")).alias("gamma_skeleton"))
    return em.explain(g, list(_M), _M, _U)


# ---- lists ---------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, 'open' AS status FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT o_orderkey, 'decided' FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def by_decision(spark: SparkSession, sf: str) -> DataFrame:
    """Cases with and without a decision, by a semi and an anti join (null ids decide nothing)."""
    o = table(spark, sf, "orders", "o_orderkey")
    d = table(spark, sf, "lineitem", F.col("l_orderkey").alias("o_orderkey"), "l_returnflag").filter("l_returnflag = 'R' AND o_orderkey IS NOT NULL").select("o_orderkey").distinct()
    return o.join(d, "o_orderkey", "left_anti").withColumn("status", F.lit("open")).unionByName(o.join(d, "o_orderkey", "left_semi").withColumn("status", F.lit("decided")))


@query("""
SELECT o_orderkey, o_orderstatus || '-' || lpad((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey))::VARCHAR, 6, '0') AS case_id FROM orders""")
def case_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Running numbers per kind: dense numbers over all in one order, less those of the kinds before, so that no kind is one task."""
    o = keep(with_ordinal(table(spark, sf, "orders", "o_orderstatus", "o_orderdate", "o_orderkey"), ["o_orderstatus", "o_orderdate", "o_orderkey"], "n"), "numbers")
    first = o.groupBy("o_orderstatus").agg(F.min("n").alias("first"))
    x = o.join(F.broadcast(first), "o_orderstatus")  # one row per status of an order, a fixed list
    return x.select("o_orderkey", F.concat("o_orderstatus", F.lit("-"), F.lpad((F.col("n") - F.col("first") + 1).cast("string"), 6, "0")).alias("case_id"))


@query("""
SELECT o_orderkey, 'Order of ' || strftime(o_orderdate, '%d %b %Y') || ': ' || format('{:,}', floor(o_totalprice)::BIGINT) AS evidence,
 array_to_string(list_transform(regexp_extract_all(lower(o_orderpriority), '([a-z]+|[^a-z]+)'), lambda w: upper(left(w, 1)) || substr(w, 2)), '') AS title FROM orders""")
def evidence_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with dates and grouped thousands, and titles."""
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    text = F.concat(F.lit("Order of "), F.date_format("o_orderdate", "dd MMM yyyy"), F.lit(": "), F.format_number(F.floor("o_totalprice"), 0))
    return o.select("o_orderkey", text.alias("evidence"), titled(F.col("o_orderpriority")).alias("title"))


@query("""
SELECT c_custkey, to_json({'segment': c_mktsegment, 'nation': c_nationkey::VARCHAR, 'in_debt': CASE WHEN c_acctbal < 0 THEN 'yes' END}) AS fields,
 to_json([{'id': 'balance', 'met': c_acctbal > 5000, 'evidence': c_mktsegment}, {'id': 'nation', 'met': c_nationkey < 10, 'evidence': NULL}]) AS trace FROM customer""")
def json_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as JSON objects with their nulls, and a list of criteria with what was found of each."""
    c = table(spark, sf, "customer", "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    fields = F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"), F.when(F.col("c_acctbal") < 0, "yes").alias("in_debt"))
    crit = lambda id_, met, ev: F.struct(F.lit(id_).alias("id"), met.alias("met"), ev.cast("string").alias("evidence"))
    trace = F.array(crit("balance", F.col("c_acctbal") > 5000, F.col("c_mktsegment")), crit("nation", F.col("c_nationkey") < 10, F.lit(None)))
    nulls = {"ignoreNullFields": "false"}
    return c.select("c_custkey", F.to_json(fields, nulls).alias("fields"), F.to_json(trace, nulls).alias("trace"))


@query("""
SELECT c_custkey, c_acctbal < 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS flagged, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS shown FROM customer
WHERE c_acctbal IS NOT NULL AND (c_acctbal < 1000 OR c_mktsegment LIKE '%ILD%')""")
def prefiltered(spark: SparkSession, sf: str) -> DataFrame:
    """A filter of several conditions, a flag of others, and a value left out in one case."""
    c = table(spark, sf, "customer", "c_custkey", "c_acctbal", "c_mktsegment").filter("c_acctbal IS NOT NULL").filter((F.col("c_acctbal") < 1000) | F.col("c_mktsegment").contains("ILD"))
    o = table(spark, sf, "orders", F.col("o_custkey").alias("c_custkey")).filter("c_custkey IS NOT NULL").distinct().withColumn("ordered", F.lit(True))
    return c.join(o, "c_custkey", "left").select("c_custkey", ((F.col("c_acctbal") < 0) & F.col("ordered").isNull()).alias("flagged"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("shown"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY sha256('7:' || o_orderkey), o_orderkey LIMIT 100")
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A hundred rows chosen by a seed, the same ones whatever the partitions (a sampling operator)."""
    return em.sample_of(table(spark, sf, "orders", "o_orderkey", "o_totalprice"), "o_orderkey", 100, 7)


@query("""
SELECT unit_id, district, pensioners, round(100000.0 * pensioners / sum(pensioners) OVER (), 4) AS target FROM (
SELECT unit_id, district, coalesce(old_age, 0) + coalesce(widow, 0) + coalesce(disability, 0) AS pensioners FROM units) WHERE pensioners > 0""")
def unit_targets(spark: SparkSession, sf: str) -> DataFrame:
    """A population shared out among units in proportion to their pensioners; units without any are left out."""
    n = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("old_age", "widow", "disability")), F.lit(0))
    u = table(spark, sf, "units", "unit_id", "district", "old_age", "widow", "disability").select("unit_id", "district", n.alias("pensioners")).filter("pensioners > 0")
    total = u.agg(F.sum("pensioners").alias("all"))  # one row
    return u.join(F.broadcast(total)).select("unit_id", "district", "pensioners", F.round(100000.0 * F.col("pensioners") / F.col("all"), 4).alias("target"))


@query("WITH p AS (SELECT regexp_replace(aadhaar, '\\s', '', 'g') AS a, min(record_id) AS k FROM pension WHERE aadhaar IS NOT NULL GROUP BY 1) SELECT record_id, k AS matched, CASE WHEN k IS NOT NULL THEN 'aadhaar' END AS via FROM kisan LEFT JOIN p ON regexp_replace(aadhaar, '\\s', '', 'g') = a")
def upload_by_number(spark: SparkSession, sf: str) -> DataFrame:
    """A department's whole file against pension records in the standard layout, by the tokens of its number column."""
    from tallyloom.plans.standardise import load_all

    return match_upload(table(spark, sf, "kisan", "record_id", "aadhaar"), load_all(spark, sf, DEMO_KEY, ["pension"]), "record_id", DEMO_KEY, {"aadhaar": "aadhaar"}).drop("aadhaar")


# ---- logs ----------------------------------------------------------------------------------------------------------

_LABEL = {"click": "opened", "view": "listed", "purchase": "decided"}


@query(f"SELECT event_id, user_id, event_type, CASE event_type {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in _LABEL.items())} ELSE event_type END AS label FROM events WHERE user_id <= 50 AND event_type = 'click' ORDER BY event_id DESC LIMIT 100 OFFSET 20")
def audit_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of a role's own entries of one action, newest first, with labels (the limit is the page; the role's rows are
    filtered before it)."""
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in _LABEL.items() for x in kv])[F.col("event_type")], F.col("event_type"))
    e = table(spark, sf, "events", "event_id", "user_id", "event_type").filter("user_id <= 50 AND event_type = 'click'")
    return e.orderBy(F.desc("event_id")).offset(20).limit(100).withColumn("label", label)


@query("SELECT user_id, event_id, event_type, nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events WHERE user_id IS NOT NULL) WHERE nth <= 30")
def object_history(spark: SparkSession, sf: str) -> DataFrame:
    """The thirty newest entries of each object, however old (the limit is the report's)."""
    w = W.partitionBy("user_id").orderBy(F.desc("event_id"))
    return table(spark, sf, "events", "user_id", "event_id", "event_type").filter("user_id IS NOT NULL").withColumn("nth", F.row_number().over(w)).filter("nth <= 30")


@query("SELECT user_id, arg_max(event_type, event_id) AS decision FROM events WHERE event_type <> 'view' AND user_id IS NOT NULL GROUP BY 1")
def latest_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """The newest decision on each object."""
    from tallyloom.operators.chain import latest

    e = table(spark, sf, "events", "user_id", "event_id", "event_type").filter("event_type <> 'view' AND user_id IS NOT NULL")
    return latest(e, "user_id", "event_id", "event_type").withColumnRenamed("event_type", "decision")


# ---- aggregates as served ------------------------------------------------------------------------------------------


@query(f"""
WITH u AS (SELECT upper(trim(block)) AS blk, sum(old_age)::BIGINT AS listed FROM units GROUP BY 1),
p AS (SELECT upper(trim(block)) AS blk, count(*) AS people, count(*) FILTER (WHERE register = 'pension') AS pensions, count(*) FILTER (WHERE register = 'death') AS deaths FROM standard WHERE {_IN_BLOCKS} GROUP BY 1)
SELECT blk AS block, people, pensions, CASE WHEN deaths BETWEEN 1 AND 24 THEN NULL ELSE deaths END AS deaths, listed FROM p LEFT JOIN u USING (blk)""")
def planning_view(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per block of a role's posting beside the counts listed for the block, small cells left out."""
    s = GovernedSession(spark, {"s": table(spark, sf, "standard", "block", "register")}, Role("planner", blocks=BLOCKS)).scoped("s")
    blk = F.upper(F.trim("block")).alias("block")
    p = s.groupBy(blk).agg(F.count("*").alias("people"), F.count_if(F.col("register") == "pension").alias("pensions"), F.count_if(F.col("register") == "death").alias("deaths"))
    u = table(spark, sf, "units", "block", "old_age").groupBy(blk).agg(F.sum("old_age").alias("listed"))
    return p.join(u, "block", "left").select("block", "people", "pensions", masks.suppress(F.col("deaths"), 25).alias("deaths"), "listed")


_P = ["ration", "pension", "mgnrega", "kisan"]


@query(
    "WITH p AS (SELECT cluster_id, " + ", ".join(f"bool_or(register = '{f}') AS {f}" for f in _P) + " FROM standard JOIN clusters USING (unique_id) WHERE cluster_id IS NOT NULL GROUP BY 1), c AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE {a} AND {b}) AS n FROM p" for a in _P for b in _P)
    + ") SELECT a, b, CASE WHEN n BETWEEN 1 AND 99 THEN NULL ELSE n END AS n FROM c"
)
def overlap_view(spark: SparkSession, sf: str) -> DataFrame:
    """The overlap of a role's programmes, each cell under both orders, small cells left out."""
    role = Role("reader", programmes=tuple(_P), min_cell=100)
    p = linked(spark, sf, "register").groupBy("cluster_id").agg(*[F.bool_or(F.col("register") == f).alias(f) for f in role.programmes])
    x = A.overlap(p, [], {f: F.col(f) for f in role.programmes})
    both = x.unionByName(x.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    return both.select("a", "b", masks.suppress(F.col("n"), role.min_cell).alias("n"))


@query("""
WITH c AS (SELECT o_orderstatus AS kind, o_orderpriority AS type, count(*) AS n, sum(o_totalprice) AS amount FROM orders GROUP BY 1, 2),
t AS (SELECT kind, sum(n)::BIGINT AS n, round(sum(amount), 2) AS amount, round(sum(amount) FILTER (WHERE type <> '5-LOW'), 2) AS without_low, max(n) AS most FROM c GROUP BY 1)
SELECT kind, n, amount, without_low, most, row_number() OVER (ORDER BY n DESC, kind) AS nth FROM t""")
def totals_view(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by kind and type summed once more by kind, the largest first."""
    c = table(spark, sf, "orders", "o_orderstatus", "o_orderpriority", "o_totalprice").groupBy(F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("type"))
    c = c.agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("amount"))
    t = c.groupBy("kind").agg(F.sum("n").alias("n"), F.round(F.sum("amount"), 2).alias("amount"), F.round(F.sum(F.when(F.col("type") != "5-LOW", F.col("amount"))), 2).alias("without_low"), F.max("n").alias("most"))
    # a row per kind of an order, a fixed list
    return t.withColumn("nth", F.row_number().over(W.orderBy(F.desc("n"), "kind")))


@query(f"""
WITH s AS (SELECT *, {_IN_BLOCKS} AS mine FROM standard)
SELECT register, sum(coalesce(mine, false)::INT)::BIGINT AS in_scope, count(*) - sum(coalesce(mine, false)::INT)::BIGINT AS refused, CASE WHEN count(*) FILTER (WHERE mine AND birth_exact) BETWEEN 1 AND 9 THEN NULL ELSE count(*) FILTER (WHERE mine AND birth_exact) END AS exact
FROM s GROUP BY 1""")
def overview(spark: SparkSession, sf: str) -> DataFrame:
    """Records per register that a role may see and those refused, in one pass."""
    s = table(spark, sf, "standard", "register", "block", "birth_exact")
    mine = F.coalesce(F.upper(F.trim("block")).isin(*BLOCKS), F.lit(False))
    g = s.groupBy("register").agg(F.count_if(mine).alias("in_scope"), F.count_if(~mine).alias("refused"), F.count_if(mine & F.col("birth_exact")).alias("exact"))
    return g.select("register", "in_scope", "refused", masks.suppress(F.col("exact"), 10).alias("exact"))


# ---- evaluation ----------------------------------------------------------------------------------------------------


@query("""
WITH x AS (SELECT unique_id, script, register, aadhaar_token AS t, cluster_id FROM standard LEFT JOIN clusters USING (unique_id) WHERE aadhaar_token IS NOT NULL),
g AS (SELECT t FROM x GROUP BY 1 HAVING count(*) BETWEEN 2 AND 60), p AS (
SELECT a.script AS sa, b.script AS sb, a.register AS ra, b.register AS rb, coalesce(a.cluster_id = b.cluster_id, false) AS found FROM x a JOIN x b ON a.t = b.t AND a.unique_id < b.unique_id WHERE a.t IN (SELECT t FROM g))
SELECT grp, count(*) AS pairs, count(*) FILTER (WHERE found) AS found, round(avg(found::INT), 4) AS recall FROM (
SELECT 'all' AS grp, found FROM p UNION ALL SELECT 'across scripts', found FROM p WHERE sa <> sb UNION ALL SELECT 'within script', found FROM p WHERE sa = sb UNION ALL SELECT 'across registers', found FROM p WHERE ra <> rb UNION ALL SELECT 'within register', found FROM p WHERE ra = rb) GROUP BY 1""")
def recall_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """How many pairs that share a number (of 2 to 60 records) an earlier grouping holds together, by kind of pair."""
    x = table(spark, sf, "standard", "unique_id", "script", "register", "aadhaar_token").filter("aadhaar_token IS NOT NULL").join(table(spark, sf, "clusters", "unique_id", "cluster_id"), "unique_id", "left")
    g = x.groupBy("aadhaar_token").agg(F.count("*").alias("n")).filter("n BETWEEN 2 AND 60").select("aadhaar_token")
    x = x.join(g, "aadhaar_token", "left_semi")
    a, b = x.alias("a"), x.alias("b")
    p = a.join(b, (F.col("a.aadhaar_token") == F.col("b.aadhaar_token")) & (F.col("a.unique_id") < F.col("b.unique_id")))
    kinds = {"all": F.lit(True), "across scripts": F.col("a.script") != F.col("b.script"), "within script": F.col("a.script") == F.col("b.script"), "across registers": F.col("a.register") != F.col("b.register"), "within register": F.col("a.register") == F.col("b.register")}
    found = F.coalesce(F.col("a.cluster_id") == F.col("b.cluster_id"), F.lit(False))
    p = p.select(found.alias("found"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))).alias("grp"))
    return p.groupBy("grp").agg(F.count("*").alias("pairs"), F.count_if("found").alias("found"), F.round(F.avg(F.col("found").cast("int")), 4).alias("recall"))


@query("""
WITH planted AS (SELECT cluster_id FROM standard JOIN clusters USING (unique_id) WHERE register = 'death' AND cluster_id IS NOT NULL GROUP BY 1),
flagged AS (SELECT cluster_id FROM standard JOIN clusters USING (unique_id) WHERE register IN ('pension', 'mgnrega') AND birth_year < 1950 AND cluster_id IS NOT NULL GROUP BY 1),
n AS (SELECT count(*) FILTER (WHERE p.cluster_id IS NOT NULL) AS planted, count(*) FILTER (WHERE f.cluster_id IS NOT NULL) AS flagged, count(*) FILTER (WHERE p.cluster_id IS NOT NULL AND f.cluster_id IS NOT NULL) AS both_ FROM planted p FULL JOIN flagged f ON p.cluster_id = f.cluster_id)
SELECT *, round(both_ / planted, 4) AS recall, round(both_ / flagged, 4) AS precision FROM n""")
def planted_and_flagged(spark: SparkSession, sf: str) -> DataFrame:
    """Recall and precision of a rule against known cases, by a full outer join of the two sets."""
    x = linked(spark, sf, "register", "birth_year")
    p = x.filter("register = 'death'").select("cluster_id").distinct().withColumn("p", F.lit(1))
    f = x.filter("register IN ('pension', 'mgnrega') AND birth_year < 1950").select("cluster_id").distinct().withColumn("f", F.lit(1))
    n = p.join(f, "cluster_id", "full").agg(F.count("p").alias("planted"), F.count("f").alias("flagged"), F.count_if(F.col("p").isNotNull() & F.col("f").isNotNull()).alias("both_"))
    return n.select("*", F.round(F.col("both_") / F.col("planted"), 4).alias("recall"), F.round(F.col("both_") / F.col("flagged"), 4).alias("precision"))


@query("""
WITH v AS (SELECT cluster_id, aadhaar_token, count(*) AS n FROM standard JOIN clusters USING (unique_id) WHERE aadhaar_token IS NOT NULL AND cluster_id IS NOT NULL GROUP BY 1, 2)
SELECT cluster_id, aadhaar_token AS voted, n FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, aadhaar_token) AS k FROM v) WHERE k = 1""")
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    """The number that most records of a group state, the smaller of equals."""
    return A.most_common(linked(spark, sf, "aadhaar_token"), "cluster_id", "aadhaar_token", "voted")


@query()
def linkage_first_pass(spark: SparkSession, sf: str) -> DataFrame:
    """The groups of the first pass of the linkage, before households are looked at."""
    from tallyloom.plans.link import link
    from tallyloom.plans.relational import delivered_once

    return link(delivered_once(spark, sf), "P", household=False)[1]


@query()
def linkage_largest(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty largest groups of the linkage with their given names and places: where strangers were merged, it shows here
    (the limit is the report's)."""
    from tallyloom.plans.relational import linkage

    g = keep(linkage(spark, sf), "groups")
    s = table(spark, sf, "standard", "unique_id", "skel_first", "panchayat_key")
    x = g.join(s, "unique_id").groupBy("cluster_id").agg(F.count("*").alias("records"), F.count_distinct("skel_first").alias("names"), F.count_distinct("panchayat_key").alias("places"))
    return x.orderBy(F.desc("records"), "cluster_id").limit(20)

