"""Core queries: each operator family over whole driver tables, with its SQL equivalent where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import masks
from tallyloom.functions.text import FOLDS, fold_word, place_key, skeleton, split_name
from tallyloom.functions.tokens import clk, dice, hmac_sha256
from tallyloom.operators import aggregates as A
from tallyloom.operators.blocking import block_pairs, block_rows, jaro_winkler, levels, near_misses
from tallyloom.operators.chain import GENESIS, checked, digest
from tallyloom.operators.components import components
from tallyloom.operators.govern import GovernedSession, Role
from tallyloom.plans.link import COLS, encode, link
from tallyloom.plans.standardise import load_all
from tallyloom.session import TODAY, keep
from tallyloom.sources.tables import table, with_ordinal
from tallyloom.streaming.events import hourly

QUERIES: dict = {}
ORACLE: dict = {}
#: A key for the demonstration queries only; linkage proper reads its key from the environment.
DEMO_KEY = b"demonstration"


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""
WITH o AS (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1),
p AS (SELECT r_name AS district, n_name AS block, count(*) AS people, count(*) FILTER (WHERE c_acctbal < 0) AS in_debt,
  count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 5000) AS machinery_rich,
  coalesce(sum(orders), 0)::BIGINT AS orders
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN o ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT district, block, people, CASE WHEN in_debt BETWEEN 1 AND 9 THEN NULL ELSE in_debt END AS in_debt, CASE WHEN building BETWEEN 1 AND 9 THEN NULL ELSE building END AS building,
  CASE WHEN machinery_rich BETWEEN 1 AND 9 THEN NULL ELSE machinery_rich END AS machinery_rich, orders FROM p""")
def planning_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    """Conditional counts per district and block with suppressed small cells."""
    c, n, r = table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), table(spark, sf, "nation"), table(spark, sf, "region")
    o = table(spark, sf, "orders", "o_custkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    # nation and region are fixed tables of 25 and 5 rows
    x = c.join(F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)), c.c_nationkey == n.n_nationkey).join(o, "c_custkey", "left")
    g = x.groupBy(F.col("r_name").alias("district"), F.col("n_name").alias("block")).agg(
        F.count("*").alias("people"), F.count_if(F.col("c_acctbal") < 0).alias("in_debt"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"),
        F.count_if((F.col("c_mktsegment") == "MACHINERY") & (F.col("c_acctbal") > 5000)).alias("machinery_rich"), F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"),
    )
    return g.select("district", "block", "people", *[masks.suppress(F.col(c), 10).alias(c) for c in ("in_debt", "building", "machinery_rich")], "orders").orderBy("district", "block")


@query("""
SELECT 'customer:' || c_custkey AS record_id, 'customer' AS register, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, NULL::INT AS size FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, s_acctbal, NULL, NULL FROM supplier
UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, NULL, NULL, p_size FROM part""")
def unify_registers(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of different columns in one layout; a column that a table lacks is null."""
    parts = []
    for name, k, cols in (("customer", "c_custkey", {"name": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment"}), ("supplier", "s_suppkey", {"name": "s_name", "balance": "s_acctbal"}), ("part", "p_partkey", {"name": "p_name", "size": "p_size"})):
        t = table(spark, sf, name, k, *cols.values())
        parts.append(t.select(F.concat(F.lit(name + ":"), F.col(k)).alias("record_id"), F.lit(name).alias("register"), *[F.col(v).alias(o) for o, v in cols.items()]))
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True).select("record_id", "register", "name", "balance", "segment", "size")


_IPAD, _OPAD = (("".join(f"\\x{b ^ x:02X}" for b in DEMO_KEY.ljust(64, b"\0"))) for x in (0x36, 0x5C))


@query(f"SELECT c_custkey, left(sha256('{_OPAD}'::BLOB || unhex(sha256('{_IPAD}'::BLOB || encode(c_name)))), 20) AS token FROM customer")
def tokenise_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed tokens of identifiers."""
    return table(spark, sf, "customer", "c_custkey", "c_name").select("c_custkey", F.substring(hmac_sha256(F.col("c_name"), DEMO_KEY), 1, 20).alias("token"))


def _sql_fold(x: str) -> str:
    x = f"regexp_replace(lower({x}), '[^a-z]', '', 'g')"
    for a, b in FOLDS:
        x = f"replace({x}, '{a}', '{b}')"
    for c in "abcdefghijklmnopqrstuvwxyz":
        x = f"regexp_replace({x}, '{c}+', '{c}', 'g')"
    return f"regexp_replace({x}, '([bcdfgjklmnpqrstvx])h', '\\1', 'g')"


@query(f"""
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), f AS (SELECT word, {_sql_fold("word")} AS x FROM w),
g AS (SELECT word, CASE WHEN length(x) > 3 THEN regexp_replace(x, 'a$', '') ELSE x END AS folded FROM f)
SELECT word, folded, left(folded, 1) || regexp_replace(substr(folded, 2), '[aeiou]', '', 'g') AS skeleton FROM g""")
def fold_names(spark: SparkSession, sf: str) -> DataFrame:
    """Phonetic folding and consonant skeletons of distinct words."""
    w = table(spark, sf, "part", "p_name").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return w.withColumn("folded", fold_word(F.lower("word"))).withColumn("skeleton", skeleton(F.col("folded")))


@query()
def split_names(spark: SparkSession, sf: str) -> DataFrame:
    """Name parts of every distinct name in standard, in either script."""
    return table(spark, sf, "standard", "name").distinct().select("name", split_name(F.col("name")).alias("p")).select("name", "p.*")


@query()
def place_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of every distinct place that pension and ration were typed with."""
    t = table(spark, sf, "pension", "gram_panchayat").unionByName(table(spark, sf, "ration", F.col("village").alias("gram_panchayat")))
    return t.filter("gram_panchayat IS NOT NULL").distinct().select(F.col("gram_panchayat").alias("place"), place_key(F.col("gram_panchayat")).alias("place_key"))


_BLOCKS = "x.p_brand = y.p_brand AND x.p_type = y.p_type AND abs(x.p_size - y.p_size) <= 3"


@query(f"""
SELECT DISTINCT l, r FROM (
SELECT x.p_partkey AS l, y.p_partkey AS r FROM part x JOIN part y ON x.p_name = y.p_name AND x.p_size = y.p_size AND x.p_partkey < y.p_partkey
UNION ALL SELECT x.p_partkey, y.p_partkey FROM part x JOIN part y ON {_BLOCKS} AND x.p_partkey < y.p_partkey)""")
def blocking_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate pairs of two blocking rules, the second with a band."""
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return block_pairs(p, "p_partkey", [(["p_name", "p_size"], None), (["p_brand", "p_type"], None, ("p_size", 3))])


@query(f"""
WITH p AS (SELECT x.p_name a, y.p_name b, x.p_size sa, y.p_size sb, x.p_retailprice ra, y.p_retailprice rb FROM part x JOIN part y ON {_BLOCKS} AND x.p_partkey < y.p_partkey),
g AS (SELECT CASE WHEN a IS NULL OR b IS NULL THEN -1 WHEN a = b THEN 3 WHEN jaro_winkler_similarity(a, b) >= 0.88 THEN 2 WHEN left(a, 1) = left(b, 1) THEN 1 ELSE 0 END AS gamma_name,
  CASE WHEN sa = sb THEN 2 WHEN abs(sa - sb) <= 1 THEN 1 ELSE 0 END AS gamma_size, CASE WHEN abs(ra - rb) < 50 THEN 1 ELSE 0 END AS gamma_price FROM p)
SELECT gamma_name, gamma_size, gamma_price, count(*) AS n FROM g GROUP BY 1, 2, 3""")
def gamma_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a block counted by their vector of comparison levels."""
    p, c, no = table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), F.col, F.lit(False)
    (j,) = block_rows(p, "p_partkey", [(["p_brand", "p_type"], None, ("p_size", 3))])
    size = levels(no, c("p_size_l") == c("p_size_r"), F.abs(c("p_size_l") - c("p_size_r")) <= 1).alias("gamma_size")
    price = levels(no, F.abs(c("p_retailprice_l") - c("p_retailprice_r")) < 50).alias("gamma_price")
    # counted by their names first, so that each two names are compared once, not once a pair
    j = j.groupBy(c("p_name_l").alias("a"), c("p_name_r").alias("b"), size, price).agg(F.count("*").alias("pairs"))
    j = j.withColumn("jw", F.when(c("a") != c("b"), jaro_winkler("a", "b")))
    name = levels(c("a").isNull() | c("b").isNull(), c("a") == c("b"), c("jw") >= 0.88, F.substring("a", 1, 1) == F.substring("b", 1, 1))
    g = j.groupBy(name.alias("gamma_name"), "gamma_size", "gamma_price").agg(F.sum("pairs").alias("n"))
    return g.select(*[F.col(k).cast("int").alias(k) for k in ("gamma_name", "gamma_size", "gamma_price")], "n")


_NEAR = """x.p_brand = y.p_brand AND x.p_partkey <> y.p_partkey AND ((x.p_name = y.p_name AND coalesce(abs(x.p_size - y.p_size), 0) <= 5)
 OR (left(x.p_name, 1) = left(y.p_name, 1) AND abs(x.p_size - y.p_size) <= 2 AND jaro_winkler_similarity(x.p_type, y.p_type) >= 0.88))"""


def _near(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part", "p_partkey", "p_brand", "p_name", "p_type", "p_size")
    return near_misses(p, p, "p_partkey", ["p_brand"], exact="p_name", text="p_type", year="p_size", years=5)


@query(f"SELECT p_partkey FROM part x WHERE EXISTS (SELECT 1 FROM part y WHERE {_NEAR})")
def near_miss_semi(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with a near miss."""
    return _near(spark, sf)


@query(f"SELECT p_partkey FROM part x WHERE NOT EXISTS (SELECT 1 FROM part y WHERE {_NEAR})")
def near_miss_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Parts without one."""
    return table(spark, sf, "part", "p_partkey").join(_near(spark, sf), "p_partkey", "left_anti")


_LINKED = "SELECT a.l_orderkey AS d1, b.l_orderkey AS d2, count(DISTINCT a.l_partkey) AS shared FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_orderkey < b.l_orderkey GROUP BY 1, 2 HAVING count(DISTINCT a.l_partkey) >= 2"


@query(_LINKED)
def linked_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that share two parts or more."""
    return A.linked_groups(table(spark, sf, "lineitem", "l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")


@query(f"WITH p AS ({_LINKED}) SELECT d1, d2 FROM p WHERE d1 IN (SELECT d1 FROM p GROUP BY 1 HAVING count(*) = 1) AND d2 IN (SELECT d2 FROM p GROUP BY 1 HAVING count(*) = 1)")
def mutual_unique(spark: SparkSession, sf: str) -> DataFrame:
    """Linked orders that occur once on either side."""
    return A.once_on_both_sides(keep(linked_documents(spark, sf).select("d1", "d2"), "linked"), "d1", "d2")


@query("""
WITH RECURSIVE e AS (SELECT unique_id_l a, unique_id_r b FROM pairs WHERE match_probability >= 0.9 AND unique_id_l <> unique_id_r),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(v, g) AS (SELECT DISTINCT a, a FROM s UNION SELECT s.b, r.g FROM r JOIN s ON s.a = r.v)
SELECT v AS vertex, min(g) AS root FROM r GROUP BY v""")
def connected_records(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components of the likely pairs."""
    p = table(spark, sf, "pairs", "unique_id_l", "unique_id_r", "match_probability").filter("match_probability >= 0.9")
    return components(p, "unique_id_l", "unique_id_r")


@query("SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2)) WHERE k = 1")
def most_common(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's most frequent event type, the smaller of equals."""
    return A.most_common(table(spark, sf, "events", "user_id", "event_type"), "user_id", "event_type")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def first_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's first order."""
    o = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return A.first_in_order(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_totalprice"])


@query("SELECT o_custkey, count(*) AS sources, (max(y) - min(y))::DOUBLE AS spread, round_even(median(y), 0)::BIGINT AS median_even FROM (SELECT o_custkey, year(o_orderdate) AS y FROM orders) GROUP BY 1")
def median_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Count, range and half-even median of each customer's order years."""
    return A.center(table(spark, sf, "orders", "o_custkey", "o_orderdate").withColumn("y", F.year("o_orderdate")), "o_custkey", "y")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) - 1 AS nth, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS size FROM orders")
def duplicates_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The repeats of each customer and priority."""
    return A.numbered(table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority"), ["o_custkey", "o_orderpriority"], [F.col("o_orderkey")]).select("o_orderkey", "nth", "size")


@query("SELECT account_token AS account, count(DISTINCT cluster_id) AS holders FROM standard JOIN clusters USING (unique_id) WHERE account_token IS NOT NULL GROUP BY 1 HAVING count(DISTINCT cluster_id) >= 3")
def shared_account(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts of three groups or more."""
    x = table(spark, sf, "standard", "unique_id", "account_token").join(table(spark, sf, "clusters", "unique_id", "cluster_id"), "unique_id")
    return A.shared_by(x, "account_token", "cluster_id", 3).withColumnRenamed("account_token", "account")


_FLAGS = ["ration", "pension", "mgnrega", "kisan", "udid", "treasury"]


@query(
    "WITH p AS (SELECT cluster_id, min(script) AS script, " + ", ".join(f"bool_or(register = '{f}') AS {f}" for f in _FLAGS) + " FROM standard JOIN clusters USING (unique_id) GROUP BY 1) "
    + " UNION ALL ".join(f"SELECT script, '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE {a} AND {b}) AS n FROM p GROUP BY script" for i, a in enumerate(_FLAGS) for b in _FLAGS[i:])
)
def overlap_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """How many groups two registers share, in long form."""
    x = table(spark, sf, "standard", "unique_id", "register", "script").join(table(spark, sf, "clusters", "unique_id", "cluster_id"), "unique_id")
    p = x.groupBy("cluster_id").agg(F.min("script").alias("script"), *[F.bool_or(F.col("register") == f).alias(f) for f in _FLAGS])
    return A.overlap(p, ["script"], {f: F.col(f) for f in _FLAGS})


@query("""
SELECT o_orderkey, o_orderpriority, o_totalprice, array_to_string(list_transform(list_filter(string_split_regex(c_name, '\\s+'), lambda x: x <> ''), lambda x: left(x, 1) || repeat('•', greatest(2, length(x) - 1))), ' ') AS name
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""")
def case_list_page(spark: SparkSession, sf: str) -> DataFrame:
    """One page of a ranked list with masked names; the limit is the page."""
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    x = o.join(table(spark, sf, "customer", F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    g = GovernedSession(spark, {"orders": x.withColumnRenamed("c_name", "name")}, Role("reader", people=True))
    return g.page("orders", {"o_orderstatus": "O"}, [rank, F.desc("o_totalprice"), "o_orderkey"], 100, 50, names=("name",)).select("o_orderkey", "o_orderpriority", "o_totalprice", "name")


@query("""
WITH d AS (SELECT l_orderkey, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, max(days)::INT AS days, floor(max(days) / 30)::INT AS months, count(*) AS n_late FROM d WHERE days > 90 GROUP BY 1""")
def days_after(spark: SparkSession, sf: str) -> DataFrame:
    """Rows dated more than a grace of 90 days after another table's date, in days and 30-day months."""
    x = table(spark, sf, "lineitem", "l_orderkey", "l_shipdate").join(table(spark, sf, "orders", F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    x = x.withColumn("days", F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))).filter("days > 90")
    return x.groupBy("l_orderkey").agg(F.max("days").alias("days"), F.floor(F.max("days") / 30).cast("int").alias("months"), F.count("*").alias("n_late"))


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    """A field of a JSON text, counted."""
    e = table(spark, sf, "events", "event_type", "props").withColumn("k", F.from_json("props", "map<string,string>")["k"])
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("""
WITH x AS (SELECT cluster_id AS p, aadhaar_token AS t FROM clusters JOIN standard USING (unique_id) WHERE aadhaar_token IS NOT NULL),
c AS (SELECT count(*) AS s FROM x GROUP BY p, t), a AS (SELECT count(*) AS s FROM x GROUP BY p), b AS (SELECT count(*) AS s FROM x GROUP BY t),
n AS (SELECT (SELECT sum(s * (s - 1) // 2) FROM b)::BIGINT AS true_pairs, (SELECT sum(s * (s - 1) // 2) FROM a)::BIGINT AS predicted_pairs, (SELECT sum(s * (s - 1) // 2) FROM c)::BIGINT AS common_pairs)
SELECT *, round(common_pairs / predicted_pairs, 4) AS precision, round(common_pairs / true_pairs, 4) AS recall FROM n""")
def pair_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Pairwise agreement of two groupings, by group sizes alone."""
    x = table(spark, sf, "clusters", "unique_id", "cluster_id").join(table(spark, sf, "standard", "unique_id", "aadhaar_token").filter("aadhaar_token IS NOT NULL"), "unique_id")
    return A.pair_counts(x, "cluster_id", "aadhaar_token")


@query("""
WITH x AS (SELECT p.unique_id_l, p.unique_id_r, l.register || '-' || r.register AS a, r.register || '-' || l.register AS b, l.register <= r.register AS up, (c.cluster_id = d.cluster_id) AS same
  FROM pairs p JOIN standard l ON l.unique_id = p.unique_id_l JOIN standard r ON r.unique_id = p.unique_id_r LEFT JOIN clusters c ON c.unique_id = p.unique_id_l LEFT JOIN clusters d ON d.unique_id = p.unique_id_r)
SELECT CASE WHEN up THEN a ELSE b END AS registers, count(*) AS pairs, round(avg(coalesce(same, false)::INT), 4) AS share_together FROM x GROUP BY 1""")
def group_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the pairs of two registers that an earlier grouping holds together."""
    s, c = table(spark, sf, "standard", "unique_id", "register"), table(spark, sf, "clusters", "unique_id", "cluster_id")
    who = s.join(c, "unique_id", "left")
    side = lambda k: who.select(F.col("unique_id").alias(f"unique_id_{k}"), F.col("register").alias(f"reg_{k}"), F.col("cluster_id").alias(f"c_{k}"))
    x = table(spark, sf, "pairs", "unique_id_l", "unique_id_r").join(side("l"), "unique_id_l").join(side("r"), "unique_id_r")
    same = F.coalesce((F.col("c_l") == F.col("c_r")).cast("int"), F.lit(0))
    return x.groupBy(F.concat_ws("-", F.least("reg_l", "reg_r"), F.greatest("reg_l", "reg_r")).alias("registers")).agg(F.count("*").alias("pairs"), F.round(F.avg(same), 4).alias("share_together"))


_DIGEST = "sha256('[\"' || event_id || '\", \"' || user_id || '\", \"' || event_type || '\"]')"


@query(f"""
WITH w AS (SELECT event_id, user_id, event_type, {_DIGEST} AS own FROM events),
l AS (SELECT event_id, user_id, CASE WHEN event_id IN (77, 778) THEN 'altered' ELSE event_type END AS event_type, own, coalesce(lag(own) OVER (ORDER BY event_id), repeat('0', 64)) AS prev FROM w),
g AS (SELECT * FROM l WHERE event_id NOT IN (36, 500, 501))
SELECT event_id, CASE WHEN prev <> coalesce(lag(own) OVER (ORDER BY event_id), repeat('0', 64)) THEN 'chain broken' WHEN own <> {_DIGEST} THEN 'entry altered' END AS reason FROM g""")
def hash_chain_check(spark: SparkSession, sf: str) -> DataFrame:
    """A numbered log with two gaps and two altered entries, checked entry by entry."""
    e = table(spark, sf, "events", "event_id", "user_id", "event_type")
    w = e.withColumn("own", digest(F.col("event_id"), F.col("user_id"), F.col("event_type")))
    w = w.join(w.select((F.col("event_id") + 1).alias("event_id"), F.col("own").alias("prev")), "event_id", "left").withColumn("prev", F.coalesce("prev", F.lit(GENESIS)))
    log = w.withColumn("event_type", F.when(F.col("event_id").isin(77, 778), "altered").otherwise(F.col("event_type"))).filter(~F.col("event_id").isin(36, 500, 501))
    return checked(log, "event_id", "prev", "own", ["event_id", "user_id", "event_type"]).select("event_id", "reason")


_B = "•"


_FIELDS = ["applicant_name", "father_husband_name", "dob", "pension_id", "bank_account", "aadhaar", "mobile", "status"]


def _sql_number(c: str, keep: int) -> str:
    d = f"regexp_replace({c}, '\\D', '', 'g')"
    return f"CASE WHEN length({d}) <= {keep} THEN repeat('{_B}', length({c})) ELSE repeat('{_B}', length({d}) - {keep}) || right({d}, {keep}) END"


def _sql_name(c: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> ''), lambda x: substr(x, 1, 1) || repeat('{_B}', greatest(2, length(x) - 1))), ' ')"


@query(f"""
SELECT record_id, {_sql_name("applicant_name")} AS applicant_name, {_sql_name("father_husband_name")} AS father_husband_name, CASE WHEN dob = '' THEN dob ELSE '{_B}{_B}-{_B}{_B}-' || right(dob, 4) END AS dob,
 CASE WHEN regexp_matches(pension_id, '\\d') THEN {_sql_number("pension_id", 3)} ELSE pension_id END AS pension_id, {_sql_number("bank_account", 4)} AS bank_account, {_sql_number("aadhaar", 4)} AS aadhaar, {_sql_number("mobile", 2)} AS mobile, status
FROM (SELECT DISTINCT record_id, {", ".join(_FIELDS)} FROM pension)""")
def mask_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of every pension record as one who may not open it sees them."""
    p = table(spark, sf, "pension", "record_id", *_FIELDS).distinct()
    m = masks.mask_fields(F.map_from_arrays(F.array(*map(F.lit, _FIELDS)), F.array(*map(F.col, _FIELDS))), F.lit(False))
    return p.select("record_id", m.alias("m")).select("record_id", *[F.col("m")[f].alias(f) for f in _FIELDS])


@query()
def bloom_dice(spark: SparkSession, sf: str) -> DataFrame:
    """Dice similarity of the Bloom filters of distinct names that share a word: each distinct name is encoded once."""
    n = table(spark, sf, "part", "p_name").distinct()
    e = keep(n.withColumn("b", clk(F.lower("p_name"), DEMO_KEY, "f")), "clk")
    w = e.select("p_name", "b", F.explode(F.split("p_name", " ")).alias("w"))
    x = w.alias("x").join(w.alias("y"), (F.col("x.w") == F.col("y.w")) & (F.col("x.p_name") < F.col("y.p_name")))
    return x.select(F.col("x.p_name").alias("a"), F.col("y.p_name").alias("b"), F.round(dice(F.col("x.b"), F.col("y.b")), 4).alias("dice")).distinct()


def delivered_once(spark: SparkSession, sf: str) -> DataFrame:
    """The records of standard as first delivered, with the columns that the linkage reads."""
    s = table(spark, sf, "standard", *COLS, "loaded_at")
    return A.first_in_order(s, ["record_id"], [F.col("loaded_at"), F.col("unique_id")], [c for c in COLS if c != "record_id"])


@query()
def linkage(spark: SparkSession, sf: str) -> DataFrame:
    """The whole linkage of standard records: groups by blocking, levels, model, strong edges, households and components."""
    return link(delivered_once(spark, sf))[1]


@query()
def linkage_blinded(spark: SparkSession, sf: str) -> DataFrame:
    """The same over Bloom-filter encodings of names; no clear name enters it."""
    one, codes = encode(keep(delivered_once(spark, sf), "delivered"), DEMO_KEY)
    return link(one, "B", codes)[1]


@query("""
SELECT r.cluster_id, count(*) AS records, bool_or(aadhaar_token IS NOT NULL) AS has_aadhaar, string_agg(DISTINCT register, ',' ORDER BY register) AS registers, strftime(min(birth_date) FILTER (WHERE birth_exact), '%Y-%m-%d') AS first_exact,
 round_even(median(birth_year), 0)::BIGINT AS birth_year, bool_or(register = 'mgnrega') AS mgnrega, (count(*) FILTER (WHERE register = 'death')) = 0 AS alive, max(loaded_at) AS seen
FROM clusters r JOIN standard USING (unique_id) WHERE r.cluster_id IS NOT NULL GROUP BY 1""")
def people(spark: SparkSession, sf: str) -> DataFrame:
    """One row per person: counts, presence, sorted registers, dates."""
    x = table(spark, sf, "clusters", "unique_id", "cluster_id").join(table(spark, sf, "standard", "unique_id", "register", "aadhaar_token", "birth_date", "birth_exact", "birth_year", "loaded_at"), "unique_id")
    return x.groupBy("cluster_id").agg(
        F.count("*").alias("records"), (F.count("aadhaar_token") > 0).alias("has_aadhaar"), F.array_join(F.array_sort(F.collect_set("register")), ",").alias("registers"),
        F.date_format(F.min(F.when(F.col("birth_exact"), F.col("birth_date"))), "yyyy-MM-dd").alias("first_exact"), F.bround(F.median("birth_year"), 0).cast("long").alias("birth_year"),
        F.bool_or(F.col("register") == "mgnrega").alias("mgnrega"), (F.count_if(F.col("register") == "death") == 0).alias("alive"), F.max("loaded_at").alias("seen"),
    )


@query("SELECT o_custkey AS id, 'both' AS side FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT c_custkey, 'no orders' FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def set_ops(spark: SparkSession, sf: str) -> DataFrame:
    """Intersection and difference of id sets."""
    o, c = table(spark, sf, "orders", F.col("o_custkey").alias("id")), table(spark, sf, "customer", F.col("c_custkey").alias("id"))
    return o.intersect(c).withColumn("side", F.lit("both")).unionByName(c.subtract(o).withColumn("side", F.lit("no orders")))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS unique_id FROM orders")
def dense_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Dense ids in a total order, without one task sorting everything."""
    return with_ordinal(table(spark, sf, "orders", "o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "unique_id")


@query("SELECT n_name AS district, count(*) AS n, CASE WHEN count(*) BETWEEN 1 AND 49 THEN NULL ELSE round(sum(c_acctbal), 2) END AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN ('NATION_1', 'NATION_2', 'NATION_3') GROUP BY 1")
def scoped_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals under a role's row scope; a suppressed count takes its sum with it."""
    n = table(spark, sf, "nation", F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("district"))
    x = table(spark, sf, "customer", "c_nationkey", "c_acctbal").join(F.broadcast(n), "c_nationkey")  # nation is a fixed table of 25 rows
    g = GovernedSession(spark, {"people": x}, Role("officer", districts=("NATION_1", "NATION_2", "NATION_3"), min_cell=1))
    return g.totals("people", ["district"], {"balance": "c_acctbal"}).select("district", "n", F.when(~F.col("n").between(1, 49), F.round("balance", 2)).alias("balance"))


@query("""
SELECT record_id, CASE WHEN try_strptime(dob, '%d-%m-%Y') IS NOT NULL AND NOT (day(try_strptime(dob, '%d-%m-%Y')) = 1 AND month(try_strptime(dob, '%d-%m-%Y')) = 1) THEN strftime(try_strptime(dob, '%d-%m-%Y'), '%Y-%m-%d') END AS birth_date,
 year(try_strptime(dob, '%d-%m-%Y')) AS birth_year FROM (SELECT DISTINCT record_id, CASE WHEN regexp_full_match(dob, '\\d{2}-\\d{2}-\\d{4}') THEN dob END AS dob FROM pension)
UNION ALL SELECT record_id, NULL, age_as_on - member_age FROM (SELECT DISTINCT record_id, member_age, age_as_on FROM ration)""")
def birth_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Birth dates and years of registers with dates and with ages, through the standard layout."""
    s = load_all(spark, sf, DEMO_KEY, ["pension", "ration"])
    return s.select("record_id", F.date_format("birth_date", "yyyy-MM-dd").alias("birth_date"), "birth_year").distinct()


@query()
def standardise_registers(spark: SparkSession, sf: str) -> DataFrame:
    """All registers of the folder in the standard layout."""
    return load_all(spark, sf, DEMO_KEY)


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    """The batch form of the streaming plan: events per hour and type."""
    return hourly(table(spark, sf, "events"))


@query(f"SELECT record_id, {TODAY.year} - (age_as_on - member_age) AS age, least(greatest(floor(({TODAY.year} - (age_as_on - member_age)) / 10) * 10, 0), 90)::INT AS band FROM (SELECT DISTINCT record_id, age_as_on, member_age FROM ration)")
def ages(spark: SparkSession, sf: str) -> DataFrame:
    """Ages at the fixed day, and their decades."""
    r = table(spark, sf, "ration", "record_id", "age_as_on", "member_age").distinct()
    age = F.lit(TODAY.year) - (F.col("age_as_on") - F.col("member_age"))
    return r.select("record_id", age.alias("age"), F.least(F.greatest(F.floor(age / 10) * 10, F.lit(0)), F.lit(90)).cast("int").alias("band"))
