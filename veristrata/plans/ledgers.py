"""Queries about ledgers, conversations, metrics, validation and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context, ledger
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = "2024-02-01 00:00:00"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


QUERIES["latest_state"] = lambda s, d: ledger.latest_state(events(s, d), "user_id", "event_type", ["ts", "event_id"])
SQL["latest_state"] = "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1"
QUERIES["first_vs_latest"] = lambda s, d: ledger.first_and_latest(events(s, d), "user_id", "event_type", ["ts", "event_id"])
SQL["first_vs_latest"] = "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_state, arg_max(event_type, (ts, event_id)) AS last_state, count(*) AS n_events FROM events GROUP BY 1"


def stale_leases(spark: SparkSession, d: str) -> DataFrame:
    """Users whose last event is an open click, older than a day: the event that closes them."""
    last = ledger.latest_state(events(spark, d), "user_id", "event_type", ["ts", "event_id"])
    return ledger.stale(last, "click", "ts", F.lit(NOW).cast("timestamp"), 86400).select("user_id", "event_id", F.lit("UNKNOWN").alias("new_state"))


QUERIES["stale_leases"] = stale_leases
SQL["stale_leases"] = f"WITH l AS ({SQL['latest_state']}) SELECT user_id, event_id, 'UNKNOWN' AS new_state FROM l WHERE state = 'click' AND epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)) > 86400"
QUERIES["budget_used"] = lambda s, d: ledger.latest_state(events(s, d), "user_id", "event_type", ["ts", "event_id"]).where(F.col("state").isin("click", "view")).groupBy("state").agg(F.count("*").alias("used"))
SQL["budget_used"] = f"WITH l AS ({SQL['latest_state']}) SELECT state, count(*) AS used FROM l WHERE state IN ('click', 'view') GROUP BY 1"
QUERIES["keep_latest_5"] = lambda s, d: ledger.keep_latest(events(s, d), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", "pos")
SQL["keep_latest_5"] = "SELECT user_id, event_id, pos::INTEGER AS pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS pos FROM events) WHERE pos <= 5"
QUERIES["latest_records"] = lambda s, d: ledger.keep_latest(events(s, d), ["user_id", "event_type"], [F.desc_nulls_last("ts"), F.desc("event_id")], 1).select("user_id", "event_type", "event_id", "value")
SQL["latest_records"] = "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) AS pos FROM events) WHERE pos = 1"


def freshness(spark: SparkSession, d: str) -> DataFrame:
    """Customers by the age of their last event, if they have any."""
    last = events(spark, d).groupBy("user_id").agg(F.max("ts").alias("ts"))
    out = table(spark, d, "customer").select("c_custkey").join(last, F.col("c_custkey") == F.col("user_id"), "left")
    return out.select("c_custkey", ledger.freshness(F.col("ts"), F.lit(NOW).cast("timestamp"), 3 * 86400).alias("status"))


QUERIES["freshness"] = freshness
SQL["freshness"] = f"""WITH l AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1)
SELECT c_custkey, CASE WHEN ts IS NULL THEN 'MISS' WHEN epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)) <= 259200 THEN 'FRESH' ELSE 'STALE' END AS status FROM customer LEFT JOIN l ON c_custkey = user_id"""

QUERIES["conv_list"] = lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.max_by("text", "turn").alias("last_text"))
SQL["conv_list"] = "SELECT conv_id, count(*) AS n_messages, arg_max(text, turn) AS last_text FROM conversations GROUP BY 1"


def asof_inherit(spark: SparkSession, d: str) -> DataFrame:
    """Each turn with the length of the nearest user turn before it."""
    value = F.when(F.col("role") == "user", F.length("text"))
    return context.inherit(table(spark, d, "conversations"), ["conv_id"], "turn", value, "user_length").select("conv_id", "turn", "user_length", "user_length_from")


QUERIES["asof_inherit"] = asof_inherit
SQL["asof_inherit"] = """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text)::INTEGER END IGNORE NULLS) OVER w AS user_length,
last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS user_length_from FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def context_window(spark: SparkSession, d: str) -> DataFrame:
    """Each turn with the only role among the three turns before it, if there is only one."""
    return context.look_back(table(spark, d, "conversations"), ["conv_id"], "turn", F.col("role")).select("conv_id", "turn", "context", "context_status")


QUERIES["context_window"] = context_window
SQL["context_window"] = """WITH w AS (SELECT conv_id, turn, list_distinct(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) AS s FROM conversations)
SELECT conv_id, turn, CASE WHEN len(s) = 1 THEN s[1] END AS context, CASE WHEN len(s) = 1 THEN 'RESOLVED' WHEN len(s) > 1 THEN 'AMBIGUOUS' ELSE 'MISSING' END AS context_status FROM w"""


def region_chain(spark: SparkSession, d: str) -> DataFrame:
    """Turns point at the turn before; those of a user at even fives open a region."""
    c = table(spark, d, "conversations")
    return context.region_chain(c.select(F.col("conv_id").alias("article"), F.col("turn").alias("sid"), (F.col("turn") % 5 == 2).alias("opens"), (F.col("turn") - 1).alias("governing")))


QUERIES["region_chain"] = region_chain
SQL["region_chain"] = "SELECT conv_id AS article, turn AS sid, max(CASE WHEN turn % 5 = 2 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS region FROM conversations"


def prune_subsumed(spark: SparkSession, d: str) -> DataFrame:
    """Lines as spans of quantity: those not strictly inside another of their order."""
    spans = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("int").alias("a"), (F.col("l_linenumber") + F.col("l_quantity")).cast("int").alias("b"))
    return context.prune_subsumed(spans, ["l_orderkey"], "a", "b").select("l_orderkey", "l_linenumber")


QUERIES["prune_subsumed"] = prune_subsumed
SQL["prune_subsumed"] = """WITH s AS (SELECT l_orderkey, l_linenumber, l_linenumber AS a, trunc(l_linenumber + l_quantity)::INTEGER AS b FROM lineitem)
SELECT l_orderkey, l_linenumber FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.l_orderkey = s.l_orderkey AND t.a <= s.a AND t.b >= s.b AND (t.a < s.a OR t.b > s.b))"""


def nearest_scope(spark: SparkSession, d: str) -> DataFrame:
    """Lines as values, the order's first two lines as scopes, gaps by line number."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), "l_returnflag")
    values = lines.where("n > 2").select("l_orderkey", F.col("n").alias("vid"), (F.col("n") * 10).alias("a"), (F.col("n") * 10 + 5).alias("b"))
    scopes = lines.where("n <= 2").select("l_orderkey", (F.col("n") * 12).alias("sa"), (F.col("n") * 12 + 6).alias("sb"), F.col("l_returnflag").alias("label"))
    return context.nearest_scope(values, scopes, ["l_orderkey"])


QUERIES["nearest_scope"] = nearest_scope
SQL["nearest_scope"] = """WITH v AS (SELECT l_orderkey, l_linenumber AS vid, l_linenumber * 10 AS a, l_linenumber * 10 + 5 AS b FROM lineitem WHERE l_linenumber > 2),
s AS (SELECT l_orderkey, l_linenumber * 12 AS sa, l_linenumber * 12 + 6 AS sb, l_returnflag AS label FROM lineitem WHERE l_linenumber <= 2),
j AS (SELECT v.*, sa, label, CASE WHEN sa IS NOT NULL THEN greatest(0, sa - b, a - sb) END AS gap FROM v LEFT JOIN s USING (l_orderkey)),
g AS (SELECT l_orderkey, vid, arg_min(label, (gap, sa, label)) AS label, count(sa) AS n, count(DISTINCT gap) AS gaps, count(*) FILTER (gap = 0) AS t FROM j GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN n = 0 THEN 'NONE' WHEN t = 1 THEN 'SPAN_CONTAINS' WHEN n > 1 AND gaps = 1 THEN 'AMBIGUOUS' ELSE 'NEAREST' END AS pairing FROM g)
SELECT l_orderkey, vid, CASE WHEN pairing IN ('SPAN_CONTAINS', 'NEAREST') THEN label END AS label, pairing FROM p"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Labels with a stand-in prediction: a document of over 500 characters is good."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    return table(spark, d, "labels").join(docs, "doc_id", "left").withColumn("predicted", F.coalesce(F.col("n_chars") > 500, F.lit(False)))


_JUDGED = "WITH j AS (SELECT l.*, n_chars, lang, source, coalesce(n_chars > 500, false) AS predicted FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id)"
_PRF = "round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"
_EACH = "coalesce(tp / nullif(tp + fp, 0), 0)::DECIMAL(17,15) AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DECIMAL(17,15) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::DECIMAL(17,15) AS f1"
_MEAN = lambda c: f"round(coalesce(sum({c})::DOUBLE / count(*), 0), 6)"
QUERIES["binary_prf"] = lambda s, d: ledger.binary_prf(judged(s, d), F.col("quality") == 1, F.col("predicted"))
SQL["binary_prf"] = _JUDGED + f", c AS (SELECT count(*) FILTER (quality = 1 AND predicted) AS tp, count(*) FILTER (quality <> 1 AND predicted) AS fp, count(*) FILTER (quality = 1 AND NOT predicted) AS fn FROM j) SELECT *, {_PRF} FROM c"


def per_label(spark: SparkSession, d: str) -> DataFrame:
    """Language as the truth, the source's number modulo four as a stand-in prediction."""
    names = F.array(*map(F.lit, ["de", "en", "es", "fr"]))
    number = F.regexp_extract("source", r"(\d+)", 1).try_cast("int")
    return ledger.per_label_prf(judged(spark, d).withColumn("guess", F.get(names, F.pmod(number, F.lit(4)))), "lang", "guess")


_LABELS = _JUDGED + """, g AS (SELECT lang, ['de','en','es','fr'][regexp_extract(source, '(\\d+)', 1)::INTEGER % 4 + 1] AS guess FROM j),
x AS (SELECT lang AS label, 'tp' AS k FROM g WHERE lang = guess UNION ALL SELECT lang, 'fn' FROM g WHERE lang <> guess UNION ALL SELECT guess, 'fp' FROM g WHERE lang <> guess),
c AS (SELECT label, count(*) FILTER (k = 'tp') AS tp, count(*) FILTER (k = 'fp') AS fp, count(*) FILTER (k = 'fn') AS fn FROM x GROUP BY 1)"""
QUERIES["per_label_prf"] = per_label
SQL["per_label_prf"] = _LABELS + f" SELECT *, {_PRF} FROM c"
QUERIES["macro_prf"] = lambda s, d: ledger.macro_prf(per_label(s, d))
SQL["macro_prf"] = _LABELS + f", p AS (SELECT *, {_EACH} FROM c) SELECT count(*) AS labels, {_MEAN('precision')} AS precision, {_MEAN('recall')} AS recall, {_MEAN('f1')} AS f1 FROM p"
QUERIES["routing_summary"] = lambda s, d: ledger.counts_by(table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"])
SQL["routing_summary"] = "SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2"


def routing_eval(spark: SparkSession, d: str) -> DataFrame:
    """Orders as gold by status, and a routing by priority that misses every ninth."""
    o = table(spark, d, "orders")
    gold = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "KOSIS_CANDIDATE").when(F.col("o_orderkey") % 10 == 0, " ").otherwise("NOT_CLAIM").alias("judged_class"))
    routed = o.where("o_orderkey % 9 <> 4").select("o_orderkey", F.when(F.substring("o_orderpriority", 1, 1) < "3", "KOSIS_CANDIDATE").otherwise("OUT_OF_SCOPE").alias("routing_class"))
    return ledger.routing_eval(gold, routed, ["o_orderkey"], "KOSIS_CANDIDATE")


QUERIES["routing_eval"] = routing_eval
SQL["routing_eval"] = f"""WITH r AS (SELECT o_orderstatus = 'F' AS g, o_orderkey % 9 <> 4 AS there, o_orderkey % 9 <> 4 AND o_orderpriority[1] < '3' AS p FROM orders WHERE o_orderstatus = 'F' OR o_orderkey % 10 <> 0),
c AS (SELECT count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p AND there) AS tn, count(*) FILTER (NOT there) AS missing FROM r) SELECT *, {_PRF}, round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS abstention_precision FROM c"""


def metrics_all(spark: SparkSession, d: str) -> DataFrame:
    """Labels as gold, a stand-in prediction by length, language against source's number as classes; toxic rows failed."""
    j = judged(spark, d)
    names = F.array(*map(F.lit, ["de", "en", "es", "fr"]))
    guess = F.get(names, F.pmod(F.regexp_extract("source", r"(\d+)", 1).try_cast("int"), F.lit(4)))
    return ledger.metrics_all(j.select(
        F.when(F.col("toxic") == 1, "failed").otherwise("ok").alias("status"), (F.col("quality") == 1).alias("gold_is_claim"), F.col("predicted").alias("pred_is_claim"), F.col("lang").alias("gold_claim_class"), guess.alias("pred_claim_class"),
        F.col("lang").alias("gold_source_scope"), F.lit("en").alias("pred_source_scope"), F.col("source").alias("gold_source_role"), F.lit("src0").alias("pred_source_role"), F.when(F.col("doc_id") % 2 == 0, "명").alias("gold_unit"), F.when(F.col("doc_id") % 3 == 0, "명").alias("pred_unit"),
        F.col("n_chars").cast("double").alias("latency_ms"), F.col("doc_id").alias("tokens"),
    ))


QUERIES["metrics_all"] = metrics_all
SQL["metrics_all"] = f"""{_JUDGED}, g AS (SELECT *, ['de','en','es','fr'][regexp_extract(source, '(\\d+)', 1)::INTEGER % 4 + 1] AS guess FROM j), k AS (SELECT * FROM g WHERE toxic <> 1),
x AS (SELECT lang AS label, 'tp' AS k FROM k WHERE lang = guess UNION ALL SELECT lang, 'fn' FROM k WHERE lang <> guess OR guess IS NULL UNION ALL SELECT guess, 'fp' FROM k WHERE lang <> guess),
cl AS (SELECT label, count(*) FILTER (k = 'tp') AS tp, count(*) FILTER (k = 'fp') AS fp, count(*) FILTER (k = 'fn') AS fn FROM x WHERE label IS NOT NULL GROUP BY 1), m AS (SELECT {_EACH} FROM cl),
b AS (SELECT count(*) FILTER (quality = 1 AND predicted) AS tp, count(*) FILTER (quality <> 1 AND predicted) AS fp, count(*) FILTER (quality = 1 AND NOT predicted) AS fn FROM k), bp AS (SELECT {_PRF} FROM b),
e AS (SELECT count(*) AS rows_ok, round(coalesce(count(*) FILTER (lang IS NOT DISTINCT FROM guess) / nullif(count(*), 0), 0), 6) AS class_accuracy, round(coalesce(count(*) FILTER (lang = 'en') / nullif(count(*), 0), 0), 6) AS scope_exact, round(coalesce(count(*) FILTER (source = 'src0') / nullif(count(*), 0), 0), 6) AS role_exact,
  round(count(*) FILTER (doc_id % 6 = 0) / greatest(count(*) FILTER (doc_id % 2 = 0 OR doc_id % 3 = 0), 1), 6) AS unit_exact FROM k)
SELECT (SELECT count(*) FROM j) AS rows_total, (SELECT round(sum(n_chars::DOUBLE), 3) FROM j) AS total_latency_ms, (SELECT sum(doc_id)::BIGINT FROM j) AS total_tokens, e.*, bp.precision AS claim_precision, bp.recall AS claim_recall, bp.f1 AS claim_f1,
  (SELECT {_MEAN("precision")} FROM m) AS class_macro_precision, (SELECT {_MEAN("recall")} FROM m) AS class_macro_recall, (SELECT {_MEAN("f1")} FROM m) AS class_macro_f1 FROM e, bp"""


def terminal_partition(spark: SparkSession, d: str) -> DataFrame:
    """Customers as targets, orders as terminal rows: the most final status of each."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("target"), "o_orderstatus")
    targets = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("target"))
    order = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    name = F.when(F.col("o_orderstatus") == "F", "ANSWERED").when(F.col("o_orderstatus") == "P", "HELD").otherwise("OPEN")
    return ledger.terminal_partition(targets, orders, "target", order, name)


QUERIES["terminal_partition"] = terminal_partition
SQL["terminal_partition"] = """WITH t AS (SELECT c_custkey AS target FROM customer WHERE c_mktsegment <> 'BUILDING'), b AS (SELECT o_custkey AS target, min(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END) AS p, count(*) AS n FROM orders GROUP BY 1)
SELECT coalesce(t.target, b.target) AS target, CASE WHEN t.target IS NULL THEN 'ORPHAN' WHEN p IS NULL THEN 'MISSING' WHEN p = 0 THEN 'ANSWERED' WHEN p = 1 THEN 'HELD' ELSE 'OPEN' END AS terminal, coalesce(n, 0) AS n FROM t FULL JOIN b ON t.target = b.target"""


def validate_rows(spark: SparkSession, d: str) -> DataFrame:
    """Order lines with the codes of the rules that they break."""
    codes = ledger.errors(("QUANTITY_HIGH", F.col("l_quantity") > 45), ("DISCOUNT_RANGE", F.col("l_discount") > 0.08), ("FLAG_UNKNOWN", ~F.col("l_returnflag").isin("A", "N")))
    return table(spark, d, "lineitem").withColumn("codes", F.array_join(codes, ",")).groupBy("codes").agg(F.count("*").alias("n"))


QUERIES["validate_rows"] = validate_rows
SQL["validate_rows"] = "SELECT concat_ws(',', CASE WHEN l_quantity > 45 THEN 'QUANTITY_HIGH' END, CASE WHEN l_discount > 0.08 THEN 'DISCOUNT_RANGE' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'FLAG_UNKNOWN' END) AS codes, count(*) AS n FROM lineitem GROUP BY 1"


def except_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Orders before 1996 against those since, by status and priority."""
    o, names = table(spark, d, "orders"), ("o_orderstatus", "o_orderpriority")
    return ledger.inventory_difference(o.where("o_orderdate < '1996-01-01'").select(*names), o.where("o_orderdate >= '1996-01-01'").select(*names))


QUERIES["except_inventory"] = except_inventory
SQL["except_inventory"] = """WITH n AS (SELECT o_orderstatus, o_orderpriority, sum(CASE WHEN o_orderdate < '1996-01-01' THEN 1 ELSE -1 END)::BIGINT AS w FROM orders GROUP BY 1, 2)
SELECT o_orderstatus, o_orderpriority, CASE WHEN w > 0 THEN 'EXTRA' ELSE 'MISSING' END AS side, abs(w) AS n FROM n WHERE w <> 0"""


def summary_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "supplier").select("s_suppkey", F.lit("old").alias("state"))
    return ledger.upsert(old, old.where("s_suppkey % 4 = 0").withColumn("state", F.lit("new")), ["s_suppkey"]).groupBy("state").agg(F.count("*").alias("n"))


QUERIES["summary_upsert"] = summary_upsert
SQL["summary_upsert"] = "SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'new' ELSE 'old' END AS state, count(*) AS n FROM supplier GROUP BY 1"


def crawl_progress(spark: SparkSession, d: str) -> DataFrame:
    """Users as seeds, event types as endpoints: enriched if all five are there, partial if some."""
    types = events(spark, d).groupBy("user_id").agg(F.count_distinct("event_type").alias("k"))
    status = F.when(F.col("k") >= 5, "enriched").when(F.col("k") > 0, "partial").otherwise("not_started")
    out = table(spark, d, "customer").join(types, F.col("c_custkey") == F.col("user_id"), "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    return out.withColumn("percent", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy(F.lit(1))), 1))  # three rows


QUERIES["crawl_progress"] = crawl_progress
SQL["crawl_progress"] = """WITH t AS (SELECT user_id, count(DISTINCT event_type) AS k FROM events GROUP BY 1), s AS (SELECT CASE WHEN k >= 5 THEN 'enriched' WHEN k > 0 THEN 'partial' ELSE 'not_started' END AS status, count(*) AS n FROM customer LEFT JOIN t ON c_custkey = user_id GROUP BY 1)
SELECT status, n, round(n * 100 / sum(n) OVER (), 1) AS percent FROM s"""
