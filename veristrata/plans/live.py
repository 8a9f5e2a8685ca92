"""The live loop over a claim of every customer, about orders of their segment, nation and month; the official tables are the orders themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.legacy import canonical_absolute
from ..functions.period import normalize_time
from ..operators import live
from ..operators.context import checkpointed
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: What each customer says, by the same expressions in both engines.
_SAYS = {
    "h": "CAST((c_custkey * 48271 + 11) % 65537 AS BIGINT)", "y": "1995 + h % 7", "m": "1 + CAST(floor(h / 7) AS BIGINT) % 12", "k": "CAST(floor(h / 84) AS BIGINT) % 10",
    "indicator": "CASE WHEN k = 0 THEN concat('월간 ', c_mktsegment, ' 주문 건수') WHEN k = 1 THEN concat(c_mktsegment, ' 주문') WHEN k < 5 THEN concat(c_mktsegment, ' 주문 금액') WHEN k = 5 THEN concat('낱말 ', c_mktsegment, ' 주문 금액') ELSE concat(c_mktsegment, ' 주문 건수') END",
    "region": "CASE WHEN h % 23 = 0 THEN '아틀란티스' WHEN h % 4 = 0 THEN '' ELSE n_name END", "period_raw": "CASE WHEN h % 2 = 0 THEN concat(y, '년 ', m, '월') ELSE concat(y, '. ', m, '월') END",
    "routing_class": "CASE WHEN h % 11 = 0 THEN 'OUT_OF_SCOPE' WHEN h % 29 = 0 THEN 'CLARIFICATION_REQUIRED' ELSE 'KOSIS_CANDIDATE' END",
}


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Orders and their sum by segment, nation (and all of them) and month; the orders are read once, and what is left of them is kept."""
    orders, customers, nations = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    rows = orders.select("o_custkey", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    at = customers.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", F.col("n_nationkey").cast("string").alias("nation"))
    by_nation = rows.join(at, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "nation", "month").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    both = by_nation.withColumn("value_ids", F.explode(F.array("nation", F.lit("all")))).groupBy("c_mktsegment", "value_ids", "month").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    sides = F.explode(F.array(F.struct(F.lit("A").alias("itm_id"), F.col("n").cast("decimal(28,2)").alias("value"), F.lit("건").alias("unit")), F.struct(F.lit("B").alias("itm_id"), F.col("v").cast("decimal(28,2)").alias("value"), F.lit("원").alias("unit"))))
    period = F.date_format("month", "yyyy-MM").alias("period")
    return checkpointed(both.select(F.concat(F.lit("T-"), "c_mktsegment").alias("table_key"), "value_ids", period, sides.alias("x")).select("table_key", "x.itm_id", "value_ids", "period", "x.value", "x.unit"))


def catalog(spark: SparkSession, d: str, official: DataFrame) -> live.Catalog:
    """A table for each segment, and one of flights that shares a word with some claims."""
    segments = table(spark, d, "customer").select("c_mktsegment").distinct()
    key = F.concat(F.lit("T-"), "c_mktsegment").alias("table_key")
    flights = lambda rows, schema: spark.createDataFrame(rows, schema)
    titles = segments.select(key, F.concat("c_mktsegment", F.lit(" 주문 동향")).alias("title")).unionByName(flights([("D-1", "월간 운항 편수")], "table_key string, title string"))
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("itm_id"), F.lit(n).alias("n"), F.lit(u).alias("unit")) for i, n, u in (("A", " 주문 건수", "건"), ("B", " 주문 금액", "원"))])).alias("x")
    items = segments.select(key, "c_mktsegment", pairs).select("table_key", "x.itm_id", F.concat("c_mktsegment", "x.n").alias("itm_nm"), "x.unit")
    items = items.unionByName(flights([("D-1", "A", "운항 편수", "편"), ("D-1", "B", "결항 편수", "편")], "table_key string, itm_id string, itm_nm string, unit string"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("value_id"), F.col("n_name").alias("value_name")).unionByName(flights([("all", "전국")], "value_id string, value_name string"))
    values = segments.select(key).crossJoin(F.broadcast(nations)).select("table_key", F.lit("G").alias("obj_id"), F.lit("행정구역별").alias("obj_nm"), F.lit(1).alias("level"), "value_id", "value_name", F.lit("").alias("value_unit"))
    coverage = segments.select(key, F.lit("M").alias("freq"), F.lit(199501).alias("lo"), F.lit(200012).alias("hi"))
    return live.Catalog(titles, items, values, coverage, official)


def speakers(spark: SparkSession, d: str) -> DataFrame:
    """Each customer with its nation and what it says, all but the number."""
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    for name, sql in _SAYS.items():
        rows = rows.withColumn(name, F.expr(sql))
    return rows


def targets(spark: SparkSession, d: str, official: DataFrame) -> DataFrame:
    """A claim a customer: the true number in two of three cases, by one too much in the third; five where there is no number."""
    rows = speakers(spark, d)
    item = F.when(F.col("indicator").endswith("건수"), "A").otherwise("B")
    truth = official.select("table_key", "itm_id", "value_ids", F.col("period").alias("at"), "value")
    asked = rows.select("*", F.concat(F.lit("T-"), "c_mktsegment").alias("table_key"), item.alias("itm_id"), F.when(F.col("region") == "", "all").otherwise(F.col("n_nationkey").cast("string")).alias("value_ids"), F.concat(F.col("y").cast("string"), F.lit("-"), F.lpad(F.col("m").cast("string"), 2, "0")).alias("at"))
    known = asked.join(truth, ["table_key", "itm_id", "value_ids", "at"], "left")
    number = F.coalesce(F.when(F.col("itm_id") == "A", F.col("value").cast("bigint")).otherwise(F.floor(F.col("value") / 10000)), F.lit(5)) + F.when(F.col("h") % 3 == 0, 1).otherwise(0)
    text = F.concat(number.cast("string"), F.when(F.col("itm_id") == "A", "").otherwise("만"))
    # Texts of periods are read once for each different one: two for each month of seven years.
    periods = rows.select("period_raw").distinct().select("period_raw", canonical_absolute(normalize_time(F.col("period_raw"), F.lit("2002-01-01").cast("date"))).alias("period"))
    said = known.join(F.broadcast(periods), "period_raw").select(F.col("c_custkey").alias("target_id"), "routing_class", "indicator", F.when(F.col("itm_id") == "A", "건").otherwise("원").alias("unit"), "region", F.lit("").alias("population"), F.lit("M").alias("freq"), "period", text.alias("value_text"))
    return said.withColumn("ord", F.replace("period", F.lit("-"), F.lit("")).try_cast("int"))


def live_loop(spark: SparkSession, d: str) -> DataFrame:
    """From routed claims to verdicts: searched, bound, looked up and judged in at most two rounds."""
    official = cells(spark, d)
    answers, _ = live.run(targets(spark, d, official), catalog(spark, d, official))
    return answers.select("target_id", "round", "verdict", "status", "signature", F.col("cell_value").cast("decimal(28,2)").cast("double").alias("cell_value"))


def live_ledger(spark: SparkSession, d: str) -> DataFrame:
    """What the rounds took, with a budget that the second round passes."""
    official = cells(spark, d)
    routed = speakers(spark, d).where("routing_class = 'KOSIS_CANDIDATE'").count()  # customers tell; no number is asked for
    _, ledger = live.run(targets(spark, d, official), catalog(spark, d, official), budgets={"search": routed})
    return ledger.select("round", "open", "answered", "corrected")


_T = "(SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey)"
for _n, _e in _SAYS.items():
    _T = f"(SELECT *, {_e} AS {_n} FROM {_T})"
_ANSWERS = f"""o AS (SELECT c_mktsegment AS seg, c_nationkey AS nk, strftime(o_orderdate, '%Y-%m') AS p, o_totalprice::DECIMAL(18,2) AS v FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT seg, nk::VARCHAR AS nk, p, count(*)::DECIMAL(28,2) AS n, sum(v)::DECIMAL(28,2) AS v FROM o GROUP BY ALL UNION ALL SELECT seg, 'all', p, count(*)::DECIMAL(28,2), sum(v)::DECIMAL(28,2) FROM o GROUP BY ALL),
t AS (SELECT *, ends_with(indicator, '건수') AS counts, CASE WHEN region = '' THEN 'all' ELSE c_nationkey::VARCHAR END AS nk, concat(y, '-', lpad(m::VARCHAR, 2, '0')) AS at FROM {_T}),
j AS (SELECT t.*, CASE WHEN counts THEN c.n ELSE c.v END AS official FROM t LEFT JOIN c ON c.seg = c_mktsegment AND c.nk = t.nk AND c.p = t.at),
x AS (SELECT *, (coalesce(CASE WHEN counts THEN official::BIGINT ELSE floor(official / 10000)::BIGINT END, 5) + (h % 3 = 0)::INT) * CASE WHEN counts THEN 1 ELSE 10000 END AS said, CASE WHEN counts THEN 1 ELSE 10000 END AS quantum FROM j),
s AS (SELECT *, CASE WHEN routing_class <> 'KOSIS_CANDIDATE' THEN concat('ROUTED_', routing_class) WHEN region = '아틀란티스' AND k <> 1 THEN 'DIMENSION_MISSING' WHEN k = 1 THEN 'ITEM_MISSING' WHEN y > 2000 THEN 'PERIOD_OUT_OF_RANGE' WHEN official IS NULL THEN 'NO_CELL'
  WHEN 2 * abs(said - official) <= quantum THEN 'MATCH' ELSE 'VALUE_MISMATCH' END AS status, CASE WHEN routing_class = 'KOSIS_CANDIDATE' AND k IN (0, 1, 5) THEN 1 ELSE 0 END AS round FROM x)"""
QUERIES["live_loop"], QUERIES["live_ledger"] = live_loop, live_ledger
SQL["live_loop"] = f"""WITH {_ANSWERS} SELECT c_custkey AS target_id, round, CASE status WHEN 'MATCH' THEN 'VERIFIED' WHEN 'VALUE_MISMATCH' THEN 'REFUTED' ELSE 'UNVERIFIABLE' END AS verdict, status,
  CASE WHEN status IN ('MATCH', 'VALUE_MISMATCH', 'NO_CELL') THEN concat('T-', c_mktsegment, '|', CASE WHEN counts THEN 'A' ELSE 'B' END, '|', nk) END AS signature, CASE WHEN status IN ('MATCH', 'VALUE_MISMATCH') THEN official::DOUBLE END AS cell_value FROM s"""
SQL["live_ledger"] = f"""WITH {_ANSWERS} SELECT 0 AS round, count(*) AS open, count(*) FILTER (round = 0) AS answered, count(*) FILTER (round = 1) AS corrected FROM s WHERE routing_class = 'KOSIS_CANDIDATE' UNION ALL SELECT 1, count(*), count(*), 0 FROM s WHERE round = 1"""
