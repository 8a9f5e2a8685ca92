"""Queries about claims and official cells (monthly order revenue stands for the facts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compare import apply_direction, compare_canonical, verdict
from ..functions.quantity import normalize_quantity
from ..operators import cells as ops
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

CLAIMS = [
    ("c1", "CHINA", "1996-03", "exact"), ("c2", "CHINA", "1996-03", "wrong"), ("c3", "NOWHERE", "1996-03", "exact"),
    ("c4", None, "1996-03", "exact"), ("c5", "JAPAN", "1997-07", "percent"), ("c6", "JAPAN", "1997-07", "about"), ("c7", "FRANCE", "1998-01", "rounded"),
]
_MONTHLY = "SELECT date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(28,2) AS revenue FROM orders GROUP BY 1"


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """Order revenue by month, exact."""
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).cast("date")
    return table(spark, d, "orders").groupBy(month.alias("month")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("revenue")).withColumn("series", F.lit("all"))


def nation_monthly(spark: SparkSession, d: str) -> DataFrame:
    """Order revenue by nation and month."""
    orders, customers, nations = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    rows = orders.select("o_custkey", F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM").alias("period"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    # Pre-aggregated by customer, so that a customer with many orders is one row in the join.
    by_customer = rows.groupBy("o_custkey", "period").agg(F.sum("v").alias("v"))
    named = customers.join(F.broadcast(nations), customers.c_nationkey == nations.n_nationkey).select("c_custkey", "n_name")  # 25 nations
    return by_customer.join(named, by_customer.o_custkey == named.c_custkey).groupBy("period", F.col("n_name").alias("nation")).agg(F.sum("v").cast("decimal(28,2)").alias("v"))


def verify_cells(spark: SparkSession, d: str) -> DataFrame:
    """Verify claims about revenue: value and unit text against the one official cell."""
    cells = nation_monthly(spark, d)
    claims = spark.createDataFrame(CLAIMS, "claim_id string, nation string, period string, how string")
    found = ops.exact_cell(claims, cells, ["period", "nation"], "v")
    # What each claim says, made from the fact so that every outcome is met.
    base = F.coalesce(F.col("cell_value"), F.lit(0)).cast("decimal(28,2)")
    text = (
        F.when(F.col("how") == "wrong", (base + 1).cast("string")).when(F.col("how") == "about", F.concat(F.lit("약 "), base.cast("string")))
        .when(F.col("how") == "rounded", F.format_string("%.1f만", F.round(base / 10000, 1).cast("double"))).otherwise(base.cast("string"))
    )
    unit = F.when(F.col("how") == "percent", "%").otherwise("원")
    read = found.withColumn("claim", normalize_quantity(text, unit)).withColumn("official", normalize_quantity(F.col("cell_value").cast("string"), F.lit("원")))
    status = F.when(F.col("cell_status") != "CELL_RESOLVED", F.col("cell_status")).otherwise(F.coalesce(F.col("claim.error"), compare_canonical(F.col("claim"), F.col("official"))))
    return read.select("claim_id", "n_cells", status.alias("status"), verdict(status).alias("verdict"))


QUERIES["verify_cells"] = verify_cells
SQL["verify_cells"] = """
WITH cells AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS period, n_name AS nation, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(28,2) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2
), claims(claim_id, nation, period, how) AS (VALUES ('c1','CHINA','1996-03','exact'), ('c2','CHINA','1996-03','wrong'), ('c3','NOWHERE','1996-03','exact'),
  ('c4',NULL,'1996-03','exact'), ('c5','JAPAN','1997-07','percent'), ('c6','JAPAN','1997-07','about'), ('c7','FRANCE','1998-01','rounded')
), f AS (
  SELECT claim_id, how, count(v) AS n_cells FROM claims LEFT JOIN cells ON claims.period = cells.period AND (claims.nation IS NULL OR claims.nation = cells.nation) GROUP BY 1, 2
), s AS (SELECT claim_id, n_cells, CASE WHEN n_cells = 0 THEN 'NO_CELL' WHEN n_cells > 1 THEN 'MULTIPLE_CELLS' WHEN how = 'about' THEN 'QUALIFIER_UNSUPPORTED'
  WHEN how = 'percent' THEN 'UNIT_MISMATCH' WHEN how = 'wrong' THEN 'VALUE_MISMATCH' ELSE 'MATCH' END AS status FROM f)
SELECT claim_id, n_cells, status, CASE status WHEN 'MATCH' THEN 'VERIFIED' WHEN 'VALUE_MISMATCH' THEN 'REFUTED' ELSE 'UNVERIFIABLE' END AS verdict FROM s
"""

QUERIES["yoy_streak"] = lambda s, d: ops.yoy_streak(monthly(s, d), ["series"], "month", "revenue").select("month", "streak")
SQL["yoy_streak"] = f"""
WITH m AS ({_MONTHLY}), u AS (SELECT a.month, coalesce(a.revenue > b.revenue, false) AS up FROM m a LEFT JOIN m b ON b.month = a.month - INTERVAL 12 MONTH),
r AS (SELECT month, up, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (ORDER BY month) AS run FROM u)
SELECT month, CASE WHEN up THEN count(*) FILTER (up) OVER (PARTITION BY run ORDER BY month) ELSE 0 END::BIGINT AS streak FROM r
"""

QUERIES["month_max_since"] = lambda s, d: ops.month_max_since(monthly(s, d), ["series"], "month", "revenue").select("month", "is_max")
SQL["month_max_since"] = f"WITH m AS ({_MONTHLY}) SELECT month, revenue > max(revenue) OVER (PARTITION BY month(month) ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS is_max FROM m"


def _yoy(rate: bool):
    def query(spark: SparkSession, d: str) -> DataFrame:
        m = monthly(spark, d)
        if rate:
            m = m.withColumn("revenue", F.col("revenue").cast("double"))
        out = ops.yoy_max_since(m, ["series"], "month", "revenue", rate)
        change = F.round(F.col("change") * 100, 6) if rate else F.col("change").cast("decimal(28,2)")
        return out.select("month", change.alias("change"), "is_max")

    return query


QUERIES["yoy_rate_max"], QUERIES["yoy_diff_max"] = _yoy(True), _yoy(False)
SQL["yoy_rate_max"] = f"""WITH m AS ({_MONTHLY}), c AS (SELECT a.month, (a.revenue::DOUBLE - b.revenue::DOUBLE) / abs(b.revenue::DOUBLE) AS ch FROM m a LEFT JOIN m b ON b.month = a.month - INTERVAL 12 MONTH)
SELECT month, round(ch * 100, 6) AS change, ch > max(ch) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS is_max FROM c"""
SQL["yoy_diff_max"] = f"""WITH m AS ({_MONTHLY}), c AS (SELECT a.month, (a.revenue - b.revenue)::DECIMAL(28,2) AS change FROM m a LEFT JOIN m b ON b.month = a.month - INTERVAL 12 MONTH)
SELECT month, change, change > max(change) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS is_max FROM c"""


def range_cells_status(spark: SparkSession, d: str) -> DataFrame:
    """Has each nation its revenue of every month of 1996, once? Some nations' months are twice there, some are gone, and some have months of other years."""
    cells = nation_monthly(spark, d).withColumn("k", F.regexp_extract("nation", r"(\d+)", 1).cast("int"))
    of_year = F.col("period").between("1996-01", "1996-12")
    held = cells.where((of_year | (F.col("k") % 4 == 1)) & ~((F.col("k") % 5 == 2) & (F.col("period") == "1996-07")))
    twice = held.where("k % 3 = 0 AND period = '1996-05'")
    months = F.transform(ops.month_periods(F.lit("1996-01-01").cast("date"), F.lit("1996-12-01").cast("date")), lambda m: F.date_format(m, "yyyy-MM"))
    wanted = table(spark, d, "nation").select(F.col("n_name").alias("nation"), F.explode(months).alias("period"))
    return ops.range_cells(wanted, held.unionByName(twice), "nation", "period")


QUERIES["range_cells_status"] = range_cells_status
SQL["range_cells_status"] = """
WITH m AS (SELECT DISTINCT n_name AS nation, regexp_extract(n_name, '([0-9]+)', 1)::INTEGER AS k, strftime(o_orderdate, '%Y-%m') AS period FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
h AS (SELECT * FROM m WHERE (period BETWEEN '1996-01' AND '1996-12' OR k % 4 = 1) AND NOT (k % 5 = 2 AND period = '1996-07')), a AS (SELECT * FROM h UNION ALL SELECT * FROM h WHERE k % 3 = 0 AND period = '1996-05'),
c AS (SELECT nation, period, count(*) AS n FROM a GROUP BY 1, 2), w AS (SELECT n_name AS nation, concat('1996-', lpad(x::VARCHAR, 2, '0')) AS period, true AS wanted FROM nation, range(1, 13) t(x)),
j AS (SELECT coalesce(w.nation, c.nation) AS nation, wanted, n FROM w FULL JOIN c ON c.nation = w.nation AND c.period = w.period),
s AS (SELECT nation, count(*) FILTER (wanted AND n IS NULL) AS missing, count(*) FILTER (wanted AND n > 1) AS duplicated, count(*) FILTER (wanted IS NULL) AS unexpected FROM j GROUP BY 1)
SELECT *, CASE WHEN duplicated > 0 THEN 'RANGE_CELLS_DUPLICATED' WHEN missing > 0 THEN 'RANGE_CELLS_MISSING' WHEN unexpected > 0 THEN 'RANGE_CELLS_UNEXPECTED' ELSE 'RANGE_RESOLVED' END AS status FROM s
"""


def verify_every_cell(spark: SparkSession, d: str) -> DataFrame:
    """A claim about every nation and month, in ten thousands with one place, moved by up to two places; held against its cell to half the last place."""
    cells = nation_monthly(spark, d)
    tenths = F.floor(F.col("v") / 1000).cast("bigint") + F.substring("period", 6, 2).cast("int") % 3
    claims = cells.select("nation", "period", F.concat((tenths / 10).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("만")).alias("said"))
    found = ops.exact_cell(claims, cells, ["nation", "period"], "v")
    read = found.withColumn("c", normalize_quantity(F.col("said"), F.lit("원"))).withColumn("o", normalize_quantity(F.col("cell_value").cast("string"), F.lit("원")))
    status = F.coalesce(F.col("c.error"), F.col("o.error"), compare_canonical(F.col("c"), F.col("o")))
    return read.select("nation", "period", "said", status.alias("status"), verdict(status).alias("verdict"))


QUERIES["verify_every_cell"] = verify_every_cell
SQL["verify_every_cell"] = """WITH c AS (SELECT n_name AS nation, strftime(o_orderdate, '%Y-%m') AS period, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(28,2) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
t AS (SELECT *, floor(v / 1000)::BIGINT + period[6:7]::INTEGER % 3 AS t FROM c), x AS (SELECT *, abs(t * 1000 - v) * 2 <= 1000 AS ok FROM t)
SELECT nation, period, concat(t // 10, '.', t % 10, '만') AS said, CASE WHEN ok THEN 'MATCH' ELSE 'VALUE_MISMATCH' END AS status, CASE WHEN ok THEN 'VERIFIED' ELSE 'REFUTED' END AS verdict FROM x"""


def annual_requery(spark: SparkSession, d: str) -> DataFrame:
    """Yearly revenue of each nation against the year before, and whether a claimed rise holds."""
    yearly = nation_monthly(spark, d).groupBy("nation", F.substring("period", 1, 4).cast("int").alias("year")).agg(F.sum("v").cast("decimal(28,2)").alias("v"))
    out = ops.annual_change(yearly, ["nation"], "year", "v")
    signed = apply_direction(F.abs("change"), F.when(F.col("change") < 0, "DECREASE").otherwise("INCREASE"))
    rate = F.round(F.col("change").cast("double") * 100 / F.abs(F.col("base").cast("double")), 4)
    return out.select("nation", "year", signed.cast("decimal(28,2)").alias("change"), rate.alias("rate"), F.when(F.col("change") > 0, "VERIFIED").otherwise("REFUTED").alias("rise"))


QUERIES["annual_requery"] = annual_requery
SQL["annual_requery"] = """
WITH y AS (SELECT n_name AS nation, year(o_orderdate)::INTEGER AS year, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(28,2) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT a.nation, a.year, (a.v - b.v)::DECIMAL(28,2) AS change, round((a.v - b.v)::DOUBLE * 100 / abs(b.v::DOUBLE), 4) AS rate, CASE WHEN a.v > b.v THEN 'VERIFIED' ELSE 'REFUTED' END AS rise
FROM y a JOIN y b ON b.nation = a.nation AND b.year = a.year - 1
"""

COVERAGE = [("F", "M", 199601, 199712), ("F", "M", 199701, 199812), ("O", "Y", 199500, 199800), ("O", "M", 199501, 199506)]


def period_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders by status and month, held against periods covered."""
    claims = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("tbl"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyyMM").cast("int").alias("ord")).agg(F.count("*").alias("n")).withColumn("freq", F.lit("M"))
    coverage = spark.createDataFrame(COVERAGE, "tbl string, freq string, lo int, hi int")
    return ops.period_coverage(claims, coverage, ["tbl"])


QUERIES["period_range_join"] = period_range_join
SQL["period_range_join"] = """
WITH c AS (SELECT o_orderstatus AS tbl, strftime(o_orderdate, '%Y%m')::INTEGER AS ord, count(*) AS n, 'M' AS freq FROM orders GROUP BY 1, 2),
v(tbl, f, lo, hi) AS (VALUES ('F','M',199601,199712), ('F','M',199701,199812), ('O','Y',199500,199800), ('O','M',199501,199506)),
j AS (SELECT c.*, v.f, CASE WHEN f = freq AND ord BETWEEN lo AND hi THEN lo END AS l, CASE WHEN f = freq AND ord BETWEEN lo AND hi THEN hi END AS h FROM c LEFT JOIN v USING (tbl)),
g AS (SELECT tbl, ord, n, freq, arg_min(l, l::BIGINT * 1000000 + h)::INTEGER AS lo, arg_min(h, l::BIGINT * 1000000 + h)::INTEGER AS hi, count(f) AS any_, count(*) FILTER (f = freq) AS same FROM j GROUP BY 1, 2, 3, 4)
SELECT tbl, ord, n, freq, lo, hi, CASE WHEN lo IS NOT NULL THEN 'COVERED' WHEN any_ = 0 THEN 'PROFILE_INCOMPLETE' WHEN same = 0 THEN 'FREQUENCY_MISMATCH' ELSE 'OUT_OF_RANGE' END AS reason FROM g
"""
