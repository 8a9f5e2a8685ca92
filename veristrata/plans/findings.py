"""Queries about findings that sentences claim: four sentences a customer, and what the revenue of their region bears out.

The sentences are made by the same expressions in both engines; the SQL reads them by patterns of its own dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series
from ..sources.tables import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Columns of the sentences, each made from those before it.
_MADE = {
    "h": "CAST((c_custkey * 48271 + i * 69621 + 7) % 65537 AS BIGINT)", "y": "1995 + CAST(floor(h / 8) AS BIGINT) % 5", "m": "1 + CAST(floor(h / 40) AS BIGINT) % 12", "n": "1 + CAST(floor(h / 480) AS BIGINT) % 9",
    "topic": "CASE (c_custkey + CASE WHEN h % 5 = 0 THEN 1 ELSE 0 END) % 3 WHEN 0 THEN '출생아 수' WHEN 1 THEN '혼인 건수' ELSE '수출 증가 폭' END",
    "later": "CASE h % 3 WHEN 0 THEN '올해' WHEN 1 THEN '지난해' ELSE concat(y + 1, '년') END",
    "text": """CASE h % 8 WHEN 0 THEN concat(y + 2, '년 ', m, '월 ', topic, '는 ', h, '명이었다') WHEN 1 THEN concat(topic, '는 ', y, '년 ', m, '월 이후 ', n, '년 만에 가장 많았다')
      WHEN 2 THEN concat(y, '년 통계 집계 이래 최고 증가율이다') WHEN 3 THEN concat('증가폭은 ', y, '년 ', m, '월 이후 ', n, '년 만에 가장 컸다')
      WHEN 4 THEN concat(topic, '는 ', y, '년 ', m, '월부터 ', later, ' ', 1 + (m + n) % 12, '월까지 ', n + 3, '개월 연속 늘었다') WHEN 5 THEN concat('지난 ', m, '월 ', topic, '는 ', y, '년 0', 1 + m % 9, '월 이후 ', n, '년 만에 가장 높았다')
      WHEN 6 THEN concat(m, '월 기준 ', topic, '는 컸다') ELSE concat(y + 1, '년 ', m, '월 값은 ', y, '년 ', m, '월의 상승 이후 ', n, '년 만에 가장 컸다') END""",
    "indicator": "CASE WHEN h % 4 < 3 THEN topic ELSE '' END", "paragraph": "CAST(floor((i + c_custkey % 2) / 3) AS INT)", "published": "concat(1999 + c_custkey % 3, '-', 1 + c_custkey % 12, '-05')",
    "hint": "CASE WHEN c_custkey % 4 = 0 THEN concat(1998 + c_custkey % 3, '-0', 1 + c_custkey % 9) ELSE '' END",
}


def sentences(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = spread(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")  # the one shuffle of windows and texts
    rows = customers.join(F.broadcast(named), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    for name, sql in _MADE.items():
        rows = rows.withColumn(name, F.expr(sql))
    return rows.select(F.col("c_custkey").alias("article"), F.col("i").alias("idx"), "paragraph", "text", "indicator", "published", "hint", "r_name")


def region_months(spark: SparkSession, d: str) -> DataFrame:
    """Order revenue by region and month, exact; the fifth region has two cells of one month."""
    orders, customers, nations = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    rows = orders.select("o_custkey", F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM").alias("period"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    by_customer = rows.groupBy("o_custkey", "period").agg(F.sum("v").alias("v"))
    at = customers.join(F.broadcast(nations.join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name", "r_regionkey")
    cells = by_customer.join(at, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name", "r_regionkey", "period").agg(F.sum("v").cast("decimal(20,2)").alias("v"))
    return cells.unionByName(cells.where("r_regionkey = 4 AND period = '1997-05'")).drop("r_regionkey")


def range_specs(spark: SparkSession, d: str) -> DataFrame:
    """What four sentences of every customer claim about a series, with the periods that are needed to tell."""
    lists = [F.concat_ws(",", c).alias(c) for c in ("expected", "comparison")]
    return series.range_specs(sentences(spark, d)).select("article", "idx", "operator", "start", "end", *lists, "anchor", "inclusion", "claim_count", "family", "month", "month_source")


def same_series(spark: SparkSession, d: str) -> DataFrame:
    """Each such claim held against the monthly revenue of the customer's region."""
    said = sentences(spark, d)
    specs = series.range_specs(said).withColumn("current", F.col("end")).join(said.where("idx = 0").select("article", "r_name"), "article")
    return series.evaluate_ranges(specs, region_months(spark, d), ["article", "idx", "operator"], ["r_name"], "period", "v")


_FROM = "(SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, range(4) t(i))"
for _name, _sql in _MADE.items():
    _FROM = f"(SELECT *, {_sql} AS {_name} FROM {_FROM})"
_KEY = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '^월별\\s+', ''), '^(?:(?:기존에|과거|이전|종전)\\s*)?(?:(?:가장|최고|최대|최저|최소)\\s*)?(?:(?:높았던|많았던|컸던|낮았던|적었던)\\s*)?', ''), '(?:\\s*(?:(?:증가|감소|변화)율|(?:상승|하락|증감|변동)률|(?:증가|감소|상승|하락|증감|변화|변동)(?:량| ?폭)|건수|규모|수준|수))+$', ''))"
_READ = rf"""s AS (SELECT c_custkey AS article, i AS idx, paragraph, text AS t, published, hint, r_name,
    CASE WHEN indicator <> '' THEN indicator WHEN regexp_matches(text, '(?:증가|감소|상승|하락|증감|변화|변동)\s*(?:율|폭|량)\s*(?:은|는|이|가)(?:\s|,|$)') THEN '증가폭' ELSE trim(regexp_extract(text, '([^,;:()]+?)\s*(?:은|는|이|가)(?:\s|,|$)', 1)) END AS label,
    CASE WHEN indicator <> '' THEN indicator ELSE trim(regexp_extract(text, '([^,;:()]+?)\s*(?:은|는|이|가)(?:\s|,|$)', 1)) END AS plain,
    coalesce(regexp_extract_all(text, '([0-9]{{4}})년\s*(0?[1-9]|1[0-2])월', 1)[-1], '') AS dy, lpad(coalesce(regexp_extract_all(text, '([0-9]{{4}})년\s*(0?[1-9]|1[0-2])월', 2)[-1], ''), 2, '0') AS dm,
    regexp_extract(text, '(0?[1-9]|1[0-2])월\s*기준', 1) AS as_of, regexp_extract(text, '(?:올해|지난)\s*(0?[1-9]|1[0-2])월', 1) AS nm, contains(text, '올해') AS this_year FROM {_FROM}),
f AS (SELECT *, {_KEY("label")} AS own0, {_KEY("plain")} AS gives0 FROM s),
c AS (SELECT *, CASE WHEN regexp_matches(own0, '^(증가|감소|상승|하락|증감|변화|변동)\s*(율|폭|량)$') THEN '' ELSE own0 END AS own, CASE WHEN regexp_matches(gives0, '^(증가|감소|상승|하락|증감|변화|변동)\s*(율|폭|량)$') THEN '' ELSE gives0 END AS gives,
  CASE WHEN hint <> '' AND as_of <> '' THEN concat(hint[1:4], '-', lpad(as_of, 2, '0')) WHEN dy <> '' THEN concat(CASE WHEN hint <> '' THEN hint[1:4] ELSE dy END, '-', dm)
    WHEN nm <> '' THEN concat(CASE WHEN hint <> '' THEN hint[1:4]::INT WHEN this_year OR nm::INT < regexp_extract(published, '-([0-9]+)-', 1)::INT THEN published[1:4]::INT ELSE published[1:4]::INT - 1 END, '-', lpad(nm, 2, '0')) ELSE '' END AS mine,
  CASE WHEN dy <> '' THEN concat(CASE WHEN hint <> '' THEN hint[1:4] ELSE dy END, '-', dm) WHEN as_of <> '' AND hint <> '' THEN concat(hint[1:4], '-', lpad(as_of, 2, '0')) ELSE '' END AS hands FROM f),
g AS (SELECT *, lag(hands) OVER w AS before_hands, coalesce(lag(paragraph) OVER w = paragraph, false) AS beside, CASE WHEN own <> '' THEN own WHEN lag(paragraph) OVER w = paragraph THEN lag(gives) OVER w ELSE '' END AS family FROM c WINDOW w AS (PARTITION BY article ORDER BY idx)),
k AS (SELECT *, beside AND family <> '' AND coalesce(lag(family) OVER (PARTITION BY article ORDER BY idx) = family, false) AS kin FROM g),
x AS (SELECT *, CASE WHEN mine <> '' THEN mine WHEN kin THEN before_hands ELSE '' END AS month, CASE WHEN mine <> '' THEN 'explicit' WHEN kin AND before_hands <> '' THEN 'adjacent_inherited' END AS month_source FROM k),
found AS (
  SELECT *, 'YOY_STREAK' AS operator, regexp_extract(t, '([0-9]{{4}})년\s*(0?[1-9]|1[0-2])월부터', 1)::INT * 12 + regexp_extract(t, '([0-9]{{4}})년\s*(0?[1-9]|1[0-2])월부터', 2)::INT - 1 AS anchor_at,
    CASE WHEN contains(t, '부터 올해') THEN published[1:4]::INT * 12 WHEN regexp_matches(t, '부터\s*[0-9]{{4}}년') THEN regexp_extract(t, '부터\s*([0-9]{{4}})년', 1)::INT * 12 END + regexp_extract(t, '(0?[1-9]|1[0-2])월까지', 1)::INT - 1 AS now_at, regexp_extract(t, '([0-9]+)개월 연속', 1)::INT AS claim_count
  FROM x WHERE regexp_matches(t, '월부터\s*(올해|지난해|작년|[0-9]{{4}}년)\s*(0?[1-9]|1[0-2])월까지\s*[0-9]+개월\s*연속')
  UNION ALL SELECT *, CASE WHEN regexp_matches(t, '가장\s*컸') THEN 'YOY_DIFFERENCE_MAX_SINCE' ELSE 'MONTH_OF_YEAR_MAX_SINCE' END, regexp_extract(t, '([0-9]{{4}})년\s*(0?[1-9]|1[0-2])월[^.]{{0,100}}?이후', 1)::INT * 12 + regexp_extract(t, '([0-9]{{4}})년\s*(0?[1-9]|1[0-2])월[^.]{{0,100}}?이후', 2)::INT - 1,
    CASE WHEN month <> '' THEN month[1:4]::INT * 12 + month[6:7]::INT - 1 END, NULL FROM x WHERE regexp_matches(t, '이후\s*[0-9]+년\s*만에\s*가장\s*(많|높|큰|컸)')
  UNION ALL SELECT *, 'YOY_RATE_MAX_SINCE', CASE WHEN month <> '' THEN regexp_extract(t, '([0-9]{{4}})년 통계', 1)::INT * 12 + month[6:7]::INT - 1 END, CASE WHEN month <> '' THEN month[1:4]::INT * 12 + month[6:7]::INT - 1 END, NULL FROM x WHERE regexp_matches(t, '통계\s*집계\s*이래')
), told AS (SELECT *, operator <> 'YOY_STREAK' AS yearly, CASE WHEN operator = 'YOY_STREAK' THEN now_at IS NOT NULL ELSE coalesce(now_at % 12 = anchor_at % 12, false) END AS ok,
  anchor_at - CASE WHEN operator = 'MONTH_OF_YEAR_MAX_SINCE' THEN 0 ELSE 12 END AS from_at, anchor_at + CASE WHEN operator IN ('YOY_STREAK', 'YOY_RATE_MAX_SINCE') THEN 0 ELSE 12 END AS compared_at FROM found),
spec AS (SELECT *, CASE WHEN ok THEN [e FOR e IN range(from_at, now_at + 1, CASE WHEN yearly THEN 12 ELSE 1 END)] ELSE [] END AS expected_at, CASE WHEN ok THEN [e FOR e IN range(compared_at, now_at + 1, CASE WHEN yearly THEN 12 ELSE 1 END)] ELSE [] END AS comparison_at FROM told)"""
_AT = lambda e: f"concat(lpad(({e} // 12)::VARCHAR, 4, '0'), '-', lpad(({e} % 12 + 1)::VARCHAR, 2, '0'))"

QUERIES["range_specs"], QUERIES["same_series"] = range_specs, same_series
SQL["range_specs"] = f"""WITH {_READ} SELECT article, idx::INT AS idx, operator, CASE WHEN operator = 'YOY_STREAK' OR ok THEN {_AT("from_at")} ELSE '' END AS "start", CASE WHEN ok THEN {_AT("now_at")} ELSE '' END AS "end",
  array_to_string([{_AT("e")} FOR e IN expected_at], ',') AS expected, array_to_string([{_AT("e")} FOR e IN comparison_at], ',') AS comparison,
  CASE WHEN yearly THEN coalesce(CASE WHEN anchor_at IS NOT NULL THEN {_AT("anchor_at")} END, '') END AS anchor, CASE operator WHEN 'YOY_STREAK' THEN 'NONE' WHEN 'YOY_RATE_MAX_SINCE' THEN 'SINCE_INCLUSIVE' ELSE 'AFTER_ANCHOR_EXCLUSIVE' END AS inclusion, claim_count, family, month, month_source FROM spec"""
SQL["same_series"] = f"""WITH {_READ}, v0 AS (SELECT r_name, r_regionkey, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS pos, (sum(o_totalprice::DECIMAL(18,2)) * 100)::HUGEINT AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
v AS (SELECT r_name, pos, v, CASE WHEN r_regionkey = 4 AND pos = 1997 * 12 + 4 THEN 2 ELSE 1 END AS n FROM v0),
need AS (SELECT article, idx, operator, r_name, unnest(expected_at) AS pos FROM spec), held AS (SELECT need.*, n FROM need LEFT JOIN v USING (r_name, pos)),
gaps AS (SELECT article, idx, operator, count(*) FILTER (n > 1) AS twice, arg_min(CASE WHEN n IS NULL THEN 'RANGE_CELLS_MISSING' ELSE 'RANGE_CELLS_DUPLICATED' END, pos) FILTER (n IS NULL OR n > 1) AS first_bad FROM held GROUP BY ALL),
cmp AS (SELECT article, idx, operator, p.pos, p.now_at, v.v, b.v AS base FROM (SELECT article, idx, operator, r_name, now_at, unnest(comparison_at) AS pos FROM spec) p LEFT JOIN v USING (r_name, pos) LEFT JOIN v b ON b.r_name = p.r_name AND b.pos = p.pos - 12),
cur AS (SELECT * FROM cmp WHERE pos = now_at),
judged AS (SELECT cmp.article, cmp.idx, cmp.operator, count(*) AS n, bool_or(cmp.base = 0) AS zero, bool_and(cmp.v > cmp.base) AS up, bool_and(cmp.pos = cmp.now_at OR cur.v > cmp.v) AS high, bool_and(cmp.pos = cmp.now_at OR cur.v - cur.base > cmp.v - cmp.base) AS wide,
  bool_and(cmp.pos = cmp.now_at OR (cur.v - cur.base) * abs(cmp.base) > (cmp.v - cmp.base) * abs(cur.base)) AS steep FROM cmp LEFT JOIN cur USING (article, idx, operator) GROUP BY ALL),
r AS (SELECT spec.article, spec.idx, spec.operator, claim_count, n, up, high, wide, steep, CASE WHEN len(expected_at) = 0 THEN 'RANGE_CLAIM_MONTH_SCOPE_AMBIGUOUS' WHEN NOT yearly AND twice > 0 THEN 'RANGE_CELLS_DUPLICATED' WHEN first_bad IS NOT NULL THEN first_bad
  WHEN spec.operator IN ('YOY_RATE_MAX_SINCE', 'YOY_DIFFERENCE_MAX_SINCE') AND zero THEN 'RANGE_ZERO_BASELINE' END AS reason FROM spec LEFT JOIN gaps USING (article, idx, operator) LEFT JOIN judged USING (article, idx, operator))
SELECT article, idx::INT AS idx, operator, CASE WHEN reason IS NULL THEN 'evaluated' ELSE 'not_evaluated' END AS status, reason,
  CASE WHEN reason IS NULL THEN coalesce(CASE operator WHEN 'YOY_STREAK' THEN n = claim_count AND up WHEN 'MONTH_OF_YEAR_MAX_SINCE' THEN n > 0 AND high WHEN 'YOY_RATE_MAX_SINCE' THEN n > 0 AND steep ELSE n > 0 AND wide END, false) END AS finding FROM r"""
