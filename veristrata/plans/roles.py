"""Roles and fields of the values of made articles: a customer an article, an order a sentence, of four shapes in the order that the table gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fields, roles
from ..sources.tables import table, tasks_for

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Both engines read these: orders of a customer in order, their shape, a number, a month, and whether a sentence begins a region of its own.
_LINES = """SELECT o_custkey AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sid, o_orderkey % 4 AS k, CAST(floor(o_totalprice) AS INT) % 90 AS q, CAST(floor(o_totalprice) AS INT) % 12 + 1 AS m,
  o_orderstatus = 'F' AND CAST(floor(o_totalprice) AS INT) % 5 = 0 AS opens, o_orderdate FROM orders"""
_SENTENCE = "CASE k WHEN 0 THEN concat('서울 수출은 전년 동월보다 ', q, '% 늘었다.') WHEN 1 THEN concat('서울 생산은 ', q, '%, 부산 소비는 ', q + 1, '% 줄었다.') WHEN 2 THEN concat('증가율은 ', q, '%였다.') ELSE concat(m, '월에는 전월보다 ', q, '% 올랐다.') END"


def _tasks(s: SparkSession, d: str) -> int:
    return tasks_for(table(s, d, "orders"), 20_000)  # a sentence an order


def made_articles(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Articles, each opened by a sentence that dates it, and their layout: labels with places (shapes 0 and 1), without (2) and none (3)."""
    orders = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate").repartition(_tasks(s, d), "o_custkey")  # the one shuffle of window and groups; texts cost more than their bytes tell
    lines = s.sql(_LINES.replace("FROM orders", "FROM {orders}"), orders=orders).withColumn("said", F.expr(_SENTENCE))
    each = lines.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("sid", "said", "k", "q", "opens"))).alias("lines"), F.max(F.to_date("o_orderdate")).alias("day"))
    dated = F.concat(F.year("day").cast("string"), F.lit("년 "), F.month("day").cast("string"), F.lit("월"))
    body = F.concat_ws(" ", F.concat(F.lit("통계청이 "), dated, F.lit(" 자료를 냈다.")), F.array_join(F.transform("lines", lambda x: x["said"]), " "))
    articles = each.select(F.col("a").cast("string").alias("article_idx"), body.alias("article_text"), F.col("day").cast("string").alias("date"))
    label = lambda t, a=None: F.struct(F.lit(t).alias("label"), F.lit(a).cast("int").alias("start"), F.lit(None if a is None else a + 2).cast("int").alias("end"))
    second = F.lit(7) + F.length(F.col("x.q").cast("string")) + 1 + 2 + 3  # behind the first value, its unit, a comma and a name
    scopes = (
        F.when(F.col("x.k") == 0, F.array(label("수출", 3))).when(F.col("x.k") == 1, F.array(label("생산", 3), F.struct(F.lit("소비").alias("label"), second.alias("start"), (second + 2).alias("end"))))
        .when(F.col("x.k") == 2, F.array(label("증가율")))
    )
    key = F.col("a").cast("string").alias("article_idx")
    subtype = F.when(F.col("a") % 2 == 0, "공식집계").otherwise("민간조사")
    first = each.select(key, F.lit(0).alias("sentence_id"), F.lit(True).alias("opens"), F.lit(None).cast("int").alias("governing"), subtype.alias("subtype"), F.lit(None).cast(roles.SCOPES).alias("scopes"), dated.alias("period_raw"))
    sid = F.col("x.sid").cast("int")
    rest = each.select("*", F.explode("lines").alias("x")).select(key, sid.alias("sentence_id"), F.col("x.opens").alias("opens"), (sid - 1).alias("governing"), F.when(F.col("x.opens"), "정책목표").otherwise("").alias("subtype"), scopes.alias("scopes"), F.lit("").alias("period_raw"))
    return articles, first.unionByName(rest)


# What holds for each value, computed from the lines: regions and the last label before by windows.
_HELD = f"""l AS ({_LINES}), s AS (SELECT a, 0 AS sid, -1 AS k, 0 AS q, 0 AS m, true AS opens, max(o_orderdate) AS o_orderdate FROM l GROUP BY a UNION ALL SELECT * FROM l),
w AS (SELECT *, CASE k WHEN 0 THEN '수출' WHEN 1 THEN '소비' WHEN 2 THEN '증가율' END AS own, max(CASE WHEN opens THEN sid END) OVER r AS region,
  last_value(CASE k WHEN 0 THEN '수출' WHEN 1 THEN '소비' WHEN 2 THEN '증가율' END IGNORE NULLS) OVER b AS head0, max(CASE WHEN k IN (0, 1, 2) THEN sid END) OVER b AS head_sid, lag(k) OVER o AS k_before, lag(m) OVER o AS m_before
  FROM s WINDOW o AS (PARTITION BY a ORDER BY sid), r AS (PARTITION BY a ORDER BY sid ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY a ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, CASE WHEN head_sid >= region THEN head0 END AS head, last_day AS day FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY a)::DATE AS last_day FROM w) WHERE k >= 0),
v AS (SELECT h.*, p.place, CASE WHEN k = 1 AND p.place = 0 THEN '생산' ELSE own END AS said FROM h, (VALUES (0), (1)) p(place) WHERE p.place = 0 OR k = 1)"""


def assign_roles(s: SparkSession, d: str) -> DataFrame:
    articles, layout = made_articles(s, d)
    return roles.assign_roles(roles.sentence_values(articles), layout, _tasks(s, d)).select(
        "article_idx", "sentence_id", "value", "indicator", "indicator_source", "indicator_pairing", "region", "source_subtype", "period_raw", "period_source", "region_status", "region_surface"
    )


QUERIES["assign_roles"] = assign_roles
SQL["assign_roles"] = f"""WITH {_HELD} SELECT a::VARCHAR AS article_idx, sid::INTEGER AS sentence_id, (q + place)::VARCHAR AS value, CASE WHEN k = 2 AND head IN ('수출', '소비') THEN concat(head, ' 증가율') WHEN k = 3 THEN head ELSE said END AS indicator,
  CASE WHEN k = 2 AND head IN ('수출', '소비') THEN 'LOCAL_COMPOSED' WHEN k < 3 THEN 'LOCAL' WHEN head IS NOT NULL THEN 'INHERITED' ELSE 'NONE' END AS indicator_source, CASE k WHEN 1 THEN 'SPAN_NEAREST' WHEN 3 THEN NULL ELSE 'POSITIONAL' END AS indicator_pairing,
  region::INTEGER AS region, CASE WHEN region > 0 THEN '정책목표' WHEN a % 2 = 0 THEN '공식집계' ELSE '민간조사' END AS source_subtype,
  CASE WHEN k = 3 THEN concat(m, '월') WHEN region = 0 THEN concat(year(day), '년 ', month(day), '월') ELSE '' END AS period_raw, CASE WHEN k = 3 THEN 'LOCAL_SENTENCE_FALLBACK' WHEN region = 0 THEN 'INHERITED' ELSE 'NONE' END AS period_source,
  CASE k WHEN 0 THEN 'EXACT' WHEN 1 THEN 'AMBIGUOUS' END AS region_status, CASE WHEN k = 0 THEN '서울' END AS region_surface FROM v"""


def compose_fields(s: SparkSession, d: str) -> DataFrame:
    articles, layout = made_articles(s, d)
    tasks = _tasks(s, d)
    assigned = roles.assign_roles(roles.sentence_values(articles), layout, tasks).repartition(tasks, "article_idx").join(articles.select("article_idx", F.to_date("date").alias("day")), "article_idx")
    out = fields.compose_fields(assigned, F.col("day"))
    return out.select("article_idx", "sentence_id", "value", "measurement", "basis", "period", "baseline", "period_note", "period_grain", "period_basis", "direction", F.array_join("item", ",").alias("item"), F.array_join("dimension", ",").alias("dimension"))


QUERIES["compose_fields"] = compose_fields
SQL["compose_fields"] = f"""WITH {_HELD}, t AS (SELECT *, k < 3 AND region = 0 AS carried, k < 3 AND region = 0 AND k_before = 3 AS takes FROM v),
u AS (SELECT *, CASE WHEN takes THEN m_before WHEN k = 3 THEN m END AS mm FROM t),
x AS (SELECT *, CASE WHEN mm IS NOT NULL THEN make_date(year(day) - (mm > month(day))::INTEGER, mm::INTEGER, 1) WHEN k = 0 THEN date_trunc('month', day)::DATE END AS cell FROM u)
SELECT a::VARCHAR AS article_idx, sid::INTEGER AS sentence_id, (q + place)::VARCHAR AS value, CASE k WHEN 2 THEN 'LEVEL' ELSE 'CHANGE_RATE' END AS measurement, CASE k WHEN 0 THEN 'YOY' WHEN 3 THEN 'MOM' ELSE 'NONE' END AS basis,
  coalesce(strftime(cell, '%Y-%m'), '') AS period, CASE k WHEN 0 THEN strftime(cell - INTERVAL 12 MONTH, '%Y-%m') WHEN 3 THEN strftime(cell - INTERVAL 1 MONTH, '%Y-%m') ELSE '' END AS baseline,
  CASE WHEN takes THEN 'INHERITED_ARTICLE_SCOPE' WHEN carried THEN 'NOT_PRESENT' END AS period_note, CASE WHEN mm IS NULL THEN '' ELSE 'month' END AS period_grain, CASE WHEN cell IS NULL THEN 'UNRESOLVED' ELSE 'PUBLISHED_AT' END AS period_basis,
  CASE WHEN k = 1 AND place = 0 THEN NULL WHEN k = 1 THEN 'DECREASE' ELSE 'INCREASE' END AS direction, CASE WHEN k = 2 AND head IN ('수출', '소비') THEN head WHEN k = 3 AND head = '증가율' THEN '' ELSE '' END AS item,
  CASE k WHEN 0 THEN '서울' WHEN 1 THEN '서울,부산' ELSE '' END AS dimension FROM x"""


# A sentence and a raw period of eight kinds, by customer: dated, with two bases, the other side alone, a quarter, the other side behind a month, dated alone, a span, an operation.
_KIND, _AT = "o_custkey % 8", "CAST(month(o_orderdate) AS INT)"
_YEAR = "CAST(year(o_orderdate) AS INT)"
_PAIR_SAID = f"""CASE {_KIND} WHEN 0 THEN '전년 동월보다 3% 늘었다' WHEN 1 THEN '전년 동월과 전월보다 늘었다' WHEN 2 THEN '전월보다 늘었다' WHEN 3 THEN '직전 분기보다' WHEN 4 THEN concat({_AT}, '월 소비는 전월(3월)보다 늘었다') WHEN 5 THEN '전월(3월)보다 늘었다' WHEN 6 THEN '2019년보다 크게 늘었다' ELSE '3년 연속 늘었다' END"""
_PAIR_RAW = f"""CASE {_KIND} WHEN 2 THEN '전월' WHEN 3 THEN concat({_YEAR}, '년 ', CAST(quarter(o_orderdate) AS INT), '분기') WHEN 4 THEN '전월(3월)' WHEN 5 THEN '전월(3월)' WHEN 6 THEN '5년 간' WHEN 7 THEN '3년 연속' ELSE concat({_YEAR}, '년 ', {_AT}, '월') END"""
_PAIR_TYPE = "CASE o_orderkey % 3 WHEN 0 THEN 'CHANGE_RATE' WHEN 1 THEN 'CHANGE_POINT' ELSE 'LEVEL' END"


def period_pair(s: SparkSession, d: str) -> DataFrame:
    """Orders as values that were published on their day."""
    rows = table(s, d, "orders").select("o_orderkey", *[F.expr(e).alias(n) for n, e in (("said", _PAIR_SAID), ("raw", _PAIR_RAW), ("type", _PAIR_TYPE))], F.to_date("o_orderdate").alias("day"))
    return fields.period_pair(rows, F.col("raw"), F.col("said"), F.col("type"), F.col("day"), F.lit("")).select("o_orderkey", "pair.*")


QUERIES["period_pair"] = period_pair
SQL["period_pair"] = f"""WITH r AS (SELECT o_orderkey, {_KIND} AS k, {_PAIR_SAID} AS said, {_PAIR_RAW} AS raw, {_PAIR_TYPE} <> 'LEVEL' AS moved, o_orderdate::DATE AS day, {_AT} AS m FROM orders),
c AS (SELECT *, CASE WHEN NOT moved THEN 'NONE' ELSE CASE k WHEN 0 THEN 'YOY' WHEN 2 THEN 'MOM' WHEN 3 THEN 'QOQ' WHEN 4 THEN 'MOM' WHEN 5 THEN 'MOM' WHEN 6 THEN 'PERIOD_TO_PERIOD' ELSE 'NONE' END END AS basis,
  make_date(year(day)::INTEGER - (m < 3)::INTEGER, 3, 1) AS march, date_trunc('month', day)::DATE AS mon, date_trunc('quarter', day)::DATE AS qu FROM r)
SELECT o_orderkey, CASE WHEN k IN (0, 1, 3) THEN raw WHEN k = 4 AND moved THEN concat(m, '월') WHEN k = 6 AND NOT moved THEN '5년 간' ELSE '' END AS measurement_raw,
  CASE WHEN k IN (0, 1) OR (k IN (2, 4) AND moved) THEN strftime(mon, '%Y-%m') WHEN k = 3 THEN concat(year(qu), '-Q', quarter(qu)) WHEN k = 5 AND moved THEN strftime(march + INTERVAL 1 MONTH, '%Y-%m') ELSE '' END AS measurement,
  CASE basis WHEN 'NONE' THEN '' ELSE CASE k WHEN 0 THEN '전년 동월보다' WHEN 2 THEN '전월' WHEN 3 THEN '직전 분기보다' WHEN 6 THEN '2019년보다' ELSE '전월(3월)' END END AS baseline_raw,
  CASE basis WHEN 'YOY' THEN strftime(mon - INTERVAL 12 MONTH, '%Y-%m') WHEN 'QOQ' THEN concat(year(qu - INTERVAL 3 MONTH), '-Q', quarter(qu - INTERVAL 3 MONTH)) WHEN 'MOM' THEN CASE WHEN k = 2 THEN strftime(mon - INTERVAL 1 MONTH, '%Y-%m') ELSE strftime(march, '%Y-%m') END ELSE '' END AS baseline,
  basis, CASE WHEN k = 7 THEN 'DURATION_OR_RANGE' ELSE 'MEASUREMENT' END AS role FROM c"""
