"""The layers end to end, on literal articles: spans, roles, routing, search paths, and verdicts on cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compare import compare_canonical, verdict
from ..functions.quantity import normalize_quantity
from ..operators import cells, layers
from ..operators.context import checkpointed
from .language import _literal

QUERIES: dict = {}
SQL: dict[str, str] = {}
V = "VARCHAR"

ARTICLES = [("a1", "t", "국가데이터처가 2025년 3월 고용동향을 발표했다. 3월 실업률은 3.1%를 기록했다. 전년 동월보다 0.2%p 올랐다. 한 민간업체는 5%로 봤다.", "2025-04-10")]
LAYOUT = [("a1", 0, True, None, "공식집계", "", "2025년 3월"), ("a1", 1, False, 0, "", "실업률", ""), ("a1", 2, False, 1, "", "", ""), ("a1", 3, True, None, "민간조사", "실업률 전망", "")]
CELLS = [("실업률", "2025-03", "3.1", "%"), ("실업률", "2024-03", "2.9", "%")]


def articles(s: SparkSession) -> DataFrame:
    return s.createDataFrame(ARTICLES, "article_idx string, title string, article_text string, date string")


def stacked(s: SparkSession) -> DataFrame:
    layout = s.createDataFrame(LAYOUT, "article_idx string, sentence_id int, opens boolean, governing int, subtype string, indicator string, period_raw string")
    return layers.run_stack(articles(s), layout)


QUERIES["run_stack"] = lambda s, d: stacked(s).select("article_idx", "sentence_id", "value", "unit", "indicator", "indicator_source", "source_subtype", "measurement", "period", "basis", "baseline", "routing_class", "reason")
SQL["run_stack"] = _literal(
    [("article_idx", V), ("sentence_id", "INTEGER"), *[(n, V) for n in ("value", "unit", "indicator", "indicator_source", "source_subtype", "measurement", "period", "basis", "baseline", "routing_class", "reason")]],
    [
        ("a1", 1, "3.1", "%", "실업률", "LOCAL", "공식집계", "LEVEL", "2025-03", "NONE", "", "KOSIS_CANDIDATE", "OFFICIAL_AGGREGATE_REGION"),
        ("a1", 2, "0.2", "%p", "실업률", "INHERITED", "공식집계", "CHANGE_POINT", "2025-03", "YOY", "2024-03", "KOSIS_CANDIDATE", "OFFICIAL_AGGREGATE_REGION"),
        ("a1", 3, "5", "%", "실업률 전망", "LOCAL", "민간조사", "LEVEL", "", "NONE", "", "OUT_OF_SCOPE", "SOURCE_SUBTYPE_민간조사"),
    ],
)


def judge_values(stack: DataFrame, facts: DataFrame) -> DataFrame:
    """``(target_id, article_idx, sentence_id, value, status, verdict)``: levels against their cell, changes against the difference of two cells; other values stay unverifiable, with the reason.

    ``facts(indicator, period, dt)``. The stack is used for plans, baselines and the result, so it is checkpointed once.
    """
    v = checkpointed(stack.withColumn("target_id", F.concat_ws(":", "article_idx", "span_id")))
    plans = v.where("routing_class = 'KOSIS_CANDIDATE'").select("target_id", "indicator", "period", "baseline", "value", "unit", "measurement")
    now = cells.exact_cell(plans, facts, ["indicator", "period"], "dt").select("target_id", F.col("cell_value").alias("now"), F.col("cell_status").alias("now_status"))
    past_plans = plans.where("baseline <> ''").select("target_id", "indicator", F.col("baseline").alias("period"))
    past = cells.exact_cell(past_plans, facts, ["indicator", "period"], "dt").select("target_id", F.col("cell_value").alias("past"))
    both = plans.join(now, "target_id").join(past, "target_id", "left")
    difference = (F.col("now").try_cast("decimal(20,6)") - F.col("past").try_cast("decimal(20,6)")).cast("string")
    official = F.when(F.col("measurement") == "CHANGE_POINT", difference).otherwise(F.col("now"))
    read = both.withColumn("c", normalize_quantity(F.col("value"), F.col("unit"))).withColumn("o", normalize_quantity(official, F.col("unit")))
    status = F.when(F.col("now_status") != "CELL_RESOLVED", F.col("now_status")).otherwise(F.coalesce(F.col("c.error"), F.col("o.error"), compare_canonical(F.col("c"), F.col("o"))))
    judged = read.select("target_id", status.alias("status"))
    out = v.select("target_id", "article_idx", "sentence_id", "value", "reason").join(judged, "target_id", "left")
    why = F.coalesce("status", "reason")
    return out.select("target_id", "article_idx", "sentence_id", "value", why.alias("status"), verdict(why).alias("verdict"))


def verify_articles(s: SparkSession, d: str) -> DataFrame:
    facts = s.createDataFrame(CELLS, "indicator string, period string, dt string, unit string").drop("unit")
    return judge_values(stacked(s), facts).select("target_id", "value", "status", "verdict")


QUERIES["verify_articles"] = verify_articles
SQL["verify_articles"] = _literal([(n, V) for n in ("target_id", "value", "status", "verdict")], [
    ("a1:s1:value_unit:37-41", "3.1", "MATCH", "VERIFIED"), ("a1:s2:value_unit:57-62", "0.2", "MATCH", "VERIFIED"), ("a1:s3:value_unit:76-78", "5", "SOURCE_SUBTYPE_민간조사", "UNVERIFIABLE"),
])

QUERIES["query_register"] = lambda s, d: layers.query_register(s.createDataFrame([("t1", "실업률", "청년", "청년 실업률 3.2%"), ("t2", "고용률", "", "1,000")], "target_id string, indicator string, item string, sentence string"))
SQL["query_register"] = _literal([(n, V) for n in ("target_id", "role", "channel", "query")], [
    *[("t1", "indicator", c, "실업률") for c in ("official", "bm25", "dense")], ("t1", "item", "bm25", "청년"), ("t1", "item", "dense", "청년"), ("t1", "sentence", "dense", "청년 실업률 %"), *[("t2", "indicator", c, "고용률") for c in ("official", "bm25", "dense")],
])
