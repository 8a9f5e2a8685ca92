"""The stricter monthly projection over a claim of every part: counts of subjects as values, months, regions and units that do not fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import monthly
from ..sources.tables import table
from . import bound

QUERIES: dict = {}
SQL: dict[str, str] = {}
_SUBJECT = "CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN '출생아' ELSE '사망자' END"
_PERIOD = "CASE WHEN p_partkey % 17 = 0 THEN '2024' ELSE concat('2024-', lpad(CAST(p_partkey % 12 + 1 AS STRING), 2, '0')) END"
_UNIT = "CASE WHEN p_size % 9 = 1 THEN '가구' WHEN p_size % 5 = 0 THEN '명' ELSE '' END"


def inputs(s: SparkSession, d: str) -> tuple[DataFrame, ...]:
    p = table(s, d, "part")
    said = p.select(F.col("p_partkey").alias("target_id"), F.expr(_SUBJECT).alias("subject"), F.expr(_PERIOD).alias("period"), F.expr(_UNIT).alias("stated"), "p_partkey")
    claims = bound.claims(s, d).join(said, "target_id").select("target_id", "indicator", "subject", F.col("stated").alias("unit"), F.when(F.col("p_partkey") % 13 == 0, "아틀란티스").otherwise(F.col("region")).alias("region"), F.lit("").alias("population"), "period")
    brands = p.select(F.col("p_brand").alias("table_key")).distinct().withColumn("b", F.regexp_extract("table_key", "([0-9]+)", 1).cast("int"))
    count = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in (("c1", "출생아 수(명)"), ("c2", "사망자 수 (명)"))]))
    axis = lambda rows, obj, level: rows.select("table_key", F.lit(obj).alias("obj_id"), F.lit("항목별").alias("obj_nm"), F.lit(level).alias("level"), count.alias("x")).select("table_key", "obj_id", "obj_nm", "level", F.col("x.i").alias("value_id"), F.col("x.n").alias("value_name"), F.lit("명").alias("value_unit"))
    # Brands by their number modulo ten: one has the counts on two axes, one has years only, one nothing.
    values = bound.values(s, d).unionByName(axis(brands, "C", 3)).unionByName(axis(brands.where("b % 10 = 3"), "E", 4))
    coverage = brands.where("b % 10 <> 5").select("table_key", F.when(F.col("b") % 10 == 4, "Y").otherwise("M").alias("freq"), F.lit(202401).alias("lo"), F.lit(202410).alias("hi"))
    return claims, bound.candidates(s, d), bound.items(s, d), values, coverage


def project_monthly(s: SparkSession, d: str) -> DataFrame:
    """How many series fit each claim, and why none does."""
    return monthly.project_monthly(*inputs(s, d), bound.ALIASES, True).drop("table_key")


def monthly_v2j(s: SparkSession, d: str) -> DataFrame:
    """Ready, or held for the best reason; every nineteenth size has a profile that is not complete."""
    profiles = table(s, d, "part").select(F.col("p_partkey").alias("target_id"), F.when(F.col("p_size") % 19 == 0, "PARTIAL").otherwise("COMPLETE").alias("status"))
    return monthly.resolve(monthly.project_monthly(*inputs(s, d), bound.ALIASES, True), profiles)


_V = lambda e: e.replace("STRING", "VARCHAR")
_PROJECTED = bound._CLAIMS + f""", q AS (SELECT p_partkey AS target_id, p_brand, p_size, {_V(_SUBJECT)} AS subject, {_V(_PERIOD)} AS period, {_UNIT} AS stated, p_partkey % 13 = 0 AS nowhere, regexp_extract(p_brand, '([0-9]+)', 1)::INT % 10 AS b FROM part),
ty AS (SELECT target_id, value_id, CASE WHEN rule = 'REGION' THEN NULL ELSE start END AS s, CASE WHEN rule = 'REGION' THEN NULL ELSE start + size END AS e FROM d WHERE obj_id = 'T' AND value_id IS NOT NULL AND (rule = 'REGION' OR NOT EXISTS (SELECT 1 FROM d o WHERE o.target_id = d.target_id AND o.rule = 'REGION'))),
go AS (SELECT target_id, value_id FROM d WHERE obj_id = 'G' AND value_id IS NOT NULL), it AS (SELECT target_id, itm_id, item_unit, start AS s, start + size AS e FROM iall WHERE itm_id IS NOT NULL),
co AS (SELECT target_id, CASE subject WHEN '출생아' THEN 'c1' WHEN '사망자' THEN 'c2' END AS value_id FROM q WHERE subject <> ''),
pr AS (SELECT it.target_id, itm_id, ty.value_id AS t, go.value_id AS g, co.value_id AS c, coalesce(NOT (it.s < ty.e AND ty.s < it.e), true) AS apart FROM it JOIN ty USING (target_id) JOIN go USING (target_id) JOIN co USING (target_id)),
ct AS (SELECT target_id, count(*) FILTER (apart) AS whole, min(concat(itm_id, '|', t, ',', g, ',', c)) FILTER (apart) AS sig FROM pr GROUP BY 1),
r AS (SELECT q.target_id, p_brand, p_size, sig, coalesce(whole, 0) AS whole, CASE WHEN length(period) = 4 THEN 'PERIOD_INVALID' WHEN b = 5 THEN 'PROFILE_INCOMPLETE' WHEN b = 4 THEN 'FREQUENCY_MISMATCH' WHEN period > '2024-10' THEN 'PERIOD_OUT_OF_RANGE' WHEN nowhere THEN 'REGION_UNBOUND'
  WHEN b = 3 AND subject <> '' THEN 'MULTIPLE_COMPATIBLE_SERIES' WHEN q.target_id NOT IN (SELECT target_id FROM it) THEN 'ITEM_MISSING'
  WHEN subject = '' OR q.target_id NOT IN (SELECT target_id FROM ty) OR q.target_id NOT IN (SELECT target_id FROM go) THEN 'DIMENSION_MISSING' WHEN coalesce(whole, 0) = 0 THEN 'SPAN_REUSE' WHEN stated = '가구' THEN 'UNIT_MISMATCH' END AS reason FROM q LEFT JOIN ct USING (target_id)),
n AS (SELECT *, CASE WHEN reason IS NULL THEN whole ELSE 0 END::DOUBLE AS n FROM r)"""
QUERIES["project_monthly"], QUERIES["monthly_v2j"] = project_monthly, monthly_v2j
SQL["project_monthly"] = f"WITH {_PROJECTED} SELECT target_id, n, CASE WHEN n = 1 THEN concat(p_brand, '|', sig) END AS signature, reason FROM n"
SQL["monthly_v2j"] = f"""WITH {_PROJECTED} SELECT target_id, CASE WHEN p_size % 19 <> 0 AND n = 1 THEN 'QUERY_READY' ELSE 'HOLD' END AS status, CASE WHEN p_size % 19 = 0 THEN 'PROFILE_COVERAGE_INCOMPLETE' WHEN n > 1 THEN 'MULTIPLE_COMPATIBLE_SERIES' ELSE reason END AS reason,
  CASE WHEN p_size % 19 <> 0 AND n = 1 THEN concat(p_brand, '|', sig) END AS signature FROM n"""
