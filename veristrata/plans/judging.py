"""Queries about source scope, target choice, clarification, plans, and other literal cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compare, quantity
from ..operators import binding, cells, context, ledger, pages, retrieval, routing, scope, text
from ..sources.tables import table
from .language import _literal

QUERIES: dict = {}
SQL: dict[str, str] = {}
V = "VARCHAR"

SCOPES = [
    ("한국은행", "KOSIS등재", "301"), ("한은", "KOSIS등재", "301"), ("한국 은행", "KOSIS등재", "301"), ("IMF", "해외기관", None), ("어느위원회", "공식기관_비KOSIS", None), ("가나다상사", "민간기관", None), ("없음", "불명", None), (None, "불명", None),
]


def source_scope(s: SparkSession, d: str) -> DataFrame:
    orgs = s.createDataFrame([("301", "한국은행"), ("101", "국가데이터처")], "org_id string, org_name string")
    aliases = s.createDataFrame([("한은", "한국은행"), ("통계청", "국가데이터처")], "alias string, org_name string")
    return scope.source_scope(s.createDataFrame([r[:1] for r in SCOPES], "org string"), orgs, aliases, "org")


QUERIES["source_scope"] = source_scope
SQL["source_scope"] = _literal([("org", V), ("scope", V), ("org_id", V)], SCOPES)

PREFILTERS = [(True, "집계통계", "KOSIS등재", "검증시도"), (True, "집계통계", None, "강등"), (True, "집계통계", "민간기관", "제외"), (False, "집계통계", "KOSIS등재", "제외"), (None, "", "x", "강등"), (True, "전망", "x", "제외")]
QUERIES["prefilter"] = lambda s, d: s.createDataFrame([r[:3] for r in PREFILTERS], "c boolean, k string, o string").select("c", "k", "o", scope.prefilter(F.col("c"), F.col("k"), F.col("o")).alias("verdict"))
SQL["prefilter"] = _literal([("c", "BOOLEAN"), ("k", V), ("o", V), ("verdict", V)], PREFILTERS)

LABELS = [(True, "전망", None, "전망", None, None, False), (True, "zzz", "잡음", None, None, "zzz", True), (False, "전망", "zzz", None, "기타", "전망", True), (None, None, "광고", None, "광고", None, False)]


def label_normalize(s: SparkSession, d: str) -> DataFrame:
    rows = s.createDataFrame([r[:3] for r in LABELS], "c boolean, k string, n string")
    out = rows.withColumn("x", scope.normalize_label(F.col("c"), F.col("k"), F.col("n"), ["전망", "집계통계"], ["광고", "기타"]))
    return out.select("c", "k", "n", "x.claim_class", "x.noise_reason", "x.claim_class_raw", "x.consistency_fix")


QUERIES["label_normalize"] = label_normalize
SQL["label_normalize"] = _literal([("c", "BOOLEAN"), ("k", V), ("n", V), ("claim_class", V), ("noise_reason", V), ("claim_class_raw", V), ("consistency_fix", "BOOLEAN")], LABELS)


def select_target(s: SparkSession, d: str) -> DataFrame:
    rows = [("q", "t1", "실업률", "2023", "LEVEL"), ("q", "t2", "청년 실업률", "2024", "LEVEL"), ("q", "t3", "실업률", "2024", "LEVEL"), ("q", "t4", "고용률", "2024", "LEVEL")]
    df = s.createDataFrame(rows, "article string, target_id string, indicator string, period string, measurement string").withColumn("query", F.lit("2024년 실업률은?"))
    return scope.select_target(df, "query", ["article"]).select("target_id", "score")


QUERIES["select_target"] = select_target
SQL["select_target"] = _literal([("target_id", V), ("score", "INTEGER")], [("t3", 153)])


def article_date_ctx(s: SparkSession, d: str) -> DataFrame:
    rows = s.createDataFrame([("a1", "b c"), ("a1", "zz"), ("a9", "b")], "article_idx string, sentence string")
    return scope.article_date(rows, s.createDataFrame([("a1", "a b c d", "2024-05-01")], "article_idx string, article_text string, date string"))


QUERIES["article_date_ctx"] = article_date_ctx
SQL["article_date_ctx"] = _literal([("article_idx", V), ("sentence", V), ("article_date", V), ("error", V)], [("a1", "b c", "2024-05-01", None), ("a1", "zz", None, None), ("a9", "b", None, "ARTICLE_UNKNOWN")])


def clarify_merge(s: SparkSession, d: str) -> DataFrame:
    rows = s.createDataFrame([("t1", "old", "m"), ("t2", "old", "m"), ("t3", "old", "m")], "target_id string, item string, period string")
    answers = s.createDataFrame([("t1", "item", "new"), ("t2", "item", "x"), ("t2", "item", "y")], "target_id string, role string, value string")
    return scope.clarify(rows, answers)


QUERIES["clarify_merge"] = clarify_merge
SQL["clarify_merge"] = _literal([("target_id", V), ("item", V), ("period", V), ("error", V)], [("t1", "new", "m", None), ("t2", "old", "m", "CLARIFICATION_CONFLICT"), ("t3", "old", "m", None)])


def plan_inventory(s: SparkSession, d: str) -> DataFrame:
    """Plans on brands' profiles: sound, unknown item, period out of range, wrong value, unknown table."""
    part = table(s, d, "part").where("p_brand = 'Brand#11'").withColumn("key", F.lit("B"))
    items = part.select("key", F.col("p_partkey").alias("itm_id"), F.col("p_name").alias("itm_nm"), F.lit("원").alias("unit"))
    values = part.select("key", F.lit("T").alias("obj_id"), F.lit(1).alias("level"), F.col("p_type").alias("value_id"), F.col("p_type").alias("value_name")).distinct()
    periods = part.select("key", F.lit("Y").alias("freq"), F.lit(1995).alias("lo"), F.lit(2001).alias("hi")).distinct()
    profile = binding.hydrate_profile(part.select("key").distinct(), items, values, periods, "key").withColumnRenamed("key", "table_key")
    good = part.agg(F.min("p_partkey").alias("i"), F.min("p_type").alias("v"))
    cases = [("p1", "B", 0, "Y", 1996, ""), ("p2", "B", -1, "Y", 1996, ""), ("p3", "B", 0, "Y", 2005, ""), ("p4", "B", 0, "Y", 1996, "zz"), ("p5", "C", 0, "Y", 1996, "")]
    plans = s.createDataFrame(cases, "target_id string, table_key string, off int, freq string, ord int, wrong string").crossJoin(F.broadcast(good))  # one row
    plans = plans.select("target_id", "table_key", F.when(F.col("off") == 0, F.col("i")).otherwise(-1).alias("itm_id"), "freq", "ord", F.when(F.col("table_key") == "B", F.array(F.concat("v", "wrong"))).otherwise(F.array().cast("array<string>")).alias("levels"))
    return scope.plan_inventory(plans, profile).select("target_id", F.array_join("errors", ",").alias("errors"))


QUERIES["plan_inventory"] = plan_inventory
SQL["plan_inventory"] = _literal([("target_id", V), ("errors", V)], [("p1", ""), ("p2", "ITEM_ID_OR_UNIT"), ("p3", "PERIOD_RANGE"), ("p4", "OBJ_LEVEL_VALUE"), ("p5", "TABLE_ID_MISMATCH,ITEM_ID_OR_UNIT,PERIOD_RANGE")])

DERIVED = [("PERCENT_CHANGE", 110.0, 100.0, 10.0), ("DIFFERENCE", 110.0, 100.0, 10.0), ("RATIO", 50.0, 100.0, 0.5), ("RATIO", 1.0, 0.0, None), ("PERCENT_CHANGE", 1.0, 0.0, None)]
QUERIES["derived"] = lambda s, d: s.createDataFrame([r[:3] for r in DERIVED], "op string, m double, b double").select("op", "m", "b", compare.derived(F.col("op"), F.col("m"), F.col("b")).alias("v"))
SQL["derived"] = _literal([("op", V), ("m", "DOUBLE"), ("b", "DOUBLE"), ("v", "DOUBLE")], DERIVED)

CONVERT = [(5.0, "억원", "만원", 50000.0), (2.0, "천명", "명", 2000.0), (3.0, "%", "%", 3.0), (3.0, "%", "%p", None), (1.0, "kg", "t", None)]
QUERIES["convert_value"] = lambda s, d: s.createDataFrame([r[:3] for r in CONVERT], "v double, a string, b string").select("v", "a", "b", quantity.convert_value(F.col("v"), F.col("a"), F.col("b")).alias("out"))
SQL["convert_value"] = _literal([("v", "DOUBLE"), ("a", V), ("b", V), ("out", "DOUBLE")], CONVERT)

FAMILIES = [("월별 출생아 수 증가율", "출생아"), ("실업률", "실업률"), ("가장 많았던 수출 증가 폭 감소율", "수출"), ("혼인 건수", "혼인")]
QUERIES["family_key"] = lambda s, d: s.createDataFrame([r[:1] for r in FAMILIES], "label string").select("label", binding.family_key(F.col("label")).alias("family"))
SQL["family_key"] = _literal([("label", V), ("family", V)], FAMILIES)

VARIANTS = [("실업률", "청년", "청년 실업률은 3.2% 올랐다", "indicator:실업률|item:청년|sentence:청년 실업률은 % 올랐다"), ("청년 실업률", "청년", "", "indicator:청년 실업률"), ("", "", "3", "")]


def query_variants(s: SparkSession, d: str) -> DataFrame:
    rows = s.createDataFrame([r[:3] for r in VARIANTS], "ind string, item string, s string")
    v = F.transform(routing.query_variants(F.col("ind"), F.col("item"), F.col("s")), lambda x: F.concat_ws(":", x["role"], x["query"]))
    return rows.select("ind", "item", "s", F.array_join(v, "|").alias("variants"))


QUERIES["query_variants"] = query_variants
SQL["query_variants"] = _literal([("ind", V), ("item", V), ("s", V), ("variants", V)], VARIANTS)

MEASURES = [("실업률", "%p", "", "CHANGE_POINT"), ("수출 증가율", "%", "", "CHANGE_RATE"), ("수출", "%", "증가했다", "CHANGE_RATE"), ("물가지수", "", "", "INDEX_LEVEL"), ("실업률", "%", "기록했다", "LEVEL")]
QUERIES["measurement_type"] = lambda s, d: s.createDataFrame([r[:3] for r in MEASURES], "i string, u string, t string").select("i", "u", "t", routing.measurement_type(F.col("i"), F.col("u"), F.col("t")).alias("m"))
SQL["measurement_type"] = _literal([("i", V), ("u", V), ("t", V), ("m", V)], MEASURES)

UNITS = [("원", "", "원", False), ("", "명", "명", False), ("원", "명", None, True), ("", "", None, False), ("억 원", "억원", "억 원", False)]


def series_unit(s: SparkSession, d: str) -> DataFrame:
    rows = s.createDataFrame([r[:2] for r in UNITS], "a string, b string").withColumn("x", binding.series_unit(F.col("a"), F.array("b")))
    return rows.select("a", "b", "x.unit", "x.conflict")


QUERIES["series_unit"] = series_unit
SQL["series_unit"] = _literal([("a", V), ("b", V), ("unit", V), ("conflict", "BOOLEAN")], UNITS)

SPANS = [("a b a", "b", "FOUND", 2), ("a b a", "a", "AMBIGUOUS", None), ("aaa", "aa", "AMBIGUOUS", None), ("abc", "x", "NOT_FOUND", None), ("abc", "", "EMPTY", None), ("가나다", "다", "FOUND", 2)]


def span_resolve(s: SparkSession, d: str) -> DataFrame:
    rows = s.createDataFrame([r[:2] for r in SPANS], "t string, p string").withColumn("x", text.unique_span(F.col("t"), F.col("p")))
    return rows.select("t", "p", "x.status", "x.start")


QUERIES["span_resolve"] = span_resolve
SQL["span_resolve"] = _literal([("t", V), ("p", V), ("status", V), ("start", "INTEGER")], SPANS)


def recovery_plan(s: SparkSession, d: str) -> DataFrame:
    """Nations with one rich supplier are ready, with several are asked about; the others search anew or stop."""
    p = table(s, d, "supplier").select(F.col("s_nationkey").alias("target_id"), F.when(F.col("s_acctbal") > 9000, F.col("s_name")).alias("signature"), F.when(F.col("s_acctbal") < 0, "UNIT_MISMATCH").otherwise("ITEM_MISSING").alias("reason"))
    return binding.recovery(p)


QUERIES["recovery_plan"] = recovery_plan
SQL["recovery_plan"] = """WITH g AS (SELECT s_nationkey AS target_id, count(DISTINCT CASE WHEN s_acctbal > 9000 THEN s_name END) AS n, avg((s_acctbal >= 0)::INTEGER) AS miss FROM supplier GROUP BY 1)
SELECT target_id, CASE WHEN n = 1 THEN 'QUERY_READY' WHEN n > 1 THEN 'ASK_USER' WHEN miss >= 0.8 THEN 'CORRECTIVE_RETRIEVAL' ELSE 'STOP' END AS action FROM g"""


def dominance(s: SparkSession, d: str) -> DataFrame:
    """Of each nation's suppliers the richest, then the first by name."""
    return binding.dominance(table(s, d, "supplier"), "s_nationkey", [F.desc(F.floor(F.col("s_acctbal") / 1000)), F.col("s_name")]).select("s_nationkey", "s_suppkey", "unique")


QUERIES["dominance"] = dominance
SQL["dominance"] = """SELECT s_nationkey, s_suppkey, true AS "unique" FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000) DESC, s_name) AS r FROM supplier) WHERE r = 1"""


def tree_crawl(s: SparkSession, d: str) -> DataFrame:
    """Regions, nations and suppliers as a category tree, walked from its roots; each node once, with its depth."""
    edges = (
        table(s, d, "region").select(F.lit(None).cast("string").alias("parent"), F.concat(F.lit("r"), "r_regionkey").alias("child"))
        .unionByName(table(s, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child")))
        .unionByName(table(s, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.concat(F.lit("s"), "s_suppkey").alias("child")))
    )
    return context.walk_tree(edges)


QUERIES["src_tree_crawl"] = tree_crawl
SQL["src_tree_crawl"] = "SELECT 'r' || r_regionkey AS node, 0::INTEGER AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 's' || s_suppkey, 2 FROM supplier"


def search_page(s: SparkSession, d: str) -> DataFrame:
    """Fused sources, hydrated with their number of documents, the second page of five; the fusion's limit comes first."""
    from . import search

    fused = search.QUERIES["rrf_fuse"](s, d).where("target_id = 't1'")
    sizes = table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n_docs"))
    return fused.join(sizes, "source").where("fused_rank BETWEEN 6 AND 10").select("source", "fused_rank", "n_docs")


def _search_sql() -> str:
    from . import search

    return f"WITH f AS ({search.SQL['rrf_fuse']}), z AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY 1) SELECT source, fused_rank, n_docs FROM f JOIN z USING (source) WHERE target_id = 't1' AND fused_rank BETWEEN 6 AND 10"


QUERIES["search_page"] = search_page
SQL["search_page"] = _search_sql()


def json_object_parse(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", pages.json_object(F.concat(F.lit("noise "), "props", F.lit(" tail")), "k int")["k"].alias("k"))


QUERIES["json_object_parse"] = json_object_parse
SQL["json_object_parse"] = "SELECT event_id, json_extract(props, '$.k')::INTEGER AS k FROM events"


def article_summary(s: SparkSession, d: str) -> DataFrame:
    """Customers as articles: verdicts and reasons of their orders, and which of their prices another order's digits cover."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("article"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    answers = o.select("article", F.when(F.col("o_orderstatus") == "F", "VERIFIED").when(F.col("o_orderstatus") == "O", "REFUTED").otherwise("UNVERIFIABLE").alias("verdict"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("blocker"))
    numbers = o.select("article", F.format_string("%,d", F.col("o_orderkey")).alias("surface"))
    values = o.where("o_orderkey % 2 = 0").select("article", (F.col("o_orderkey") * 10).cast("string").alias("value_text"))
    shown = lambda c, f: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[f], x["n"])), ",")
    out = ledger.article_summary(answers, numbers, values, "article")
    return out.select("article", "answers", shown("verdicts", "verdict").alias("verdicts"), shown("blockers", "blocker").alias("blockers"), "numbers", "covered")


QUERIES["article_summary"] = article_summary
SQL["article_summary"] = """WITH a AS (SELECT o_custkey AS article, o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'VERIFIED' WHEN 'O' THEN 'REFUTED' ELSE 'UNVERIFIABLE' END AS v, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS b FROM orders),
vs AS (SELECT article, string_agg(concat(v, ':', n), ',' ORDER BY v) AS verdicts FROM (SELECT article, v, count(*) AS n FROM a GROUP BY 1, 2) GROUP BY 1), bs AS (SELECT article, string_agg(concat(b, ':', n), ',' ORDER BY b) AS blockers FROM (SELECT article, b, count(*) AS n FROM a WHERE b IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT article, count(*) AS numbers, count(*) FILTER (EXISTS (SELECT 1 FROM a o WHERE o.article = a.article AND o.k % 2 = 0 AND (contains((o.k * 10)::VARCHAR, a.k::VARCHAR) OR contains(a.k::VARCHAR, (o.k * 10)::VARCHAR)))) AS covered FROM a GROUP BY 1)
SELECT article, numbers AS answers, verdicts, blockers, numbers, covered FROM c JOIN vs USING (article) LEFT JOIN bs USING (article)"""


def primary_target(s: SparkSession, d: str) -> DataFrame:
    """Orders as articles: lines by ship month and supplier parity as series, returned ones as levels, others as changes from the line status."""
    li = table(s, d, "lineitem")
    rows = li.select(
        F.col("l_orderkey").alias("article"), F.lit(0).alias("sentence"), (F.col("l_suppkey") % 2).alias("family"), F.lit("p").alias("period"), F.when(F.col("l_returnflag") == "R", "LEVEL").when(F.col("l_returnflag") == "A", "CHANGE_RATE").otherwise("CHANGE_POINT").alias("measurement"),
        F.when(F.col("l_linestatus") == "O", "2023").otherwise(F.when(F.col("l_linenumber") > 1, "2022")).alias("baseline"), F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("target_id"),
    )
    return cells.primary_target(rows, ["article"])


QUERIES["primary_target"] = primary_target
SQL["primary_target"] = """WITH r AS (SELECT l_orderkey AS article, l_suppkey % 2 AS family, l_returnflag = 'R' AS lv, CASE WHEN l_linestatus = 'O' THEN '2023' WHEN l_linenumber > 1 THEN '2022' ELSE '' END AS b, concat_ws(':', l_linenumber, l_partkey, l_suppkey) AS t FROM lineitem),
g AS (SELECT article, family, min(t) FILTER (lv) AS t, count(*) FILTER (NOT lv) AS n, min(b) FILTER (NOT lv) AS b FROM r GROUP BY 1, 2 HAVING count(*) FILTER (lv) = 1 AND count(*) FILTER (NOT lv) > 0 AND count(DISTINCT b) FILTER (NOT lv) = 1 AND min(b) FILTER (NOT lv) <> ''),
o AS (SELECT article, count(*) AS k, min(t) AS t, min(n) AS n, min(b) AS b FROM g GROUP BY 1), a AS (SELECT DISTINCT article FROM r)
SELECT a.article, CASE WHEN k = 1 THEN t END AS target_id, CASE WHEN k = 1 THEN n END AS siblings, CASE WHEN k = 1 THEN b END AS baseline, CASE WHEN k IS NULL OR k > 1 THEN 'PRIMARY_TARGET_AMBIGUOUS' END AS error FROM a LEFT JOIN o ON o.article = a.article"""


def cell_cache(s: SparkSession, d: str) -> DataFrame:
    """Orders looked up by customer and date in a cache whose equal entries count once."""
    o = table(s, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    cache = o.unionByName(o).dropDuplicates(["o_custkey", "day", "o_totalprice"])
    plans = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(None).cast("date").alias("day"))
    return cells.exact_cell(plans, cache, ["o_custkey", "day"], "o_totalprice").groupBy("cell_status").agg(F.count("*").alias("n"))


QUERIES["cell_cache_match"] = cell_cache
SQL["cell_cache_match"] = """WITH c AS (SELECT DISTINCT o_custkey, o_orderdate::DATE AS day, o_totalprice FROM orders), n AS (SELECT c_custkey, count(o_totalprice) AS k FROM customer LEFT JOIN c ON c_custkey = o_custkey GROUP BY 1)
SELECT CASE WHEN k = 0 THEN 'NO_CELL' WHEN k > 1 THEN 'MULTIPLE_CELLS' ELSE 'CELL_RESOLVED' END AS cell_status, count(*) AS n FROM n GROUP BY 1"""

QUERIES["retrieval_cache"] = lambda s, d: retrieval.facets(table(s, d, "conversations").select("role", F.sha2(F.lower(F.trim("text")).cast("binary"), 256).alias("h")).distinct(), ["role"])
SQL["retrieval_cache"] = "SELECT role, count(DISTINCT lower(trim(text))) AS n FROM conversations GROUP BY 1"
