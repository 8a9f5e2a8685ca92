"""Queries about text, numbers, periods, routing, binding and pages. Korean inputs are literal, as the tables hold none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import period, quantity
from ..operators import binding, pages, retrieval, routing, text
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _literal(columns: list[tuple[str, str]], rows: list[tuple]) -> str:
    """SQL for literal expected rows."""
    form = lambda v: "NULL" if v is None else str(v) if isinstance(v, int | float) and not isinstance(v, bool) else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(map(form, r)) + ")" for r in rows)
    return f"SELECT {', '.join(f'{n}::{t} AS {n}' for n, t in columns)} FROM (VALUES {values}) AS v({', '.join(n for n, _ in columns)})"


NUMBERS = [("1조8000억", 1.8e12), ("92억", 9.2e9), ("308만9300", 3089300.0), ("100.4", 100.4), ("9천444", 9444.0), ("-3.5", -3.5), ("x", None)]
QUERIES["knum_recursive"] = lambda s, d: s.createDataFrame([(a,) for a, _ in NUMBERS], "text string").select("text", quantity.korean_number(F.col("text")).alias("number"))
SQL["knum_recursive"] = _literal([("text", "VARCHAR"), ("number", "DOUBLE")], NUMBERS)

QUANTITIES = [
    ("3만6745", "명", "36745.000000", "count:명", None, "1.000000", None), ("2.6", "%", "2.600000", "percent", None, "0.100000", None),
    ("25.4조", "원", "25400000000000.000000", "money", None, "100000000000.000000", None), ("약 5", "명", "5.000000", "count:명", "약", "1.000000", None),
    ("5", "", None, None, None, None, "UNIT_UNAVAILABLE"), ("5명", "원", None, None, None, None, "UNIT_CONFLICT"), ("12", "억원", "1200000000.000000", "money", None, "100000000.000000", None),
    ("3만5억", "원", None, None, None, None, "VALUE_INVALID"), ("1.5", "%p", "1.500000", "percent_point", None, "0.100000", None), ("2만", "천명", None, None, None, None, "UNIT_SCALE_CONFLICT"),
]


def quantity_norm(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([r[:2] for r in QUANTITIES], "value string, unit string").withColumn("q", quantity.normalize_quantity(F.col("value"), F.col("unit")))
    return rows.select("value", "unit", F.col("q.value_base").cast("string").alias("base"), "q.dimension", "q.qualifier", F.col("q.quantum").cast("string").alias("quantum"), "q.error")


QUERIES["quantity_norm"] = quantity_norm
SQL["quantity_norm"] = _literal([(n, "VARCHAR") for n in ("value", "unit", "base", "dimension", "qualifier", "quantum", "error")], QUANTITIES)

PERIODS = [
    ("2024년 1분기", "Q", "202401", 20241), ("2024.01", "M", "202401", 202401), ("202401", "M", "202401", 202401), ("2024", "Y", "2024", 202400), ("2024년 1분기(2~4월)", None, None, None),
    ("2024년 2분기(4~6월)", "Q", "202402", 20242), ("2024 3/4", "Q", "202403", 20243), ("2024Q4", "Q", "202404", 20244), ("2024-7", "M", "202407", 202407), ("2024년", "Y", "2024", 202400), ("202413", None, None, None),
]


def period_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([r[:1] for r in PERIODS], "text string").withColumn("p", period.parse_period(F.col("text")))
    return rows.select("text", "p.freq", "p.api", period.period_order(F.col("p.freq"), F.col("p.api")).cast("int").alias("ord"))


QUERIES["period_parse"] = period_parse
SQL["period_parse"] = _literal([("text", "VARCHAR"), ("freq", "VARCHAR"), ("api", "VARCHAR"), ("ord", "INTEGER")], PERIODS)

SHIFTS = [("2024-01", -1, "2023-12"), ("2024-Q1", -1, "2023-Q4"), ("2024", -1, "2023"), ("2024-11", 14, "2026-01"), ("2024-13", 1, None)]
QUERIES["shift_period"] = lambda s, d: s.createDataFrame([r[:2] for r in SHIFTS], "p string, n int").select("p", "n", period.shift_period(F.col("p"), F.col("n")).alias("shifted"))
SQL["shift_period"] = _literal([("p", "VARCHAR"), ("n", "INTEGER"), ("shifted", "VARCHAR")], SHIFTS)

TIMES = [
    ("3분기", "2025-05-10", "2024년 3분기", "분기"), ("1분기", "2025-05-10", "2025년 1분기", "분기"), ("지난 3월", "2025-05-10", "2025.03", "월"), ("지난 7월", "2025-05-10", "2024.07", "월"),
    ("지난달", "2025-01-10", "2024.12", "월"), ("재작년", "2025-05-10", "2023", "연"), ("6월", "2025-05-10", "2024.06", "월"), ("2020년 3월", "2025-05-10", "2020년 3월", "월"), ("어제", "2025-05-10", "어제", "불명확"),
]


def time_norm(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([r[:2] for r in TIMES], "text string, pub string")
    return rows.select("text", "pub", period.normalize_time(F.col("text"), F.to_date("pub")).alias("resolved"), period.time_span_type(F.col("text")).alias("span_type"))


QUERIES["time_norm"] = time_norm
SQL["time_norm"] = _literal([(n, "VARCHAR") for n in ("text", "pub", "resolved", "span_type")], TIMES)

PAIRS = [
    ("실업률은 3.2%로 0.4%포인트 올랐다", "3.2|% 0.4|%p", "증감폭"), ("취업자는 3만6745명 늘었다", "3만6745|명", "단순수치"), ("3~4%대 성장", "3|% 4|%", "증감률"),
    ("2023년 가구는 100가구", "100|가구", "단순수치"), ("3분의 1이 찬성", "3/1|비율", "단순수치"), ("수출 92억위안 증가", "92억|위안", "증감률"), ("역대 최고 5건", "5|건", "순위"),
]


def value_unit_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([r[:1] for r in PAIRS], "s string").withColumn("p", text.clean_pairs(text.value_unit_pairs(F.col("s"))))
    shown = F.array_join(F.transform("p", lambda x: F.concat(x["value"], F.lit("|"), x["unit"])), " ")
    return rows.select("s", shown.alias("pairs"), text.change_type(F.col("s"), F.transform("p", lambda x: x["unit"])).alias("change"))


QUERIES["value_unit_pairs"] = value_unit_pairs
SQL["value_unit_pairs"] = _literal([("s", "VARCHAR"), ("pairs", "VARCHAR"), ("change", "VARCHAR")], PAIRS)


def list_resolve(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([("a", ["1", "2", "3"], ["x", "y", "z"], "7~9월 각각"), ("b", ["1", "2", "3"], [], "7~9월 각각"), ("c", ["1", "2"], [], "7~9월"), ("d", ["1"], [], ""), ("e", ["1", "2"], ["x", "x"], "11~2월")], "id string, v array<string>, e array<string>, s string")
    out = rows.withColumn("x", text.list_alignment(F.col("v"), F.col("e"), text.month_range(F.col("s"))))
    return out.select("id", "x.status", F.array_join("x.labels", ",").alias("labels"))


QUERIES["list_resolve"] = list_resolve
SQL["list_resolve"] = _literal([("id", "VARCHAR"), ("status", "VARCHAR"), ("labels", "VARCHAR")], [("a", "ALIGNED", "x,y,z"), ("b", "ALIGNED", "7월,8월,9월"), ("c", "COUNT_MISMATCH", ""), ("d", "SINGLE_VALUE", ""), ("e", "COUNT_MISMATCH", "")])

ROUTES = [
    ("r1", "공식집계", "실업률", "3.2%", False, "KOSIS_CANDIDATE", 1.0, "OFFICIAL_AGGREGATE_REGION"), ("r2", None, "실업률", "3.2%", False, "KOSIS_CANDIDATE", 0.5, "INDICATOR_WITHOUT_RESOLVED_REGION"),
    ("r3", "민간조사", "실업률", "3.2%", False, "OUT_OF_SCOPE", 1.0, "SOURCE_SUBTYPE_민간조사"), ("r4", "공식집계", "소득 하위 20%", "20 %", False, "NOT_CLAIM", 1.0, "VALUE_REPEATED_INSIDE_INDICATOR"),
    ("r5", None, None, "3", False, "NOT_CLAIM", 1.0, "NO_INDICATOR_NO_REGION"), ("r6", "공식집계", "실업률", "3", True, "CLARIFICATION_REQUIRED", 0.0, "INDICATOR_FIELD_CLARIFICATION_REQUIRED"),
]


def route(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([r[:5] for r in ROUTES], "id string, sub string, ind string, v string, clarify boolean")
    return rows.select("id", routing.route(F.col("sub"), F.col("ind"), F.col("v"), F.col("clarify")).alias("x")).select("id", "x.routing_class", F.col("x.confidence").cast("double").alias("confidence"), "x.reason")


QUERIES["route"] = route
SQL["route"] = _literal([("id", "VARCHAR"), ("routing_class", "VARCHAR"), ("confidence", "DOUBLE"), ("reason", "VARCHAR")], [(r[0], *r[5:]) for r in ROUTES])

def unique_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' offers as projections: a nation is resolved if one supplier fits."""
    p = table(spark, d, "supplier").select(F.col("s_nationkey").alias("target_id"), F.when(F.col("s_acctbal") > 8000, F.col("s_name")).alias("signature"), F.when(F.col("s_acctbal") < 0, "UNIT_MISMATCH").otherwise("ITEM_MISSING").alias("reason"))
    return binding.unique_resolve(p)


QUERIES["unique_resolve"] = unique_resolve
SQL["unique_resolve"] = """WITH p AS (SELECT s_nationkey AS target_id, CASE WHEN s_acctbal > 8000 THEN s_name END AS signature, CASE WHEN s_acctbal < 0 THEN 'UNIT_MISMATCH' ELSE 'ITEM_MISSING' END AS reason FROM supplier),
g AS (SELECT target_id, count(DISTINCT signature) AS n, min(signature) AS s, max(CASE WHEN signature IS NULL THEN reason END) AS r FROM p GROUP BY 1)
SELECT target_id, CASE WHEN n = 1 THEN 'QUERY_READY' ELSE 'HOLD' END AS status, CASE WHEN n = 1 THEN s END AS signature, CASE WHEN n > 1 THEN 'MULTIPLE_COMPATIBLE_SERIES' WHEN n = 0 THEN r END AS reason FROM g"""


def hydrate_profile(spark: SparkSession, d: str) -> DataFrame:
    """Brands as tables: parts as items, types and sizes as axes, order years as periods."""
    part = table(spark, d, "part").withColumn("key", F.col("p_brand"))
    items = part.select("key", F.col("p_partkey").alias("itm_id"), F.col("p_name").alias("itm_nm"), F.lit("원").alias("unit"))
    axes = part.select("key", F.lit("TYPE").alias("obj_id"), F.lit(1).alias("level"), F.col("p_type").alias("value_id"), F.col("p_type").alias("value_name")).distinct()
    sizes = part.select("key", F.lit("SIZE").alias("obj_id"), F.lit(2).alias("level"), F.col("p_size").cast("string").alias("value_id"), F.col("p_size").cast("string").alias("value_name")).distinct()
    periods = part.select("key", F.lit("Y").alias("freq"), F.lit(1995).alias("lo"), F.lit(2001).alias("hi")).distinct()
    out = binding.hydrate_profile(part.select("key").distinct(), items, axes.unionByName(sizes), periods, "key")
    return out.select("key", F.size("items").cast("bigint").alias("n_items"), F.size("dimensions").alias("n_axes"), F.size(F.col("dimensions")[0]["vals"]).cast("bigint").alias("n_types"), F.array_join("errors", ",").alias("errors"))


QUERIES["hydrate_profile"] = hydrate_profile
SQL["hydrate_profile"] = "SELECT p_brand AS key, count(*) AS n_items, 2::INTEGER AS n_axes, count(DISTINCT p_type) AS n_types, '' AS errors FROM part GROUP BY 1"


def value_side_index(spark: SparkSession, d: str) -> DataFrame:
    """One row for each word of a part's type."""
    p = table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_type", " ")).alias("pos", "word"))
    return p.where(F.trim("word") != "").groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("parts"))


QUERIES["value_side_index"] = value_side_index
SQL["value_side_index"] = "WITH w AS (SELECT p_partkey, lower(unnest(string_split(p_type, ' '))) AS word FROM part) SELECT word, count(*) AS n, count(DISTINCT p_partkey) AS parts FROM w WHERE word <> '' GROUP BY 1"


def slim_index(spark: SparkSession, d: str) -> DataFrame:
    """A search text for each part, and the hash of its canonical JSON (names in order)."""
    p = table(spark, d, "part")
    hay = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return p.select("p_partkey", hay.alias("haystack"), F.sha2(F.to_json(F.struct("p_brand", "p_name")).cast("binary"), 256).alias("sha"))


QUERIES["slim_index"] = slim_index
SQL["slim_index"] = """SELECT p_partkey, lower(concat_ws(' ', p_name, p_brand, p_type)) AS haystack, sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '"}') AS sha FROM part"""

QUERIES["url_host"] = lambda s, d: table(s, d, "pages").select("page_id", pages.url_host(F.col("url")).alias("host"))
SQL["url_host"] = "SELECT page_id, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host FROM pages"


def html_strip(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", pages.html_paragraphs(F.regexp_replace("html", r"(?is)<style\b.*?</style>|<script\b.*?</script>", " ")).alias("ps"))
    joined = F.array_join("ps", "\n")
    return p.select("page_id", F.size("ps").cast("bigint").alias("n"), F.sha2(joined.cast("binary"), 256).alias("sha"), pages.quality(joined).alias("good"))


QUERIES["html_strip"] = html_strip
SQL["html_strip"] = r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style\b.*?</style>|<script\b.*?</script>', ' ', 'g'), '(?is)<nav\b.*?</nav>', ' ', 'g'), '(?is)<footer\b.*?</footer>', ' ', 'g'), '(?is)<aside\b.*?</aside>', ' ', 'g'), '(?is)<form\b.*?</form>', ' ', 'g') AS h FROM pages),
p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(h, '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS ps FROM b),
j AS (SELECT page_id, ps, array_to_string(ps, chr(10)) AS t FROM p)
SELECT page_id, len(ps) AS n, sha256(t) AS sha, length(regexp_replace(t, '\s+', '', 'g')) >= 100 AND len(regexp_extract_all(t, '[A-Za-z가-힣]')) >= 30 AS good FROM j"""

QUERIES["html_extract"] = lambda s, d: table(s, d, "pages").select("page_id", pages.html_extract(F.col("html")).alias("x")).select("page_id", "x.*")
QUERIES["sentences"] = lambda s, d: text.sentences(table(s, d, "documents").select("doc_id", "text"), "text").select("doc_id", "sentence_id", "char_start", "char_end")
SQL["sentences"] = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, text, regexp_replace(text, '([.!?])(\s+)', '\1' || chr(1) || '\2', 'g') AS x FROM t),
q AS (SELECT doc_id, unnest(string_split(x, chr(1))) AS s, unnest(range(len(string_split(x, chr(1))))) AS i FROM (SELECT doc_id, regexp_replace(x, '([0-9]\.)' || chr(1), '\1', 'g') AS x FROM m)),
o AS (SELECT doc_id, i, s, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) - length(s) AS a FROM q),
k AS (SELECT doc_id, i, a + length(regexp_extract(s, '^\s*')) AS b, length(regexp_replace(regexp_replace(s, '^\s+', ''), '\s+$', '')) AS n FROM o)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS sentence_id, b::INTEGER AS char_start, (b + n)::INTEGER AS char_end FROM k WHERE n > 0"""


def near_dim_match(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose name holds the first word of their type: a substring test under an equal key, never across all pairs."""
    p = table(spark, d, "part")
    types = p.select("p_brand", F.lower(F.substring_index("p_type", " ", 1)).alias("label")).distinct()
    return p.join(types, "p_brand").where(F.contains(F.lower("p_name"), F.col("label"))).groupBy("p_brand", "label").agg(F.count("*").alias("n"))


QUERIES["near_dim_match"] = near_dim_match
SQL["near_dim_match"] = "WITH t AS (SELECT DISTINCT p_brand, lower(string_split(p_type, ' ')[1]) AS label FROM part) SELECT p_brand, label, count(*) AS n FROM part JOIN t USING (p_brand) WHERE contains(lower(p_name), label) GROUP BY 1, 2"
QUERIES["fts_build"] = lambda s, d: retrieval.postings(table(s, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
SQL["fts_build"] = r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY 1"
