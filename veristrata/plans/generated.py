"""Queries whose Korean inputs are made from table values by the same expressions in both engines; the SQL computes what they must give by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import compare, legacy, period, quantity
from ..operators import binding, layers, pages, routing, scope, text
from ..sources.tables import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def made(name: str, source: str, keys: list[str], inputs: dict[str, str], outs, expected: dict[str, str]) -> None:
    """Register a query over a whole table: ``inputs`` are SQL expressions that Spark and DuckDB both read; ``outs()`` gives columns; ``expected`` is SQL over columns and inputs."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, source)
        for n, sql in inputs.items():
            rows = rows.withColumn(n, F.expr(sql))
        return rows.select(*keys, *outs())

    QUERIES[name] = run
    layered = f"(SELECT * FROM {source})"
    for n, sql in inputs.items():
        layered = f"(SELECT *, {sql} AS {n} FROM {layered})"
    SQL[name] = f"SELECT {', '.join([*keys, *[f'{e} AS {n}' for n, e in expected.items()]])} FROM {layered}"


def pick(index: str, *values: str) -> str:
    """SQL: one of the texts, by a number modulo their count."""
    return "CASE " + " ".join(f"WHEN ({index}) % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


C = F.col
L = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

# ---- numbers, units, comparison
made("knum_recursive", "lineitem", L, {"hi": "CAST(l_quantity AS INT)", "t": "concat(hi, '조 ', l_partkey % 9000 + 1, '억', l_orderkey % 900 + 1, '만')"},
     lambda: ["t", quantity.korean_number(C("t")).alias("number")], {"t": "t", "number": "(hi * 1e12 + (l_partkey % 9000 + 1) * 1e8 + (l_orderkey % 900 + 1) * 1e4)::DOUBLE"})
made("knum_strict", "lineitem", L, {"q": "CAST(l_quantity AS INT)", "sign": pick("l_linenumber", "", "-", "+"), "t": "concat(sign, q, '억', l_partkey % 9000 + 1, '만', l_orderkey % 100, '명')", "bad": "concat(q, '백만원')"},
     lambda: ["t", legacy.strict_number(C("t")).alias("number"), legacy.strict_number(C("bad")).alias("bad")],
     {"t": "t", "number": "((CASE WHEN sign = '-' THEN -1 ELSE 1 END) * (q * 1e8 + (l_partkey % 9000 + 1) * 1e4 + l_orderkey % 100))::DOUBLE", "bad": "NULL::DOUBLE"})
made("quantity_norm", "lineitem", L, {
    "kind": "(l_orderkey + l_linenumber) % 8", "q": "CAST(l_quantity AS INT)",
    "v": "CASE kind WHEN 0 THEN concat(q, '만', l_partkey % 9000 + 1) WHEN 1 THEN concat(q, '.', l_linenumber) WHEN 2 THEN concat('약 ', q) WHEN 3 THEN concat(q, '명') WHEN 4 THEN concat(q, '만', q, '억') WHEN 5 THEN concat(q, '만') ELSE concat(q) END",
    "u": "CASE kind WHEN 0 THEN '명' WHEN 1 THEN '%' WHEN 2 THEN '원' WHEN 3 THEN '원' WHEN 4 THEN '원' WHEN 5 THEN '천명' WHEN 6 THEN '억원' ELSE '' END",
}, lambda: ["v", "u", *[quantity.normalize_quantity(C("v"), C("u"))[f].cast(t).alias(n) for f, t, n in (("value_base", "double", "base"), ("dimension", "string", "dimension"), ("qualifier", "string", "qualifier"), ("quantum", "double", "quantum"), ("error", "string", "error"))]], {
    "v": "v", "u": "u", "base": "(CASE kind WHEN 0 THEN q * 10000 + l_partkey % 9000 + 1 WHEN 1 THEN q + l_linenumber / 10.0 WHEN 2 THEN q WHEN 6 THEN q * 1e8 END)::DOUBLE",
    "dimension": "CASE kind WHEN 0 THEN 'count:명' WHEN 1 THEN 'percent' WHEN 2 THEN 'money' WHEN 6 THEN 'money' END", "qualifier": "CASE WHEN kind = 2 THEN '약' END",
    "quantum": "(CASE kind WHEN 0 THEN 1 WHEN 1 THEN 0.1 WHEN 2 THEN 1 WHEN 6 THEN 1e8 END)::DOUBLE",
    "error": "CASE kind WHEN 3 THEN 'UNIT_CONFLICT' WHEN 4 THEN 'VALUE_INVALID' WHEN 5 THEN 'UNIT_SCALE_CONFLICT' WHEN 7 THEN 'UNIT_UNAVAILABLE' END",
})
_UNITS = {"억원": (1e8, "money:KRW"), "만 명": (1e4, "count"), "달러": (1, "money:USD"), "%p": (1, "percent_point"), "가구": (1, "count"), "백만원": (1e6, "money:KRW")}
_unit = lambda i, values: "CASE " + " ".join(f"WHEN ({i}) % {len(_UNITS)} = {k} THEN {v}" for k, v in enumerate(values)) + " END"
made("to_base_unit", "lineitem", L, {"u": pick("l_partkey", *_UNITS)}, lambda: ["u", legacy.base_unit(C("l_quantity"), C("u"))["value"].alias("base"), legacy.base_unit(C("l_quantity"), C("u"))["dimension"].alias("dim")],
     {"u": "u", "base": f"(l_quantity * {_unit('l_partkey', [n for n, _ in _UNITS.values()])})::DOUBLE", "dim": _unit("l_partkey", [f"'{d}'" for _, d in _UNITS.values()])})
made("compare_values", "lineitem", L, {"ua": pick("l_partkey", "억원", "명", "x"), "ub": pick("l_suppkey", "만원", "가구", "y"), "a": "l_quantity", "b": "CASE WHEN (l_partkey % 3 = 0) AND (l_suppkey % 3 = 0) THEN l_quantity * 10000 + l_linenumber * 10 ELSE l_quantity + l_discount END"},
     lambda: ["ua", "ub", legacy.compare_values(C("a"), C("b"), C("ua"), C("ub"))["match"].alias("match"), legacy.compare_values(C("a"), C("b"), C("ua"), C("ub"))["unit_status"].alias("status")],
     {"ua": "ua", "ub": "ub", "status": "CASE WHEN ua = 'x' OR ub = 'y' THEN 'UNKNOWN' WHEN (ua = '억원') = (ub = '만원') THEN 'KNOWN_COMPATIBLE' ELSE 'KNOWN_MISMATCH' END",
      "match": "CASE WHEN ua = 'x' OR ub = 'y' THEN abs(a - b) / abs(b) <= 0.005 WHEN (ua = '억원') <> (ub = '만원') THEN false WHEN ua = '억원' THEN abs(a * 1e8 - b * 1e4) / abs(b * 1e4) <= 0.005 ELSE abs(a - b) / abs(b) <= 0.005 END"})
made("unit_compat", "lineitem", L, {"a": pick("l_partkey", "억 원", "천원", "명", "KG"), "b": pick("l_suppkey", "억원", "조원", "가구", "kg ")}, lambda: ["a", "b", legacy.unit_compatible(C("a"), C("b")).alias("ok")],
     {"a": "a", "b": "b", "ok": "(a = '억 원' AND b = '억원') OR (a = '천원' AND b IN ('억원', '조원')) OR (a = 'KG' AND b = 'kg ')"})
made("infer_unit", "part", ["p_partkey"], {"u": pick("p_size", "명", "", " "), "l": "CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN concat(p_name, ' (', p_type, ')') ELSE concat('(x) ', p_name, '(억 ', p_type, ') ') END"},
     lambda: [legacy.infer_unit(C("u"), C("l")).alias("unit")], {"unit": "CASE WHEN u = '명' THEN '명' WHEN p_partkey % 3 = 1 THEN p_type WHEN p_partkey % 3 = 2 THEN concat('억 ', p_type) END"})
made("fmt_decimal", "lineitem", L, {"n": "CAST(floor(l_extendedprice) AS BIGINT)", "v": "CAST(n AS DOUBLE) + (l_linenumber % 4) * 0.25"}, lambda: [legacy.format_decimal(C("v")).alias("s")],
     {"s": "concat(CASE WHEN n >= 1000 THEN concat(n // 1000, ',', lpad(CAST(n % 1000 AS VARCHAR), 3, '0')) ELSE CAST(n AS VARCHAR) END, CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END)"})
made("precision_tol", "lineitem", L, {"q": "CAST(l_quantity AS INT)", "t": pick("l_partkey", "A", "B", "C", "D"), "s": "CASE t WHEN 'A' THEN concat(q, '.', l_linenumber, '%') WHEN 'B' THEN concat(q, '만 ', l_linenumber, '천명') WHEN 'C' THEN concat(q, '.25조') ELSE '없음' END"},
     lambda: [legacy.precision_tolerance(C("s")).alias("tol")], {"tol": "(CASE t WHEN 'A' THEN 0.05 WHEN 'B' THEN 500 WHEN 'C' THEN 0.5 * 1e12 * pow(10.0, -2) END)::DOUBLE"})
made("convert_value", "lineitem", L, {"a": pick("l_partkey", "억원", "천명", "%", "kg"), "b": pick("l_suppkey", "만원", "명", "%", "%p")}, lambda: ["a", "b", quantity.convert_value(C("l_quantity"), C("a"), C("b")).alias("out")],
     {"a": "a", "b": "b", "out": "(CASE WHEN a = '%' AND b = '%' THEN l_quantity WHEN a IN ('%', 'kg') OR b IN ('%', '%p') THEN NULL ELSE l_quantity * (CASE a WHEN '억원' THEN 1e8 ELSE 1e3 END) / (CASE b WHEN '만원' THEN 1e4 ELSE 1 END) END)::DOUBLE"})
made("derived", "lineitem", L, {"op": pick("l_partkey", "PERCENT_CHANGE", "DIFFERENCE", "RATIO"), "base": "CASE WHEN l_suppkey % 4 = 0 THEN 0.0 ELSE CAST(l_linenumber AS DOUBLE) END"}, lambda: ["op", F.round(compare.derived(C("op"), C("l_quantity"), C("base")), 6).alias("v")],
     {"op": "op", "v": "CASE WHEN op = 'DIFFERENCE' THEN l_quantity - base WHEN base = 0 THEN NULL WHEN op = 'RATIO' THEN round(l_quantity / base, 6) ELSE round((l_quantity - base) * 100 / base, 6) END"})
made("apply_direction", "lineitem", L, {"v": "l_quantity - 25", "way": pick("l_partkey", "DECREASE", "INCREASE", "x")}, lambda: [compare.apply_direction(C("v"), C("way")).alias("v")], {"v": "CASE WHEN way = 'DECREASE' THEN -abs(v) + CASE WHEN v = 0 THEN 0 ELSE 0 END ELSE v END + 0"})

# ---- periods
_Y, _M = "CAST(year(o_orderdate) AS INT)", "CAST(month(o_orderdate) AS INT)"
O = ["o_orderkey"]  # noqa: E741
made("period_parse", "orders", O, {
    "y": _Y, "m": _M, "q": "CAST(quarter(o_orderdate) AS INT)", "k": "o_orderkey % 9", "mm": "lpad(CAST(m AS STRING), 2, '0')",
    "t": "CASE k WHEN 0 THEN concat(y, '년 ', q, '분기') WHEN 1 THEN concat(y, '.', mm) WHEN 2 THEN concat(y, mm) WHEN 3 THEN concat(y, '년') WHEN 4 THEN concat(y, '년 ', q, '분기(', q * 3 - 2, '~', q * 3, '월)') WHEN 5 THEN concat(y, '년 ', q, '분기(', q * 3 - 1, '~', q * 3, '월)') WHEN 6 THEN concat(y, 'Q', q) WHEN 7 THEN concat(y, '-', m) ELSE concat(y, '1', '3') END",
}, lambda: ["t", period.parse_period(C("t"))["freq"].alias("freq"), period.parse_period(C("t"))["api"].alias("api"), period.period_order(period.parse_period(C("t"))["freq"], period.parse_period(C("t"))["api"]).cast("int").alias("ord")], {
    "t": "t", "freq": "CASE WHEN k IN (0, 4, 6) THEN 'Q' WHEN k IN (1, 2, 7) THEN 'M' WHEN k = 3 THEN 'Y' END", "api": "CASE WHEN k IN (0, 4, 6) THEN concat(y, '0', q) WHEN k IN (1, 2, 7) THEN concat(y, mm) WHEN k = 3 THEN CAST(y AS VARCHAR) END",
    "ord": "CAST(CASE WHEN k IN (0, 4, 6) THEN y * 10 + q WHEN k IN (1, 2, 7) THEN y * 100 + m WHEN k = 3 THEN y * 100 END AS INTEGER)",
})
made("period_freq", "orders", O, {"t": pick("o_orderkey", "Year", "연간", " M ", "월간", "분기", "quarterly", "주")}, lambda: [period.period_frequency(C("t")).alias("freq")], {"freq": "CASE o_orderkey % 7 WHEN 0 THEN 'Y' WHEN 1 THEN 'Y' WHEN 2 THEN 'M' WHEN 3 THEN 'M' WHEN 4 THEN 'Q' WHEN 5 THEN 'Q' END"})
made("shift_period", "orders", O, {"y": _Y, "m": _M, "n": "CAST(o_custkey % 61 - 30 AS INT)", "k": "o_orderkey % 4", "p": "CASE k WHEN 0 THEN concat(y, '-', lpad(CAST(m AS STRING), 2, '0')) WHEN 1 THEN concat(y, '-Q', CAST(quarter(o_orderdate) AS INT)) WHEN 2 THEN concat(y) ELSE concat(y, '-13') END"},
     lambda: ["p", "n", period.shift_period(C("p"), C("n")).alias("shifted")],
     {"p": "p", "n": "n", "shifted": "CASE k WHEN 0 THEN strftime(date_trunc('month', o_orderdate) + to_months(n), '%Y-%m') WHEN 1 THEN concat(year(date_trunc('month', o_orderdate) + to_months(3 * n)), '-Q', quarter(date_trunc('month', o_orderdate) + to_months(3 * n))) WHEN 2 THEN CAST(y + n AS VARCHAR) END"})
_REL = ["지난달", "이번 달", "재작년", "지난해", "올해", "3월", "2분기", "지난 7월", "2020년 5월", "어제"]
made("time_norm", "orders", O, {"t": pick("o_custkey", *_REL)}, lambda: ["t", period.normalize_time(C("t"), C("o_orderdate").cast("date")).alias("resolved"), period.time_span_type(C("t")).alias("span_type")], {
    "t": "t", "resolved": """CASE o_custkey % 10 WHEN 0 THEN strftime(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH, '%Y.%m') WHEN 1 THEN strftime(o_orderdate, '%Y.%m') WHEN 2 THEN CAST(year(o_orderdate) - 2 AS VARCHAR) WHEN 3 THEN CAST(year(o_orderdate) - 1 AS VARCHAR)
      WHEN 4 THEN CAST(year(o_orderdate) AS VARCHAR) WHEN 5 THEN concat(year(o_orderdate) - (month(o_orderdate) < 3)::INT, '.03') WHEN 6 THEN concat(year(o_orderdate) - (quarter(o_orderdate) < 2)::INT, '년 2분기') WHEN 7 THEN concat(year(o_orderdate) - (month(o_orderdate) < 7)::INT, '.07') ELSE t END""",
    "span_type": "CASE o_custkey % 10 WHEN 6 THEN '분기' WHEN 0 THEN '월' WHEN 1 THEN '월' WHEN 5 THEN '월' WHEN 7 THEN '월' WHEN 8 THEN '월' WHEN 9 THEN '불명확' ELSE '연' END",
})
made("pub_bucket", "orders", O, {"g": pick("o_custkey", "month", "quarter", "year", "day")}, lambda: ["g", period.publication_bucket(C("o_orderdate").cast("date"), C("g")).alias("bucket")],
     {"g": "g", "bucket": "CASE g WHEN 'month' THEN strftime(o_orderdate, '%Y-%m') WHEN 'quarter' THEN concat(year(o_orderdate), '-Q', quarter(o_orderdate)) WHEN 'year' THEN CAST(year(o_orderdate) AS VARCHAR) END"})
made("named_month", "orders", O, {"m": _M, "k": "o_custkey % 5", "n": "CAST(o_orderkey % 13 AS INT)", "t": "CASE k WHEN 0 THEN concat('지난 ', n, '월') WHEN 1 THEN concat('올해 ', n, '월') WHEN 2 THEN concat(97, '년 ', n, '월') WHEN 3 THEN concat(2019, '년', n, '월') ELSE concat(n, '월') END"},
     lambda: ["t", period.named_month(C("t"), C("o_orderdate").cast("date")).alias("period")],
     {"t": "t", "period": "CASE WHEN n = 0 OR k = 4 THEN NULL ELSE concat(CASE k WHEN 0 THEN year(o_orderdate) - (n >= m)::INT WHEN 1 THEN year(o_orderdate) WHEN 2 THEN 2097 ELSE 2019 END, '-', lpad(CAST(n AS VARCHAR), 2, '0')) END"})
made("anchored_period", "orders", O, {"y": _Y, "m": _M, "k": "o_custkey % 5", "n": "CAST(o_orderkey % 12 + 1 AS INT)", "nn": "lpad(CAST(n AS STRING), 2, '0')",
      "t": "CASE k WHEN 0 THEN '작년' WHEN 1 THEN '올해' WHEN 2 THEN concat('올해 ', n % 4 + 1, '분기') WHEN 3 THEN concat(n, '월') ELSE concat('지난 ', n, '월') END",
      "s": "CASE k WHEN 0 THEN concat(y - 1) WHEN 1 THEN concat(y - o_orderkey % 2) WHEN 2 THEN concat(y, ' ', n % 4 + 1, '분기') WHEN 3 THEN concat(y, '.', nn) ELSE concat(y, '.', nn) END"},
     lambda: ["t", "s", period.anchored_period(C("t"), C("s"), C("o_orderdate").cast("date"))["rule"].alias("rule")],
     {"t": "t", "s": "s", "rule": "CASE k WHEN 0 THEN 'anchor-previous-year' WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'anchor-current-year' END WHEN 2 THEN 'anchor-current-year-quarter' WHEN 3 THEN 'anchor-current-year-month' ELSE CASE WHEN n < m THEN 'anchor-most-recent-named-month' END END"})
_ABS = {"t": "CASE o_custkey % 11 WHEN 0 THEN concat(y, '년 ', q, '분기') WHEN 1 THEN concat(y, '-Q', q) WHEN 2 THEN concat(y, '년 ', m, '월') WHEN 3 THEN concat(y, '.', m) WHEN 4 THEN concat(y, '년') WHEN 5 THEN concat(m, '월') WHEN 6 THEN concat(y) WHEN 7 THEN concat(y, '년 ', m + 12, '월') WHEN 8 THEN concat(y, '-') WHEN 9 THEN concat(y, '.') ELSE concat(y, '/ ', m) END"}
_ABS_WANT = "CASE WHEN o_custkey % 11 IN (0, 1) THEN concat(y, '-Q', q) WHEN o_custkey % 11 IN (2, 3, 10) THEN concat(y, '-', lpad(CAST(m AS VARCHAR), 2, '0')) WHEN o_custkey % 11 IN (4, 6) THEN CAST(y AS VARCHAR) ELSE '' END"
made("canonical_abs", "orders", O, {"y": _Y, "m": _M, "q": "CAST(quarter(o_orderdate) AS INT)"} | _ABS, lambda: ["t", legacy.canonical_absolute(C("t")).alias("p")], {"t": "t", "p": _ABS_WANT})
_GRAIN = {"이달 첫 주": "week", "3주 차": "week", "주간 동향": "week", "3월 5일": "day", "1분기": "quarter", "전월": "month", "12 월": "month", "지난해": "year", "2024 년": "year", "어제": "", "주민": ""}
made("granularity", "orders", O, {"t": pick("o_custkey", *_GRAIN)}, lambda: ["t", legacy.granularity(C("t")).alias("g")], {"t": "t", "g": pick("o_custkey", *_GRAIN.values())})
made("resolved_abs", "orders", O, {"t": pick("o_custkey", "지난달", "3월 5일", "이달 첫 주", "지난해", "1분기", "어제")}, lambda: ["t", legacy.resolved_absolute(C("t"), C("o_orderdate").cast("date")).alias("p")],
     {"t": "t", "p": "CASE o_custkey % 6 WHEN 0 THEN strftime(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH, '%Y-%m') WHEN 3 THEN CAST(year(o_orderdate) - 1 AS VARCHAR) WHEN 4 THEN concat(year(o_orderdate), '-Q1') ELSE '' END"})
made("html_date", "orders", O, {"t": "CASE o_custkey % 3 WHEN 0 THEN concat(CAST(year(o_orderdate) AS INT) + 10, '. ', CAST(month(o_orderdate) AS INT), '. ', CAST(day(o_orderdate) AS INT)) WHEN 1 THEN concat('입력 ', CAST(year(o_orderdate) AS INT) + 10, '년 ', CAST(month(o_orderdate) AS INT), '월 ', CAST(day(o_orderdate) AS INT), '일') ELSE 'x' END"},
     lambda: [pages.iso_date_column(C("t")).alias("day")],
     {"day": "CASE WHEN o_custkey % 3 < 2 AND year(o_orderdate) + 10 >= 2000 THEN concat(year(o_orderdate) + 10, '-', lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0'), '-', lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0')) END"})

# ---- text
made("value_unit_pairs", "lineitem", L, {"q": "CAST(l_quantity AS INT)", "k": "l_partkey % 7",
      "s": "CASE k WHEN 0 THEN concat('실업률은 ', q, '.', l_linenumber, '%로 0.', l_linenumber, '%포인트 올랐다') WHEN 1 THEN concat('취업자는 ', q, '만', l_suppkey + 1, '명이다') WHEN 2 THEN concat(q, '~', q + 1, '% 성장') WHEN 3 THEN concat('2023년 가구는 ', q, '가구') WHEN 4 THEN concat(q, '분의 ', l_linenumber, '이 찬성') WHEN 5 THEN concat('지수는 ', q, '.5선') ELSE concat('역대 최고 ', q, '건, ', l_linenumber, '2분기') END"},
     lambda: [F.array_join(F.transform(text.clean_pairs(text.value_unit_pairs(C("s"))), lambda x: F.concat_ws("|", x["value"], x["unit"])), " ").alias("pairs")],
     {"pairs": "CASE k WHEN 0 THEN concat(q, '.', l_linenumber, '|% 0.', l_linenumber, '|%p') WHEN 1 THEN concat(q, '만', l_suppkey + 1, '|명') WHEN 2 THEN concat(q, '|% ', q + 1, '|%') WHEN 3 THEN concat(q, '|가구') WHEN 4 THEN concat(q, '/', l_linenumber, '|비율') WHEN 5 THEN concat(q, '.5|선 ', q, '.5|지수') ELSE concat(q, '|건 ', l_linenumber, '2|분기') END"})
made("value_direction", "lineitem", L, {"q": "CAST(l_quantity AS INT)", "n": "CAST(length(CAST(q AS STRING)) + 1 AS INT)", "s": pick("l_partkey", "A", "B", "C", "D"), "z": "CAST(0 AS INT)", "t": "concat(q, CASE s WHEN 'A' THEN '% 감소했다' WHEN 'B' THEN '% 늘었다' WHEN 'C' THEN '%, 증가' ELSE '% 기록' END)"},
     lambda: [text.value_direction(C("t"), C("z"), C("n")).alias("dir")], {"dir": "CASE s WHEN 'A' THEN 'DECREASE' WHEN 'B' THEN 'INCREASE' END"})
made("period_span", "orders", O, {"y": _Y, "m": _M, "k": "o_custkey % 3", "s": "CASE k WHEN 0 THEN concat(y, '년 ', m, '월 실업률은 3%') WHEN 1 THEN concat('지난해보다 늘어 ', m, '월 3%') ELSE concat(y, '년 이후 3%') END", "at": "CAST(length(s) - 2 AS INT)"},
     lambda: [text.period_span(C("s"), C("at"))["raw"].alias("raw"), text.period_span(C("s"), C("at"))["start"].alias("start")], {"raw": "CASE k WHEN 0 THEN concat(y, '년 ', m, '월') WHEN 1 THEN concat(m, '월') ELSE '' END", "start": "CAST(CASE k WHEN 0 THEN 0 WHEN 1 THEN 9 END AS INTEGER)"})
made("month_range", "lineitem", L, {"a": "CAST(l_partkey % 12 + 1 AS INT)", "b": "CAST(l_suppkey % 12 + 1 AS INT)", "s": "concat(a, '~', b, '월 각각')"}, lambda: ["s", F.array_join(text.month_range(C("s")), ",").alias("months")],
     {"s": "s", "months": "CASE WHEN a <= b THEN list_reduce(list_transform(range(a, b + 1), lambda x: concat(x, '월')), lambda x, y: concat(x, ',', y)) ELSE '' END"})
made("list_resolve", "lineitem", L, {"a": "CAST(l_partkey % 10 + 1 AS INT)", "n": "CAST(l_linenumber AS INT)", "s": "concat(a, '~', a + 2, '월 각각')"},
     lambda: ["s", text.list_alignment(F.sequence(F.lit(1), C("n")), F.array().cast("array<string>"), text.month_range(C("s")))["status"].alias("status"), F.array_join(text.list_alignment(F.sequence(F.lit(1), C("n")), F.array().cast("array<string>"), text.month_range(C("s")))["labels"], ",").alias("labels")],
     {"s": "s", "status": "CASE WHEN n <= 1 THEN 'SINGLE_VALUE' WHEN n = 3 THEN 'ALIGNED' ELSE 'COUNT_MISMATCH' END", "labels": "CASE WHEN n = 3 THEN concat(a, '월,', a + 1, '월,', a + 2, '월') ELSE '' END"})
made("list_transition", "lineitem", L, {"a": "CAST(l_quantity AS INT)", "n": "CAST(l_linenumber % 3 + 2 AS INT)", "s": "concat(a, '%에서 ', a + 2, '%로, ', a + 4, '%에서 ', a + 6, '%로')"},
     lambda: [F.array_join(F.transform(text.transitions(C("s"), C("n")), lambda x: F.concat_ws(">", x["from"], x["to"])), "|").alias("moves")], {"moves": "CASE WHEN n = 4 THEN concat(a, '>', a + 2, '|', a + 4, '>', a + 6) END"})
made("list_entity", "lineitem", L, {"a": "CAST(l_quantity AS INT)", "e": pick("l_partkey", "부산", "서울"), "n": "CAST(l_linenumber % 2 + 1 AS INT)", "s": "concat('서울은 ', a, '%, ', e, '은 ', a + 1, '%')"},
     lambda: [F.array_join(F.transform(text.entity_values(C("s"), C("n")), lambda x: F.concat_ws("=", x["entity"], x["value"])), "|").alias("pairs")], {"pairs": "CASE WHEN n = 2 AND e = '부산' THEN concat('서울=', a, '|부산=', a + 1) END"})
made("punct_insensitive_match", "part", ["p_partkey"], {"a": "concat(upper(p_name), ' (', p_type, ')')", "b": "CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN concat(p_name, p_type) ELSE concat(p_type, p_name, 'zz') END"},
     lambda: [text.contains_loosely(C("a"), C("b")).alias("hit")], {"hit": "p_partkey % 3 = 1"})
made("strip_period", "orders", O, {"y": _Y, "m": _M, "k": "o_custkey % 5", "t": "CASE k WHEN 0 THEN concat(y, '년 ', m, '월 실업률') WHEN 1 THEN concat(m, '월') WHEN 2 THEN concat('전년 동월 대비 수출 ', o_orderpriority) WHEN 3 THEN concat('최근 ', m, '년간 수출') ELSE o_orderpriority END"},
     lambda: [text.strip_period(C("t")).alias("out")], {"out": "CASE k WHEN 0 THEN '실업률' WHEN 1 THEN concat(m, '월') WHEN 2 THEN concat('수출 ', o_orderpriority) WHEN 3 THEN '수출' ELSE o_orderpriority END"})
_TAILS = ["수출 증가율", "원화 기준", "올해 성장률", "출생아 수", "1분기", "물가 지수"]
made("measure_tail", "part", ["p_partkey"], {"t": pick("p_partkey", *_TAILS)}, lambda: ["t", text.measure_tail(C("t")).alias("tail"), text.names_a_subject(C("t")).alias("subject")],
     {"t": "t", "tail": pick("p_partkey", "증가율", "", "성장률", "", "", "지수"), "subject": "p_partkey % 6 IN (0, 3, 4, 5)"})
made("compose_inherited", "part", ["p_partkey"], {"a": pick("p_partkey", "증가율", "올해 성장률", "수출", "지수", "원화 기준"), "b": "CASE WHEN p_size % 3 = 0 THEN concat(p_name, ' 지수') WHEN p_size % 3 = 1 THEN '성장률' ELSE p_name END"},
     lambda: [text.compose_inherited(C("a"), C("b")).alias("label")],
     {"label": "CASE WHEN p_partkey % 5 = 2 OR p_size % 3 = 1 THEN a WHEN p_partkey % 5 = 3 AND p_size % 3 = 0 THEN b ELSE concat(b, ' ', CASE p_partkey % 5 WHEN 0 THEN '증가율' WHEN 1 THEN '성장률' WHEN 3 THEN '지수' ELSE '원화 기준' END) END"})
made("span_resolve", "part", ["p_partkey"], {"p": "CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN 'e' WHEN 2 THEN '' ELSE 'zzz' END", "t": "concat('aaa ', p_name, ' ', p_type)"}, lambda: ["t", "p", text.unique_span(C("t"), C("p"))["status"].alias("status"), text.unique_span(C("t"), C("p"))["start"].alias("start")],
     {"t": "t", "p": "p", "status": "CASE WHEN p = '' THEN 'EMPTY' WHEN strpos(t, p) = 0 THEN 'NOT_FOUND' WHEN strpos(substr(t, strpos(t, p) + 1), p) > 0 THEN 'AMBIGUOUS' ELSE 'FOUND' END", "start": "CAST(CASE WHEN p <> '' AND strpos(t, p) > 0 AND strpos(substr(t, strpos(t, p) + 1), p) = 0 THEN strpos(t, p) - 1 END AS INTEGER)"})
made("source_terms", "part", ["p_partkey"], {"k": "p_partkey % 3", "s": "CASE k WHEN 0 THEN concat('국가데이터처에 따르면 ', p_size, '% 늘었다') WHEN 1 THEN concat('한국은행은 \"2024년 3월 ', p_name, '\"을 냈다') ELSE concat('\"', p_size, '.5\" 기록') END"},
     lambda: [F.array_join(F.transform(text.source_terms(C("s")), lambda x: F.concat_ws(":", x["role"], x["text"])), "|").alias("terms")], {"terms": "CASE k WHEN 0 THEN 'agency:국가데이터처' WHEN 1 THEN concat('agency:한국은행|report:', p_name) ELSE '' END"})

# ---- fields and routing
_SUB = "CASE WHEN p_partkey % 5 = 0 THEN '공식집계' WHEN p_partkey % 5 = 1 THEN '민간조사' WHEN p_partkey % 5 = 2 THEN '정책목표' END"
made("route", "part", ["p_partkey"], {"sub": _SUB, "ind": "CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN concat('하위 ', p_size, '% 소득') ELSE p_name END", "v": "concat(p_size, ' %')", "ask": "p_partkey % 7 = 0"},
     lambda: [routing.route(C("sub"), C("ind"), C("v"), C("ask"))["routing_class"].alias("class"), routing.route(C("sub"), C("ind"), C("v"), C("ask"))["reason"].alias("reason")],
     {"class": "CASE WHEN ask THEN 'CLARIFICATION_REQUIRED' WHEN sub IN ('민간조사', '정책목표') THEN 'OUT_OF_SCOPE' WHEN p_size % 4 = 1 THEN 'NOT_CLAIM' WHEN sub = '공식집계' OR ind <> '' THEN 'KOSIS_CANDIDATE' ELSE 'NOT_CLAIM' END",
      "reason": "CASE WHEN ask THEN 'INDICATOR_FIELD_CLARIFICATION_REQUIRED' WHEN sub IN ('민간조사', '정책목표') THEN concat('SOURCE_SUBTYPE_', sub) WHEN p_size % 4 = 1 THEN 'VALUE_REPEATED_INSIDE_INDICATOR' WHEN sub = '공식집계' THEN 'OFFICIAL_AGGREGATE_REGION' WHEN ind <> '' THEN 'INDICATOR_WITHOUT_RESOLVED_REGION' ELSE 'NO_INDICATOR_NO_REGION' END"})
_MT = {"ind": pick("p_partkey", "수출", "고용률", "소비자물가지수", "수출 증가율", "취업자 증가폭"), "u": pick("p_size", "%", "%p", "명", "%포인트"), "t": pick("p_size + p_partkey * 3", " 늘었다", "이었다", "를 기록", "으로 집계됐다", " 더 줄어", "p 올랐다")}
made("measurement_type", "part", ["p_partkey"], _MT, lambda: ["ind", "u", "t", routing.measurement_type(C("ind"), C("u"), C("t")).alias("m")], {"ind": "ind", "u": "u", "t": "t", "m": """CASE WHEN ind = '소비자물가지수' THEN 'INDEX_LEVEL'
  WHEN u IN ('%p', '%포인트') OR t = 'p 올랐다' THEN 'CHANGE_POINT' WHEN t IN ('이었다', '으로 집계됐다') THEN 'LEVEL' WHEN u = '%' AND t IN (' 늘었다', ' 더 줄어') THEN 'CHANGE_RATE'
  WHEN ind = '취업자 증가폭' THEN 'CHANGE_POINT' WHEN ind = '수출 증가율' THEN 'CHANGE_RATE' WHEN ind = '고용률' OR u = '%' THEN 'LEVEL' WHEN t IN (' 늘었다', ' 더 줄어') THEN 'CHANGE_POINT' ELSE 'LEVEL' END"""})
made("strip_modifiers", "part", ["p_partkey"], {"t": "concat(CASE p_partkey % 4 WHEN 0 THEN '한국의 ' WHEN 1 THEN '향후 우리나라 ' WHEN 2 THEN '초반 ' ELSE '' END, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END)"},
     lambda: [routing.strip_modifiers(C("t"))["indicator"].alias("indicator"), F.array_join(F.concat(routing.strip_modifiers(C("t"))["scope"], routing.strip_modifiers(C("t"))["projection"]), ",").alias("gone")],
     {"indicator": "CASE WHEN p_size % 5 = 0 THEN trim(t) ELSE p_name END", "gone": "CASE p_partkey % 4 WHEN 0 THEN '한국의' WHEN 1 THEN '우리나라,향후' ELSE '' END"})
made("item_terms", "part", ["p_partkey"], {"t": "CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ' 증가율') WHEN 1 THEN p_name WHEN 2 THEN concat('대기업 ', p_name, ' 비중') ELSE '지수' END"}, lambda: [F.array_join(routing.item_terms(C("t")), ",").alias("items")], {"items": "CASE WHEN p_partkey % 4 IN (0, 2) THEN p_name ELSE '' END"})
made("population_terms", "part", ["p_partkey"], {"ind": "CASE WHEN p_partkey % 3 = 0 THEN '청년 근로자 수' ELSE p_name END", "s": "CASE WHEN p_size % 2 = 0 THEN '‘인구동향’에서 취업자와 가구가 늘고 취업자가' ELSE p_type END"},
     lambda: [F.array_join(routing.population_terms(C("ind"), C("s")), ",").alias("people")], {"people": "CASE WHEN p_partkey % 3 = 0 THEN '청년,근로자' WHEN p_size % 2 = 0 THEN '취업자,가구' ELSE '' END"})
made("dimension_terms", "part", ["p_partkey"], {"ind": "CASE WHEN p_partkey % 3 = 0 THEN '서울 제조업 생산' ELSE p_name END", "s": "CASE WHEN p_size % 2 = 0 THEN '부산과 비수도권에서 청년층' ELSE p_type END"},
     lambda: [F.array_join(routing.dimension_terms(C("ind"), C("s")), ",").alias("facets")], {"facets": "CASE WHEN p_partkey % 3 = 0 THEN '서울,제조업' WHEN p_size % 2 = 0 THEN '부산,비수도권,청년층' ELSE '' END"})
made("query_variants", "part", ["p_partkey"], {"ind": "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END", "item": "CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_type ELSE '' END", "s": "concat(p_type, '  ', p_size, '.5 명')"},
     lambda: [F.array_join(F.transform(routing.query_variants(C("ind"), C("item"), C("s")), lambda x: F.concat_ws(":", x["role"], x["query"])), "|").alias("variants")],
     {"variants": "concat(CASE WHEN ind <> '' THEN concat('indicator:', ind, '|') ELSE '' END, CASE WHEN item <> '' AND NOT contains(ind, item) THEN concat('item:', item, '|') ELSE '' END, 'sentence:', p_type, ' 명')"})
_ORGS = ["한국은행", "한은", "IMF 본부", "경기도청", "서울대학교", "국회", "부광약품", "청호나이스", "없음", "한국 은행"]
_ORG_SCOPE = ["KOSIS등재", "KOSIS등재", "해외기관", "공식기관_비KOSIS", "공식기관_비KOSIS", "공식기관_비KOSIS", "민간기관", "민간기관", "불명", "KOSIS등재"]


def source_scope(s: SparkSession, d: str) -> DataFrame:
    """Customers' made-up sources by dictionary, alias, and the form of their names; and the one sure candidate, if any."""
    orgs, aliases = s.createDataFrame([("301", "한국은행"), ("101", "국가데이터처")], "org_id string, org_name string"), s.createDataFrame([("한은", "한국은행")], "alias string, org_name string")
    claims = table(s, d, "customer").select("c_custkey", F.expr(pick("c_custkey", *_ORGS)).alias("org"))
    scoped = scope.org_candidates(scope.source_scope(claims, orgs, aliases, "org"))
    return scoped.select("c_custkey", "org", "scope", "org_id", F.size("candidates").alias("n"))


QUERIES["source_scope"] = source_scope
SQL["source_scope"] = f"SELECT c_custkey, {pick('c_custkey', *_ORGS)} AS org, {pick('c_custkey', *_ORG_SCOPE)} AS scope, CASE WHEN c_custkey % 10 IN (0, 1, 9) THEN '301' END AS org_id, (CASE WHEN c_custkey % 10 IN (0, 1, 9) THEN 1 ELSE 0 END)::INTEGER AS n FROM customer"
made("prefilter", "customer", ["c_custkey"], {"c": "CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END", "k": pick("c_nationkey", "집계통계", "", "전망예측"), "o": "CASE CAST(floor(abs(c_acctbal)) AS INT) % 4 WHEN 0 THEN 'KOSIS등재' WHEN 1 THEN '공식기관_비KOSIS' WHEN 2 THEN '민간기관' END"},
     lambda: ["c", "k", "o", scope.prefilter(C("c"), C("k"), C("o")).alias("verdict")],
     {"c": "c", "k": "k", "o": "o", "verdict": "CASE WHEN NOT c THEN '제외' WHEN k = '' THEN '강등' WHEN k <> '집계통계' THEN '제외' WHEN o = 'KOSIS등재' THEN '검증시도' WHEN o = '민간기관' THEN '제외' ELSE '강등' END"})
made("label_normalize", "customer", ["c_custkey"], {"c": "CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END", "k": "CASE c_nationkey % 3 WHEN 0 THEN '전망예측' WHEN 1 THEN 'zzz' END", "w": "CASE CAST(floor(abs(c_acctbal)) AS INT) % 3 WHEN 0 THEN '광고' WHEN 1 THEN 'qqq' END"},
     lambda: ["c", "k", "w", *[scope.normalize_label(C("c"), C("k"), C("w"), ["전망예측", "집계통계"], ["광고", "기타"])[f].alias(f) for f in ("claim_class", "noise_reason", "claim_class_raw", "noise_reason_raw", "consistency_fix")]],
     {"c": "c", "k": "k", "w": "w", "claim_class": "CASE WHEN c AND k = '전망예측' THEN k END", "noise_reason": "CASE WHEN c THEN NULL WHEN w = 'qqq' THEN '기타' ELSE w END", "claim_class_raw": "CASE WHEN c AND k = '전망예측' THEN NULL ELSE k END",
      "noise_reason_raw": "CASE WHEN c OR w = 'qqq' THEN w END", "consistency_fix": "CASE WHEN c THEN w IS NOT NULL ELSE k IS NOT NULL END"})
made("series_unit", "part", ["p_partkey"], {"a": pick("p_partkey", "원", "", "억 원"), "b": pick("p_size", "원", "명", "억원", "")}, lambda: ["a", "b", binding.series_unit(C("a"), F.array(C("b")))["unit"].alias("unit"), binding.series_unit(C("a"), F.array(C("b")))["conflict"].alias("conflict")],
     {"a": "a", "b": "b", "conflict": "a <> '' AND b <> '' AND replace(a, ' ', '') <> b", "unit": "CASE WHEN a <> '' AND b <> '' AND replace(a, ' ', '') <> b THEN NULL WHEN a <> '' THEN a WHEN b <> '' THEN b END"})
made("family_key", "part", ["p_partkey"], {"l": "concat(CASE p_partkey % 4 WHEN 0 THEN '월별  ' WHEN 1 THEN '기존에 가장 높았던 ' WHEN 2 THEN '최대 ' ELSE ' ' END, p_name, CASE p_size % 5 WHEN 0 THEN ' 증가율' WHEN 1 THEN ' 수 증가 폭' WHEN 2 THEN '건수 변동률' WHEN 3 THEN ' 규모' ELSE '' END)"}, lambda: [binding.family_key(C("l")).alias("family")], {"family": "p_name"})
_ROUTE = r"""CASE k WHEN 0 THEN 'ARTICLE_URL' WHEN 1 THEN 'SIMPLE_KOSIS_QUERY' WHEN 2 THEN 'OUT_OF_SCOPE' WHEN 3 THEN 'ARTICLE_TEXT' ELSE CASE
  WHEN regexp_matches(ltrim(coalesce(text, '')), '(?i)^https?://[^/?#@:\s]') THEN 'ARTICLE_URL'
  WHEN length(regexp_replace(trim(coalesce(text, ''), E' \n\t\r\f\x0b'), '\s+', ' ', 'g')) BETWEEN 1 AND 300 AND len(regexp_extract_all(regexp_replace(trim(text, E' \n\t\r'), '\s+', ' ', 'g'), '[.!?。](?:\s|$)')) <= 2 AND regexp_matches(lower(text), 'gdp|%') AND contains(text, '?') THEN 'SIMPLE_KOSIS_QUERY'
  WHEN length(trim(coalesce(text, ''))) >= 400 OR len(string_split(trim(coalesce(text, '')), chr(10))) >= 3 OR len(regexp_extract_all(trim(coalesce(text, '')), '[.!?。](?:\s|$)')) >= 3 THEN 'ARTICLE_TEXT' ELSE 'OUT_OF_SCOPE' END END"""
_STATED = f"CASE how WHEN 'url' THEN 'ARTICLE_URL' WHEN 'article' THEN 'ARTICLE_TEXT' WHEN 'query' THEN CASE WHEN ({_ROUTE}) = 'SIMPLE_KOSIS_QUERY' THEN 'SIMPLE_KOSIS_QUERY' ELSE 'OUT_OF_SCOPE' END ELSE {_ROUTE} END"
made("input_route", "documents", ["doc_id"], {"how": "CASE doc_id % 7 WHEN 1 THEN 'url' WHEN 2 THEN 'article' WHEN 3 THEN 'query' WHEN 4 THEN 'auto' END", "k": "doc_id % 5", "t": "CASE k WHEN 0 THEN concat('https://example.org/', doc_id) WHEN 1 THEN '작년 출생 인구는 몇 명인가요?' WHEN 2 THEN '안녕' WHEN 3 THEN '기자가 전했다' ELSE text END"},
     lambda: [routing.input_route(C("t"), C("how"))["route"].alias("route"), routing.input_route(C("t"), C("how"))["confidence"].cast("double").alias("confidence")],
     {"route": _STATED, "confidence": f"(CASE WHEN how IN ('url', 'query', 'article') THEN 1.0 ELSE CASE ({_ROUTE}) WHEN 'ARTICLE_URL' THEN 1.0 WHEN 'SIMPLE_KOSIS_QUERY' THEN 0.9 WHEN 'ARTICLE_TEXT' THEN 0.85 ELSE 0.8 END END)::DOUBLE"})


def query_register(s: SparkSession, d: str) -> DataFrame:
    """Search paths of every part as a target."""
    p = table(s, d, "part")
    targets = p.select(F.col("p_partkey").cast("string").alias("target_id"), F.col("p_name").alias("indicator"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("item"), F.concat("p_type", F.lit(" "), F.col("p_size").cast("string")).alias("sentence"))
    return layers.query_register(targets)


QUERIES["query_register"] = query_register
SQL["query_register"] = """WITH t AS (SELECT p_partkey::VARCHAR AS target_id, p_name, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS item, p_type FROM part), c(role, channel) AS (VALUES ('indicator', 'official'), ('indicator', 'bm25'), ('indicator', 'dense'), ('item', 'bm25'), ('item', 'dense'), ('sentence', 'dense'))
SELECT target_id, role, channel, CASE role WHEN 'indicator' THEN p_name WHEN 'item' THEN item ELSE p_type END AS query FROM t, c WHERE role <> 'item' OR item <> ''"""


def select_target(s: SparkSession, d: str) -> DataFrame:
    """Of each brand's parts the one that a question about the brand's types and years asks for."""
    p = table(s, d, "part").select(
        F.col("p_brand").alias("article"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("target_id"), F.col("p_name").alias("indicator"), F.concat((F.lit(2020) + F.col("p_size") % 5).cast("string"), F.lit("년")).alias("period"), F.lit("LEVEL").alias("measurement")
    )
    asked = p.withColumn("query", F.concat(F.lit("2023년 "), F.max("indicator").over(Window.partitionBy("article")), F.lit("은?")))
    return scope.select_target(asked, "query", ["article"]).select("article", "target_id", "score")


QUERIES["select_target"] = select_target
SQL["select_target"] = """WITH p AS (SELECT p_brand AS article, lpad(p_partkey::VARCHAR, 9, '0') AS target_id, p_name AS indicator, 2020 + p_size % 5 AS y, max(p_name) OVER (PARTITION BY p_brand) AS asked FROM part),
f AS (SELECT *, (100 + length(indicator) + CASE WHEN y = 2023 THEN 30 ELSE 0 END + 20)::INTEGER AS score FROM p WHERE contains(asked, indicator))
SELECT article, target_id, score FROM (SELECT *, row_number() OVER (PARTITION BY article ORDER BY score DESC, target_id) AS r FROM f) WHERE r = 1"""


def article_date_ctx(s: SparkSession, d: str) -> DataFrame:
    """Turns as sentences of conversations, of which every seventh is unknown and every fifth has no date."""
    c = table(s, d, "conversations")
    articles = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("article_text")).where("conv_id % 7 <> 3")
    articles = articles.select(F.col("conv_id").alias("article_idx"), "article_text", F.when(F.col("conv_id") % 5 == 0, "").otherwise("2024-05-01").alias("date"))
    rows = c.select(F.col("conv_id").alias("article_idx"), "turn", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("※ not there").alias("sentence"))
    return scope.article_date(rows, articles).select("article_idx", "turn", "article_date", "error")


QUERIES["article_date_ctx"] = article_date_ctx
SQL["article_date_ctx"] = "SELECT conv_id AS article_idx, turn, CASE WHEN conv_id % 7 <> 3 AND conv_id % 5 <> 0 AND turn % 2 = 0 AND text IS NOT NULL THEN '2024-05-01' END AS article_date, CASE WHEN conv_id % 7 = 3 THEN 'ARTICLE_UNKNOWN' END AS error FROM conversations"


def clarify_merge(s: SparkSession, d: str) -> DataFrame:
    """Customers with answers made of their orders' priorities: one priority settles the item, several conflict."""
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("target_id"), F.lit("old").alias("item"), F.col("c_mktsegment").alias("period"))
    answers = table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("target_id"), F.lit("item").alias("role"), F.col("o_orderpriority").alias("value"))
    return scope.clarify(rows, answers)


QUERIES["clarify_merge"] = clarify_merge
SQL["clarify_merge"] = """WITH a AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS k, min(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT c_custkey AS target_id, CASE WHEN k = 1 THEN v ELSE 'old' END AS item, c_mktsegment AS period, CASE WHEN k > 1 THEN 'CLARIFICATION_CONFLICT' END AS error FROM customer LEFT JOIN a ON o_custkey = c_custkey"""


# ---- the layers end to end, an article a part
_A, _B, _D = "p_size % 5 + 1", "p_partkey % 10", "p_partkey % 9 + 1"


def _stacked(s: SparkSession, d: str) -> DataFrame:
    """Three sentences an article: who says it, a rate, and its change from the year before; every seventh article is a private survey's."""
    p = spread(table(s, d, "part").select("p_partkey", "p_size"), "p_partkey", rows=10_000)
    body = F.concat(F.lit("국가데이터처가 2025년 3월 고용동향을 발표했다. 3월 실업률은 "), F.expr(f"concat({_A}, '.', {_B})"), F.lit("%를 기록했다. 전년 동월보다 0."), F.expr(f"cast({_D} as string)"), F.lit("%p 올랐다."))
    articles = p.select(F.col("p_partkey").cast("string").alias("article_idx"), F.lit("t").alias("title"), body.alias("article_text"), F.lit("2025-04-10").alias("date"))
    whose = F.when(F.col("p_partkey") % 7 == 3, "민간조사").otherwise("공식집계")
    row = lambda sid, opens, governing, subtype, indicator, raw: F.struct(F.lit(sid).alias("sentence_id"), F.lit(opens).alias("opens"), F.lit(governing).cast("int").alias("governing"), subtype.alias("subtype"), F.lit(indicator).alias("indicator"), F.lit(raw).alias("period_raw"))
    layout = p.select(F.col("p_partkey").cast("string").alias("article_idx"), F.explode(F.array(row(0, True, None, whose, "", "2025년 3월"), row(1, False, 0, F.lit(""), "실업률", ""), row(2, False, 1, F.lit(""), "", ""))).alias("r")).select("article_idx", "r.*")
    return layers.run_stack(articles, layout)


_SAID = f"""s AS (SELECT p_partkey::VARCHAR AS article_idx, 1 AS sentence_id, concat({_A}, '.', {_B}) AS value, '%' AS unit, p_partkey % 7 = 3 AS private, ({_A}) * 10 + {_B} = 31 AS right_one FROM part
UNION ALL SELECT p_partkey::VARCHAR, 2, concat('0.', {_D}), '%p', p_partkey % 7 = 3, {_D} = 2 FROM part)"""
QUERIES["run_stack"] = lambda s, d: _stacked(s, d).select("article_idx", "sentence_id", "value", "unit", "indicator", "indicator_source", "source_subtype", "measurement", "period", "basis", "baseline", "routing_class", "reason")
SQL["run_stack"] = f"""WITH {_SAID} SELECT article_idx, sentence_id, value, unit, '실업률' AS indicator, CASE sentence_id WHEN 1 THEN 'LOCAL' ELSE 'INHERITED' END AS indicator_source, CASE WHEN private THEN '민간조사' ELSE '공식집계' END AS source_subtype, CASE sentence_id WHEN 1 THEN 'LEVEL' ELSE 'CHANGE_POINT' END AS measurement,
  '2025-03' AS period, CASE sentence_id WHEN 1 THEN 'NONE' ELSE 'YOY' END AS basis, CASE sentence_id WHEN 1 THEN '' ELSE '2024-03' END AS baseline, CASE WHEN private THEN 'OUT_OF_SCOPE' ELSE 'KOSIS_CANDIDATE' END AS routing_class, CASE WHEN private THEN 'SOURCE_SUBTYPE_민간조사' ELSE 'OFFICIAL_AGGREGATE_REGION' END AS reason FROM s"""


def verify_articles(s: SparkSession, d: str) -> DataFrame:
    """Every article's rate and change against two official cells, from text to verdict."""
    from .stack import judge_values

    facts = s.createDataFrame([("실업률", "2025-03", "3.1"), ("실업률", "2024-03", "2.9")], "indicator string, period string, dt string")
    return judge_values(_stacked(s, d), facts).select("article_idx", "sentence_id", "value", "status", "verdict")


QUERIES["verify_articles"] = verify_articles
SQL["verify_articles"] = f"""WITH {_SAID} SELECT article_idx, sentence_id, value, CASE WHEN private THEN 'SOURCE_SUBTYPE_민간조사' WHEN right_one THEN 'MATCH' ELSE 'VALUE_MISMATCH' END AS status, CASE WHEN private THEN 'UNVERIFIABLE' WHEN right_one THEN 'VERIFIED' ELSE 'REFUTED' END AS verdict FROM s"""


def plan_inventory(s: SparkSession, d: str) -> DataFrame:
    """A plan a part on its brand's profile: sound, with an unknown item, a period out of range, a wrong value, or of an unknown table."""
    p = table(s, d, "part").withColumn("k", F.col("p_partkey") % 5)
    key = F.col("p_brand").alias("key")
    items = p.select(key, F.col("p_partkey").alias("itm_id"), F.col("p_name").alias("itm_nm"), F.lit("원").alias("unit"))
    values = p.select(key, F.lit("T").alias("obj_id"), F.lit(1).alias("level"), F.col("p_type").alias("value_id"), F.col("p_type").alias("value_name")).distinct()
    periods = p.select(key, F.lit("Y").alias("freq"), F.lit(1995).alias("lo"), F.lit(2001).alias("hi")).distinct()
    profile = binding.hydrate_profile(p.select(key).distinct(), items, values, periods, "key").withColumnRenamed("key", "table_key")
    plans = p.select(
        F.col("p_partkey").alias("target_id"), F.when(F.col("k") == 4, "none").otherwise(F.col("p_brand")).alias("table_key"), F.when(F.col("k") == 1, -1).otherwise(F.col("p_partkey")).alias("itm_id"), F.lit("Y").alias("freq"),
        F.when(F.col("k") == 2, 2005).otherwise(1996).alias("ord"), F.when(F.col("k") == 4, F.array().cast("array<string>")).when(F.col("k") == 3, F.array(F.lit("zz"))).otherwise(F.array("p_type")).alias("levels"),
    )
    return scope.plan_inventory(plans, profile).select("target_id", F.array_join("errors", ",").alias("errors"))


QUERIES["plan_inventory"] = plan_inventory
SQL["plan_inventory"] = "SELECT p_partkey AS target_id, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'ITEM_ID_OR_UNIT' WHEN 2 THEN 'PERIOD_RANGE' WHEN 3 THEN 'OBJ_LEVEL_VALUE' ELSE 'TABLE_ID_MISMATCH,ITEM_ID_OR_UNIT,PERIOD_RANGE' END AS errors FROM part"
