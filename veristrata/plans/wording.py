"""More literal cases: legacy numbers, directions, period spans, lists in sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import legacy
from ..operators import text
from ..sources.tables import table
from .language import _literal

QUERIES: dict = {}
SQL: dict[str, str] = {}
V, D, I, B = "VARCHAR", "DOUBLE", "INTEGER", "BOOLEAN"


def case(name: str, ins: list[tuple[str, str, str]], outs: list[tuple[str, str]], rows: list[tuple], make) -> None:
    """Register a query over literal rows: inputs (name, Spark type, SQL type), outputs (name, SQL type), ``make() -> columns``."""
    k = len(ins)
    QUERIES[name] = lambda s, d: s.createDataFrame([r[:k] for r in rows], ", ".join(f"{n} {t}" for n, t, _ in ins)).select(*[n for n, _, _ in ins], *make())
    SQL[name] = _literal([(n, t) for n, _, t in ins] + outs, rows)


S = lambda n: (n, "string", V)
case("knum_strict", [S("t")], [("n", D)], [("3백만원", None), ("1조8000억", 1.8e12), ("25.4조원", 2.54e13), ("12만3", 120003.0), ("5만1조", None), ("-7.5%", -7.5), ("", None)], lambda: [legacy.strict_number(F.col("t")).alias("n")])
case("to_base_unit", [("v", "double", D), S("u")], [("base", D), ("dim", V)], [(5.0, "억원", 5e8, "money:KRW"), (2.0, "%p", 2.0, "percent_point"), (3.0, "만 명", 30000.0, "count"), (1.0, "kg", None, None)],
     lambda: [legacy.base_unit(F.col("v"), F.col("u"))["value"].alias("base"), legacy.base_unit(F.col("v"), F.col("u"))["dimension"].alias("dim")])
case("compare_values", [("a", "double", D), S("ua"), ("b", "double", D), S("ub")], [("match", B), ("status", V)],
     [(5.0, "억원", 50000.0, "만원", True, "KNOWN_COMPATIBLE"), (5.0, "명", 5.0, "원", False, "KNOWN_MISMATCH"), (100.0, "x", 100.4, "y", True, "UNKNOWN"), (1.0, "x", 0.0, "x", False, "UNKNOWN"), (0.0, "x", 0.0, "x", True, "UNKNOWN")],
     lambda: [legacy.compare_values(F.col("a"), F.col("b"), F.col("ua"), F.col("ub"))["match"].alias("match"), legacy.compare_values(F.col("a"), F.col("b"), F.col("ua"), F.col("ub"))["unit_status"].alias("status")])
case("unit_compat", [S("a"), S("b")], [("ok", B)], [("억 원", "억원", True), ("천원", "조원", True), ("명", "가구", False)], lambda: [legacy.unit_compatible(F.col("a"), F.col("b")).alias("ok")])
case("infer_unit", [S("u"), S("l")], [("unit", V)], [("명", "x (원)", "명"), ("", "수출액 (억 달러)", "억 달러"), (" ", "수출액", None)], lambda: [legacy.infer_unit(F.col("u"), F.col("l")).alias("unit")])
case("fmt_decimal", [("v", "double", D)], [("s", V)], [(1234567.5, "1,234,567.5"), (1000.0, "1,000"), (0.25, "0.25"), (-3.0, "-3")], lambda: [legacy.format_decimal(F.col("v")).alias("s")])
case("canonical_abs", [S("t")], [("p", V)], [("2024년 3분기", "2024-Q3"), ("2024-Q2", "2024-Q2"), ("2024년 5월", "2024-05"), ("2024.7", "2024-07"), ("2024년", "2024"), ("5월", ""), (None, "")], lambda: [legacy.canonical_absolute(F.col("t")).alias("p")])
case("granularity", [S("t")], [("g", V)], [("이달 첫 주", "week"), ("3월 5일", "day"), ("1분기", "quarter"), ("전월", "month"), ("지난해", "year"), ("어제", "")], lambda: [legacy.granularity(F.col("t")).alias("g")])
case("value_direction", [S("s"), ("a", "int", I), ("b", "int", I)], [("dir", V)],
     [("3% 감소했다", 0, 2, "DECREASE"), ("수출은 늘어 5%를", 7, 9, "INCREASE"), ("3%, 증가", 0, 2, None), ("3% 기록", 0, 2, None), ("3% 감소", 9, 2, None)], lambda: [text.value_direction(F.col("s"), F.col("a"), F.col("b")).alias("dir")])
case("period_span", [S("s"), ("pos", "int", I)], [("raw", V), ("start", I)],
     [("2024년 3월 실업률은 3%", 14, "2024년 3월", 0), ("실업률 3%는 올해 기록", 4, "올해", 8), ("지난해보다 늘어 5월 3%", 12, "5월", 9), ("2020년 이후 3%", 9, "", None)],
     lambda: [text.period_span(F.col("s"), F.col("pos"))["raw"].alias("raw"), text.period_span(F.col("s"), F.col("pos"))["start"].alias("start")])
case("list_transition", [S("s"), ("n", "int", I)], [("moves", V)], [("3%에서 5%로, 7%에서 9%로", 4, "3>5|7>9"), ("3%에서 5%로", 3, None), ("3% 올랐다", 1, None)],
     lambda: [F.array_join(F.transform(text.transitions(F.col("s"), F.col("n")), lambda x: F.concat_ws(">", x["from"], x["to"])), "|").alias("moves")])
case("list_entity", [S("s"), ("n", "int", I)], [("pairs", V)], [("서울은 3%, 부산은 5%", 2, "서울=3|부산=5"), ("서울은 3%, 서울은 5%", 2, None), ("서울은 3%", 1, None)],
     lambda: [F.array_join(F.transform(text.entity_values(F.col("s"), F.col("n")), lambda x: F.concat_ws("=", x["entity"], x["value"])), "|").alias("pairs")])
case("punct_insensitive_match", [S("a"), S("b")], [("hit", B)], [("15-29 세 (청년)", "15~29세", False), ("고용 률(전체)", "고용률", True), ("abc", "", False), ("A.B c", "ab_C", True)], lambda: [text.contains_loosely(F.col("a"), F.col("b")).alias("hit")])
case("strip_period", [S("t")], [("out", V)], [("2024년 5월 실업률", "실업률"), ("5월", "5월"), ("수출", "수출")], lambda: [text.strip_period(F.col("t")).alias("out")])
QUERIES["chunk"] = lambda s, d: text.chunks(table(s, d, "conversations"), ["conv_id"], "turn", 3).select("conv_id", F.col("chunk").cast("bigint").alias("chunk"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
SQL["chunk"] = "SELECT conv_id, turn // 3 AS chunk, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS ids FROM conversations GROUP BY 1, 2"
