"""Roles and fields of values: pairing, inheritance and periods on hand-made sentences."""

from pyspark.sql import functions as F

from veristrata.operators import fields, layers, roles

PAIR = "case string, scopes array<struct<label:string,start:int,end:int>>, place int, n int, at int, end int, sentence string"


def paired(spark, rows):
    p = roles.pair_with_scope(*[F.col(c) for c in ("scopes", "place", "n", "at", "end", "sentence")])
    return {r["case"]: (r.p.label, r.p.pairing) if r.p else None for r in spark.createDataFrame(rows, PAIR).select("case", p.alias("p")).collect()}


def test_pairing(spark):
    s, t = "수출은 5% 늘고 수입은 3% 줄었다", "수출 증가율은 5%로 지난달(3%)보다 높다"
    rows = [
        ("nearest", [("수출", 0, 2), ("수입", 10, 12)], 1, 2, 14, 16, s), ("tie goes to the first", [("a", 0, 2), ("b", 6, 8), ("c", 20, 21)], 0, 9, 4, 4, s), ("touched", [("수출 증가율", 0, 9), ("x", None, None)], 0, 1, 4, 6, s),
        ("order", [("a", None, None), ("b", None, None)], 1, 2, 14, 16, s), ("fewer labels", [("a", None, None), ("b", None, None)], 4, 5, 14, 16, s), ("none", [], 0, 1, 4, 6, s),
        ("baseline", [("수출 증가율", 0, 23), ("수출액", 0, 23)], 1, 2, 16, 18, t), ("all cover, no parentheses", [("수출 증가율", 0, 23), ("수출액", 0, 23)], 0, 2, 8, 10, t), ("two levels", [("수입액", 0, 23), ("수출액", 0, 23)], 1, 2, 16, 18, t),
    ]
    assert t[15] == "(" and t[16:18] == "3%" and s[14:16] == "3%"
    assert paired(spark, rows) == {
        "nearest": ("수입", "SPAN_NEAREST"), "tie goes to the first": ("a", "SPAN_NEAREST"), "touched": ("수출 증가율", "SPAN_CONTAINS"), "order": ("b", "POSITIONAL"), "fewer labels": ("b", "COUNT_MISMATCH_FALLBACK"), "none": None,
        "baseline": ("수출액", "PARENTHESIZED_BASELINE"), "all cover, no parentheses": ("수출 증가율", "POSITIONAL"), "two levels": ("수출액", "POSITIONAL"),
    }


LAYOUT = "article_idx string, sentence_id int, opens boolean, governing int, subtype string, scopes array<struct<label:string,start:int,end:int>>, indicator_state string, period_raw string, value string"


def test_roles_of_an_article(spark):
    body = "통계청 발표다. 수출은 5% 늘었다. 증가율은 3%였다. 모두 2%다. 민간은 다르다. 비율은 7%다. 9%다."
    layout = [
        ("a", 0, True, None, "공식집계", None, None, "2025년 3월", "x"), ("a", 1, False, 0, "", [("수출", None, None)], None, "", "x"), ("a", 2, False, 1, "", [(" ", None, None), ("증가율", None, None)], None, " ", "x"),
        ("a", 3, False, 2, "", [], "MISSING", "", "x"), ("a", 4, True, None, "민간조사", None, None, None, "x"), ("a", 5, False, 4, "", [("비율", None, None)], None, "", "x"),
    ]
    articles = spark.createDataFrame([("a", body, "2025-04-10"), ("b", None, None), ("c", "수출은 1%다.", None)], "article_idx string, article_text string, date string")
    out = roles.assign_roles(roles.sentence_values(articles), spark.createDataFrame(layout, LAYOUT))
    got = {(r.article_idx, r.sentence_id): (r.value, r.indicator, r.indicator_source, r.indicator_from, r.region, r.source_subtype, r.period_raw, r.period_source, r.clarify) for r in out.collect()}
    assert got == {
        ("a", 1): ("5", "수출", "LOCAL", None, 0, "공식집계", "2025년 3월", "INHERITED", False), ("a", 2): ("3", "수출 증가율", "LOCAL_COMPOSED", 1, 0, "공식집계", "2025년 3월", "INHERITED", False),
        ("a", 3): ("2", None, "NONE", None, 0, "공식집계", "2025년 3월", "INHERITED", True), ("a", 5): ("7", "비율", "LOCAL", None, 4, "민간조사", "", "NONE", False),
        # No layout of its own: no region, so what is carried is that of any sentence before.
        ("a", 6): ("9", "비율", "INHERITED", 5, None, "", "2025년 3월", "INHERITED", False), ("c", 0): ("1", None, "NONE", None, None, "", "", "NONE", False),
    }
    assert layers.run_stack(articles.where("article_idx = 'none'"), spark.createDataFrame(layout, LAYOUT)).count() == 0


def test_period_pairs(spark):
    rows = [
        ("own", "2025년 3월", "전년 동월보다 3% 늘었다", "CHANGE_RATE", "", ("2025년 3월", "2025-03", "전년 동월보다", "2024-03", "YOY", "MEASUREMENT")),
        ("level", "2025년 3월", "전년 동월보다 3% 늘었다", "LEVEL", "", ("2025년 3월", "2025-03", "", "", "NONE", "MEASUREMENT")),
        ("region's", "전월", "전월보다 늘었다", "CHANGE_POINT", "2월", ("2월", "2025-02", "전월", "2025-01", "MOM", "MEASUREMENT")),
        ("forward", "전월(8월)", "전월(8월)보다 늘었다", "CHANGE_POINT", None, ("", "2024-09", "전월(8월)", "2024-08", "MOM", "MEASUREMENT")),
        ("published", "", "직전 분기 대비 늘었다", "CHANGE_POINT", "", ("", "2025-Q2", "직전 분기 대비", "2025-Q1", "QOQ", "MEASUREMENT")),
        ("year", "작년", "1년 전보다 늘었다", "CHANGE_RATE", "", ("작년", "2024", "", "", "NONE", "MEASUREMENT")),  # the words are of two bases
        ("two", "2025년", "전년과 전월보다", "CHANGE_RATE", "", ("2025년", "2025", "", "", "NONE", "MEASUREMENT")),
        ("span", "5년 간", "2019년과 비교해 늘었다", "CHANGE_RATE", "", ("", "", "2019년과 비교", "", "PERIOD_TO_PERIOD", "MEASUREMENT")),
        ("operation", "2001년 이후", "2001년 이후 가장 크다", "LEVEL", "", ("", "", "", "", "NONE", "DURATION_OR_RANGE")),
        ("null", None, None, None, None, ("", "", "", "", "NONE", "MEASUREMENT")),
    ]
    df = spark.createDataFrame([r[:5] for r in rows], "case string, raw string, s string, m string, f string").withColumn("day", F.lit("2025-04-10").cast("date"))
    got = {r["case"]: tuple(r.pair) for r in fields.period_pair(df, F.col("raw"), F.col("s"), F.col("m"), F.col("day"), F.col("f")).collect()}
    assert got == {r[0]: r[5] for r in rows}
    merged = fields.period_pair(df.where("case = 'year'"), F.col("raw"), F.col("s"), F.col("m"), F.col("day"), F.col("f"), merge=True)
    assert tuple(merged.first().pair) == ("작년", "2024", "1년 전보다", "2023", "YOY", "MEASUREMENT")


def test_baseline_in_parentheses_is_the_other_side(spark):
    body = "3월 수출액은 9%로 전월(7%)보다 높았다."
    layout = spark.createDataFrame([("a", 0, True, None, "공식집계", [("수출 증가율", 3, 20), ("수출액", 3, 20)], None, "", "")], LAYOUT)
    out = layers.run_stack(spark.createDataFrame([("a", body, "2025-04-10")], "article_idx string, article_text string, date string"), layout)
    assert {r.value: (r.indicator, r.indicator_pairing, r.period, r.baseline, r.basis) for r in out.collect()} == {
        "9": ("수출 증가율", "POSITIONAL", "2025-03", "2025-02", "MOM"), "7": ("수출액", "PARENTHESIZED_BASELINE", "2025-02", "", "NONE"),
    }


def test_tasks_of_the_stack_follow_rows(spark):
    """Values are read by as many tasks as rows ask for, where bytes alone would ask for one."""
    rows = roles.sentence_values(spark.createDataFrame([("a", "3월 수출액은 9%였다.", "2025-04-10")], "article_idx string, article_text string, date string"))
    layout = spark.createDataFrame([("a", 0, True, None, "공식집계", [("수출액", 3, 6)], None, "", "")], LAYOUT)
    assert roles.assign_roles(rows, layout, 23).rdd.getNumPartitions() == 23
    assert [r.value for r in roles.assign_roles(rows, layout, 23).collect()] == ["9"]
