"""Scalar semantics by hand-made vectors and properties."""

from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veristrata.functions import compare, period, quantity
from veristrata.operators import binding, cells, context, ledger, pages, retrieval, text
from veristrata.plans import registry


def test_quantity_codes():
    assert quantity.quantity("5", "")["error"] == "UNIT_UNAVAILABLE"
    assert quantity.quantity(None, None)["error"] == "UNIT_UNAVAILABLE"
    assert quantity.quantity("1인당 5", "가구당원")["error"] == "UNIT_DENOMINATOR_CONFLICT"
    assert quantity.quantity("3만6745", "명")["value_base"] == Decimal(36745)


@given(st.integers(1, 9999), st.integers(0, 9999))
def test_scales_add_up(a, b):
    assert quantity.number(f"{a}만{b}" if b else f"{a}만")[0] == a * 10_000 + b
    assert quantity.expand_number(f"{a}만{b}" if b else f"{a}만") == a * 10_000 + b


def test_compare(spark):
    q = "struct<value_base:decimal(38,6),dimension:string,currency:string,denominator:string,qualifier:string,quantum:decimal(38,6)>"
    one = lambda v, d="percent", q=None: (Decimal(v), d, None, None, q, Decimal("0.1"))
    rows = [(one("2.6"), one("2.64"), "MATCH"), (one("2.6"), one("2.66"), "VALUE_MISMATCH"), (one("5"), one("5", "percent_point"), "UNIT_MISMATCH"), (one("5", q="약"), one("5"), "QUALIFIER_UNSUPPORTED")]
    df = spark.createDataFrame(rows, f"c {q}, o {q}, want string")
    out = df.select("want", compare.compare_canonical(F.col("c"), F.col("o")).alias("got")).collect()
    assert all(r.want == r.got for r in out)


def test_shift_inverse(spark):
    df = spark.createDataFrame([(p, n) for p in ("2024-01", "2023-12", "2024-Q1", "1999") for n in (-30, -1, 0, 7, 40)], "p string, n int")
    back = df.select("p", period.shift_period(period.shift_period(F.col("p"), F.col("n")), -F.col("n")).alias("b")).collect()
    assert all(r.p == r.b for r in back)


def test_exact_cell(spark):
    plans = spark.createDataFrame([("a", "x", "1"), ("b", "x", None), ("c", "y", "9")], "t string, k string, l string")
    facts = spark.createDataFrame([("x", "1", 5.0), ("x", "2", 6.0)], "k string, l string, v double")
    got = {r.t: (r.cell_status, r.cell_value) for r in cells.exact_cell(plans, facts, ["k", "l"], "v").collect()}
    assert got == {"a": ("CELL_RESOLVED", 5.0), "b": ("MULTIPLE_CELLS", None), "c": ("NO_CELL", None)}


def test_range_cells(spark):
    want = spark.createDataFrame([("s", 1), ("s", 2), ("t", 1), ("u", 1)], "s string, p int")
    have = spark.createDataFrame([("s", 1), ("t", 1), ("t", 1), ("u", 1), ("u", 2)], "s string, p int")
    got = {r.s: r.status for r in cells.range_cells(want, have, "s", "p").collect()}
    assert got == {"s": "RANGE_CELLS_MISSING", "t": "RANGE_CELLS_DUPLICATED", "u": "RANGE_CELLS_UNEXPECTED"}


def test_region_chain_cycles_and_gaps(spark):
    rows = [("a", 1, True, None), ("a", 2, False, 1), ("a", 3, False, 2), ("a", 4, False, 5), ("a", 5, False, 4), ("a", 6, False, 99)]
    got = {r.sid: r.region for r in context.region_chain(spark.createDataFrame(rows, "article string, sid int, opens boolean, governing int")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: None, 5: None, 6: None}


def test_dense_boundary_tie_drops_all(spark):
    hits = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.5), (1, "c", 0.5)], "query_id int, g string, score double")
    got = retrieval.grouped_cutoff(hits, "g", 2).collect()
    assert [(r.g, r.status) for r in got] == [("a", "DROPPED_UNCLOSED_CUTOFF_TIE")]


def test_rrf(spark):
    hits = spark.createDataFrame([("t", "A", 1), ("t", "A", 2), ("t", "B", 1)], "target_id string, k string, rank int")
    got = {r.k: (r.rrf_score, r.fused_rank) for r in retrieval.rrf_fuse(hits, "k").collect()}
    assert got["A"] == (pytest.approx(1 / 61 + 1 / 62, abs=1e-9), 1) and got["B"][1] == 2


def test_binary_prf_without_positives(spark):
    df = spark.createDataFrame([(False, False)], "t boolean, p boolean")
    r = ledger.binary_prf(df, F.col("t"), F.col("p")).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_unique_resolve(spark):
    rows = [("a", "s", None), ("a", "s", None), ("b", "s", None), ("b", "t", None), ("c", None, "ITEM_MISSING"), ("c", None, "UNIT_MISMATCH")]
    got = {r.target_id: (r.status, r.reason) for r in binding.unique_resolve(spark.createDataFrame(rows, "target_id string, signature string, reason string")).collect()}
    assert got == {"a": ("QUERY_READY", None), "b": ("HOLD", "MULTIPLE_COMPATIBLE_SERIES"), "c": ("HOLD", "UNIT_MISMATCH")}


def test_span_overlap(spark):
    t = "array<struct<sentence:int,start:int,end:int>>"
    df = spark.createDataFrame([([(0, 0, 3), (0, 3, 5)],), ([(0, 0, 4), (0, 3, 5)],), ([(0, 0, 4), (1, 3, 5)],), ([],)], f"s {t}")
    assert [r[0] for r in df.select(binding.span_overlap(F.col("s"))).collect()] == [False, True, False, False]


@settings(max_examples=200)
@given(st.text(alphabet="ab1. !?\n가", max_size=40))
def test_sentences_keep_offsets(s):
    out = text.split_sentences(s)
    assert [x["sentence_id"] for x in out] == list(range(len(out)))
    assert all(s[x["char_start"] : x["char_end"]] == x["text"] for x in out)
    assert "".join("".join(x["text"].split()) for x in out) == "".join(s.split())


def test_page_extraction():
    body = "<p>" + "word " * 40 + "</p>"
    html = f"""<html><head><meta property="og:title" content="T2"><script type="application/ld+json">{{"@graph":[{{"headline":"no article"}},{{"@type":"NewsArticle","headline":"T1","datePublished":"2024-03-05T10:00"}}]}}</script></head>
    <body><nav><p>skip me</p></nav><article><h1>T3</h1>{body}</article><footer><p>no</p></footer></body></html>"""
    out = pages.extract(html)
    assert (out["title"], out["title_from"], out["published"], out["date_from"], out["status"], out["paragraphs"]) == ("T1", "jsonld", "2024-03-05", "jsonld", "OK", 1)
    assert pages.extract(None)["status"] == "BODY_TOO_SHORT"
    assert pages.iso_date("2024년 3월 5일") == "2024-03-05"


def test_near_equal_paragraphs():
    assert pages.merge_near_equal(["the quick brown fox 1", "the quick brown fox 1!", "the quick brown fox 2"]) == ["the quick brown fox 1!", "the quick brown fox 2"]


def test_stream_equals_batch(spark, tmp_path):
    from veristrata.streaming import ledger as stream

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stream.latest_by_key(live).writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    got = sorted((r.user_id, r.event_id) for r in spark.table("latest").collect())
    assert got == sorted((r.user_id, r.event_id) for r in registry.QUERIES["latest_state"](spark, "/root/testdata/sf0.001").collect())


def test_region_chain_of_many_articles(spark):
    """Two million sentences: chains of 8 behind one that opens, and one of 52 links, which is too long."""
    rows = spark.range(2_000_000).selectExpr("id div 8 AS article", "id % 8 AS sid", "id % 8 = 0 AS opens", "CASE WHEN id % 8 > 0 THEN id % 8 - 1 END AS governing")
    out = context.region_chain(rows)
    assert out.where("region = 0").count() == 2_000_000
    long = spark.range(60).selectExpr("0 AS article", "id AS sid", "id = 0 AS opens", "CASE WHEN id > 0 THEN id - 1 END AS governing")
    got = {r.sid: r.region for r in context.region_chain(long).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[i] is None for i in range(51, 60))


def test_walk_tree_is_deep_and_stops_at_cycles(spark):
    edges = [(None, "n0")] + [(f"n{i}", f"n{i + 1}") for i in range(30)] + [("n30", "n3"), ("x", "y"), ("n0", "n1")]
    got = {r.node: r.depth for r in context.walk_tree(spark.createDataFrame(edges, "parent string, child string")).collect()}
    assert got == {f"n{i}": i for i in range(31)}


def test_exact_cell_without_any_axis(spark):
    plans = spark.createDataFrame([(1, None), (2, "x")], "t int, k string")
    facts = spark.createDataFrame([("x", 5.0), ("y", 6.0)], "k string, v double")
    got = {r.t: r.cell_status for r in cells.exact_cell(plans, facts, ["k"], "v").collect()}
    assert got == {1: "MULTIPLE_CELLS", 2: "CELL_RESOLVED"}
    assert cells.exact_cell(plans.limit(0), facts, ["k"], "v").count() == 0


def test_pairs_keep_ranges_ages_and_signs():
    pairs = lambda s: [(p["value"], p["unit"]) for p in text.find_pairs(s)]
    assert pairs("1조 2000~3000억원 규모") == [("2000", "원"), ("3000억", "원")]
    assert pairs("15~29세 고용률은 46.2%") == [("15", "세"), ("29", "세"), ("46.2", "%")]
    assert pairs("자동차부품(-7.6%)") == [("-7.6", "%")]
    assert pairs("1조 8000억 원과 3만 명") == [("1조 8000억", "원"), ("3만", "명")]
    assert pairs("2023년 1분기") == [("1", "분기")] and pairs("") == [] and pairs(None) == []


@settings(max_examples=300)
@given(st.text(alphabet="a가.!?\"”( 1@", max_size=30))
def test_body_sentences_cover_the_text(s):
    out = text.split_body(s)
    assert all(s[x["char_start"] : x["char_end"]] == x["text"] for x in out)
    assert "".join("".join(x["text"].split()) for x in out) == "".join(s.split())


def test_many_query_terms_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "w0 w1 b"), (2, "w1 w1 x")], "id int, t string")
    many = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40))), (2, "x w1")], "query_id int, query string")
    few = sorted(map(tuple, retrieval.bm25(docs, many, "id", "t", [], False).collect()))
    monkeypatch.setattr(retrieval, "QUERY_TERMS", 3)
    assert sorted(map(tuple, retrieval.bm25(docs, many, "id", "t", [], False).collect())) == few and len(few) == 4


def test_body_by_selectors():
    long = "한국은행은 지난해 값이 늘었다고 밝혔다. " * 5
    page = f"""<html><body><nav><p>{long}</p></nav><div id="articleBody"><p class="x">{long}</p><div class="ad"><p>{long}</p></div><div class="content_text"><p>{long}<br>둘</p></div></div><article>{long * 4}</article></body></html>"""
    body, selector, adapter, n = pages.body_of(page, "www.khan.co.kr")
    assert (selector, adapter, n) == ("#articleBody .content_text", "KHAN_ARTICLE_V1", 1) and body.endswith("둘")
    body, selector, adapter, n = pages.body_of(page, "example.org")
    assert (selector, adapter, n) == ("article", "GENERIC", 1)
    assert pages.body_of(f"<div id='articleBody'><p>{long * 2}</p></div>", None)[1:] == ("#articleBody", "GENERIC", 1)
    assert pages.body_of(None, None) == (None, None, None, 0) and pages.body_of("<p>kurz</p></div></p>", "x")[0] is None


def test_text_is_normalized(spark):
    raw = "# 제목\r\n\r\n\r\n\r\n**굵은** 글 [이미지: 표]  \n---\n끝\n"
    assert spark.createDataFrame([(raw,)], "t string").select(pages.normalize_text(F.col("t"))).first()[0] == "제목\n\n굵은 글\n\n끝"


def test_span_candidates():
    got = [(c["kind"], c["text"], c["unit"]) for c in text.candidates_of("서울 고용률은 3개월 연속 62.5%로, 15~29세는 제외. 경기를 경유한 지난해 1분기~올해 2분기 지수는 103.2로 올랐다")]
    assert ("dimension", "서울", None) in got and ("value_unit", "62.5%", "%") in got and ("dimension", "15~29세", None) in got
    assert ("value_unit", "103.2", "지수") in got and ("value_unit", "지난해 1분기~올해 2분기", "기간") in got and ("time", "지난해 1분기", None) in got
    assert not any(k == "dimension" and t == "경기" for k, t, _ in got) and not any(u == "개월 연속" for _, _, u in got)
    assert [c["unit"] for c in text.candidates_of("물가는 4개월 연속 올랐다") if c["kind"] == "value_unit"] == ["개월 연속"]


def test_absolute_periods_refuse_trailing_marks(spark):
    from veristrata.functions import legacy

    wanted = {"2024-": "", "2024.": "", "2024/": "", "2024": "2024", "2024년": "2024", "2024 대비 2023년 5월": "2023-05", "2024년 3월 1분기": "2024-03", "2024-123": "2024-12", "2024 2분기": "2024-Q2", "2024-q3": "2024-Q3", "2024/ 7": "2024-07", "2024.13": "", "20245": "", None: ""}
    rows = spark.createDataFrame([(k,) for k in wanted], "t string").select("t", legacy.canonical_absolute(F.col("t")).alias("p")).collect()
    assert {r.t: r.p for r in rows} == wanted


def test_decimals_keep_their_places(spark):
    from veristrata.functions import legacy

    rows = spark.createDataFrame([(1234567.123456789, "1,234,567.123456789"), (-1000.0, "-1,000"), (0.0000001, "0.0000001"), (100.0, "100"), (None, None)], "v double, s string").select("s", legacy.format_decimal(F.col("v")).alias("got")).collect()
    assert all(r.got == r.s for r in rows)


def test_routes_of_marks_and_stated_types(spark):
    from veristrata.operators import routing

    rows = [("실업률 3%？", None, "OUT_OF_SCOPE"), ("실업률 3%?", "auto", "SIMPLE_KOSIS_QUERY"), ("안녕", "query", "OUT_OF_SCOPE"), ("작년 인구는 몇 명", "query", "SIMPLE_KOSIS_QUERY"), ("x", "url", "ARTICLE_URL"), ("https://a.b", "article", "ARTICLE_TEXT"), ("https://a.b", None, "ARTICLE_URL"), (None, None, "OUT_OF_SCOPE")]
    got = spark.createDataFrame(rows, "t string, how string, want string").select("want", routing.input_route(F.col("t"), F.col("how"))["route"].alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_findings_of_sentences(spark):
    from decimal import Decimal

    from veristrata.operators import series

    said = [
        (1, 0, 0, "2024년 4월 출생아 수는 늘었다", "출생아 수", "2024-06-01", ""), (1, 1, 0, "출생아 수는 2001년 4월 이후 23년 만에 가장 많았다", "출생아 수", "2024-06-01", "2024-04"),
        (2, 0, 0, "2024년 4월 출생아는 늘었다", "출생아", "2024-06-01", ""), (2, 1, 0, "1981년 통계 집계 이래 최고 증가율", "", "2024-06-01", ""), (2, 2, 1, "1981년 통계 집계 이래 최고 증가율", "", "2024-06-01", ""),
        (3, 0, 0, "2001년 3월 이후 23년 만에 가장 컸다", "혼인", "2024-06-01", "2024-03"), (4, 0, 0, "2023년 1월부터 올해 3월까지 15개월 연속 증가", "혼인", "2024-06-01", ""), (5, 0, 0, "2023년 1월부터 작년 3월까지 3개월 연속", "혼인", "2024-06-01", ""),
    ]
    rows = spark.createDataFrame(said, "article int, idx int, paragraph int, text string, indicator string, published string, hint string")
    got = {(r.article, r.idx): r for r in series.range_specs(rows).collect()}
    of = lambda a, i: (got[a, i].operator, got[a, i].start, got[a, i].end, len(got[a, i].expected), len(got[a, i].comparison), got[a, i].anchor)
    assert of(1, 1) == ("MONTH_OF_YEAR_MAX_SINCE", "2001-04", "2024-04", 24, 23, "2001-04")
    assert of(2, 1) == ("YOY_RATE_MAX_SINCE", "1980-04", "2024-04", 45, 44, "1981-04") and got[2, 1].month_source == "adjacent_inherited" and got[2, 1].family == "출생아"
    assert of(2, 2) == ("YOY_RATE_MAX_SINCE", "", "", 0, 0, "") and got[2, 2].family == ""
    assert of(3, 0) == ("YOY_DIFFERENCE_MAX_SINCE", "2000-03", "2024-03", 25, 23, "2001-03")
    assert of(4, 0) == ("YOY_STREAK", "2022-01", "2024-03", 27, 15, None) and got[4, 0].claim_count == 15
    assert of(5, 0)[1:5] == ("2022-01", "", 0, 0)

    specs = [("max", "MONTH_OF_YEAR_MAX_SINCE", ["2001-03", "2002-03", "2003-03", "2004-03"], ["2002-03", "2003-03", "2004-03"], "2004-03"), ("wide", "YOY_DIFFERENCE_MAX_SINCE", ["2000-03", "2001-03", "2002-03", "2003-03", "2004-03"], ["2002-03", "2003-03", "2004-03"], "2004-03"),
             ("gap", "MONTH_OF_YEAR_MAX_SINCE", ["2004-03", "2005-03"], ["2005-03"], "2005-03"), ("rate", "YOY_RATE_MAX_SINCE", ["1999-03", "2000-03"], ["2000-03"], "2000-03"), ("none", "YOY_RATE_MAX_SINCE", [], [], "")]
    cells = [("2001-03", 100), ("2002-03", 5), ("2003-03", 6), ("2004-03", 50), ("2000-03", 7), ("1999-03", 0)]
    table = spark.createDataFrame([("s", p, Decimal(v)) for p, v in cells], "series string, period string, v decimal(20,2)")
    asked = spark.createDataFrame([(i, "s", o, e, c, None, now) for i, o, e, c, now in specs], "id string, series string, operator string, expected array<string>, comparison array<string>, claim_count int, current string")
    out = {r.id: (r.status, r.reason, r.finding) for r in series.evaluate_ranges(asked, table, ["id"], ["series"], "period", "v").collect()}
    # The anchor's own value is not compared: highest since March 2001 without it.
    assert out == {"max": ("evaluated", None, True), "wide": ("evaluated", None, True), "gap": ("not_evaluated", "RANGE_CELLS_MISSING", None), "rate": ("not_evaluated", "RANGE_ZERO_BASELINE", None), "none": ("not_evaluated", "RANGE_CLAIM_MONTH_SCOPE_AMBIGUOUS", None)}


def test_stored_index(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "a b a", "x"), (2, "b c", "y"), (3, None, "x"), (4, "a " * 50, "y"), (5, "실업률 3%", "x")], "id int, t string, kind string")
    retrieval.write_index(docs, "id", "t", ["kind"], str(tmp_path / "i"), buckets=4)
    asked = spark.createDataFrame([(1, "a b"), (2, "B"), (3, "zz"), (4, "실업률")], "query_id int, query string")
    for limit in (1000, 1):  # sent to the postings, or joined to them
        monkeypatch.setattr(retrieval, "QUERY_TERMS", limit)
        for every in (True, False):
            got = {(r.query_id, r.id): r.score for r in retrieval.search_index(spark, str(tmp_path / "i"), asked, "id", ["kind"], every, 10).collect()}
            assert got == {(r.query_id, r.id): r.score for r in retrieval.bm25(docs, asked, "id", "t", ["kind"], every).collect()}
    only = retrieval.search_index(spark, str(tmp_path / "i"), asked, "id", ["kind"], False, 1, {"kind": ["y"]})
    assert {(r.query_id, r.id) for r in only.collect()} == {(1, 4), (2, 2)}
    with pytest.raises(ValueError, match="no word"):
        retrieval.search_index(spark, str(tmp_path / "i"), spark.createDataFrame([(1, " ?")], "query_id int, query string"), "id", ["kind"], True, 5)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        retrieval.write_index(docs, "id", "t", ["kind"], str(tmp_path / "i"))


def test_cache_and_crawl(spark):
    from veristrata.operators import state

    asked = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "i int, q string")
    empty = spark.createDataFrame([], "address string, release string, result string, fetched_at timestamp")
    calls = []

    def fetch(wanted):
        calls.append(wanted.count())
        return wanted.select("address", F.concat(F.lit("r:"), F.coalesce("q", F.lit("none"))).alias("result"))

    at = lambda t: F.lit(t).cast("timestamp")
    first, cache = state.cached(asked, ["q"], empty, "r1", at("2024-01-01 00:00:00"), 60, fetch)
    assert {(r.i, r.outcome, r.result) for r in first.collect()} == {(1, "MISS", "r:a"), (2, "MISS", "r:a"), (3, "MISS", "r:b"), (4, "MISS", "r:none")}
    for release, now, outcome, n in (("r1", "2024-01-01 00:01:00", "HIT", 0), ("r1", "2024-01-01 00:01:01", "STALE", 3), ("r2", "2024-01-01 00:00:30", "MISS", 3)):
        again, grown = state.cached(asked, ["q"], cache, release, at(now), 60, fetch)
        assert {r.outcome for r in again.collect()} == {outcome} and calls[-1] == n and grown.count() == (6 if release == "r2" else 3)

    edges = {"r": ["a", "b", "bad"], "a": ["c", "r"], "b": ["c"], "c": []}
    table = spark.createDataFrame(list(edges.items()), "node string, children array<string>")
    pages_ = lambda p: p.join(table, "node").select("node", (F.col("node") != "b").__or__(F.col("attempts") > 0).alias("ok"), "children")
    seeds = state.seeded(spark.createDataFrame([("r",), ("r",)], "node string"))
    whole = {tuple(r) for r in state.crawl(seeds, pages_).collect()}
    assert whole == {("r", 0, "done", 1), ("a", 1, "done", 1), ("b", 1, "done", 2), ("c", 2, "done", 1), ("bad", 1, "error", 3)}
    for stop in (1, 2, 3):
        assert {tuple(r) for r in state.crawl(state.crawl(seeds, pages_, steps=stop), pages_).collect()} == whole
    assert state.crawl(seeds.limit(0), pages_).count() == 0


def test_plan_inventory_meets_only_what_a_plan_names(spark):
    """Items, values and levels of odd shape; no plan's row holds all items or values of its table."""
    from pyspark.sql import functions as F

    from veristrata.operators import scope

    profiles = spark.createDataFrame(
        [("t", [(1, "a"), (1, "b"), (2, "c")], [("Y", 1995, 2001)], [(1, "A", [("x", ""), (None, "")]), (2, "B", [("y", "")])]), ("bare", None, None, None), ("flat", [(7, "q")], [("Y", 1, 9)], None)],
        "table_key string, items array<struct<itm_id:bigint,itm_nm:string>>, periods array<struct<freq:string,lo:int,hi:int>>, dimensions array<struct<level:int,obj_id:string,vals:array<struct<value_id:string,value_name:string>>>>",
    )
    rows = [
        ("sound", "t", 1, "Y", 1995, ["x", "y"], ""), ("twice", "t", 1, "Y", 1995, ["x", "y"], ""), ("swapped", "t", 2, "Y", 1995, ["y", "x"], "OBJ_LEVEL_VALUE"), ("short", "t", 2, "Y", 1995, ["x"], "OBJ_LEVEL_KEYS,OBJ_LEVEL_VALUE"),
        ("long", "t", 2, "Y", 1995, ["x", "y", "x"], "OBJ_LEVEL_KEYS,OBJ_LEVEL_VALUE"), ("null value", "t", 2, "Y", 1995, [None, "y"], "OBJ_LEVEL_VALUE"), ("no levels", "t", 2, "Y", 1995, None, ""), ("no item", "t", None, "Q", 1995, ["x", "y"], "ITEM_ID_OR_UNIT,PERIOD_RANGE"),
        ("bad", "t", 9, "Z", 1, ["x", "y"], "ITEM_ID_OR_UNIT,PERIOD_PARAMETER"), ("bare", "bare", 1, "Y", 1, [], "TABLE_ID_MISMATCH,ITEM_ID_OR_UNIT,PERIOD_RANGE"), ("null table", None, 1, "Y", 1, ["x"], "TABLE_ID_MISMATCH,ITEM_ID_OR_UNIT,PERIOD_RANGE,OBJ_LEVEL_KEYS,OBJ_LEVEL_VALUE"), ("flat", "flat", 7, "Y", 5, [], ""),
    ]
    plans = spark.createDataFrame([r[:6] for r in rows], "target_id string, table_key string, itm_id bigint, freq string, ord int, levels array<string>")
    out = scope.plan_inventory(plans, profiles)
    assert {r.target_id: ",".join(r.errors) for r in out.collect()} == {r[0]: r[6] for r in rows}
    assert "exists(items" not in out.select(F.col("errors"))._jdf.queryExecution().optimizedPlan().toString()


def test_findings_read_texts_once_in_even_tasks(spark):
    """Sentences are dealt over all cores and more as rows grow; specs are made of them once, not once for each use."""
    from veristrata.plans import findings
    from veristrata.sources.tables import spread

    folder = "/root/testdata/sf0.001"
    assert findings.sentences(spark, folder).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert spread(spark.range(1000), "id", rows=10).rdd.getNumPartitions() == 100
    plan = findings.same_series(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "c_custkey" in findings.range_specs(spark, folder)._jdf.queryExecution().optimizedPlan().toString() and "lag(" not in plan


def test_equal_texts_are_read_once_and_batches_in_slices():
    import pandas as pd

    from veristrata.operators import text

    asked = []
    assert text.each_once(lambda x, y: asked.append((x, y)) or (x, y), pd.Series(["a", None, "a", None], dtype=object), pd.Series([1, 2, 1, 2])) == [("a", 1), (None, 2), ("a", 1), (None, 2)]
    assert asked == [("a", 1), (None, 2)]
    whole = pd.Series([f"{i}." for i in range(text.SLICE * 2 + 3)])
    parts = list(text.in_slices(iter([whole, whole.iloc[:0]]), lambda rows: rows.map(text.split_sentences)))
    assert [len(p) for p in parts] == [text.SLICE, text.SLICE, 3] and [s[0]["text"] for p in parts for s in p] == list(whole)


def test_postings_move_texts_not_terms(spark):
    from veristrata.operators import retrieval

    docs = spark.createDataFrame([(1, "a b a", "x"), (1, "a", "x"), (None, "b", "y"), (3, None, None)], "id bigint, text string, source string")
    out = retrieval.postings(docs, "id", "text", ["source"])
    assert sorted(map(str, out.select("id", "source", "len", "term", "tf").collect())) == sorted(map(str, spark.createDataFrame([(1, "x", 3, "a", 2), (1, "x", 3, "b", 1), (1, "x", 1, "a", 1), (None, "y", 1, "b", 1)], "id bigint, source string, len int, term string, tf bigint").collect()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(id") == 1 and "hashpartitioning(id#" in plan and "term#" not in plan.split("Exchange hashpartitioning(", 1)[1].split(")", 1)[0]
