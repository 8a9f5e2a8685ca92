"""Queries about sources in files, state kept between runs, and single functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import legacy
from ..operators import binding, cells, pages, scope, state
from ..sources import tables
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
C = F.col
NOW = "2024-02-01 00:00:00"


def query(sql: str):
    """Register a function as a query under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


# ---- sources: tables written as files of a kind, and read by the scan of that kind
@query("SELECT CASE WHEN c_custkey % 17 <> 3 THEN c_custkey END AS c_custkey, CASE WHEN c_custkey % 17 <> 3 THEN c_name END AS c_name, c_custkey % 17 = 3 AS bad FROM customer WHERE c_custkey % 19 <> 5")
def src_jsonl(s: SparkSession, d: str) -> DataFrame:
    """Customers as JSON lines, some cut short, with blank lines between."""
    line = F.to_json(F.struct("c_custkey", "c_name"))
    path = tables.scratch(s)
    table(s, d, "customer").select(F.when(C("c_custkey") % 19 == 5, "").when(C("c_custkey") % 17 == 3, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    return tables.json_lines(s, path, "c_custkey bigint, c_name string", tolerant=True).select("c_custkey", "c_name", C("_corrupt_record").isNotNull().alias("bad"))


@query("""WITH a AS (SELECT CASE WHEN doc_id % 13 = 0 THEN doc_id + 1 ELSE doc_id END AS i, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE 't' END AS title, CASE WHEN doc_id % 7 = 0 THEN 'yesterday' ELSE concat('2024-0', doc_id % 9 + 1, '-05') END AS said, text FROM documents), n AS (SELECT *, count(*) OVER (PARTITION BY i) AS k FROM a)
SELECT i::VARCHAR AS article_idx, CASE WHEN said <> 'yesterday' THEN said END AS date, CASE WHEN title = ' ' OR trim(coalesce(text, '')) = '' THEN 'FIELD_MISSING' WHEN k > 1 THEN 'DUPLICATE_ID' WHEN said = 'yesterday' THEN 'DATE_INVALID' END AS error FROM n""")
def src_articles(s: SparkSession, d: str) -> DataFrame:
    """Documents as articles: every thirteenth takes its neighbour's id, some have no title, some no date that is one."""
    i = C("doc_id")
    out = table(s, d, "documents").select(
        F.when(i % 13 == 0, i + 1).otherwise(i).cast("string").alias("article_idx"), F.when(i % 11 == 0, " ").otherwise("t").alias("title"), C("text").alias("article_text"),
        F.when(i % 7 == 0, "yesterday").otherwise(F.concat(F.lit("2024-0"), (i % 9 + 1).cast("string"), F.lit("-05"))).alias("date"), F.lit("http://x").alias("source_url"),
    )
    path = tables.scratch(s)
    out.write.json(path)
    return tables.articles(s, path).select("article_idx", C("date").cast("string").alias("date"), "error")


def _parts_as_csv(s: SparkSession, d: str) -> DataFrame:
    path = tables.scratch(s)
    said = F.concat("p_name", F.lit(', "'), "p_type", F.lit('"\n'), "p_brand")
    table(s, d, "part").select(C("p_partkey").cast("string").alias("article_id"), said.alias("body")).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return tables.csv_corpus(s, path, "article_id string, body string")


@query("""SELECT p_partkey::VARCHAR AS article_id, concat(p_name, ', "', p_type, '"', chr(10), p_brand) AS body FROM part""")
def src_csv(s: SparkSession, d: str) -> DataFrame:
    """Parts as a CSV corpus of quoted texts with line ends, commas and quotes."""
    return _parts_as_csv(s, d)


@query("""SELECT p_partkey::VARCHAR AS article_id, concat(p_name, ', "', p_type, '"', chr(10), p_brand) AS body FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""")
def src_csv_lookup(s: SparkSession, d: str) -> DataFrame:
    """The rows of that corpus whose parts were ordered in large numbers."""
    keys = table(s, d, "lineitem").where("l_quantity > 45").select(C("l_partkey").cast("string").alias("article_id"))
    return tables.rows_for_keys(_parts_as_csv(s, d), keys, "article_id")


@query("SELECT o_orderkey, o_orderstatus AS snapshot_id FROM orders WHERE o_orderstatus = 'F'")
def src_pg_metadata(s: SparkSession, d: str) -> DataFrame:
    """One release of a table that is kept by release; the others are not read."""
    path = tables.scratch(s)
    tables.publish(table(s, d, "orders").select("o_orderkey", C("o_orderstatus").alias("snapshot_id")), path, ["snapshot_id"])
    return tables.snapshot(s.read.parquet(path), "F").select("o_orderkey", C("snapshot_id").cast("string").alias("snapshot_id"))


# ---- state between runs
@query(f"""WITH r AS (SELECT conv_id, turn, role, lower(trim(text)) AS q FROM conversations), k AS (SELECT role AS kr, q AS kq, min(conv_id) AS first FROM r GROUP BY 1, 2)
SELECT conv_id, turn, CASE first % 5 WHEN 0 THEN 'HIT' WHEN 1 THEN 'STALE' ELSE 'MISS' END AS outcome, CASE WHEN first % 5 = 0 THEN -1 ELSE length(coalesce(q, '')) END::BIGINT AS result FROM r JOIN k ON kr IS NOT DISTINCT FROM r.role AND kq IS NOT DISTINCT FROM r.q""")
def retrieval_cache(s: SparkSession, d: str) -> DataFrame:
    """What was said, as requests: of five addresses one is kept, one is too old, and one is kept for another release."""
    asked = table(s, d, "conversations").select("conv_id", "turn", "role", F.lower(F.trim("text")).alias("q"))
    first = asked.groupBy("role", "q").agg(F.min("conv_id").alias("first")).where("first % 5 < 3")
    old = F.when(C("first") % 5 == 1, F.lit("2024-01-01 00:00:00")).otherwise(F.lit("2024-01-31 12:00:00")).cast("timestamp")
    kept = first.select(state.address(["role", "q"]).alias("address"), F.when(C("first") % 5 == 2, "r0").otherwise("r1").alias("release"), F.lit(-1).cast("bigint").alias("result"), old.alias("fetched_at"))
    answers, _ = state.cached(asked, ["role", "q"], kept, "r1", F.lit(NOW).cast("timestamp"), 86400, lambda w: w.select("address", F.length(F.coalesce("q", F.lit(""))).cast("bigint").alias("result")))
    return answers.select("conv_id", "turn", "outcome", "result")


def _tree(s: SparkSession, d: str):
    """What a node of regions, nations and suppliers gives: every seventh nation never answers, every fifth answers at the second try."""
    up = table(s, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("node"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    down = table(s, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("node"), F.concat(F.lit("s"), "s_suppkey").alias("child"))
    below = up.unionByName(down).groupBy("node").agg(F.collect_list("child").alias("children"))
    number = F.when(C("node").startswith("n"), F.substring("node", 2, 9).cast("int"))
    ok = F.coalesce(number % 7 != 3, F.lit(True)) & (F.coalesce(number % 5 != 2, F.lit(True)) | (C("attempts") > 0))
    return lambda pending: pending.join(below, "node", "left").select("node", ok.alias("ok"), F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def _crawled(s: SparkSession, d: str) -> DataFrame:
    """A crawl that is stopped after two steps, written, read and gone on with."""
    fetch = _tree(s, d)
    seeds = table(s, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    path = tables.scratch(s)
    tables.publish(state.crawl(state.seeded(seeds), fetch, steps=2), path)
    return state.crawl(s.read.parquet(path), fetch)


_NODES = """t AS (SELECT 'r' || r_regionkey AS node, 0 AS depth, 'done' AS state, 1 AS attempts FROM region UNION ALL SELECT 'n' || n_nationkey, 1, CASE WHEN n_nationkey % 7 = 3 THEN 'error' ELSE 'done' END, CASE WHEN n_nationkey % 7 = 3 THEN 3 WHEN n_nationkey % 5 = 2 THEN 2 ELSE 1 END FROM nation
  UNION ALL SELECT 's' || s_suppkey, 2, 'done', 1 FROM supplier WHERE s_nationkey % 7 <> 3)"""


@query(f"WITH {_NODES} SELECT * FROM t")
def crawl_resumed(s: SparkSession, d: str) -> DataFrame:
    return _crawled(s, d)


@query(f"WITH {_NODES} SELECT state, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM t), 1) AS percent FROM t GROUP BY 1")
def crawl_progress(s: SparkSession, d: str) -> DataFrame:
    return state.progress(_crawled(s, d))


@query(f"""WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max((ts, event_id)) AS m FROM events GROUP BY 1)
SELECT 1 AS run, sha256(concat(user_id, '|', m[2], '|UNKNOWN')) AS transaction_id, user_id, 'UNKNOWN' AS state, m[2] AS closes FROM l WHERE state = 'click' AND epoch(TIMESTAMP '{NOW}') - floor(epoch(m[1])) > 86400""".replace("m[2]", "struct_extract(m, 2)").replace("m[1]", "struct_extract(m, 1)"))
def budget_recover(s: SparkSession, d: str) -> DataFrame:
    """Users whose last event is an open click that has run out: closed by the first run, after which the second and a repeated first have nothing to add."""
    log = table(s, d, "events").select("event_id", "user_id", C("event_type").alias("state"), "ts")
    now = F.lit(NOW).cast("timestamp")
    closing = lambda events: state.closing_events(events, "user_id", "event_id", "state", "ts", "click", now, 86400)
    first = closing(log)
    with_first = log.unionByName(first.select(F.lit(1 << 60).alias("event_id"), "user_id", "state", C("at").alias("ts")))
    second = closing(with_first)
    book = state.append_once(state.append_once(first.limit(0), first), first)
    again = state.append_once(book, second)
    return again.join(first.select("transaction_id", F.lit(1).alias("run")), "transaction_id", "left").select("run", "transaction_id", "user_id", "state", "closes")


# ---- single functions
@query("SELECT p_partkey, concat(CASE WHEN p_partkey % 2 = 0 THEN concat(p_name, '   ', p_size) ELSE concat(p_name, ' ', p_size) END, '|', p_name, ' ', p_size + 1, '|ㄱㄴㄷ') AS kept FROM part")
def near_dup_para(s: SparkSession, d: str) -> DataFrame:
    """Paragraphs told twice with other white space, with another number, and twice the same."""
    one, wide = F.concat_ws(" ", "p_name", C("p_size").cast("string")), F.concat(F.lit("  "), "p_name", F.lit("   "), C("p_size").cast("string"))
    paragraphs = F.array(one, F.when(C("p_partkey") % 2 == 0, wide).otherwise(" "), F.concat_ws(" ", "p_name", (C("p_size") + 1).cast("string")), F.lit("ㄱㄴㄷ"), F.lit("ㄱㄴㄷ "))
    return table(s, d, "part").select("p_partkey", F.array_join(pages.near_dup_paragraphs(paragraphs), "|").alias("kept"))


@query("SELECT p_partkey, concat(p_name, chr(10), chr(10), p_type) AS t FROM part")
def text_normalize(s: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("## "), "p_name", F.lit("  \r\n\r\n\r\n\r\n**"), "p_type", F.lit("** [사진: x]  \n---\n"))
    return table(s, d, "part").select("p_partkey", pages.normalize_text(said).alias("t"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE 'OTHER' END AS p FROM orders")
def relation_clamp(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", scope.clamp(C("o_orderpriority"), ["1-URGENT", "2-HIGH"], "OTHER").alias("p"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1) THEN 'time_ref' ELSE 'unknown' END AS s FROM part")
def verify_scope(s: SparkSession, d: str) -> DataFrame:
    unit = F.get(F.array(*map(F.lit, [" 개월", "년", "명", "", "년도"])), (C("p_partkey") % 5).cast("int"))
    return table(s, d, "part").select("p_partkey", scope.verify_scope(unit).alias("s"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 4 <> 0 THEN concat('o', s_nationkey, ':1.0') ELSE '' END AS candidates FROM supplier")
def org_candidates(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "supplier").select("s_suppkey", F.when(C("s_suppkey") % 3 == 0, "KOSIS등재").otherwise("민간기관").alias("scope"), F.when(C("s_suppkey") % 4 != 0, F.concat(F.lit("o"), "s_nationkey")).alias("org_id"))
    return scope.org_candidates(rows).select("s_suppkey", F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["org_id"], c["confidence"].cast("string"))), ",").alias("candidates"))


_SPANS = "SELECT l_orderkey, l_linenumber % 2 AS sentence, l_partkey % 40 AS a, l_partkey % 40 + CAST(l_quantity AS INT) % 7 + 1 AS b FROM lineitem"


@query(f"WITH s AS ({_SPANS}), x AS (SELECT *, row_number() OVER () AS row FROM s) SELECT l_orderkey, bool_or(EXISTS (SELECT 1 FROM x y WHERE y.l_orderkey = x.l_orderkey AND y.row <> x.row AND y.sentence = x.sentence AND y.a < x.b AND x.a < y.b)) AS overlap FROM x GROUP BY 1")
def span_overlap(s: SparkSession, d: str) -> DataFrame:
    table(s, d, "lineitem").createOrReplaceTempView("_spans_of_lineitem")
    x = s.sql(_SPANS.replace("FROM lineitem", "FROM _spans_of_lineitem"))
    spans = F.collect_list(F.struct("sentence", C("a").alias("start"), C("b").alias("end")))
    return x.groupBy("l_orderkey").agg(spans.alias("spans")).select("l_orderkey", F.coalesce(binding.span_overlap(C("spans")), F.lit(False)).alias("overlap"))


@query("SELECT o_orderkey, concat('101|DT_', o_orderpriority, '|T', o_custkey, '|M|', strftime(o_orderdate, '%Y%m'), '|', strftime(o_orderdate, '%Y%m'), '|objL1=', o_orderstatus, ',objL2=00') AS p FROM orders")
def query_plan(s: SparkSession, d: str) -> DataFrame:
    plan = binding.query_plan(F.lit("101"), F.concat(F.lit("DT_"), "o_orderpriority"), F.concat(F.lit("T"), "o_custkey"), F.lit("M"), F.date_format(C("o_orderdate").cast("timestamp"), "yyyyMM"), F.array(C("o_orderstatus"), F.lit("00")))
    rows = table(s, d, "orders").select("o_orderkey", plan.alias("p"))
    levels = F.array_join(F.transform(F.array_sort(F.map_entries("p.obj_levels")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return rows.select("o_orderkey", F.concat_ws("|", "p.org_id", "p.tbl_id", "p.itm_id", "p.prd_se", "p.start_prd_de", "p.end_prd_de", levels).alias("p"))


@query("SELECT event_id, CASE WHEN value > 0 AND event_id % 9 > 0 THEN round(pow((event_id % 9) / 10.0, 0.6) * pow(20.0 / value, 0.2) * pow(100.0 / (user_id + 1), 0.2), 6) END AS score FROM events")
def rlt_score(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.round(legacy.rlt_score(C("event_id") % 9 / 10, C("value"), C("user_id") + 1, 20.0, 100.0), 6).alias("score"))


@query("SELECT o_orderkey, array_to_string(list_transform(range(o_custkey % 6), lambda k: concat(year(o_orderdate) - (o_custkey % 6 - 1) + k, strftime(o_orderdate, '-%m'))), ',') AS months FROM orders")
def same_month_series(s: SparkSession, d: str) -> DataFrame:
    """The month of every order and the same month of up to four years before; of every sixth customer none, as the first lies behind the last."""
    last = F.trunc(C("o_orderdate").cast("date"), "month")
    series = cells.month_periods(F.add_months(last, (F.lit(-12) * (C("o_custkey") % 6 - 1)).cast("int")), last, 12)
    return table(s, d, "orders").select("o_orderkey", F.array_join(F.transform(series, lambda m: F.date_format(m, "yyyy-MM")), ",").alias("months"))
