"""Queries about binding, catalogues, validation and the layers' joins, over whole tables, with faults made from table values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import catalog, context, matching, retrieval, text, validation
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
C = F.col


def query(sql: str):
    """Register a function as a query under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


# ---- binding: suppliers claim things of the brand of their number; parts are its items, types an axis, sizes another
ALIASES = [("widget", "gadget")]


def claims(s: SparkSession, d: str) -> DataFrame:
    """One claim a part: its name (every third with an alias), with its type in front for even sizes."""
    p = table(s, d, "part")
    name = F.when(C("p_partkey") % 3 == 0, F.replace("p_name", F.lit("widget"), F.lit("gadget"))).otherwise(C("p_name"))
    said = F.concat_ws(" ", F.when(C("p_size") % 2 == 0, C("p_type")), F.upper(name))
    return p.select(
        C("p_partkey").alias("target_id"), C("p_brand").alias("table_key"), said.alias("indicator"), F.when(C("p_size") % 5 == 0, "명").otherwise("").alias("unit"),
        F.when(C("p_size") % 7 == 0, C("p_type")).otherwise("").alias("region"), F.lit("").alias("population"),
    )


def candidates(s: SparkSession, d: str) -> DataFrame:
    return claims(s, d).select("target_id", "table_key", F.lit(1).alias("rank"))


def items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").groupBy(C("p_brand").alias("table_key"), C("p_name").alias("itm_nm")).agg(F.min("p_partkey").alias("itm_id")).select("table_key", "itm_id", "itm_nm", F.when(C("itm_id") % 4 == 0, "명").otherwise("").alias("unit"))


def values(s: SparkSession, d: str) -> DataFrame:
    """Two axes of every brand: its types, and one with the whole country and brands of provinces."""
    p = table(s, d, "part")
    types = p.select(C("p_brand").alias("table_key"), F.lit("T").alias("obj_id"), F.lit("종류").alias("obj_nm"), F.lit(1).alias("level"), C("p_type").alias("value_id"), C("p_type").alias("value_name"), F.lit("").alias("value_unit")).distinct()
    regions = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in (("0", "전국"), ("1", "부산"))]))
    geo = p.select(C("p_brand").alias("table_key")).distinct().select("table_key", F.lit("G").alias("obj_id"), F.lit("행정구역별").alias("obj_nm"), F.lit(2).alias("level"), regions.alias("r"))
    return types.unionByName(geo.select("table_key", "obj_id", "obj_nm", "level", C("r.i").alias("value_id"), C("r.n").alias("value_name"), F.lit("").alias("value_unit")))


_LOOSE = r"lower(regexp_replace({}, '[\s\-_./:(),]+', '', 'g'))"
_CLAIMS = f"""c AS (SELECT p_partkey AS target_id, p_brand AS table_key, p_type, p_size, concat(CASE WHEN p_size % 2 = 0 THEN concat(p_type, ' ') ELSE '' END, upper(CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, 'widget', 'gadget') ELSE p_name END)) AS indicator,
  CASE WHEN p_size % 5 = 0 THEN '명' ELSE '' END AS unit FROM part), cl AS (SELECT *, {_LOOSE.format('indicator')} AS surface FROM c),
i AS (SELECT p_brand AS table_key, p_name AS itm_nm, min(p_partkey) AS itm_id, CASE WHEN min(p_partkey) % 4 = 0 THEN '명' ELSE '' END AS item_unit, {_LOOSE.format('p_name')} AS l FROM part GROUP BY 1, 2),
ih AS (SELECT target_id, cl.table_key, itm_id, item_unit, CASE WHEN contains(surface, l) THEN 'EXACT_LABEL' ELSE 'SEMANTIC_ALIAS' END AS rule, CASE WHEN contains(surface, l) THEN l ELSE replace(l, 'widget', 'gadget') END AS said, surface
  FROM cl JOIN i ON i.table_key = cl.table_key AND (contains(surface, l) OR (contains(l, 'widget') AND contains(surface, replace(l, 'widget', 'gadget'))))),
iall AS (SELECT target_id, table_key, itm_id, item_unit, rule, (strpos(surface, said) - 1)::INTEGER AS start, length(said)::INTEGER AS size FROM ih
  UNION ALL SELECT target_id, cl.table_key, CASE WHEN n = 1 THEN lone END, CASE WHEN n = 1 THEN u END, CASE WHEN n = 1 THEN 'SINGLETON_INVENTORY' ELSE 'NO_SUBSPAN_MATCH' END, NULL, NULL
  FROM cl JOIN (SELECT table_key, count(*) AS n, min(itm_id) AS lone, min(item_unit) AS u FROM i GROUP BY 1) k ON k.table_key = cl.table_key WHERE target_id NOT IN (SELECT target_id FROM ih)),
v AS (SELECT DISTINCT p_brand AS table_key, p_type AS value_id, lower(p_type) AS l FROM part),
dt AS (SELECT target_id, cl.table_key, value_id, CASE WHEN p_size % 7 = 0 AND cl.p_type = value_id THEN 'REGION' ELSE 'EXACT_LABEL' END AS rule, (strpos(surface, l) - 1)::INTEGER AS start, length(l)::INTEGER AS size, contains(surface, l) AS spoken
  FROM cl JOIN v ON v.table_key = cl.table_key WHERE contains(surface, l) OR (p_size % 7 = 0 AND cl.p_type = value_id)),
dk AS (SELECT * FROM dt WHERE rule = 'REGION' OR NOT EXISTS (SELECT 1 FROM dt o WHERE o.target_id = dt.target_id AND o.rule <> 'REGION' AND o.start <= dt.start AND o.start + o.size >= dt.start + dt.size AND o.size > dt.size)),
d AS (SELECT target_id, table_key, 'T' AS obj_id, 1 AS level, value_id, rule, CASE WHEN spoken THEN start END AS start, CASE WHEN spoken THEN size END AS size FROM dk
  UNION ALL SELECT target_id, table_key, 'T', 1, NULL, 'UNBOUND', NULL, NULL FROM cl WHERE target_id NOT IN (SELECT target_id FROM dk)
  UNION ALL SELECT target_id, table_key, 'G', 2, CASE WHEN p_size % 7 <> 0 THEN '0' END, CASE WHEN p_size % 7 <> 0 THEN 'DISCLOSED_NATIONWIDE_DEFAULT' ELSE 'UNBOUND' END, NULL, NULL FROM cl)
"""
_ASSIGNED = _CLAIMS + """, t AS (SELECT target_id, value_id, max(CASE WHEN rule <> 'REGION' THEN start END) AS a, max(CASE WHEN rule <> 'REGION' THEN size END) AS n FROM d WHERE obj_id = 'T' GROUP BY 1, 2),
x AS (SELECT iall.target_id, iall.table_key, itm_id, t.value_id AS tv, g.value_id AS gv, item_unit, c.unit, CASE WHEN itm_id IS NULL THEN 'ITEM_MISSING' WHEN t.value_id IS NULL OR g.value_id IS NULL THEN 'DIMENSION_MISSING'
  WHEN c.unit <> '' AND item_unit <> '' AND c.unit <> item_unit THEN 'UNIT_MISMATCH' WHEN start < a + n AND a < start + size THEN 'SPAN_REUSE' END AS reason
  FROM iall JOIN t USING (target_id) JOIN (SELECT target_id, value_id FROM d WHERE obj_id = 'G') g USING (target_id) JOIN c ON c.target_id = iall.target_id)
"""


@query("WITH " + _CLAIMS + "SELECT * FROM iall")
def item_match(s: SparkSession, d: str) -> DataFrame:
    return matching.item_match(claims(s, d), candidates(s, d), items(s, d), ALIASES)


@query("WITH " + _CLAIMS + "SELECT rule, count(*) AS n FROM iall GROUP BY 1")
def alias_match(s: SparkSession, d: str) -> DataFrame:
    """How items are found: by label, by alias, as the only one, or not."""
    return item_match(s, d).groupBy("rule").agg(F.count("*").alias("n"))


@query("WITH " + _CLAIMS + "SELECT * FROM d")
def dim_match(s: SparkSession, d: str) -> DataFrame:
    return matching.dim_match(claims(s, d), candidates(s, d), values(s, d), ALIASES).drop("value_unit")


@query("WITH " + _CLAIMS + "SELECT target_id, value_id, rule FROM d WHERE obj_id = 'G'")
def nationwide_default(s: SparkSession, d: str) -> DataFrame:
    return matching.dim_match(claims(s, d), candidates(s, d), values(s, d), ALIASES).where("obj_id = 'G'").select("target_id", "value_id", "rule")


def assigned(s: SparkSession, d: str) -> DataFrame:
    c, k = claims(s, d), candidates(s, d)
    return matching.assignment_product(c, matching.item_match(c, k, items(s, d), ALIASES), matching.dim_match(c, k, values(s, d), ALIASES))


@query("WITH " + _ASSIGNED + "SELECT target_id, itm_id, concat(coalesce(tv, '-'), ',', coalesce(gv, '-')) AS vals, reason, CASE WHEN reason IS NULL THEN concat(table_key, '|', itm_id, '|', tv, ',', gv) END AS signature FROM x")
def assignment_product(s: SparkSession, d: str) -> DataFrame:
    out = assigned(s, d)
    return out.select("target_id", "itm_id", F.array_join(F.transform("value_ids", lambda v: F.coalesce(v, F.lit("-"))), ",").alias("vals"), "reason", "signature")


@query("WITH " + _ASSIGNED + "SELECT target_id, count(DISTINCT CASE WHEN reason IS NULL THEN concat(itm_id, tv, gv) END) AS n FROM x WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.target_id = x.target_id AND o.p_size % 3 = 1) GROUP BY 1")
def resolve_top50(s: SparkSession, d: str) -> DataFrame:
    """Answers of the first 50 candidates: of sizes 1 modulo 3 the only candidate comes later."""
    ranked = claims(s, d).join(table(s, d, "part").select(C("p_partkey").alias("target_id"), "p_size"), "target_id").select("target_id", "table_key", F.when(C("p_size") % 3 == 1, 51).otherwise(50).alias("rank"), F.lit(False).alias("titled"))
    return matching.resolve_top(assigned(s, d), ranked, 50, "titled").groupBy("target_id").agg(F.count_distinct("signature").alias("n"))


@query("WITH " + _ASSIGNED + """, n AS (SELECT target_id, count(DISTINCT CASE WHEN reason IS NULL THEN concat(itm_id, '|', tv, '|', gv) END) AS n FROM x GROUP BY 1)
SELECT c.target_id, CASE WHEN p_size % 11 <> 0 AND n = 1 THEN 'QUERY_READY' ELSE 'HOLD' END AS status, CASE WHEN p_size % 11 = 0 THEN 'PROFILE_COVERAGE_INCOMPLETE' WHEN n > 1 THEN 'MULTIPLE_COMPATIBLE_SERIES' WHEN n = 0 THEN 'NO_COMPATIBLE_SERIES' END AS reason, sha256(table_key) AS receipt FROM c JOIN n USING (target_id)""")
def resolve_monthly(s: SparkSession, d: str) -> DataFrame:
    """Held as a whole where a profile is incomplete (every eleventh size)."""
    profiles = table(s, d, "part").select(C("p_partkey").alias("target_id"), C("p_brand").alias("table_key"), F.when(C("p_size") % 11 == 0, "PARTIAL").otherwise("COMPLETE").alias("status"))
    return matching.resolve_monthly(assigned(s, d), profiles).select("target_id", "status", "reason", "receipt")


@query("WITH " + _CLAIMS + """, k AS (SELECT target_id, table_key, obj_id, count(DISTINCT value_id) AS n FROM d GROUP BY 1, 2, 3), o AS (SELECT table_key, 'T' AS obj_id, list_sort(list(value_id)) AS os FROM v GROUP BY 1 UNION ALL SELECT DISTINCT table_key, 'G', ['부산', '전국'] FROM v)
SELECT target_id, obj_id, CASE WHEN n = 1 THEN 'RESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'MISSING' END AS status, CASE WHEN n = 1 THEN '' ELSE array_to_string(os, ',') END AS options FROM k JOIN o USING (table_key, obj_id)""")
def slot_diagnostics(s: SparkSession, d: str) -> DataFrame:
    hits = matching.dim_match(claims(s, d), candidates(s, d), values(s, d), ALIASES)
    return matching.slot_diagnostics(hits, values(s, d)).select("target_id", "obj_id", "status", F.array_join("options", ",").alias("options"))


@query("""WITH a AS (SELECT p_brand AS target_id, count(DISTINCT p_type) AS nt, count(DISTINCT p_size) AS ns FROM part GROUP BY 1)
SELECT target_id, CASE WHEN ns > 1 THEN 'a_size' WHEN nt > 1 THEN 'b_type' ELSE 'G' END AS role, CASE WHEN ns > 20 THEN 'SEARCHABLE' ELSE 'LIST' END AS kind, (CASE WHEN ns > 1 THEN ns WHEN nt > 1 THEN nt ELSE 2 END)::INTEGER AS n FROM a""")
def multi_question(s: SparkSession, d: str) -> DataFrame:
    """Brands with many answers: by size, else by type, else by the open slot."""
    p = table(s, d, "part")
    labels = p.select(C("p_brand").alias("target_id"), F.lit("b_type").alias("role"), C("p_type").alias("label")).unionByName(p.select("p_brand", F.lit("a_size"), C("p_size").cast("string")).toDF("target_id", "role", "label"))
    brands = p.select(C("p_brand").alias("target_id")).distinct()
    slots = brands.select("target_id", F.lit("G").alias("obj_id"), F.lit("MISSING").alias("status"), F.array(F.lit("x"), F.lit("y")).alias("options"))
    return matching.multi_question(labels, slots, brands).select("target_id", "role", "kind", F.size("options").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '명' WHEN p_size % 3 = 1 AND p_partkey % 2 = 0 THEN '원' ELSE 'kg' END AS unit FROM part")
def official_unit(s: SparkSession, d: str) -> DataFrame:
    of_values = F.when(C("p_size") % 3 == 0, F.array(F.lit("명"), F.lit(""), F.lit(" 명"))).when(C("p_size") % 3 == 1, F.array(F.lit("원"), F.when(C("p_partkey") % 2 == 0, "원").otherwise("명"))).otherwise(F.array().cast("array<string>"))
    return table(s, d, "part").select("p_partkey", matching.official_unit(F.lit(" kg"), of_values).alias("unit"))


@query("SELECT o_orderkey, o_orderkey % 5 <> 0 AS identical, o_orderkey % 3 <> 0 AS moved FROM orders")
def period_only_identity(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.year("o_orderdate").alias("y"))
    other = o.withColumn("o_custkey", C("o_custkey") + F.when(C("o_orderkey") % 5 == 0, 1).otherwise(0)).withColumn("y", C("y") - F.when(C("o_orderkey") % 3 == 0, 0).otherwise(1))
    return matching.period_only_identity(o, other, "o_orderkey", ["o_custkey", "o_orderpriority"], ["y"])


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(year(o_orderdate) - 1 AS VARCHAR) END AS period,
  CASE WHEN o_custkey % 4 = 0 THEN 'BASELINE_NOT_ANNUAL' WHEN o_custkey % 3 = 0 THEN 'BASELINE_NOT_EARLIER' END AS error FROM orders""")
def baseline_plan(s: SparkSession, d: str) -> DataFrame:
    y = F.year("o_orderdate")
    plans = table(s, d, "orders").select("o_orderkey", "o_custkey", F.when(C("o_custkey") % 4 == 0, "M").otherwise("Y").alias("freq"), y.cast("string").alias("period"), (y - F.when(C("o_custkey") % 3 == 0, 0).otherwise(1)).alias("b"))
    return matching.baseline_plan(plans, C("b")).select("o_orderkey", "period", "error")


@query("""SELECT o_custkey AS article, year(o_orderdate)::INTEGER AS sentence, o_orderpriority AS family, o_orderstatus AS period, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS members FROM orders GROUP BY 1, 2, 3, 4""")
def family_groups(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(C("o_custkey").alias("article"), F.year("o_orderdate").alias("sentence"), C("o_orderstatus").alias("period"), C("o_orderkey").alias("target_id"), "o_orderpriority")
    return matching.family_groups(o, C("o_orderpriority")).select("article", "sentence", "family", "period", "n", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


@query("SELECT count(*) AS requests, count(DISTINCT (o_custkey, o_orderpriority)) AS fetched, count(*) - count(DISTINCT (o_custkey, o_orderpriority)) AS hits FROM orders")
def cell_memo(s: SparkSession, d: str) -> DataFrame:
    asked = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return matching.cell_memo(asked, ["o_custkey", "o_orderpriority"], lambda plans: plans.withColumn("cell", F.xxhash64("o_custkey")))[1]


# ---- retrieval
@query("""WITH h AS (SELECT o_custkey AS query_id, CASE WHEN o_orderkey % 2 = 0 THEN 'bm25' WHEN o_custkey % 13 = 0 THEN 'other' ELSE 'dense' END AS channel, concat('k', o_orderkey % 50) AS table_key, CASE WHEN o_custkey % 11 = 0 AND o_orderkey % 3 = 0 THEN 'r2' ELSE 'r1' END AS release_id, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) AS rank, CASE WHEN o_orderkey % 7 = 0 THEN 'gte' ELSE 'eq' END AS relation FROM orders),
bad AS (SELECT query_id FROM h WHERE channel = 'other' OR release_id <> 'r1' UNION SELECT query_id FROM (SELECT query_id FROM h GROUP BY query_id, channel, table_key HAVING count(*) > 1) UNION SELECT query_id FROM (SELECT query_id FROM h GROUP BY query_id, channel HAVING count(*) > 20)),
f AS (SELECT query_id, table_key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf_score, min(rank)::INTEGER AS best_rank FROM h WHERE query_id NOT IN (SELECT query_id FROM bad) GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, best_rank, table_key)::INTEGER AS fused_rank FROM f) JOIN (SELECT query_id, max(relation) AS total_relation FROM h GROUP BY 1) USING (query_id) WHERE fused_rank <= 20""")
def hybrid_rrf(s: SparkSession, d: str) -> DataFrame:
    """Orders as hits of their customers' queries; some have a foreign channel, release, or a key twice."""
    o = table(s, d, "orders")
    rank = F.row_number().over(Window.partitionBy("o_custkey", C("o_orderkey") % 2).orderBy("o_orderkey"))
    hits = o.select(
        C("o_custkey").alias("query_id"), F.when(C("o_orderkey") % 2 == 0, "bm25").when(C("o_custkey") % 13 == 0, "other").otherwise("dense").alias("channel"), F.concat(F.lit("k"), (C("o_orderkey") % 50).cast("string")).alias("table_key"),
        F.when((C("o_custkey") % 11 == 0) & (C("o_orderkey") % 3 == 0), "r2").otherwise("r1").alias("release_id"), rank.alias("rank"), F.when(C("o_orderkey") % 7 == 0, "gte").otherwise("eq").alias("relation"),
    )
    return retrieval.hybrid_rrf(hits, "r1", 20)[0]


@query("WITH f AS (SELECT o_custkey::VARCHAR AS target_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders) SELECT * FROM f WHERE rank <= 5")
def rrf_only(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    fused = o.select(C("o_custkey").cast("string").alias("target_id"), C("o_orderkey").alias("k"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("fused_rank"))
    return retrieval.rrf_only(fused, "k", 5)


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(1 / (1 + exp(-(l_quantity - 25) / 5)), 9) AS p FROM lineitem")
def sigmoid(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(retrieval.sigmoid((C("l_quantity") - 25) / 5), 9).alias("p"))


def _terms():
    return F.array(F.struct(F.lit("Agency!").alias("role"), C("p_brand").alias("text")), F.struct(F.lit("agency_").alias("role"), F.concat(F.lit(" "), C("p_brand"), F.lit("  ")).alias("text")), F.struct(F.lit("report").alias("role"), F.when(C("p_size") % 2 == 0, C("p_name")).otherwise(" ").alias("text")))


@query("")
def context_register(s: SparkSession, d: str) -> DataFrame:
    """Two terms that are one after cleaning, and one that is blank for odd sizes."""
    return retrieval.extra_register(table(s, d, "part").select(C("p_partkey").alias("target_id"), _terms().alias("terms")), "terms", "source").select("target_id", "role", "channel", "query")


@query("")
def corrective_register(s: SparkSession, d: str) -> DataFrame:
    return retrieval.extra_register(table(s, d, "part").select(C("p_partkey").alias("target_id"), _terms().alias("terms")), "terms", "corrective").select("target_id", "role", "channel", "query")


SQL["context_register"] = "WITH t AS (SELECT p_partkey AS target_id, p_brand AS query, 'source_agency' AS role FROM part UNION ALL SELECT p_partkey, p_name, 'source_report' FROM part WHERE p_size % 2 = 0), c(channel) AS (VALUES ('official'), ('bm25')) SELECT target_id, role, channel, query FROM t, c"
SQL["corrective_register"] = "WITH t AS (SELECT p_partkey AS target_id, p_brand AS query, 'agency' AS role FROM part UNION ALL SELECT p_partkey, p_name, 'report' FROM part WHERE p_size % 2 = 0), c(channel) AS (VALUES ('official'), ('bm25'), ('dense')) SELECT target_id, role, channel, query FROM t, c"


# ---- layers
@query("""WITH s AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n, min(l_linenumber) AS a FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l_orderkey AS article, CASE WHEN n = 1 THEN 'EXACT' ELSE 'AMBIGUOUS' END AS status, CASE WHEN n = 1 THEN concat('r', a) END AS surface FROM s""")
def region_evidence(s: SparkSession, d: str) -> DataFrame:
    """Returned lines as region spans of their order, by line number."""
    spans = table(s, d, "lineitem").where("l_returnflag = 'R'").select(C("l_orderkey").alias("article"), C("l_linenumber").alias("start"), (C("l_linenumber") + 1).alias("end"), F.concat(F.lit("r"), C("l_linenumber").cast("string")).alias("text"))
    return context.region_evidence(spans, ["article"]).select("article", "status", "surface")


@query("""WITH v AS (SELECT o_custkey AS g, o_orderkey AS vid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, count(*) OVER (PARTITION BY o_custkey) AS nv FROM orders),
s AS (SELECT o_custkey AS g, list(o_orderpriority ORDER BY o_orderkey) AS ls, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 3 <> 0 GROUP BY 1)
SELECT v.g, vid, CASE WHEN n IS NULL THEN NULL WHEN n = 1 THEN ls[1] ELSE ls[least(place, n - 1) + 1] END AS label, CASE WHEN n IS NULL THEN 'NONE' WHEN n = 1 THEN 'NEAREST' WHEN n = nv THEN 'POSITIONAL' ELSE 'COUNT_MISMATCH_FALLBACK' END AS pairing FROM v LEFT JOIN s ON s.g = v.g""")
def local_indicator(s: SparkSession, d: str) -> DataFrame:
    """Orders as values of their customers, those neither pending nor of every third key as scopes, all at one distance: a lone scope is nearest, else places decide."""
    o = table(s, d, "orders")
    v = o.select(C("o_custkey").alias("g"), C("o_orderkey").alias("vid"), C("o_orderkey").alias("a"), C("o_orderkey").alias("b"))
    scopes = o.select(C("o_custkey").alias("g"), (C("o_orderkey") + 10_000_000).alias("sa"), (C("o_orderkey") + 10_000_001).alias("sb"), F.when((C("o_orderstatus") != "P") & (C("o_orderkey") % 3 != 0), C("o_orderpriority")).otherwise("").alias("label"))
    return _local(context, v, scopes)


def _local(ops, v: DataFrame, scopes: DataFrame) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("g").orderBy("sa"))
    flat = scopes.where("label <> ''").withColumn("o", order).select("g", (C("o") / 1_000_000 + 5).alias("sa"), F.lit(6.0).alias("sb"), "label")
    at = v.withColumn("o", F.row_number().over(Window.partitionBy("g").orderBy("vid")))
    return ops.local_indicator(at.select("g", "vid", F.lit(7.0).alias("a"), F.lit(8.0).alias("b")), flat, ["g"])


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN '' ELSE 'x' END AS i, l_returnflag AS src, CASE WHEN l_linestatus = 'O' THEN '' ELSE l_linestatus END AS st, CASE WHEN l_partkey % 2 = 0 THEN 'p' ELSE '' END AS p FROM lineitem)
SELECT 'values' AS what, '' AS name, count(*) AS n FROM r UNION ALL SELECT 'with_indicator', '', count(*) FROM r WHERE i <> '' UNION ALL SELECT 'with_source_subtype', '', count(*) FROM r WHERE st <> '' UNION ALL SELECT 'with_period', '', count(*) FROM r WHERE p <> ''
UNION ALL SELECT 'indicator_source', src, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'source_subtype', CASE WHEN st = '' THEN '(없음)' ELSE st END, count(*) FROM r GROUP BY 2""")
def assignment_summary(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select(F.when(C("l_returnflag") == "R", "").otherwise("x").alias("indicator"), C("l_returnflag").alias("indicator_source"), F.when(C("l_linestatus") == "O", "").otherwise(C("l_linestatus")).alias("source_subtype"), F.when(C("l_partkey") % 2 == 0, "p").alias("period_raw"))
    return context.assignment_summary(rows)


@query("""WITH r AS (SELECT conv_id AS article, turn AS sid, CASE WHEN turn % 3 = 0 THEN concat('20', 10 + conv_id % 9, '년') ELSE '' END AS raw, turn % 5 = 4 AS blocked FROM conversations), g AS (SELECT article, sid + 1 AS sid, count(DISTINCT raw) AS n, min(raw) AS raw FROM r WHERE raw <> '' GROUP BY 1, 2)
SELECT r.article, r.sid, CASE WHEN r.raw <> '' THEN r.raw WHEN NOT blocked AND n = 1 THEN g.raw END AS period, CASE WHEN r.raw <> '' THEN 'OWN' WHEN NOT blocked AND n = 1 THEN 'INHERITED_ARTICLE_SCOPE' ELSE 'NONE' END AS period_from FROM r LEFT JOIN g USING (article, sid)""")
def article_period(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "conversations").select(C("conv_id").alias("article"), C("turn").alias("sid"), F.when(C("turn") % 3 == 0, F.concat(F.lit("20"), (10 + C("conv_id") % 9).cast("string"), F.lit("년"))).alias("period_raw"))
    return context.article_period(rows, F.lit(True), C("sid") % 5 == 4).select("article", "sid", "period", "period_from")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN concat(p_size, ';', p_size + 1) ELSE concat(p_size) END AS value_list, CASE WHEN p_size % 2 = 0 THEN '%;%' ELSE '명' END AS unit_list, CASE WHEN p_size % 2 = 0 THEN '지난해' ELSE '올해' END AS time_ref,
  CASE WHEN p_size % 2 = 0 THEN '전년' END AS time_compare, CASE WHEN p_size % 2 = 0 THEN '한국은행' END AS source_org, CASE WHEN p_size % 2 = 0 THEN '고용률' ELSE '취업자 수' END AS indicator, CASE WHEN p_size % 2 = 0 THEN '비교' ELSE '단순수치' END AS change FROM part WHERE p_size % 5 <> 0""")
def sentence_extract(s: SparkSession, d: str) -> DataFrame:
    """Sentences made of sizes: two rates, a count, or no value at all."""
    said = F.when(C("p_size") % 5 == 0, "값이 없다").when(C("p_size") % 2 == 0, F.format_string("한국은행에 따르면 지난해 고용률은 %d%%, 전년보다 %d%%", C("p_size"), C("p_size") + 1)).otherwise(F.format_string("올해 취업자 수 %d명", C("p_size")))
    out = text.sentence_extract(table(s, d, "part").select("p_partkey", said.alias("s")), "s")
    return out.select("p_partkey", "value_list", "unit_list", "time_ref", "time_compare", "source_org", C("context.indicator").alias("indicator"), "change")


# ---- catalogue
def itm_rows(s: SparkSession, d: str) -> DataFrame:
    """Parts as metadata rows of brands: every part an item and a value of its type's axis; some ids are blank."""
    p = table(s, d, "part")
    unit = F.when(C("p_size") % 3 == 0, "명").when(C("p_size") % 3 == 1, "원")
    item = p.select(C("p_brand").alias("table_key"), F.lit("ITEM").alias("OBJ_ID"), F.lit(None).cast("string").alias("OBJ_NM"), F.lit(None).cast("int").alias("OBJ_ID_SN"), F.when(C("p_size") % 10 == 0, "").otherwise(C("p_partkey").cast("string")).alias("ITM_ID"), C("p_name").alias("ITM_NM"), unit.alias("UNIT_NM"))
    value = p.select(C("p_brand").alias("table_key"), C("p_type").alias("OBJ_ID"), F.lower("p_type").alias("OBJ_NM"), (100 - F.length("p_type")).alias("OBJ_ID_SN"), C("p_partkey").cast("string").alias("ITM_ID"), C("p_name").alias("ITM_NM"), F.lit(None).cast("string").alias("UNIT_NM"))
    return item.unionByName(value)


@query("SELECT 'item' AS kind, p_brand AS table_key, count(*) AS n FROM part WHERE p_size % 10 <> 0 GROUP BY 2 UNION ALL SELECT 'value', p_brand, count(*) FROM part GROUP BY 2")
def split_itm(s: SparkSession, d: str) -> DataFrame:
    i, v = catalog.split_itm(itm_rows(s, d))
    count = lambda df, kind: df.groupBy("table_key").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "table_key", "n")
    return count(i, "item").unionByName(count(v, "value"))


@query("""WITH a AS (SELECT DISTINCT p_brand AS table_key, p_type AS obj_id FROM part) SELECT table_key, obj_id, row_number() OVER (PARTITION BY table_key ORDER BY length(obj_id) DESC, obj_id)::INTEGER AS level FROM a""")
def profile_from_api(s: SparkSession, d: str) -> DataFrame:
    return catalog.profile_from_api(catalog.split_itm(itm_rows(s, d))[1]).select("table_key", "obj_id", "level").distinct()


@query("""WITH p AS (SELECT *, p_brand AS k FROM part), i AS (SELECT k, list_sort(list(DISTINCT CASE p_size % 3 WHEN 0 THEN '명' WHEN 1 THEN '원' END)) AS us, count(*) AS n FROM p WHERE p_size % 10 <> 0 GROUP BY 1), y AS (SELECT k, max(CASE WHEN p_size % 4 = 0 THEN 2000 + p_size END) AS y FROM p GROUP BY 1), b AS (SELECT DISTINCT k FROM p)
SELECT b.k AS table_key, array_to_string(list_filter(coalesce(us, []), lambda x: x IS NOT NULL), ',') AS units, CAST(y AS VARCHAR) AS latest_period, concat(CASE WHEN n IS NULL THEN 'items' ELSE '' END, CASE WHEN n IS NULL AND y IS NULL THEN ',' ELSE '' END, CASE WHEN y IS NULL THEN 'periods' ELSE '' END) AS missing,
  CASE WHEN n IS NOT NULL AND y IS NOT NULL AND b.k NOT LIKE '%1' THEN 'enriched' ELSE 'partial' END AS meta_status FROM b LEFT JOIN i USING (k) LEFT JOIN y USING (k)""")
def catalog_record(s: SparkSession, d: str) -> DataFrame:
    """Brands as tables; those whose name ends in 1 lack an endpoint."""
    i, v = catalog.split_itm(itm_rows(s, d))
    p = table(s, d, "part")
    seeds = p.select(C("p_brand").alias("table_key"), C("p_brand").alias("tbl_name")).distinct()
    periods = p.where("p_size % 4 = 0").select(C("p_brand").alias("table_key"), F.lit("Y").alias("PRD_SE"), (2000 + C("p_size")).cast("string").alias("END_PRD_DE"))
    statuses = seeds.select("table_key", F.explode(F.array(*map(F.lit, catalog.ENDPOINTS))).alias("endpoint")).withColumn("status", F.when(C("table_key").endswith("1") & (C("endpoint") == "NCD"), "ERROR").otherwise("OK"))
    out = catalog.catalog_record(seeds, i, v, periods, statuses)
    return out.select("table_key", F.array_join("units", ",").alias("units"), "latest_period", F.array_join("missing", ",").alias("missing"), "meta_status")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN concat(p_brand, ' > ', p_type) WHEN 1 THEN p_type ELSE '' END AS path FROM part")
def category_path(s: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    primary = F.when(C("p_size") % 3 == 0, F.array("p_brand", "p_type")).otherwise(none)
    paths = F.when(C("p_size") % 3 == 1, F.array(none, F.array("p_type")))
    return table(s, d, "part").select("p_partkey", catalog.category_path(primary, paths).alias("path"))


@query("SELECT o_custkey, count(*) AS row_count, max(strftime(o_orderdate, '%Y%m%d')) AS latest, sha256(string_agg(strftime(o_orderdate, '%Y%m%d'), chr(10) ORDER BY strftime(o_orderdate, '%Y%m%d'))) AS sha FROM orders GROUP BY 1")
def ncd_summary(s: SparkSession, d: str) -> DataFrame:
    return catalog.ncd_summary(table(s, d, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyyMMdd").alias("day")), "o_custkey", "day")


@query("""SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 5 = 0 THEN 'SEED_ID_MISSING' WHEN c_custkey % 5 = 1 THEN 'SEED_KEY_MISMATCH' END AS error, CASE c_custkey % 5 WHEN 0 THEN concat(':', c_custkey) WHEN 1 THEN 'x:y' ELSE concat(c_nationkey, ':', c_custkey) END AS table_key FROM customer""")
def seed_canonical(s: SparkSession, d: str) -> DataFrame:
    k = C("c_custkey") % 5
    rows = table(s, d, "customer").select(F.when(k == 0, " ").otherwise(C("c_nationkey").cast("string")).alias("org_id"), C("c_custkey").cast("string").alias("tbl_id"), F.when(k == 1, "x:y").when(k == 2, F.concat_ws(":", C("c_nationkey").cast("string"), C("c_custkey").cast("string"))).alias("table_key"), C("c_name").alias("tbl_name"))
    return catalog.canonical_seed(rows).select(C("tbl_id").alias("id"), "error", "table_key")


@query("""WITH w AS (SELECT c_custkey, e FROM customer, (VALUES ('TBL'), ('ITM'), ('PRD'), ('SOURCE'), ('NCD')) v(e)), r AS (SELECT o_custkey, CASE o_orderkey % 3 WHEN 0 THEN 'TBL' WHEN 1 THEN 'ITM' ELSE 'PRD' END AS e, arg_max(CASE WHEN o_orderstatus = 'F' THEN 'OK' ELSE 'ERROR' END, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1, 2)
SELECT w.e AS endpoint, CASE WHEN status = 'OK' THEN 'REUSE' ELSE 'FETCH' END AS action, count(*) AS n FROM w LEFT JOIN r ON o_custkey = c_custkey AND r.e = w.e GROUP BY 1, 2""")
def enrich(s: SparkSession, d: str) -> DataFrame:
    """Customers as seeds, orders as records: what is reused and what is fetched again."""
    seeds = table(s, d, "customer").select(C("c_custkey").alias("table_key"))
    k = C("o_orderkey") % 3
    records = table(s, d, "orders").select(C("o_custkey").alias("table_key"), F.when(k == 0, "TBL").when(k == 1, "ITM").otherwise("PRD").alias("endpoint"), F.when(C("o_orderstatus") == "F", "OK").otherwise("ERROR").alias("status"), C("o_orderdate").alias("retrieved_at"), C("o_orderkey").alias("seq"))
    return catalog.enrich_plan(seeds, records, True).groupBy("endpoint", "action").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT p_size AS k, arg_min(p_name, p_partkey) AS name FROM part WHERE p_partkey % 7 <> 0 GROUP BY 1) SELECT k, name FROM p")
def src_catalog_stream(s: SparkSession, d: str) -> DataFrame:
    """Parts as JSON lines, every seventh cut off; of one size the first line stays."""
    lines = table(s, d, "part").select("p_partkey", F.to_json(F.struct(C("p_size").alias("k"), C("p_name").alias("name"))).alias("j"))
    cut = lines.select("p_partkey", F.when(C("p_partkey") % 7 == 0, F.substring("j", 1, 9)).otherwise(C("j")).alias("value"))
    return catalog.catalog_lines(cut, "k int, name string", "k", "value", "p_partkey")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'EMPTY' WHEN 2 THEN 'SERVICE_ERROR_21' ELSE 'MALFORMED' END AS status, (CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END)::INTEGER AS n FROM part")
def src_official_api(s: SparkSession, d: str) -> DataFrame:
    """Answers of a service: rows, no data, an error, or what is no JSON."""
    k = C("p_size") % 4
    payload = F.when(k == 0, F.to_json(F.array(F.struct(C("p_name").alias("TBL_NM"))))).when(k == 1, '{"err":"30","errMsg":"x"}').when(k == 2, '{"err":"21"}').otherwise("<html>")
    out = table(s, d, "part").select("p_partkey", catalog.service_rows(payload, "TBL_NM string").alias("x"))
    return out.select("p_partkey", "x.status", F.when(C("x.rows").isNotNull(), F.size("x.rows")).alias("n"))


# ---- validation
@query("""SELECT c_custkey, concat(CASE WHEN c_custkey % 10 = 0 THEN 'CLAIM_TEXT_REQUIRED,' ELSE '' END, CASE WHEN c_custkey % 7 = 0 THEN 'OFFSETS_REVERSED,' ELSE '' END, CASE WHEN c_nationkey % 5 = 0 THEN 'CLAIM_CLASS_INVALID,' ELSE '' END,
  CASE WHEN c_custkey % 3 = 0 THEN 'CLASS_WITHOUT_CLAIM,' ELSE '' END, CASE WHEN c_custkey % 4 = 0 THEN 'UNIT_REQUIRED,' ELSE '' END, CASE WHEN c_custkey % 6 = 0 THEN 'PERIOD_REVERSED,' ELSE '' END, CASE WHEN c_custkey % 9 = 0 THEN 'ATOM_ID_TWICE,' ELSE '' END) AS errors FROM customer""")
def validate_claim(s: SparkSession, d: str) -> DataFrame:
    """Customers as claims, with faults by their numbers."""
    c, k = table(s, d, "customer"), C("c_custkey")
    text_ = lambda x: F.lit(x).cast("string")
    atom = lambda i: F.struct(i.alias("atom_id"), F.lit("a").alias("raw"), F.lit("a").alias("normalized"), F.lit("item").alias("role_hint"), text_(None).alias("observation_id"))
    observation = F.struct(
        k.cast("string").alias("claim_id"), F.lit("o1").alias("observation_id"), F.lit(1.5).alias("value_num"), F.when(k % 4 == 0, "").otherwise("명").alias("unit_norm"), F.lit("primary").alias("relation_type"), F.lit("unknown").alias("verify_scope"),
        F.when(k % 6 == 0, "2025").otherwise("2023").alias("period_start"), F.lit("2024").alias("period_end"), F.array(F.lit("지역")).alias("dimensions"), F.array(atom(F.lit("x")), atom(F.when(k % 9 == 0, "x").otherwise("y"))).alias("atoms"),
    )
    rows = c.select(
        k.alias("c_custkey"), k.cast("string").alias("claim_id"), k.alias("article_idx"), F.when(k % 10 == 0, "").otherwise(C("c_name")).alias("claim_text"), F.lit(0).alias("sentence_index"), F.lit(5).alias("sentence_char_start"), F.when(k % 7 == 0, 4).otherwise(9).alias("sentence_char_end"),
        (k % 3 != 0).alias("is_claim"), F.when(C("c_nationkey") % 5 == 0, "zzz").otherwise("집계통계").alias("claim_class"), *[text_(None).alias(n) for n in validation.VOCABULARY if n != "claim_class"], F.array(F.lit("announcer")).alias("roles"), F.array(observation).alias("observations"),
    )
    return rows.select("c_custkey", F.concat_ws("", F.transform(validation.claim_errors(), lambda e: F.concat(e, F.lit(",")))).alias("errors"))


@query("SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 5 = 0 THEN 'TBL_NAME_REQUIRED' END, CASE WHEN c_custkey % 4 = 0 THEN 'TABLE_KEY_MISMATCH' END) AS errors FROM customer")
def validate_table(s: SparkSession, d: str) -> DataFrame:
    k = C("c_custkey")
    rows = table(s, d, "customer").select("c_custkey", F.when(k % 4 == 0, "x:y").otherwise(F.concat_ws(":", C("c_nationkey").cast("string"), k.cast("string"))).alias("table_key"), C("c_nationkey").cast("string").alias("org_id"), k.cast("string").alias("tbl_id"), F.when(k % 5 == 0, "").otherwise(C("c_name")).alias("tbl_name"))
    return rows.select("c_custkey", F.array_join(validation.table_errors(), ",").alias("errors"))


@query("""WITH m AS (SELECT *, o_orderkey % 3 = 0 AS ready, o_custkey % 4 = 0 AS queried, o_orderkey % 5 = 0 AS noplan FROM orders) SELECT o_orderkey, concat_ws(',', CASE WHEN o_custkey % 7 = 0 THEN 'RANK_INVALID' END, CASE WHEN ready AND noplan THEN 'READY_WITHOUT_PLAN' END,
  CASE WHEN NOT ready AND queried THEN 'BLOCKED_BUT_QUERIED' END, CASE WHEN queried AND NOT ready THEN 'QUERIED_WITHOUT_READY' END, CASE WHEN queried AND noplan THEN 'QUERIED_WITHOUT_PLAN' END) AS errors FROM m""")
def validate_mapping(s: SparkSession, d: str) -> DataFrame:
    k, c = C("o_orderkey"), C("o_custkey")
    rows = table(s, d, "orders").select(
        "o_orderkey", F.when(c % 7 == 0, 0).otherwise(1).alias("rank"), F.lit("CANDIDATE").alias("status"), F.lit(None).cast("string").alias("align_status"), F.when(k % 3 == 0, "QUERY_READY").otherwise("DIM_MISSING").alias("resolution_status"),
        F.when(c % 4 == 0, "NO_CELL").otherwise("NOT_QUERIED").alias("cell_status"), F.lit("i").alias("matched_item_id"), F.when(k % 5 == 0, "").otherwise("{}").alias("query_plan"), F.lit(False).alias("selected"),
    )
    return rows.select("o_orderkey", F.array_join(validation.mapping_errors(), ",").alias("errors"))


@query("""WITH e AS (SELECT user_id AS run, event_type AS stage, event_id % 3 = 0 AS p FROM events), c AS (SELECT run, stage, count(*) AS used FROM e WHERE stage <> 'click' GROUP BY 1, 2 UNION ALL SELECT run, 'click', count(*) FILTER (NOT p) FROM e WHERE stage = 'click' GROUP BY 1
UNION ALL SELECT run, 'evidence', count(*) FILTER (p) FROM e WHERE stage = 'click' GROUP BY 1 UNION ALL SELECT run, 'click_total', count(*) FROM e WHERE stage = 'click' GROUP BY 1)
SELECT run, stage, used, CASE WHEN stage NOT IN ('click', 'evidence', 'click_total', 'error') THEN 'UNKNOWN_STAGE' WHEN used > (CASE stage WHEN 'click' THEN 3 WHEN 'evidence' THEN 1 WHEN 'click_total' THEN 4 ELSE 2 END) THEN 'EXHAUSTED' ELSE 'OK' END AS status FROM c""")
def call_limits(s: SparkSession, d: str) -> DataFrame:
    """Events as calls of their users' runs; clicks are counted in two parts and in all."""
    calls = table(s, d, "events").select(C("user_id").alias("run"), C("event_type").alias("stage"), F.when(C("event_id") % 3 == 0, "evidence").alias("part"))
    return validation.call_limits(calls, {"click": 3, "error": 2}, "click", "evidence", 1, 4).select("run", "stage", "used", "status")


@query("WITH b AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1), a AS (SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1) SELECT coalesce(a.user_id, b.user_id) AS channel, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM a FULL JOIN b ON a.user_id = b.user_id")
def call_deltas(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumnRenamed("user_id", "channel")
    count = lambda df: df.groupBy("channel").agg(F.count("*").alias("calls"))
    return validation.call_deltas(count(e.where("event_id % 2 = 0")), count(e.where("event_type <> 'error'")), ["channel"])


@query("""WITH m AS (SELECT o_custkey AS run, o_orderkey AS stage, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders)
SELECT run, stage, CASE WHEN stage % 7 = 0 THEN 'MANIFEST_INVALID' WHEN stage % 5 = 0 THEN 'SHA_MISMATCH' WHEN prev IS NOT NULL AND stage % 11 = 0 THEN 'CHAIN_BROKEN' END AS error FROM m""")
def manifest_chain(s: SparkSession, d: str) -> DataFrame:
    """Orders as stages of their customers' runs, with lists that do not fit, changed files and broken links."""
    o = table(s, d, "orders").select(C("o_custkey").alias("run"), C("o_orderkey").alias("stage"))
    sha = F.sha2(C("stage").cast("string").cast("binary"), 256)
    before = F.lag(sha).over(Window.partitionBy("run").orderBy("stage"))
    files = o.select("run", "stage", F.lit("data").alias("name"), F.when(C("stage") % 5 == 0, "changed").otherwise("s").alias("sha"), F.lit(1).cast("bigint").alias("size"))
    listed = F.array(F.struct(F.when(C("stage") % 7 == 0, "other").otherwise("data").alias("name"), F.lit("s").alias("sha"), F.lit(1).cast("bigint").alias("size")))
    manifests = o.withColumn("sha", sha).withColumn("previous_sha", F.when(C("stage") % 11 == 0, "zz").otherwise(before)).withColumn("status", F.lit("COMPLETE")).withColumn("listed", listed)
    return validation.manifest_chain(manifests, files).select("run", "stage", "error")


@query("""WITH k AS (SELECT o_custkey AS u, o_orderkey % 20 AS t, o_orderdate AS c FROM orders WHERE o_orderstatus = 'F'), k1 AS (SELECT u, t, min(c) AS c FROM k GROUP BY 1, 2), a AS (SELECT o_custkey AS u, o_orderkey % 20 AS t, min(o_orderdate) AS c FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2),
b AS (SELECT * FROM k1 UNION ALL SELECT * FROM a WHERE (u, t) NOT IN (SELECT (u, t) FROM k1)) SELECT u AS user_id, t AS table_key, row_number() OVER (PARTITION BY u ORDER BY c DESC, t)::INTEGER AS pos FROM b""")
def favorites(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(C("o_custkey").alias("user_id"), (C("o_orderkey") % 20).alias("table_key"), C("o_orderdate").alias("created"), "o_orderstatus")
    kept = o.where("o_orderstatus = 'F'").groupBy("user_id", "table_key").agg(F.min("created").alias("created"))
    return validation.favorites(kept, o.where("o_orderstatus <> 'F'")).select("user_id", "table_key", "pos")


@query("""SELECT c_custkey AS target_id, CASE WHEN c_custkey % 5 = 0 THEN 'VERDICT_DRIFT' WHEN c_custkey % 5 = 1 THEN 'CITATION_UNKNOWN' WHEN c_custkey % 5 = 2 THEN 'RAW_DIGITS' WHEN c_custkey % 5 = 3 THEN 'PLACEHOLDER_UNKNOWN' END AS error,
  CASE WHEN c_custkey % 5 = 4 THEN concat(c_name, '는 ', c_mktsegment, '이다') END AS text FROM customer""")
def answer_guard(s: SparkSession, d: str) -> DataFrame:
    """Customers' answers, each with another fault, and every fifth sound."""
    k = C("c_custkey") % 5
    rows = table(s, d, "customer").select(
        C("c_custkey").alias("target_id"), F.lit("VERIFIED").alias("verdict"), F.when(k == 0, "REFUTED").otherwise("VERIFIED").alias("official_verdict"), F.array(F.when(k == 1, "z").otherwise("c1")).alias("citations"), F.array(F.lit("c1")).alias("allowed"),
        F.when(k == 2, "{name}는 7이다").when(k == 3, "{name}는 {other}이다").otherwise("{name}는 {segment}이다").alias("template"), F.create_map(F.lit("name"), C("c_name"), F.lit("segment"), C("c_mktsegment")).alias("values"),
    )
    return validation.answer_guard(rows)


# ---- sentences, questions, rules
_BODY = ["{n}% 늘었다.다음", "끝났다.”그는 {n}명", "값은 {n}.5다.다음", "a.b@c.co.kr로 보내라.끝", "U.S.의 값.\"인용", "한 문장. 두 문장", "www.a.kr.가나 {n}"]
_PARTS = ["{n}% 늘었다.|다음", "끝났다.”|그는 {n}명", "값은 {n}.5다.|다음", "a.b@c.co.kr로 보내라.|끝", "U.S.의 값.|\"인용", "한 문장.|두 문장", "www.a.kr.가나 {n}"]


def _form(templates: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN p_partkey % {len(templates)} = {i} THEN replace('{t}', '{{n}}', CAST(p_size AS STRING))" for i, t in enumerate(templates)) + " END"


@query(f"SELECT p_partkey, {_form(_PARTS)} AS parts FROM part")
def sentence_split_v1(s: SparkSession, d: str) -> DataFrame:
    """Bodies without white space between sentences, with quotations, addresses, decimals and abbreviations."""
    out = text.sentences_v1(table(s, d, "part").select("p_partkey", F.expr(_form(_BODY)).alias("t")), "t")
    return out.groupBy("p_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence_id", "text"))), lambda x: x["text"]), "|").alias("parts"))


@query("SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN 3 WHEN 2 THEN NULL END AS INTEGER) AS a, CAST(CASE p_partkey % 3 WHEN 0 THEN length(p_name) + 4 END AS INTEGER) AS b FROM part")
def ws_insensitive_span(s: SparkSession, d: str) -> DataFrame:
    """A name with other spaces and case: found once, twice, or not."""
    k, name = C("p_partkey") % 3, C("p_name")
    body = F.when(k == 0, F.concat(F.lit("z  "), F.replace(name, F.lit(" "), F.lit("  ")), F.lit(" z"))).when(k == 1, F.concat(name, F.lit(" "), F.upper(name))).otherwise("zz")
    x = text.unspaced_span(body, F.upper(F.replace(name, F.lit(" "), F.lit(""))))
    return table(s, d, "part").select("p_partkey", x["start"].alias("a"), x["end"].alias("b"))


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'EMPTY_QUERY' WHEN 1 THEN 'MULTI_SENTENCE' WHEN 2 THEN 'VALUE_UNIT_COUNT' WHEN 3 THEN 'INDICATOR_PARTICLE_REQUIRED' END AS error, CASE WHEN p_size % 6 >= 4 THEN CAST(p_size AS VARCHAR) END AS value, CASE WHEN p_size % 6 >= 4 THEN '%' END AS unit,
  CASE WHEN p_size % 6 >= 4 THEN '실업률' END AS indicator, CASE WHEN p_size % 6 = 4 THEN '2024년' END AS year FROM part""")
def query_claim_front(s: SparkSession, d: str) -> DataFrame:
    k, n = C("p_size") % 6, C("p_size").cast("string")
    q = F.when(k == 0, " ").when(k == 1, F.concat(F.lit("실업률은 "), n, F.lit("%다. 맞나?"))).when(k == 2, "실업률은 높다").when(k == 3, F.concat(F.lit("실업률 "), n, F.lit("%"))).when(k == 4, F.concat(F.lit("2024년 실업률은 "), n, F.lit("%다"))).otherwise(F.concat(F.lit("실업률이 "), n, F.lit("%인가?")))
    return table(s, d, "part").select("p_partkey", text.query_front(q).alias("x")).select("p_partkey", "x.*")


@query("""SELECT p_partkey, CASE WHEN p_size % 5 IN (1, 3) OR (p_size % 2 = 1 AND p_size % 5 <> 0) THEN 'CLARIFICATION_REQUIRED' WHEN p_size % 5 = 0 THEN 'VERIFY_ARTICLE' WHEN p_size % 5 = 2 THEN 'COMPARE_PERIODS' ELSE 'LOOKUP_VALUE' END AS task,
  CASE p_size % 5 WHEN 1 THEN 'CHANGE_UNSPECIFIED' WHEN 2 THEN 'CHANGE_RATE' WHEN 3 THEN 'DIFFERENCE' ELSE 'LEVEL' END AS measurement,
  concat_ws(',', CASE WHEN p_size % 2 = 1 AND p_size % 5 <> 0 THEN 'indicator' END, CASE WHEN p_size % 5 IN (1, 3) THEN 'period' END, CASE WHEN p_size % 5 = 1 THEN 'change_measure' END) AS missing FROM part""")
def user_intent(s: SparkSession, d: str) -> DataFrame:
    asked = F.get(F.array(*map(F.lit, ["기사 전체를 봐줘", "출생이 감소했나", "2023년과 2024년의 증가율 비교", "작년과 인구 차이는", "실업률은 얼마"])), C("p_size") % 5)
    out = table(s, d, "part").select("p_partkey", text.user_intent(asked, C("p_size") % 2 == 0).alias("x"))
    return out.select("p_partkey", "x.task", "x.measurement", F.array_join("x.missing", ",").alias("missing"))


@query("SELECT p_partkey, 'brand' AS rule, regexp_extract(p_brand, '[0-9]+', 0) AS found FROM part UNION ALL SELECT p_partkey, 'widget', 'widget' FROM part WHERE contains(p_name, 'widget')")
def lexical_rules(s: SparkSession, d: str) -> DataFrame:
    """A registry of three rules, one switched off."""
    rules = {"brand": (r"\d+", "numbers of brands"), "widget": ("widget", "names"), "off": (".*", "everything")}
    rows = table(s, d, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_name").alias("t"))
    return text.rule_hits(rows, "p_partkey", "t", rules, ("off",)).select("p_partkey", "rule", "found")


@query("""SELECT p_partkey, '지난해' AS time_ref, '2023' AS time_abs, '연' AS time_span, CAST(p_size AS VARCHAR) AS value_list, '실업률' AS about, 'EXPLICIT' AS about_status FROM part UNION ALL SELECT p_partkey, '올해', '2024', '연', CAST(p_size + 1 AS VARCHAR),
  CASE WHEN p_partkey % 4 = 0 THEN '고용률' WHEN p_size % 2 = 1 THEN '실업률' END, CASE WHEN p_partkey % 4 = 0 THEN 'REFERENT_CANDIDATE' WHEN p_size % 2 = 0 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END FROM part""")
def article_extract(s: SparkSession, d: str) -> DataFrame:
    """Articles with two values, the second of no indicator of its own: after one indicator, after two, or long after both, under a title that names one."""
    far = F.when(C("p_partkey") % 4 == 0, " 그렇다. 아니다. 그렇다.").otherwise("")
    body = F.concat(F.lit("값이 없다. 지난해 실업률은 "), C("p_size").cast("string"), F.lit("%였다."), F.when(C("p_size") % 2 == 0, " 고용률은 올랐다.").otherwise(""), far, F.lit(" 올해는 "), (C("p_size") + 1).cast("string"), F.lit("%다."))
    p = table(s, d, "part").select("p_partkey", body.alias("body"), F.lit("2024-05-01").alias("published"), F.lit("고용률 오르다").alias("title"))
    return text.article_extract(p, "body", "published", "title").select("p_partkey", "time_ref", "time_abs", "time_span", "value_list", "about", "about_status")


@query("""SELECT p_partkey, concat('value_unit:', p_size, '%|', CASE WHEN p_size % 2 = 0 THEN 'dimension:부산|' ELSE '' END, 'time:지난해') AS spans FROM part""")
def span_candidates(s: SparkSession, d: str) -> DataFrame:
    """A rate of last year, of a city for even sizes; words that look like regions are none."""
    said = F.concat(F.lit("자료에 따르면 지난해 "), F.when(C("p_size") % 2 == 0, "부산 ").otherwise(""), F.lit("고용률은 "), C("p_size").cast("string"), F.lit("%다"))
    out = text.span_candidates(table(s, d, "part").select("p_partkey", F.lit(0).alias("sid"), said.alias("t")), "t", "sid")
    ordered = F.array_sort(F.collect_list(F.struct((F.when(C("kind") == "value_unit", 0).when(C("kind") == "dimension", 1).otherwise(2)).alias("o"), F.concat_ws(":", "kind", "text").alias("x"))))
    return out.drop("t").groupBy("p_partkey").agg(F.array_join(F.transform(ordered, lambda x: x["x"]), "|").alias("spans"))


@query("""SELECT p_partkey, 'EXPLICIT' AS value, CASE WHEN p_size % 3 = 0 THEN 'INFERRED' ELSE 'EXPLICIT' END AS indicator, CASE WHEN p_size % 2 = 0 THEN 'UNKNOWN' ELSE 'EXPLICIT' END AS period, (length(p_name) + 2)::INTEGER AS value_start, (length(p_name) + 2 + length(p_size::VARCHAR))::INTEGER AS unit_start FROM part""")
def claim_core(s: SparkSession, d: str) -> DataFrame:
    """Values with their atoms: indicators that the sentence holds twice have no place."""
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    sentence = F.concat(name, F.lit("은 "), C("p_size").cast("string"), F.lit("명, 2024년"), F.when(C("p_size") % 3 == 0, F.concat(F.lit(" "), name)).otherwise(""))
    rows = table(s, d, "part").select("p_partkey", sentence.alias("t"), F.concat(C("p_size").cast("string"), F.lit("명")).alias("value_text"), F.lit("명").alias("value_unit"), name.alias("indicator"), F.when(C("p_size") % 2 == 1, "2024 년").alias("period_raw"), F.lit("").alias("region"), F.lit(None).cast("string").alias("population"))
    out = text.claim_core(rows, "t")
    return out.select("p_partkey", C("value_atom.status").alias("value"), C("indicator_atom.status").alias("indicator"), C("period_atom.status").alias("period"), C("value_atom.start").alias("value_start"), C("unit_atom.start").alias("unit_start"))


@query("""SELECT p_partkey, p_size % 4 IN (0, 3) AS kept FROM part""")
def dim_filter(s: SparkSession, d: str) -> DataFrame:
    """Facets and words that only look like them."""
    k = C("p_size") % 4
    facet = F.when(k == 2, "산업").otherwise("지역")
    found = F.when(k == 0, "부산").when(k == 1, F.when(C("p_partkey") % 2 == 0, "따르면").otherwise("국제기구")).when(k == 2, "공업제품").otherwise("경기")
    return table(s, d, "part").select("p_partkey", text.keep_facet(facet, found, F.lit(" 남부")).alias("kept"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '자동차보험료' WHEN 1 THEN '고용률' WHEN 2 THEN '수출 가격' END AS indicator, CASE WHEN p_size % 4 = 1 THEN '청년층' END AS population, CASE p_size % 4 WHEN 0 THEN '자동' WHEN 1 THEN '서울' ELSE '' END AS region FROM part""")
def structured_context(s: SparkSession, d: str) -> DataFrame:
    """Hints of a sentence: the longest premium, a listed indicator, a run that ends like one, or a word that only points. Regions go by their ending alone here."""
    k = C("p_size") % 4
    said = F.when(k == 0, "자동차보험료와 보험료가 올랐다").when(k == 1, "서울 청년층 고용률은 3%").when(k == 2, "수출 가격이 3% 올랐다").otherwise("이 수")
    x = text.sentence_context(said)
    return table(s, d, "part").select("p_partkey", x["indicator"].alias("indicator"), x["population"].alias("population"), F.array_join(x["facets"]["지역"], ",").alias("region"))


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN role END AS own, CASE WHEN turn % 2 = 0 THEN role END AS term, CASE WHEN conv_id % 2 = 0 THEN 'title' END AS title FROM conversations),
w AS (SELECT *, list_distinct(list_filter(list(term) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL)) AS s FROM c)
SELECT conv_id, turn, CASE WHEN own IS NOT NULL THEN own WHEN len(s) = 1 THEN s[1] WHEN len(s) > 1 THEN NULL ELSE title END AS context, CASE WHEN own IS NOT NULL THEN 'EXPLICIT' WHEN len(s) = 1 THEN 'RESOLVED' WHEN len(s) > 1 THEN 'AMBIGUOUS' WHEN title IS NOT NULL THEN 'REFERENT_CANDIDATE' ELSE 'MISSING' END AS context_status FROM w""")
def context_resolve(s: SparkSession, d: str) -> DataFrame:
    """Turns with a term of their own, of the last three turns, or of their conversation."""
    t, c = C("turn"), table(s, d, "conversations")
    out = context.resolve_context(c, ["conv_id"], "turn", F.when(t % 4 == 3, C("role")), F.when(t % 2 == 0, C("role")), F.when(C("conv_id") % 2 == 0, "title"))
    return out.select("conv_id", "turn", "context", "context_status")


@query("""SELECT p_brand AS table_key, count(*) FILTER (p_size % 2 = 0) AS n_items, count(*) FILTER (p_size % 2 = 1) AS n_values FROM part WHERE p_partkey % 6 <> 0 GROUP BY 1 HAVING count(*) > 0""")
def src_meta_api(s: SparkSession, d: str) -> DataFrame:
    """Answers of the metadata service, one a part, every sixth an error: items and axis values by table."""
    rows = F.to_json(F.array(F.struct(F.when(C("p_size") % 2 == 0, "ITEM").otherwise(C("p_type")).alias("OBJ_ID"), C("p_partkey").cast("string").alias("ITM_ID"), C("p_name").alias("ITM_NM"))))
    payload = F.when(C("p_partkey") % 6 == 0, '{"err":"20"}').otherwise(rows)
    schema = "OBJ_ID string, OBJ_NM string, OBJ_ID_SN int, ITM_ID string, ITM_NM string, UNIT_NM string"
    told = table(s, d, "part").select(C("p_brand").alias("table_key"), F.explode(catalog.service_rows(payload, schema)["rows"]).alias("r")).select("table_key", "r.*")
    i, v = catalog.split_itm(told)
    count = lambda df, name: df.groupBy("table_key").agg(F.count("*").alias(name))
    both = count(i, "n_items").join(count(v, "n_values"), "table_key", "full_outer")
    return both.select("table_key", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_values", F.lit(0)).alias("n_values"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'EMPTY' WHEN 1 THEN 'SERVICE_ERROR_31' ELSE 'OK' END AS status, CASE WHEN o_orderkey % 5 = 2 THEN 'MULTIPLE_CELLS' WHEN o_orderkey % 5 IN (0, 1) THEN 'NO_CELL' ELSE 'CELL_RESOLVED' END AS cell_status, CASE WHEN o_orderkey % 5 > 2 THEN o_orderstatus END AS value FROM orders""")
def src_cell_api(s: SparkSession, d: str) -> DataFrame:
    """Answers of the cell service to a plan an order: none, an error, two cells, or one."""
    from ..operators import cells

    k = C("o_orderkey") % 5
    one = F.struct(C("o_orderkey").cast("string").alias("C1"), C("o_orderstatus").alias("DT"))
    payload = F.when(k == 0, '{"err":"30"}').when(k == 1, '{"err":"31"}').when(k == 2, F.to_json(F.array(one, one))).otherwise(F.to_json(F.array(one)))
    told = table(s, d, "orders").select("o_orderkey", catalog.service_rows(payload, "C1 string, DT string").alias("x"))
    found = told.select(F.explode("x.rows").alias("r")).select(C("r.C1").cast("bigint").alias("o_orderkey"), C("r.DT").alias("DT"))
    settled = cells.exact_cell(told.select("o_orderkey"), found, ["o_orderkey"], "DT")
    return told.select("o_orderkey", "x.status").join(settled, "o_orderkey").select("o_orderkey", "status", "cell_status", C("cell_value").alias("value"))


@query("")
def html_body_select(s: SparkSession, d: str) -> DataFrame:
    """Bodies of all pages by selectors."""
    from ..operators import pages

    p = table(s, d, "pages")
    return p.select("page_id", pages.html_body(C("html"), pages.url_host(C("url"))).alias("x")).select("page_id", "x.selector", "x.adapter", "x.paragraphs")


del SQL["html_body_select"]  # a page's tree is no matter of SQL; tests hold it against pages made by hand
