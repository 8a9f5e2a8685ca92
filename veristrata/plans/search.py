"""Queries about retrieval, ranking, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as ops
from ..sources.tables import scratch, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

ASKED = [(1, "the of and"), (2, "que les"), (3, "der die und")]
_ASKED_SQL = "(VALUES (1,'the of and'), (2,'que les'), (3,'der die und')) AS v(query_id, query)"
#: Scores of BM25 over documents, as SQL; ``met`` is the number of a query's terms.
_BM25 = rf"""
WITH t AS (SELECT doc_id, source, lang, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS t FROM documents),
z AS (SELECT count(*) AS n, avg(len(t)) AS al FROM t),
q AS (SELECT DISTINCT query_id, unnest(string_split(query, ' ')) AS term FROM {_ASKED_SQL}),
p AS (SELECT doc_id, source, lang, len, term, count(*) AS tf FROM (SELECT doc_id, source, lang, len(t) AS len, unnest(t) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query_id, doc_id, source, lang, count(*) AS met, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) AS score
  FROM p JOIN d USING (term) JOIN q USING (term), z GROUP BY 1, 2, 3, 4),
w AS (SELECT query_id, count(*) AS n_terms FROM q GROUP BY 1)
"""


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id int, query string")


def bm25_hits(spark: SparkSession, d: str, match_all: bool) -> DataFrame:
    return ops.bm25(table(spark, d, "documents"), asked(spark), "doc_id", "text", ["source", "lang"], match_all)


def bm25_and_topk(spark: SparkSession, d: str) -> DataFrame:
    """For each query the 20 best documents that hold all its terms."""
    return ops.top(bm25_hits(spark, d, True), ["query_id"], [F.desc("score"), "doc_id"], 20).select("query_id", "doc_id", "score", "rank")


QUERIES["bm25_and_topk"] = bm25_and_topk
SQL["bm25_and_topk"] = _BM25 + "SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN w USING (query_id) WHERE met = n_terms) WHERE rank <= 20"


def bm25_collapse(spark: SparkSession, d: str) -> DataFrame:
    """For each query the sources by their best document that holds any of its terms."""
    return ops.collapse(bm25_hits(spark, d, False), "source", "doc_id", 100)


QUERIES["bm25_collapse"] = bm25_collapse
SQL["bm25_collapse"] = _BM25 + """, b AS (SELECT query_id, source, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS r FROM s) WHERE r = 1)
SELECT query_id, source, doc_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source) AS rank FROM b) WHERE rank <= 100"""



def _indexed(spark: SparkSession, d: str) -> str:
    """Documents as a stored index."""
    path = scratch(spark)
    ops.write_index(table(spark, d, "documents"), "doc_id", "text", ["source", "lang"], path)
    return path


def fts_index(spark: SparkSession, d: str) -> DataFrame:
    """The terms of the stored index with their documents and their largest gain."""
    return spark.read.parquet(f"{_indexed(spark, d)}/terms").select("term", "df", F.round("most", 6).alias("most"))


def fts_and_query(spark: SparkSession, d: str) -> DataFrame:
    """For each query the 20 best documents that hold all its terms, of the buckets of these terms."""
    return ops.search_index(spark, _indexed(spark, d), asked(spark), "doc_id", ["source", "lang"], True, 20).select("query_id", "doc_id", "score", "rank")


def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    """For each query the 20 best English or German documents that hold any of its terms."""
    hits = ops.search_index(spark, _indexed(spark, d), asked(spark), "doc_id", ["source", "lang"], False, 20, {"lang": ["en", "de"]})
    return hits.select("query_id", "doc_id", "lang", "score", "rank")


QUERIES |= {"fts_index": fts_index, "fts_and_query": fts_and_query, "bm25_filtered": bm25_filtered}
SQL["fts_index"] = r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t FROM documents), z AS (SELECT avg(len(t)) AS al FROM t),
p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM t) GROUP BY ALL)
SELECT term, count(*) AS df, round(max(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) AS most FROM p, z GROUP BY 1"""
SQL["fts_and_query"] = SQL["bm25_and_topk"]
SQL["bm25_filtered"] = _BM25 + "SELECT query_id, doc_id, lang, score, rank::INTEGER AS rank FROM (SELECT query_id, doc_id, lang, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE lang IN ('en', 'de')) WHERE rank <= 20"

_COS = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS qv FROM e WHERE vec_id IN (7, 77, 177)),
h AS (SELECT query_id::INTEGER AS query_id, vec_id, label, round(list_dot_product(v, qv) / sqrt(list_dot_product(v, v) * list_dot_product(qv, qv)), 6) AS score FROM e, q)
"""


def cosine_hits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where(F.col("vec_id").isin(7, 77, 177)).select(F.col("vec_id").cast("int").alias("query_id"), F.col("embedding").alias("query_vector"))
    return ops.cosine_hits(e, q, "vec_id", "embedding", ["label"])


QUERIES["dense_topk"] = lambda s, d: ops.top(cosine_hits(s, d), ["query_id"], [F.desc("score"), "vec_id"], 20).select("query_id", "vec_id", "score", "rank")
SQL["dense_topk"] = _COS + "SELECT query_id, vec_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM h) WHERE rank <= 20"

QUERIES["dense_grouped"] = lambda s, d: ops.grouped_cutoff(cosine_hits(s, d), "label", 5)
SQL["dense_grouped"] = _COS + """, b AS (SELECT query_id, label, max(score) AS score FROM h GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS rank FROM b),
k AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, max(rank) OVER (PARTITION BY query_id) AS worst FROM r WHERE rank <= 5)
SELECT query_id, label, score, rank::INTEGER AS rank, CASE WHEN n > 5 THEN 'DROPPED_UNCLOSED_CUTOFF_TIE' ELSE 'CLOSED' END AS status FROM k WHERE n <= 5 OR rank < worst"""


def channel_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of two channels: lexical hits by query, ranked by match; and by length, both keyed by source."""
    hits = bm25_hits(spark, d, False)
    lexical = ops.top(hits, ["query_id"], [F.desc("score"), "doc_id"], 50).withColumn("channel", F.lit("bm25"))
    other = ops.top(hits, ["query_id"], ["score", "doc_id"], 50).withColumn("channel", F.lit("dense"))
    both = lexical.unionByName(other)
    return both.select(F.concat(F.lit("t"), F.col("query_id")).alias("target_id"), "query_id", "channel", "source", "doc_id", "rank")


_CHANNELS = _BM25 + """, h AS (SELECT 't' || query_id AS target_id, query_id, channel, source, doc_id, rank FROM (
  SELECT *, 'bm25' AS channel, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s UNION ALL SELECT *, 'dense' AS channel, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS rank FROM s) WHERE rank <= 50),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id, query_id, channel, source ORDER BY rank, doc_id) AS pos FROM h) WHERE pos = 1)
"""
_FUSED = """SELECT target_id, source, rrf_score, best_rank::INTEGER AS best_rank, n_hits, fused_rank::INTEGER AS fused_rank FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY rrf_score DESC, best_rank, source) AS fused_rank
FROM (SELECT target_id, source, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf_score, min(rank) AS best_rank, count(*) AS n_hits FROM n GROUP BY 1, 2)) WHERE fused_rank <= 100"""

QUERIES["rrf_fuse"] = lambda s, d: ops.rrf_fuse(ops.normalize_path(channel_hits(s, d), "source", "doc_id"), "source")
SQL["rrf_fuse"] = _CHANNELS + _FUSED
QUERIES["path_normalize"] = lambda s, d: ops.normalize_path(channel_hits(s, d), "source", "doc_id")
SQL["path_normalize"] = _CHANNELS + "SELECT target_id, query_id, channel, source, doc_id, rank::INTEGER AS rank FROM n"


def merge_rounds(spark: SparkSession, d: str) -> DataFrame:
    """A first round of lexical hits; a second one that repeats them at worse ranks and brings the other channel's."""
    hits = channel_hits(spark, d)
    return ops.merge_rounds([hits.where("channel = 'bm25'"), hits.withColumn("rank", F.col("rank") + 7)], "source", "doc_id")


QUERIES["merge_rounds"] = merge_rounds
SQL["merge_rounds"] = _CHANNELS.replace("n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id, query_id, channel, source ORDER BY rank, doc_id) AS pos FROM h) WHERE pos = 1)", """r AS (SELECT *, 0 AS round FROM h WHERE channel = 'bm25' UNION ALL SELECT target_id, query_id, channel, source, doc_id, rank + 7, 1 FROM h),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id, query_id, channel, doc_id ORDER BY round) AS first FROM r) WHERE first = 1),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id, query_id, channel, source ORDER BY rank, doc_id) AS pos FROM o) WHERE pos = 1)""") + _FUSED


def rrf_path_audit(spark: SparkSession, d: str) -> DataFrame:
    paths = spark.createDataFrame([(q, c) for q in (1, 2, 3) for c in ("bm25", "dense", "official")], "query_id int, channel string")
    return ops.path_audit(paths, channel_hits(spark, d))


QUERIES["rrf_path_audit"] = rrf_path_audit
SQL["rrf_path_audit"] = _CHANNELS + """
, paths AS (SELECT q.query_id, c.channel FROM (VALUES (1), (2), (3)) q(query_id), (VALUES ('bm25'), ('dense'), ('official')) c(channel))
SELECT p.query_id, p.channel, count(h.doc_id) AS n_hits, CASE WHEN count(h.doc_id) > 0 THEN 'OK' ELSE 'EMPTY' END AS status FROM paths p LEFT JOIN h ON h.query_id = p.query_id AND h.channel = p.channel GROUP BY 1, 2"""

QUERIES["passages"] = lambda s, d: ops.passages(table(s, d, "part"), "p_brand", ["p_name", "p_type"], "p_partkey").select("p_brand", F.sha2(F.col("passage").cast("binary"), 256).alias("sha"), F.length("passage").alias("size"))
SQL["passages"] = """WITH x AS (SELECT p_brand, 'p_name' AS f, p_partkey AS r, p_name AS t FROM part UNION ALL SELECT p_brand, 'p_type', p_partkey, p_type FROM part),
g AS (SELECT p_brand, string_agg(f || ': ' || t, chr(10) ORDER BY f, r, t) AS passage FROM x GROUP BY 1) SELECT p_brand, sha256(passage) AS sha, length(passage)::INTEGER AS size FROM g"""


def browse_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of ten suppliers by name."""
    return ops.page(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), ["s_name", "s_suppkey"], 10, 10)


QUERIES["browse_page"] = browse_page
SQL["browse_page"] = "SELECT s_suppkey, s_name, s_nationkey FROM supplier ORDER BY s_name, s_suppkey LIMIT 10 OFFSET 10"
QUERIES["org_facets"] = lambda s, d: ops.facets(table(s, d, "supplier").join(F.broadcast(table(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")), ["n_nationkey", "n_name"])
SQL["org_facets"] = "SELECT n_nationkey, n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2"


def hydrate_ordered(spark: SparkSession, d: str) -> DataFrame:
    keys = spark.createDataFrame([([9, 3, 7, 100000001, 1],)], "keys array<bigint>")
    return ops.hydrate_ordered(table(spark, d, "supplier").select("s_suppkey", "s_name"), keys, "s_suppkey").orderBy("pos")


QUERIES["hydrate_ordered"] = hydrate_ordered
SQL["hydrate_ordered"] = "SELECT s_suppkey, s_name, (pos - 1)::INTEGER AS pos FROM supplier JOIN (SELECT unnest([9, 3, 7, 100000001, 1]) AS k, unnest(range(1, 6)) AS pos) ON k = s_suppkey"


def rerank(spark: SparkSession, d: str) -> DataFrame:
    """Fused candidates by a stand-in score; the set that was scored is the set of candidates."""
    fused = QUERIES["rrf_fuse"](spark, d)
    scores = fused.select("target_id", "source", (1 / (1 + F.exp(-F.length("source").cast("double")))).alias("score"))
    return ops.rerank(fused, scores.withColumn("score", F.round("score", 6)), "source", 50)


QUERIES["rerank"] = rerank
SQL["rerank"] = _CHANNELS + """, c AS (SELECT DISTINCT target_id, source, round(1 / (1 + exp(-length(source)::DOUBLE)), 6) AS score FROM n)
SELECT target_id, source, score, rank::INTEGER AS rank, true AS complete FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, source) AS rank FROM c) WHERE rank <= 50"""


def option_page(spark: SparkSession, d: str) -> DataFrame:
    """Options whose label holds a text, by label and id, after a cursor."""
    p = table(spark, d, "part").where(F.lower("p_name").contains("a") & (F.struct("p_name", "p_partkey") > F.struct(F.lit("b"), F.lit(0).cast("bigint"))))
    return ops.page(p.select("p_partkey", "p_name"), ["p_name", "p_partkey"], 20, 0)


QUERIES["option_page"] = option_page
SQL["option_page"] = "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND (p_name > 'b' OR (p_name = 'b' AND p_partkey > 0)) ORDER BY p_name, p_partkey LIMIT 20"
