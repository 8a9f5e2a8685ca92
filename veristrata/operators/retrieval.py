"""Retrieval: postings and BM25, vectors, rank fusion, paging and facets. Every top-k has a total order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K1, B, RRF = 1.2, 0.75, 60
#: The most different terms of queries that are scored together, and the most query vectors.
QUERY_TERMS, QUERY_VECTORS = 1000, 1000


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def postings(records: DataFrame, record_id: str, text: str, carry: list[str] | None = None) -> DataFrame:
    """``(term, record_id, tf, len, …)``: one row for each term of each record."""
    # Texts are moved instead of their terms' rows: a record's terms are then counted where it lies.
    dealt = records.select(record_id, *(carry or []), text).repartition(record_id, *(carry or []))
    split = dealt.select(record_id, *(carry or []), terms(F.col(text)).alias("t"))
    exploded = split.select(record_id, *(carry or []), F.size("t").alias("len"), F.explode("t").alias("term"))
    return exploded.groupBy(record_id, *(carry or []), "len", "term").agg(F.count("*").alias("tf"))


def top(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` of each group; the filter on row_number becomes a group limit before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def bm25(records: DataFrame, queries: DataFrame, record_id: str, text: str, carry: list[str], match_all: bool) -> DataFrame:
    """``(query_id, record_id, …, score)`` of every record that holds all (or, else, any) of a query's terms.

    The terms of a handful of queries (at most ``QUERY_TERMS`` pairs of query and term, counted) filter each record's
    tokens where they lie, so only tokens that some query asks for are exploded, and their weights are broadcast. More
    are joined by a shuffle. Lengths and counts cover all records.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    wanted = asked.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    listed = [r["term"] for r in asked.select("term").limit(QUERY_TERMS + 1).collect()]
    few = len(listed) <= QUERY_TERMS
    split = records.select(record_id, *carry, terms(F.col(text)).alias("t"))
    size = split.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avg_len"))
    hits = split.select(record_id, *carry, F.size("t").alias("len"), F.explode(F.filter("t", lambda x: x.isin(sorted(set(listed)))) if few else F.col("t")).alias("term"))
    hits = hits if few else hits.join(asked.select("term").distinct(), "term", "left_semi")
    post = hits.groupBy(record_id, *carry, "len", "term").agg(F.count("*").alias("tf"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    weights = asked.join(df, "term").crossJoin(size)  # one row a query term, and one row of sizes
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = post.join(F.broadcast(weights) if few else weights, "term")
    out = scored.groupBy("query_id", record_id, *carry).agg(F.sum(gain).alias("score"), F.count("*").alias("met"))
    if match_all:
        out = out.join(wanted, "query_id").where(F.col("met") == F.col("n_terms"))
    return out.select("query_id", record_id, *carry, F.round("score", 6).alias("score"))


#: Buckets of a stored index; a query reads those of its terms.
BUCKETS = 64


def write_index(records: DataFrame, record_id: str, text: str, carry: list[str], path: str, buckets: int = BUCKETS) -> None:
    """Store an inverted index of ``records`` under ``path``: ``postings`` and ``terms`` by bucket of the term, and ``corpus``, one row.

    Postings ``(bucket, term, record_id, …, len, tf)`` lie sorted by term within a bucket, so that a term's rows are
    found by the files' statistics; terms hold ``(bucket, term, df, most)``, most being the largest gain of any of its postings before the term's own weight.
    The index is never replaced.
    """
    size = F.size(terms(F.col(text)))
    records.agg(F.count("*").alias("n"), F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_len"), F.lit(buckets).alias("buckets")).write.parquet(f"{path}/corpus")
    corpus = records.sparkSession.read.parquet(f"{path}/corpus")
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    posted = postings(records, record_id, text, carry).withColumn("bucket", bucket)
    # Ranges, so that the postings of a frequent term are many files and no task's alone.
    posted.repartitionByRange("bucket", "term", record_id).sortWithinPartitions("bucket", "term", record_id).write.partitionBy("bucket").parquet(f"{path}/postings")
    stored = records.sparkSession.read.parquet(f"{path}/postings")
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    weighed = stored.crossJoin(F.broadcast(corpus.select("avg_len")))  # one row
    weighed.groupBy("bucket", "term").agg(F.count("*").alias("df"), F.max(gain).alias("most")).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")


def search_index(spark: SparkSession, path: str, queries: DataFrame, record_id: str, carry: list[str], match_all: bool, k: int, only: dict[str, list] | None = None) -> DataFrame:
    """``(query_id, record_id, …, score, rank)``: the first ``k`` records of each query by BM25, from a stored index.

    Only the buckets of the queries' terms are read, and of them only those terms. ``only`` keeps records by the values of carried columns;
    weights stay those of the whole corpus. A query without any word is an error if all terms must match.
    """
    asked = queries.select("query_id", F.explode_outer(F.array_distinct(terms(F.col("query")))).alias("term"))
    if match_all and asked.where("term IS NULL").head(1):
        raise ValueError("a query has no word")
    corpus = spark.read.parquet(f"{path}/corpus").first()
    asked = asked.where("term IS NOT NULL").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(corpus["buckets"])).cast("int"))
    wanted = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most the buckets
    in_them = lambda what: spark.read.parquet(f"{path}/{what}").where(F.col("bucket").isin(wanted)) if wanted else spark.read.parquet(f"{path}/{what}").where(F.lit(False))
    listed = [r["term"] for r in asked.select("term").limit(QUERY_TERMS + 1).collect()]
    few = len(listed) <= QUERY_TERMS
    posted = in_them("postings")
    posted = posted.where(F.col("term").isin(sorted(set(listed)))) if few else posted
    for column, values in (only or {}).items():
        posted = posted.where(F.col(column).isin(values))
    weights = asked.join(in_them("terms").select("bucket", "term", "df"), ["bucket", "term"])
    n, mean = F.lit(corpus["n"]), F.lit(corpus["avg_len"])
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    scored = posted.join(F.broadcast(weights) if few else weights, ["bucket", "term"]).groupBy("query_id", record_id, *carry).agg(F.sum(gain).alias("score"), F.count("*").alias("met"))
    if match_all:
        scored = scored.join(asked.groupBy("query_id").agg(F.count("*").alias("n_terms")), "query_id").where(F.col("met") == F.col("n_terms"))
    rounded = scored.select("query_id", record_id, *carry, F.round("score", 6).alias("score"))
    return top(rounded, ["query_id"], [F.desc("score"), record_id], k)


def collapse(hits: DataFrame, group: str, record_id: str, k: int) -> DataFrame:
    """The best record of each group, then the first k groups of each query, by score and then key."""
    best = hits.groupBy("query_id", group).agg(F.max(F.struct("score", (-F.col(record_id)).alias("at"))).alias("b"))
    flat = best.select("query_id", group, (-F.col("b.at")).alias(record_id), F.col("b.score").alias("score"))
    return top(flat, ["query_id"], [F.desc("score"), group], k)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_hits(corpus: DataFrame, queries: DataFrame, id_col: str, vector: str, carry: list[str]) -> DataFrame:
    """Scores of every record for each of a stated handful of query vectors (at most ``QUERY_VECTORS``, checked), which are sent to the corpus."""
    q = queries.select("query_id", F.col("query_vector"), F.sqrt(dot(F.col("query_vector"), F.col("query_vector"))).alias("query_norm"))
    asked = q.limit(QUERY_VECTORS + 1).collect()
    if len(asked) > QUERY_VECTORS:
        raise ValueError(f"more than {QUERY_VECTORS} query vectors: use an index instead")
    listed = F.broadcast(corpus.sparkSession.createDataFrame(asked, q.schema).agg(F.collect_list(F.struct("*")).alias("qs")))  # one row
    normed = corpus.select(id_col, *carry, F.col(vector).alias("v"), F.sqrt(dot(F.col(vector), F.col(vector))).alias("norm"))
    each = normed.crossJoin(listed).select(id_col, *carry, "v", "norm", F.explode("qs").alias("q"))
    return each.select("q.query_id", id_col, *carry, F.round(dot(F.col("v"), F.col("q.query_vector")) / (F.col("norm") * F.col("q.query_norm")), 6).alias("score"))


def grouped_cutoff(hits: DataFrame, group: str, limit: int) -> DataFrame:
    """Best hit by group; groups by rank up to ``limit``. If more tie at the boundary, all at that score are dropped."""
    best = hits.groupBy("query_id", group).agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"))
    ranked = best.withColumn("rank", F.rank().over(by_score)).where(F.col("rank") <= limit)
    per_query = Window.partitionBy("query_id")
    kept = ranked.withColumn("n", F.count("*").over(per_query)).withColumn("worst", F.max("rank").over(per_query))
    over = F.col("n") > limit
    status = F.when(over, "DROPPED_UNCLOSED_CUTOFF_TIE").otherwise("CLOSED")
    return kept.withColumn("status", status).where(~over | (F.col("rank") < F.col("worst"))).select("query_id", group, "score", "rank", "status")


def normalize_path(hits: DataFrame, key: str, record_id: str) -> DataFrame:
    """One hit for each target, query, channel and key: the least rank, then record."""
    return top(hits, ["target_id", "query_id", "channel", key], ["rank", record_id], 1, "_n").drop("_n")


def rrf_fuse(hits: DataFrame, key: str, limit: int = 100) -> DataFrame:
    """Reciprocal-rank fusion: ``sum(1 / (60 + rank))``; order by score, best rank, key."""
    fused = hits.groupBy("target_id", key).agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 9).alias("rrf_score"), F.min("rank").alias("best_rank"), F.count("*").alias("n_hits"))
    return top(fused, ["target_id"], [F.desc("rrf_score"), "best_rank", key], limit, "fused_rank")


def merge_rounds(rounds: list[DataFrame], key: str, record_id: str, limit: int = 100) -> DataFrame:
    """Rounds of hits together, an earlier round's hit first where one recurs, fused anew."""
    marked = reduce(lambda a, b: a.unionByName(b), [r.withColumn("round", F.lit(i)) for i, r in enumerate(rounds)])
    once = top(marked, ["target_id", "query_id", "channel", record_id], ["round"], 1, "_n").drop("_n", "round")
    return rrf_fuse(normalize_path(once, key, record_id), key, limit)


def path_audit(paths: DataFrame, hits: DataFrame) -> DataFrame:
    """Each registered path with its number of hits: OK or EMPTY."""
    counts = hits.groupBy("query_id", "channel").agg(F.count("*").alias("n_hits"))
    out = paths.join(counts, ["query_id", "channel"], "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    return out.withColumn("status", F.when(F.col("n_hits") > 0, "OK").otherwise("EMPTY"))


def passages(records: DataFrame, key: str, fields: list[str], record_id: str) -> DataFrame:
    """For each key its ``FIELD: text`` lines, ordered by field, record and text."""
    lines = F.array(*[F.struct(F.lit(f).alias("field"), F.col(record_id).alias("r"), F.col(f).alias("text")) for f in fields])
    gathered = records.select(key, F.explode(lines).alias("x")).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return gathered.select(key, F.array_join(F.transform("xs", lambda x: F.concat(x["field"], F.lit(": "), x["text"])), "\n").alias("passage"))


def rerank(candidates: DataFrame, scores: DataFrame, key: str, k: int = 50) -> DataFrame:
    """Candidates by score, then key. ``complete`` is false where the scored set is not exactly the candidates."""
    both = candidates.select("target_id", key, F.lit(1).alias("c")).join(scores.select("target_id", key, "score"), ["target_id", key], "full_outer")
    whole = both.groupBy("target_id").agg((F.count_if(F.col("c").isNull() | F.col("score").isNull()) == 0).alias("complete"))
    ranked = top(both.where("c IS NOT NULL AND score IS NOT NULL"), ["target_id"], [F.desc("score"), key], k)
    return ranked.join(whole, "target_id").select("target_id", key, "score", "rank", "complete")


def page(df: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def facets(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def hydrate_ordered(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows for an ordered array of keys, in that order (column ``pos``); unknown keys are left out."""
    listed = keys.select(F.posexplode("keys").alias("pos", key))
    return df.join(listed, key)


def hybrid_rrf(hits: DataFrame, release: str, limit: int = 100, k: int = RRF) -> tuple[DataFrame, DataFrame]:
    """Two channels fused by rank, and the faults that make a query's fusion void.

    ``hits(query_id, channel, table_key, release_id, rank, relation)``. Faults ``(query_id, fault)``: a
    channel other than bm25 and dense, a key twice in one channel, more hits than ``limit`` in one,
    another release. The fused rows have ``total_relation``: gte if a channel says so.
    """
    per_key = hits.groupBy("query_id", "channel", "table_key").agg(F.count("*").alias("n"))
    per_channel = hits.groupBy("query_id", "channel").agg(F.count("*").alias("n"), F.count_if(F.col("release_id") != release).alias("other"))
    fault = lambda df, cond, name: df.where(cond).select("query_id", F.lit(name).alias("fault"))
    known = F.col("channel").isin("bm25", "dense")
    faults = reduce(lambda a, b: a.unionByName(b), [
        fault(per_channel, ~known, "SOURCE_MISMATCH"), fault(per_channel, F.col("n") > limit, "WINDOW_TOO_LONG"), fault(per_channel, F.col("other") > 0, "RELEASE_MISMATCH"), fault(per_key, F.col("n") > 1, "KEY_TWICE"),
    ]).distinct()
    sound = hits.join(faults.select("query_id").distinct(), "query_id", "left_anti")
    fused = sound.groupBy("query_id", "table_key").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf_score"), F.min("rank").alias("best_rank"))
    relation = sound.groupBy("query_id").agg(F.max("relation").alias("total_relation"))  # gte comes after eq
    return top(fused, ["query_id"], [F.desc("rrf_score"), "best_rank", "table_key"], limit, "fused_rank").join(relation, "query_id"), faults


def rrf_only(fused: DataFrame, key: str, k: int = 50) -> DataFrame:
    """Without re-ranking: the fused order, its first ``k``."""
    return fused.where(F.col("fused_rank") <= k).select("target_id", key, F.col("fused_rank").alias("rank"))


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


#: Fields that context and corrective paths look in (fixed values).
CONTEXT_FIELDS = ("TITLE", "CATEGORY", "ITEM", "DIMENSION_AXIS")


def extra_register(targets: DataFrame, terms_col: str, kind: str) -> DataFrame:
    """Search paths ``(target_id, query_id, role, channel, query)`` for terms ``array<struct<role, text>>``, beside the six default paths.

    ``kind`` source: on the official and lexical channels; corrective: on all three. White space is
    collapsed, blank texts are left out, and of one role and text the first place counts.
    """
    channels = ["official", "bm25"] if kind == "source" else ["official", "bm25", "dense"]
    role = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("t.role", F.lit("context" if kind == "source" else "corrective"))), "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    text = F.trim(F.regexp_replace(F.coalesce("t.text", F.lit("")), r"\s+", " "))
    rows = targets.select("target_id", F.posexplode(terms_col).alias("at", "t")).select("target_id", "at", role.alias("role"), text.alias("query")).where("query <> ''")
    once = rows.groupBy("target_id", "role", "query").agg(F.min("at").alias("at"))
    named = once.select("target_id", F.concat_ws("_", F.lit(kind), "role", "at").alias("query_id"), F.concat(F.lit(f"{kind}_"), "role").alias("role") if kind == "source" else F.col("role"), "query")
    return named.select("target_id", "query_id", "role", F.explode(F.array(*map(F.lit, channels))).alias("channel"), "query")
