"""Checks of claims, tables, mappings, budgets and stage manifests: every row keeps its error codes, none is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the vocabulary.
CLAIM_CLASSES = ("집계통계", "개별사례", "전망예측", "목표계획", "법령제도", "해석수사", "사고대응임시통계", "여론조사", "통계조사안내", "정정보도")
NOISE_REASONS = ("광고", "의견", "질문", "불완전문", "인용맥락", "UI잡음", "기타")
VOCABULARY = {
    "claim_class": CLAIM_CLASSES, "noise_reason": NOISE_REASONS, "verifiability_prefilter": ("검증시도", "강등", "제외"),
    "source_scope": ("KOSIS등재", "공식기관_비KOSIS", "민간기관", "해외기관", "불명"), "list_alignment_status": ("ALIGNED", "COUNT_MISMATCH", "LOW_CONFIDENCE", "NOT_LIST_FORM", "SINGLE_VALUE"),
    "overall_status": ("VERIFIED", "REFUTED", "UNVERIFIABLE", "PARTIAL"), "context_status": ("NOT_APPLICABLE", "EXPLICIT", "RESOLVED", "REFERENT_CANDIDATE", "REFERENT_AMBIGUOUS", "CONTEXT_MISSING"),
    "mapping_eligibility": ("OUT_OF_SCOPE", "CONTEXT_EXPANDED", "CLAIM_ONLY_SAFE", "CONTEXT_REQUIRED_UNRESOLVED"),
}
ROLES = ("data_producer", "announcer", "claimer", "comparison_source", "cited_source")
RELATIONS = ("primary", "comparison_base", "component", "total", "rank_peer", "untyped")
SCOPES = ("aggregate", "individual", "noise", "time_ref", "unknown")
AXES = ("지역", "성별", "연령", "산업", "항목")
ROLE_HINTS = ("indicator", "item", "population", "dimension", "population_or_dimension", "unknown")
MATCHES = ("CANDIDATE", "SELECTED", "REJECTED", "AMBIGUOUS", "NO_KOSIS_MATCH")
ALIGNMENTS = ("ALIGNED", "DIM_MISSING", "PERIOD_MISMATCH", "ITEM_AMBIGUOUS", "NO_CELL")
RESOLUTIONS = ("QUERY_READY", "ITEM_AMBIGUOUS", "AXIS_AMBIGUOUS", "DIM_MISSING", "PERIOD_MISMATCH", "UNIT_MISMATCH", "PROFILE_INCOMPLETE", "DERIVED_READY", "DERIVED_RANGE")
CELLS = ("NOT_QUERIED", "CELL_RESOLVED", "NO_CELL", "MULTIPLE_CELLS", "API_ERROR")

ATOM = "struct<atom_id:string,raw:string,normalized:string,role_hint:string,observation_id:string>"
OBSERVATION = f"struct<claim_id:string,observation_id:string,value_num:double,unit_norm:string,relation_type:string,verify_scope:string,period_start:string,period_end:string,dimensions:array<string>,atoms:array<{ATOM}>>"


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def codes(*pairs: tuple[Column, str]) -> Column:
    """The codes whose condition holds (null: it does not), in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for cond, code in pairs]))


def _repeats(ids: Column) -> Column:
    return F.size(ids) > F.size(F.array_distinct(ids))


def claim_errors() -> Column:
    """Codes of a claim row: required fields, offsets, vocabularies, what excludes what, and its observations and their atoms.

    Columns: claim_id, article_idx, claim_text, sentence_index, sentence_char_start, sentence_char_end,
    is_claim, those of ``VOCABULARY``, roles (array), observations (array of ``OBSERVATION``).
    """
    c = F.col
    outside = lambda x, words: ~blank(x) & ~x.isin(*words)
    some = lambda test: F.exists(F.coalesce(c("observations"), F.array().cast(f"array<{OBSERVATION}>")), test)
    atoms = lambda o: F.coalesce(o["atoms"], F.array().cast(f"array<{ATOM}>"))
    ids = lambda xs, f: F.filter(F.transform(xs, lambda x: x[f]), lambda i: ~blank(i))
    return codes(
        (blank(c("claim_id")), "CLAIM_ID_REQUIRED"), (c("article_idx").isNull(), "ARTICLE_IDX_REQUIRED"), (blank(c("claim_text")), "CLAIM_TEXT_REQUIRED"),
        (c("sentence_index") < 0, "SENTENCE_INDEX_NEGATIVE"), ((c("sentence_char_start") < 0) | F.coalesce(c("sentence_char_end") < 0, F.lit(False)), "OFFSET_NEGATIVE"),
        (c("sentence_char_end") < c("sentence_char_start"), "OFFSETS_REVERSED"),
        *[(outside(c(name), words), f"{name.upper()}_INVALID") for name, words in VOCABULARY.items()],
        (~c("is_claim") & ~blank(c("claim_class")), "CLASS_WITHOUT_CLAIM"), (c("is_claim") & ~blank(c("noise_reason")), "NOISE_WITH_CLAIM"),
        (F.exists("roles", lambda r: ~F.coalesce(r, F.lit("")).isin(*ROLES)), "SOURCE_ROLE_INVALID"),
        (some(lambda o: ~o["claim_id"].eqNullSafe(c("claim_id"))), "OBSERVATION_OF_OTHER_CLAIM"), (_repeats(F.transform("observations", lambda o: o["observation_id"])), "OBSERVATION_ID_TWICE"),
        (some(lambda o: o["value_num"].isNotNull() & blank(o["unit_norm"])), "UNIT_REQUIRED"), (some(lambda o: ~F.coalesce(o["relation_type"], F.lit("")).isin(*RELATIONS)), "RELATION_INVALID"),
        (some(lambda o: ~F.coalesce(o["verify_scope"], F.lit("")).isin(*SCOPES)), "VERIFY_SCOPE_INVALID"), (some(lambda o: ~blank(o["period_start"]) & ~blank(o["period_end"]) & (o["period_start"] > o["period_end"])), "PERIOD_REVERSED"),
        (some(lambda o: F.exists(F.coalesce(o["dimensions"], F.array().cast("array<string>")), lambda d: ~F.coalesce(d, F.lit("")).isin(*AXES))), "DIMENSION_KEY_INVALID"),
        (some(lambda o: F.exists(atoms(o), lambda a: blank(a["atom_id"]))), "ATOM_ID_REQUIRED"), (some(lambda o: _repeats(ids(atoms(o), "atom_id"))), "ATOM_ID_TWICE"),
        (some(lambda o: F.exists(atoms(o), lambda a: blank(a["raw"]) | blank(a["normalized"]))), "ATOM_TEXT_REQUIRED"), (some(lambda o: F.exists(atoms(o), lambda a: ~F.coalesce(a["role_hint"], F.lit("")).isin(*ROLE_HINTS))), "ROLE_HINT_INVALID"),
        (some(lambda o: F.exists(atoms(o), lambda a: ~blank(a["observation_id"]) & (a["observation_id"] != o["observation_id"]))), "ATOM_OF_OTHER_OBSERVATION"),
    )


def table_errors() -> Column:
    """Codes of ``(table_key, org_id, tbl_id, tbl_name)``: what is required, and the key made of the ids."""
    c = F.col
    made = F.concat(F.coalesce("org_id", F.lit("")), F.lit(":"), F.coalesce("tbl_id", F.lit("")))
    return codes(*[(blank(c(n)), f"{n.upper()}_REQUIRED") for n in ("table_key", "org_id", "tbl_id", "tbl_name")], (~c("table_key").eqNullSafe(made), "TABLE_KEY_MISMATCH"))


def mapping_errors() -> Column:
    """Codes of ``(rank, status, align_status, resolution_status, cell_status, matched_item_id, query_plan, selected)``; a ready query has an item and a plan, and only that is queried."""
    c = F.col
    ready, queried = c("resolution_status").eqNullSafe("QUERY_READY"), ~c("cell_status").eqNullSafe("NOT_QUERIED")
    return codes(
        (~F.coalesce(c("rank") >= 1, F.lit(False)), "RANK_INVALID"), (~F.coalesce(c("status"), F.lit("")).isin(*MATCHES), "STATUS_INVALID"), (~blank(c("align_status")) & ~c("align_status").isin(*ALIGNMENTS), "ALIGN_STATUS_INVALID"),
        (~blank(c("resolution_status")) & ~c("resolution_status").isin(*RESOLUTIONS), "RESOLUTION_STATUS_INVALID"), (~F.coalesce(c("cell_status"), F.lit("")).isin(*CELLS), "CELL_STATUS_INVALID"),
        (ready & blank(c("matched_item_id")), "READY_WITHOUT_ITEM"), (ready & blank(c("query_plan")), "READY_WITHOUT_PLAN"), (~ready & ~blank(c("resolution_status")) & queried, "BLOCKED_BUT_QUERIED"),
        (queried & ~ready, "QUERIED_WITHOUT_READY"), (queried & blank(c("query_plan")), "QUERIED_WITHOUT_PLAN"), (c("selected") & (c("status") != "SELECTED"), "SELECTED_STATUS_MISMATCH"),
    )


def call_limits(calls: DataFrame, limits: dict[str, int], split: str, part: str, part_limit: int, total_limit: int) -> DataFrame:
    """``(run, stage, used, limit, status)`` of call rows ``(run, stage, part)``: EXHAUSTED where a stage is over its limit.

    The stage ``split`` is counted in two, its rows of ``part`` (limit ``part_limit``) and the others, and in all (``total_limit``).
    """
    own = calls.groupBy("run", "stage").agg(F.count("*").alias("used"), F.count_if(F.col("part") == part).alias("of_part"))
    names = F.when(F.col("stage") == split, F.array(
        F.struct(F.lit(split).alias("stage"), (F.col("used") - F.col("of_part")).alias("used")), F.struct(F.lit(part).alias("stage"), F.col("of_part").alias("used")), F.struct(F.lit(f"{split}_total").alias("stage"), F.col("used").alias("used")),
    )).otherwise(F.array(F.struct("stage", "used")))
    rows = own.select("run", F.explode(names).alias("x")).select("run", "x.*")
    all_limits = limits | {part: part_limit, f"{split}_total": total_limit}
    limit = F.try_element_at(F.create_map(*[F.lit(v) for kv in all_limits.items() for v in kv]), F.col("stage"))
    return rows.withColumn("limit", limit).withColumn("status", F.when(limit.isNull(), "UNKNOWN_STAGE").when(F.col("used") > limit, "EXHAUSTED").otherwise("OK"))


def call_deltas(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Counters after less those before, by channel; a counter that is missing counts as 0."""
    joined = before.withColumnRenamed("calls", "b").join(after.withColumnRenamed("calls", "a"), by, "full_outer")
    return joined.select(*by, (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("delta"))


def manifest_chain(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """``(run, stage, error, chain)``: is every stage's manifest complete, its files the ones it lists, unchanged, and linked to the stage before?

    ``manifests(run, stage, status, previous_sha, sha, listed array<struct<name, sha, size>>)``,
    ``files(run, stage, name, sha, size)`` as found. MANIFEST_INVALID before SHA_MISMATCH before CHAIN_BROKEN.
    """
    found = files.groupBy("run", "stage").agg(F.array_sort(F.collect_list(F.struct("name", "sha", "size"))).alias("found"))
    own = manifests.join(found, ["run", "stage"], "left").withColumn("listed", F.array_sort("listed"))
    names = lambda c: F.transform(c, lambda x: x["name"])
    before = F.lag("sha").over(Window.partitionBy("run").orderBy("stage"))
    out = own.withColumn("before", before)
    nothing = F.coalesce("found", F.array().cast("array<struct<name:string,sha:string,size:bigint>>"))
    error = (
        F.when(~F.col("status").eqNullSafe("COMPLETE") | ~names("listed").eqNullSafe(names(nothing)), "MANIFEST_INVALID")
        .when(~F.col("listed").eqNullSafe(nothing), "SHA_MISMATCH").when(F.col("before").isNotNull() & ~F.col("previous_sha").eqNullSafe(F.col("before")), "CHAIN_BROKEN")
    )
    return out.select("run", "stage", error.alias("error"), F.when(error.isNull(), F.sha2(F.concat_ws(":", "before", "sha").cast("binary"), 256)).alias("chain"))


def favorites(kept: DataFrame, added: DataFrame) -> DataFrame:
    """Favourites ``(user_id, table_key, created)`` with those added that were not there; newest first, then by key, in column ``pos``."""
    fresh = added.groupBy("user_id", "table_key").agg(F.min("created").alias("created")).join(kept, ["user_id", "table_key"], "left_anti")
    both = kept.select("user_id", "table_key", "created").unionByName(fresh)
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created"), "table_key")))


def answer_guard(answers: DataFrame) -> DataFrame:
    """``(target_id, error, text)`` of ``(target_id, verdict, official_verdict, citations, allowed, template, values)``.

    The verdict must not drift, every citation must be an allowed one, and the text may hold digits only by its
    ``{placeholders}``, which are replaced; one that is unknown is an error.
    """
    bare = F.regexp_replace("template", r"\{[a-z0-9_]+\}", "")
    names = F.array_distinct(F.regexp_extract_all("template", F.lit(r"\{([a-z0-9_]+)\}"), 1))
    unknown = F.size(F.array_except(names, F.map_keys("values"))) > 0
    error = (
        F.when(~F.col("verdict").eqNullSafe(F.col("official_verdict")), "VERDICT_DRIFT").when(F.size(F.array_except("citations", "allowed")) > 0, "CITATION_UNKNOWN")
        .when(bare.rlike("[0-9]"), "RAW_DIGITS").when(unknown, "PLACEHOLDER_UNKNOWN")
    )
    filled = F.aggregate(names, F.col("template"), lambda text, n: F.replace(text, F.concat(F.lit("{"), n, F.lit("}")), F.try_element_at("values", n)))
    return answers.select("target_id", error.alias("error"), F.when(error.isNull(), filled).alias("text"))
