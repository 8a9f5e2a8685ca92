"""Whose figure it is, whether it can be checked, and consistency of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pages import nfkc

# Fixed values of the vocabulary.
TIME_UNITS = ("년", "개월", "월", "분기", "일", "주", "시간", "분", "초")
NO_SOURCE = ("", "불명", "없음", "미상", "null", "none", "nan", "보고서", "자료", "통계", "결과", "조사", "발표", "보도자료", "관련 기관", "관련 기관 보도자료", "관련 통계자료", "알려짐")
FOREIGN = r"(?i)미국|미 정부|미 노동부|영국|중국|일본|독일|프랑스|캐나다|러시아|유럽연합|EU|연준|FOMC|IMF|OECD|UN|세계은행|국제통화기금|국제에너지기구|국제원자력기구|IAEA|해외|국제기구"
#: A domestic public body by the end of its name.
PUBLIC = ("정부", "위원회", "부처", "공단", "공사", "청", "부", "원", "지자체", "시청", "도청", "구청", "군청", "국책연구기관", "연구원", "대학교", "대학", "법원", "국회")


def plain_name(name: Column) -> Column:
    """A name in compatible form (NFKC), without white space and light punctuation; null and its spellings are empty."""
    t = F.trim(nfkc(F.coalesce(name, F.lit(""))))
    return F.when(F.lower(t).isin("nan", "none", "null"), "").otherwise(F.regexp_replace(t, r"[\s·ㆍ,.'\"`]+", ""))


def source_scope(claims: DataFrame, orgs: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """Adds ``scope`` and ``org_id``: exact dictionary name, then verified alias, then foreign, public and private marks.

    ``orgs(org_id, org_name)`` and ``aliases(alias, org_name)`` are joined by the plain name; they
    are dictionaries of a few hundred entries, and Spark broadcasts them by their size.
    """
    by_name = orgs.select(plain_name(F.col("org_name")).alias("_n"), "org_id").dropDuplicates(["_n"])
    other = aliases.select(plain_name(F.col("alias")).alias("_a"), plain_name(F.col("org_name")).alias("_n2")).dropDuplicates(["_a"])
    other = other.join(by_name, F.col("_n2") == F.col("_n")).select("_a", F.col("org_id").alias("_alias_id"))
    own = claims.withColumn("_p", plain_name(F.col(name)))
    found = own.join(by_name, F.col("_p") == F.col("_n"), "left").join(other, F.col("_p") == F.col("_a"), "left")
    raw = F.trim(F.coalesce(F.col(name), F.lit("")))
    none = (F.col("_p") == "") | F.lower(raw).isin(*NO_SOURCE) | F.lower("_p").isin(*NO_SOURCE)
    hit = F.coalesce("org_id", "_alias_id")
    scope = (
        F.when(none, "불명").when(hit.isNotNull(), "KOSIS등재").when(raw.rlike(FOREIGN), "해외기관").when(raw.rlike(f"(?:{'|'.join(PUBLIC)})$"), "공식기관_비KOSIS").otherwise("민간기관")
    )
    return found.select(*claims.columns, scope.alias("scope"), F.when(~none, hit).alias("org_id"))


def org_candidates(scoped: DataFrame) -> DataFrame:
    """Of rows with ``scope`` and ``org_id`` the one sure candidate, with its confidence; rows without one stay, with none."""
    sure = (F.col("scope") == "KOSIS등재") & F.col("org_id").isNotNull()
    return scoped.withColumn("candidates", F.when(sure, F.array(F.struct("org_id", F.lit(1.0).alias("confidence")))).otherwise(F.array().cast("array<struct<org_id:string,confidence:double>>")))


def prefilter(is_claim: Column, claim_class: Column, scope: Column) -> Column:
    """검증시도 (try), 강등 (demote) or 제외 (drop) by claim, class and source; null is undecided, not false."""
    s = F.coalesce(scope, F.lit(""))
    return (
        F.when(~is_claim, "제외")
        .when((claim_class == "집계통계") & (s == "KOSIS등재"), "검증시도")
        .when((claim_class == "집계통계") & s.isin("공식기관_비KOSIS", "불명", ""), "강등")
        .when(claim_class == "집계통계", "제외")
        .when(F.coalesce(claim_class, F.lit("")) == "", "강등")
        .otherwise("제외")
    )


def verify_scope(unit: Column) -> Column:
    return F.when(F.trim(F.coalesce(unit, F.lit(""))).isin(*TIME_UNITS), "time_ref").otherwise("unknown")


def normalize_label(is_claim: Column, claim_class: Column, noise: Column, classes: list[str], noises: list[str]) -> Column:
    """struct: class and noise made consistent with is_claim and the vocabulary; what was changed stays in ``*_raw``."""
    claim = F.coalesce(is_claim, F.lit(False))
    cls, why = F.nullif(claim_class, F.lit("")), F.nullif(noise, F.lit(""))
    bad_class, bad_noise = cls.isNotNull() & ~cls.isin(*classes), why.isNotNull() & ~why.isin(*noises)
    return F.struct(
        F.when(claim & ~bad_class, cls).alias("claim_class"), F.when(~claim, F.when(bad_noise, "기타").otherwise(why)).alias("noise_reason"),
        F.when((claim & bad_class) | (~claim & cls.isNotNull()), cls).alias("claim_class_raw"), F.when((claim & why.isNotNull()) | (~claim & bad_noise), why).alias("noise_reason_raw"),
        ((claim & why.isNotNull()) | (~claim & cls.isNotNull())).alias("consistency_fix"),
    )


def clamp(value: Column, vocabulary: list[str], fallback: str) -> Column:
    return F.when(value.isin(*vocabulary), value).otherwise(fallback)


def select_target(rows: DataFrame, query: str, by: list[str]) -> DataFrame:
    """Of each group the row whose indicator lies in the query, by score (100 + its length, 30 for equal years, 20 for the measurement), then id."""
    fits = rows.where(F.contains(F.col(query), F.col("indicator")) & (F.col("indicator") != ""))
    years = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(19\d{2}|20\d{2})"), 1)))
    same = years(F.col(query)) == years(F.col("period"))
    wants_rate = F.col(query).rlike("증가율|감소율|상승률|하락률")
    score = 100 + F.length("indicator") + F.when(same, 30).otherwise(0) + F.when(wants_rate == (F.col("measurement") == "CHANGE_RATE"), 20).otherwise(0)
    ranked = fits.withColumn("score", score).withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "target_id")))
    return ranked.where("_n = 1").drop("_n")


def article_date(rows: DataFrame, articles: DataFrame) -> DataFrame:
    """Adds the article's date where the sentence is in its text, and an error where the article is unknown."""
    a = articles.select("article_idx", F.col("article_text").alias("_t"), F.col("date").alias("_d"), F.lit(True).alias("_known"))
    out = rows.join(a, "article_idx", "left")
    held = F.contains(F.col("_t"), F.col("sentence")) & (F.coalesce(F.col("_d").cast("string"), F.lit("")) != "")
    return out.select(*rows.columns, F.when(held, F.col("_d")).alias("article_date"), F.when(F.col("_known").isNull(), "ARTICLE_UNKNOWN").alias("error"))


def clarify(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Fields overridden by at most three answers ``(target_id, role, value)``; two values for one role conflict."""
    per_role = answers.groupBy("target_id", "role").agg(F.count_distinct("value").alias("k"), F.min("value").alias("value"))
    merged = per_role.groupBy("target_id").agg(F.max("k").alias("k"), F.count("*").alias("n"), F.map_from_entries(F.collect_list(F.struct("role", "value"))).alias("m"))
    out = rows.join(merged, "target_id", "left")
    fields = [c for c in rows.columns if c != "target_id"]
    error = F.when(F.col("k") > 1, "CLARIFICATION_CONFLICT").when(F.col("n") > 3, "CLARIFICATION_TOO_MANY")
    return out.select("target_id", *[F.coalesce(F.when(error.isNull(), F.try_element_at("m", F.lit(c))), F.col(c)).alias(c) for c in fields], error.alias("error"))


def plan_inventory(plans: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each plan ``(target_id, table_key, itm_id, freq, ord, levels)`` with the codes of what its profile, one a table, does not hold.

    No plan meets all items or values of its table: a profile's items and values are rows of their own, joined by what a plan names.
    """
    c = F.col
    items = profiles.select("table_key", F.explode("items").alias("i")).select("table_key", c("i.itm_id").cast("string").alias("_item")).distinct()
    vals = profiles.select("table_key", F.posexplode("dimensions").alias("_at", "d")).select("table_key", "_at", F.explode("d.vals").alias("x")).select("table_key", "_at", c("x.value_id").alias("_value")).distinct()
    tables = profiles.select("table_key", "periods", (c("items").isNull() & c("periods").isNull()).alias("_bare"), F.size("dimensions").alias("_axes"))
    # Each different choice of levels is looked up once; how many of its values their axes hold.
    chosen = plans.select("table_key", "levels").distinct().select("table_key", "levels", F.posexplode("levels").alias("_at", "_value"))
    met = chosen.join(vals, ["table_key", "_at", "_value"]).groupBy("table_key", "levels").agg(F.count("*").alias("_met"))
    joined = (
        plans.withColumn("_item", c("itm_id").cast("string")).join(items.withColumn("_known", F.lit(True)), ["table_key", "_item"], "left")
        .join(met, ["table_key", "levels"], "left").join(tables, "table_key", "left")
    )
    no_item = c("_known").isNull()
    no_period = ~F.coalesce(F.exists("periods", lambda p: (p["freq"] == c("freq")) & c("ord").between(p["lo"], p["hi"])), F.lit(False))
    axes = F.greatest(F.coalesce("_axes", F.lit(0)), F.lit(0))
    wrong_levels = F.size("levels") != axes
    no_value = c("levels").isNotNull() & (F.coalesce("_met", F.lit(0)) < F.greatest(F.size("levels"), axes))
    codes = F.array(
        F.when(F.coalesce("_bare", F.lit(True)), F.lit("TABLE_ID_MISMATCH")), F.when(no_item, F.lit("ITEM_ID_OR_UNIT")), F.when(~c("freq").isin("Y", "M", "Q"), F.lit("PERIOD_PARAMETER")).when(no_period, F.lit("PERIOD_RANGE")),
        F.when(wrong_levels, F.lit("OBJ_LEVEL_KEYS")), F.when(no_value, F.lit("OBJ_LEVEL_VALUE")),
    )
    return joined.select("target_id", F.array_compact(codes).alias("errors"))
