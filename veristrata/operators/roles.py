"""Which indicator, source, period and region hold for each value: what its own sentence says, else what governs it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.period import let
from . import context, text

#: Ends of labels that name a change, and what stands behind a value in parentheses that another is held against (fixed values).
CHANGE_ENDS = r"(?:증가율|감소율|상승률|하락률|증감률|변화율|변동률|증감폭|증가폭|감소폭|차이|증감액|증가\s*금액|감소\s*금액)$"
THAN_BEHIND = r"^\)\s*보다"
SCOPES = "array<struct<label:string,start:int,end:int>>"
#: States of a sentence's indicator that forbid to carry one into it (fixed values).
OPEN_STATES = ("MISSING", "AMBIGUOUS")


def sentence_values(articles: DataFrame) -> DataFrame:
    """One row a sentence that holds a digit: ``(article_idx, sentence_id, sentence, char_start, values, regions)``.

    ``values`` are its values with units in order of place (``at``, ``end`` within the sentence, unit
    included), ``regions`` its different region names.
    """
    s = text.sentences(articles.select("article_idx", "article_text"), "article_text").where(F.col("text").rlike(r"\p{Nd}"))  # no value without one
    found = s.select("article_idx", "sentence_id", F.col("text").alias("sentence"), "char_start", text.candidates(F.col("text")).alias("found"))
    spans = F.transform(F.filter("found", lambda c: c["kind"] == "value_unit"), lambda c: F.struct(c["char_start"].alias("at"), c["char_end"].alias("end"), c["value"].alias("value"), c["unit"].alias("unit")))
    regions = F.transform(F.filter("found", lambda c: c["facet"] == "지역"), lambda c: F.struct(c["char_start"].alias("at"), c["char_end"].alias("end"), c["text"].alias("text")))
    return found.select("article_idx", "sentence_id", "sentence", "char_start", F.array_sort(spans).alias("values"), F.array_sort(F.array_distinct(regions)).alias("regions"))


def pair_with_scope(scopes: Column, place: Column, n_values: Column, at: Column, end: Column, sentence: Column) -> Column:
    """struct(label, pairing): which of a sentence's labels belongs to the value at a place, and why.

    The only located label that touches the value (SPAN_CONTAINS); the nearest, if distances differ
    (SPAN_NEAREST, ties to the first); where all cover a value in parentheses that is followed by
    *than*, the only one that names no change (PARENTHESIZED_BASELINE); the label at the value's own
    place, if there are as many labels as values (POSITIONAL); else the last one not behind that
    place (COUNT_MISMATCH_FALLBACK). Null without labels.
    """
    gap = lambda s: F.greatest(F.lit(0), at - s["end"], s["start"] - end)
    within = (at > 0) & (F.substring(sentence, at, 1) == "(") & F.substring(sentence, end + 1, 8).rlike(THAN_BEHIND)

    def choose(located: Column, gaps: Column) -> Column:
        level = F.filter(located, lambda s: ~F.trim(s["label"]).rlike(CHANGE_ENDS))
        pick = lambda s, why: F.struct(s["label"].alias("label"), F.lit(why).alias("pairing"))
        nearest = F.get(located, (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int"))
        return (
            F.when((F.size(located) == 1) & (F.array_max(gaps) == 0), pick(F.get(located, F.lit(0)), "SPAN_CONTAINS"))
            .when(F.size(F.array_distinct(gaps)) > 1, pick(nearest, "SPAN_NEAREST"))
            .when((F.array_max(gaps) == 0) & within & (F.size(level) == 1), pick(F.get(level, F.lit(0)), "PARENTHESIZED_BASELINE"))
            .when((F.size(scopes) > 0) & (F.size(scopes) == n_values), pick(F.get(scopes, place), "POSITIONAL"))
            .when(F.size(scopes) > 0, pick(F.get(scopes, F.least(place, F.size(scopes) - 1)), "COUNT_MISMATCH_FALLBACK"))
        )

    placed = F.filter(scopes, lambda s: s["start"].isNotNull() & s["end"].isNotNull())
    return let(placed, lambda located: let(F.transform(located, gap), lambda gaps: choose(located, gaps)))


def _layout(layout: DataFrame) -> DataFrame:
    """The columns of a layout that are read, with labels as an array; ``indicator`` alone is one label without a place."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    if "scopes" in layout.columns:
        scopes = F.filter(F.coalesce(F.col("scopes").cast(SCOPES), F.array().cast(SCOPES)), lambda s: blank(s["label"]).isNotNull())
    else:
        one = F.struct(F.col("indicator").alias("label"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
        scopes = F.when(blank(F.col("indicator")).isNotNull(), F.array(one)).otherwise(F.array().cast(SCOPES))
    state = F.col("indicator_state") if "indicator_state" in layout.columns else F.lit(None).cast("string")
    return layout.select("article_idx", "sentence_id", F.coalesce("opens", F.lit(False)).alias("opens"), "governing", "subtype", scopes.alias("scopes"), state.alias("state"), blank(F.col("period_raw")).alias("own_period"))


def assign_roles(rows: DataFrame, layout: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row a value of ``sentence_values``, with what holds for it.

    ``layout(article_idx, sentence_id, opens, governing, subtype, period_raw)``, one row a sentence,
    with ``scopes`` (label, start, end within the sentence; the places may be null) or one
    ``indicator``, and optionally ``indicator_state``. A sentence may lack a row.

    indicator: the label paired with the value (LOCAL); where the sentence has none, the last label of
    the nearest earlier sentence that has any, not before the region begins (INHERITED); a label that
    names no subject, in a region, takes it from there (LOCAL_COMPOSED). Nothing is carried into a
    sentence whose indicator is MISSING or AMBIGUOUS: ``clarify`` says so.
    period: the layout's (LOCAL), else the nearest in the sentence (LOCAL_SENTENCE_FALLBACK), else
    that of the nearest earlier sentence in the region (INHERITED).
    region names: the only one of the sentence is EXACT, several are AMBIGUOUS.

    Sentences keep their values in one row up to the end, so every join and window moves sentences, not values.
    ``tasks``: how many tasks read their values, where Spark, which goes by bytes, would take too few.
    """
    key = ["article_idx", "sentence_id"]
    given = _layout(layout)
    graph = given.select(F.col("article_idx").alias("article"), F.col("sentence_id").alias("sid"), "opens", "governing")
    region = context.region_chain(graph).select(F.col("article").alias("article_idx"), F.col("sid").alias("sentence_id"), "region")
    sources = given.where("opens").select("article_idx", F.col("sentence_id").alias("region"), F.col("subtype").alias("source_subtype"), F.col("own_period").alias("region_period_raw"))
    spine = rows.join(given, key, "full_outer")
    carried = context.inherit(spine, ["article_idx"], "sentence_id", F.try_element_at("scopes", F.lit(-1))["label"], "i")
    carried = context.inherit(carried, ["article_idx"], "sentence_id", F.col("own_period"), "t")
    placed = carried.where(F.size("values") > 0).join(region, key, "left")
    placed = placed.repartition(tasks, "article_idx", "region") if tasks else placed  # the shuffle of the next join
    full = placed.join(sources, ["article_idx", "region"], "left")
    usable = lambda c: F.when(F.col("region").isNull() | (F.col(f"{c}_from") >= F.col("region")), F.col(c))
    each = full.select(
        *key, "sentence", "char_start", "region", "source_subtype", "region_period_raw", "own_period", F.coalesce("scopes", F.array().cast(SCOPES)).alias("scopes"), F.coalesce(F.col("state").isin(*OPEN_STATES), F.lit(False)).alias("clarify"),
        usable("i").alias("head"), F.col("i_from").alias("head_from"), usable("t").alias("before"), F.col("t_from").alias("before_from"), "regions", F.size("values").alias("n_values"), F.posexplode("values").alias("place", "v"),
    )
    paired = each.withColumn("p", pair_with_scope(F.col("scopes"), F.col("place"), F.col("n_values"), F.col("v.at"), F.col("v.end"), F.col("sentence"))).withColumn("near", text.period_span(F.col("sentence"), F.col("v.at")))
    local, head = F.col("p.label"), F.trim(F.coalesce("head", F.lit("")))
    fragment = local.isNotNull() & F.col("region").isNotNull() & ~text.names_a_subject(local) & (head != "") & text.names_a_subject(head)
    source = (
        F.when(fragment & ~F.col("clarify"), "LOCAL_COMPOSED").when(local.isNotNull(), "LOCAL").when(F.col("head").isNotNull() & ~F.col("clarify"), "INHERITED").otherwise("NONE")
    )
    said = paired.withColumn("indicator_source", source)
    near = F.nullif(F.col("near.raw"), F.lit(""))
    indicator = F.when(F.col("indicator_source") == "LOCAL_COMPOSED", text.compose_inherited(local, F.col("head"))).when(F.col("indicator_source") == "INHERITED", F.col("head")).otherwise(local)
    carries = lambda *of: F.col("indicator_source").isin(*of)
    a, b, one = F.col("char_start") + F.col("v.at"), F.col("char_start") + F.col("v.end"), F.size("regions") == 1
    return said.select(
        *key, "sentence", F.format_string("s%d:value_unit:%d-%d", "sentence_id", a, b).alias("span_id"), "v.value", "v.unit", a.alias("char_start"), b.alias("char_end"), F.col("v.at").alias("at"), F.col("v.end").alias("end"), F.substring("sentence", F.col("v.end") + 1, F.lit(20)).alias("tail"),
        "region", F.coalesce("source_subtype", F.lit("")).alias("source_subtype"), indicator.alias("indicator"), "indicator_source", F.when(carries("LOCAL", "LOCAL_COMPOSED"), F.col("p.pairing")).alias("indicator_pairing"),
        F.when(carries("LOCAL_COMPOSED"), local).alias("indicator_fragment"), F.when(carries("LOCAL_COMPOSED", "INHERITED"), F.col("head_from")).alias("indicator_from"), "clarify",
        F.coalesce("own_period", near, "before", F.lit("")).alias("period_raw"), F.when(F.col("own_period").isNotNull(), "LOCAL").when(near.isNotNull(), "LOCAL_SENTENCE_FALLBACK").when(F.col("before").isNotNull(), "INHERITED").otherwise("NONE").alias("period_source"),
        F.when(F.coalesce("own_period", near).isNull() & F.col("before").isNotNull(), F.col("before_from")).alias("period_from"), F.coalesce("region_period_raw", F.lit("")).alias("region_period_raw"),
        F.when(one, "EXACT").when(F.size("regions") > 1, "AMBIGUOUS").alias("region_status"), F.when(one, F.get("regions", F.lit(0))["text"]).alias("region_surface"),
        F.when(F.size("regions") > 1, F.array_sort(F.array_distinct(F.transform("regions", lambda r: r["text"])))).alias("region_candidates"),
    )
