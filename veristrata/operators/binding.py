"""Binding claims to cells: profiles, uniqueness, plans and what to do when there is no single answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Why a target is held, most telling first.
REASONS = ("UNIT_MISMATCH", "SPAN_REUSE", "PERIOD_OUT_OF_RANGE", "FREQUENCY_MISMATCH", "DIMENSION_MISSING", "ITEM_MISSING", "PROFILE_INCOMPLETE")


def hydrate_profile(tables: DataFrame, items: DataFrame, values: DataFrame, periods: DataFrame, key: str) -> DataFrame:
    """One nested profile a table, each part gathered by its own aggregation and joined by key, with error codes.

    ``items(key, itm_id, itm_nm, unit)``, ``values(key, obj_id, level, value_id, value_name)``,
    ``periods(key, freq, lo, hi)``. A profile has at most eight axes, of levels 1 to n.
    """
    i = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("itm_id", "itm_nm", "unit"))).alias("items"))
    axes = values.groupBy(key, "obj_id", "level").agg(F.array_sort(F.collect_list(F.struct("value_id", "value_name"))).alias("vals"), (F.count("*") > F.count_distinct("value_id")).alias("twice"))
    v = axes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("level", "obj_id", "vals"))).alias("dimensions"), F.max("twice").alias("twice"))
    p = periods.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("freq", "lo", "hi"))).alias("periods"))
    out = tables.join(i, key, "left").join(v, key, "left").join(p, key, "left")
    levels = F.transform("dimensions", lambda x: x["level"].cast("int"))
    codes = F.array(
        F.when(F.col("items").isNull(), F.lit("ITEM_MISSING")), F.when(F.col("periods").isNull(), F.lit("PERIOD_MISSING")), F.when(F.size("dimensions") > 8, F.lit("AXES_TOO_MANY")),
        F.when(levels != F.sequence(F.lit(1), F.greatest(F.size("dimensions"), F.lit(1))), F.lit("LEVELS_NOT_CONTIGUOUS")), F.when(F.col("twice"), F.lit("VALUE_ID_TWICE")),
    )
    return out.withColumn("errors", F.array_compact(codes)).drop("twice")


def unique_resolve(projections: DataFrame, target: str = "target_id") -> DataFrame:
    """``(target, signature, reason)``: one distinct signature is ready, several are held, none is held for its best reason."""
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason")), F.lit(0)), F.lit(99))
    out = projections.groupBy(target).agg(F.count_distinct("signature").alias("n"), F.min("signature").alias("signature"), F.min(F.when(F.col("signature").isNull(), F.struct(order.alias("o"), F.col("reason").alias("r")))).alias("worst"))
    ready = F.col("n") == 1
    reason = F.when(F.col("n") > 1, "MULTIPLE_COMPATIBLE_SERIES").when(~ready, F.col("worst.r"))
    return out.select(target, F.when(ready, "QUERY_READY").otherwise("HOLD").alias("status"), F.when(ready, F.col("signature")).alias("signature"), reason.alias("reason"))


def span_overlap(spans: Column) -> Column:
    """Do any two half-open spans ``(sentence, start, end)`` of one sentence overlap? Neighbours in order suffice."""
    s = F.array_sort(spans)
    pairs = F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(1))), lambda a, b: (a["sentence"] == b["sentence"]) & (a["end"] > b["start"]))
    return F.exists(pairs, lambda x: F.coalesce(x, F.lit(False)))


def series_unit(item_unit: Column, value_units: Column) -> Column:
    """struct(unit, conflict): the units named must be one; the item's is preferred as its spelling."""
    bare = lambda u: F.lower(F.regexp_replace(u, r"\s+", ""))
    named = F.filter(F.concat(F.array(item_unit), value_units), lambda u: F.coalesce(F.trim(u), F.lit("")) != "")
    conflict = F.size(F.array_distinct(F.transform(named, bare))) > 1
    return F.struct(F.when(~conflict, F.get(named, F.lit(0))).alias("unit"), conflict.alias("conflict"))


def query_plan(org: Column, tbl: Column, item: Column, freq: Column, period: Column, levels: Column) -> Column:
    """Coordinates of one cell; ``levels`` are the chosen value ids, in order of axis."""
    names = F.transform(F.sequence(F.lit(1), F.greatest(F.size(levels), F.lit(1))), lambda i: F.concat(F.lit("objL"), i.cast("string")))
    return F.struct(org.alias("org_id"), tbl.alias("tbl_id"), item.alias("itm_id"), freq.alias("prd_se"), period.alias("start_prd_de"), period.alias("end_prd_de"), F.map_from_arrays(names, levels).alias("obj_levels"))


def recovery(projections: DataFrame, target: str = "target_id", used: Column | None = None) -> DataFrame:
    """What to do next: nothing, ask, search anew (if at least 80 % of candidates miss the item, and only once) or stop."""
    ready = F.count_distinct("signature")
    miss = F.avg((F.coalesce(F.col("reason"), F.lit("")) == "ITEM_MISSING").cast("double"))
    out = projections.groupBy(target).agg(ready.alias("n"), miss.alias("miss"))
    again = (F.col("miss") >= 0.8) & ~(used if used is not None else F.lit(False))
    return out.select(target, F.when(F.col("n") == 1, "QUERY_READY").when(F.col("n") > 1, "ASK_USER").when(again, "CORRECTIVE_RETRIEVAL").otherwise("STOP").alias("action"))


def dominance(ties: DataFrame, target: str, steps: list) -> DataFrame:
    """Among tied candidates those that are first by each step in turn; ``unique`` tells if one is left."""
    left = ties
    for i, step in enumerate(steps):
        left = left.withColumn(f"_r{i}", F.rank().over(Window.partitionBy(target).orderBy(step))).where(F.col(f"_r{i}") == 1).drop(f"_r{i}")
    return left.withColumn("unique", F.count("*").over(Window.partitionBy(target)) == 1)


# Words in front of an indicator and role words at its end that do not tell series apart.
FREQUENCY_WORD, RANK_WORDS = r"^월별\s+", r"^(?:(?:기존에|과거|이전|종전)\s*)?(?:(?:가장|최고|최대|최저|최소)\s*)?(?:(?:높았던|많았던|컸던|낮았던|적었던)\s*)?"
ROLE_WORDS = (
    "증가율", "감소율", "상승률", "하락률", "증감률", "변화율", "변동률", "증가량", "감소량", "상승량", "하락량", "증감량", "변화량", "변동량", "증가폭", "감소폭", "상승폭", "하락폭", "증감폭", "변화폭", "변동폭",
    "증가 폭", "감소 폭", "상승 폭", "하락 폭", "증감 폭", "변화 폭", "변동 폭", "건수", "규모", "수준", "수",
)


def family_key(label: Column) -> Column:
    """The indicator without a word of frequency or rank in front, and without role words, taken off at the end again and again."""
    flat = F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"\s+", " "))
    head = F.regexp_replace(F.regexp_replace(flat, FREQUENCY_WORD, ""), RANK_WORDS, "")
    return F.trim(F.regexp_replace(head, rf"(?:\s*(?:{'|'.join(ROLE_WORDS)}))+$", ""))
