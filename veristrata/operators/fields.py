"""The fields that a value is searched by: what it is compared with, its period and baseline, population, item and dimension, each with where it comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.legacy import granularity, resolved_absolute
from ..functions.period import let, publication_bucket, shift_period
from . import routing, text

# How a comparison, the other side of one, a period, a span of time and an operation over periods are said.
MARKERS = {
    "YOY": r"전년\s*(?:동월|동기|같은\s*기간)?(?:\s*대비|보다)?|지난해\s*같은\s*기간(?:\s*대비|보다)?|1년\s*전(?:\s*대비|보다)?",
    "MOM": r"전월(?:\s*\([^)]*\))?(?:\s*대비|보다)?|한\s*달\s*(?:전|만에)|지난달보다",
    "QOQ": r"(?:전분기|직전\s*분기)(?:\s*대비|보다)?",
    "PERIOD_TO_PERIOD": r"(?:\d+\s*년\s*전|\d{4}년(?:\s*\d+분기|\s*\d+월)?)[^.]{0,40}?(?:비교|보다)",
}
BASELINE_ONLY = r"^\s*(?:전년\s*(?:동월|동기|같은\s*기간)?|지난해\s*같은\s*기간|1년\s*전|전월(?:\s*\([^)]*\))?|한\s*달\s*전|전분기|직전\s*분기)(?:\s*대비|보다)?\s*$"
EXPLICIT = r"(?:올해|지난해|작년)\s*\d+\s*분기|\d{4}년(?:\s*\d+\s*분기|\s*\d+\s*월)?|(?:올해|지난해|작년|지난달|이달)|(?<!\d)\d{1,2}월"
DURATION = r"^\s*(?:최근|지난)?\s*(?!(?:19|20)\d{2}\s*년(?:\s|$))\d+\s*(?:년|개월|분기|주)\s*(?:간|동안)?\s*$"
OPERATION = r"\d+\s*년\s*(?:연속|만에)|\d{4}\s*년\s*(?:이후|이래|부터)"
GOVERNING_TAIL = r"\s*기준(?:\s*으로)?\s*$"
SINCE = r"\s*(?:이후|이래|부터)"
#: How many of its own units a period is moved by, by basis and grain; one otherwise.
STEPS = {("YOY", "month"): 12, ("YOY", "quarter"): 4}


def _text(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def comparison(sentence: Column, measurement: Column, merge: bool = False) -> Column:
    """struct(basis, marker, start): the one basis that a sentence names for a change, its words and their place; else NONE, empty and null.

    Two bases are none. With ``merge`` those of the very same words count as one, the first in order of ``MARKERS``.
    """
    s = F.coalesce(sentence, F.lit(""))
    each = F.array(*[F.struct(F.lit(k).alias("basis"), F.regexp_extract(s, p, 0).alias("marker"), (F.regexp_instr(s, F.lit(p)) - 1).alias("start")) for k, p in MARKERS.items()])
    none = F.struct(F.lit("NONE").alias("basis"), F.lit("").alias("marker"), F.lit(None).cast("int").alias("start"))

    def only(found: Column) -> Column:
        place = F.transform(found, lambda x: F.concat_ws(":", x["start"], F.length(x["marker"])))
        left = F.filter(found, lambda x, i: F.array_position(place, F.concat_ws(":", x["start"], F.length(x["marker"]))) == i + 1) if merge else found
        one = F.get(left, F.lit(0))
        return F.when(F.size(left) == 1, F.struct(one["basis"].alias("basis"), F.trim(one["marker"]).alias("marker"), one["start"].alias("start"))).otherwise(none)

    return F.when(measurement.isin("CHANGE_RATE", "CHANGE_POINT"), let(F.filter(each, lambda x: x["marker"] != ""), only)).otherwise(none)


def preceding(sentence: Column, start: Column) -> Column:
    """The last explicit period before a place; empty if there is none."""
    before = F.regexp_extract_all(F.substring(sentence, F.lit(1), F.coalesce(start, F.lit(0))), F.lit(EXPLICIT), F.lit(0))
    return F.coalesce(F.trim(F.try_element_at(before, F.lit(-1))), F.lit(""))


def is_operation(raw: Column, sentence: Column) -> Column:
    """Is it a span of time, or said of several cells (for the third year, since 2001), so that it is no cell's period?"""
    flat = lambda c: F.regexp_replace(c, r"\s+", "")
    said = F.regexp_extract_all(F.coalesce(sentence, F.lit("")), F.lit(OPERATION), F.lit(0))
    meets = let(flat(raw), lambda r: F.exists(said, lambda m: F.contains(flat(m), r) | F.contains(r, flat(m))))
    return (raw != "") & (raw.rlike(f"^(?:{OPERATION})$") | raw.rlike(DURATION) | meets)


def period_pair(df: DataFrame, raw: Column, sentence: Column, measurement: Column, published: Column, fallback: Column, name: str = "pair", merge: bool = False) -> DataFrame:
    """Adds ``struct(measurement_raw, measurement, baseline_raw, baseline, basis, role)``: the cell that is claimed and the one it is compared with.

    A raw period that only names the other side (the month before) is the baseline: the measured one is then the last
    explicit period before those words, else ``fallback``, else one step after the baseline. Without any, a change
    is that of the publication's month, quarter or year. Two named periods leave the baseline empty.
    """
    step = lambda back: F.coalesce(*[F.when((F.col("_c.basis") == b) & (F.col("_grain") == g), -n if back else n) for (b, g), n in STEPS.items()], F.when(F.col("_c.basis").isin("YOY", "MOM", "QOQ"), -1 if back else 1))
    operation = _text(raw).rlike(f"^(?:{OPERATION})$")
    out = df.withColumns({"_raw": _text(raw), "_s": F.coalesce(sentence, F.lit("")), "_c": comparison(sentence, measurement, merge), "_op": operation, "_pub": published})
    out = out.withColumn("_cell", F.when(F.col("_op"), "").otherwise(F.col("_raw"))).withColumn("_other", F.col("_cell").rlike(BASELINE_ONLY))
    measured = F.when(F.col("_other"), F.coalesce(F.nullif(preceding(F.col("_s"), F.col("_c.start")), F.lit("")), _text(fallback))).otherwise(F.col("_cell"))
    out = out.withColumn("_m", measured).withColumn("_m", F.when((F.col("_c.basis") == "PERIOD_TO_PERIOD") & F.col("_m").rlike(DURATION), "").otherwise(F.col("_m")))
    compared = F.col("_c.basis") != "NONE"
    out = out.withColumn("_b", F.when(F.col("_other") & compared, F.col("_raw")).otherwise(F.col("_c.marker")))
    grain = F.coalesce(*[F.nullif(granularity(F.col(c)), F.lit("")) for c in ("_m", "_b", "_s")], F.lit("year"))
    out = out.withColumns({"_grain": grain, "_m0": resolved_absolute(F.col("_m"), F.col("_pub")), "_b0": F.when(compared & F.col("_other"), resolved_absolute(F.col("_raw"), F.col("_pub"))).otherwise("")})
    bucket = publication_bucket(F.col("_pub"), F.when(F.col("_grain").isin("month", "quarter"), F.col("_grain")).otherwise("year"))
    now = F.coalesce(
        F.nullif("_m0", F.lit("")), F.when(compared & (F.col("_b0") != ""), shift_period(F.col("_b0"), step(False))), F.when(compared & (F.col("_c.basis") != "PERIOD_TO_PERIOD"), bucket), F.lit("")
    )
    out = out.withColumn("_now", now)
    then = F.when(compared & (F.col("_c.basis") != "PERIOD_TO_PERIOD"), F.coalesce(F.nullif("_b0", F.lit("")), shift_period(F.col("_now"), step(True)), F.lit(""))).otherwise("")
    pair = F.struct(F.col("_m").alias("measurement_raw"), F.col("_now").alias("measurement"), F.col("_b").alias("baseline_raw"), then.alias("baseline"), F.col("_c.basis").alias("basis"), F.when(F.col("_op"), "DURATION_OR_RANGE").otherwise("MEASUREMENT").alias("role"))
    return out.withColumn(name, pair).drop("_raw", "_s", "_c", "_op", "_pub", "_cell", "_other", "_m", "_b", "_grain", "_m0", "_b0", "_now")


def adjacent_period(assigned: DataFrame) -> DataFrame:
    """``period_raw`` and ``period_source`` kept only where the sentence shows them; ``period_note`` tells what was done.

    A period that the sentence does not show, or that is an operation over cells, gives way to the only period that the
    values of the sentence right before show, if the sentence names no time of its own (INHERITED_ARTICLE_SCOPE); else
    one that is not shown is dropped (NOT_PRESENT), and an operation stays, as one (OPERATION).
    """
    flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    own = assigned.withColumn("_raw", _text(F.col("period_raw"))).withColumn("_op", is_operation(F.col("_raw"), F.col("sentence")))
    own = own.withColumn("_shown", (F.col("_raw") != "") & F.contains(flat(F.col("sentence")), flat(F.col("_raw"))))
    before = Window.partitionBy("article_idx").orderBy("sentence_id").rangeBetween(-1, -1)
    fit = ~F.col("_op") & F.col("_shown")
    own = own.withColumn("_kinds", F.size(F.collect_set(F.when(fit, flat(F.col("_raw")))).over(before))).withColumn("_first", F.min(F.when(fit, F.struct("char_start", F.col("_raw").alias("raw")))).over(before))
    blocked = F.coalesce(F.col("sentence"), F.lit("")).rlike(f"(?>{EXPLICIT})(?!{SINCE})")
    lost = (F.col("_raw") != "") & ~F.col("_op") & ~F.col("_shown")
    takes = (lost | F.col("_op")) & (F.col("_kinds") == 1) & ~blocked
    note = F.when(takes, "INHERITED_ARTICLE_SCOPE").when(lost, "NOT_PRESENT").when(F.col("_op"), "OPERATION")
    out = own.withColumns({"period_note": note, "operation_raw": F.when(F.col("_op"), F.col("_raw"))})
    raw = F.when(takes, F.col("_first.raw")).when(lost, "").otherwise(F.col("_raw"))
    return out.withColumns({"period_raw": raw, "period_source": F.when(takes, "INHERITED_ARTICLE_SCOPE").otherwise(F.col("period_source"))}).drop("_raw", "_op", "_shown", "_kinds", "_first")


def compose_fields(assigned: DataFrame, published: Column, merge: bool = False) -> DataFrame:
    """Adds to the values of ``roles.assign_roles`` what they are searched by, and drops nothing.

    ``label`` (the indicator without periods and head words), ``measurement``, ``direction``, ``period``,
    ``baseline``, ``basis``, ``period_role``, ``period_grain``, ``period_basis`` (EXPLICIT_SPAN, PUBLISHED_AT or
    UNRESOLVED), ``period_fallback``, ``population``, ``item``, ``dimension`` and ``projection``.
    A value in parentheses that another is held against is itself the baseline: its period is that of
    the other side of the comparison.
    """
    rows = adjacent_period(assigned.withColumn("_day", published))
    rows = rows.withColumns({"_whole": _text(F.col("indicator"))}).withColumn("_bare", text.strip_period(F.col("_whole")))
    rows = rows.withColumn("_head", routing.strip_modifiers(F.col("_bare")))
    carried = F.when(F.col("_bare") != F.col("_whole"), F.trim(F.regexp_extract("_whole", "|".join(text.PERIOD_WORDS), 0)))
    trimmed = lambda c: let(F.trim(F.regexp_replace(c, GOVERNING_TAIL, "")), lambda t: F.when(t != "", t).otherwise(F.trim(c)))
    given = F.coalesce(F.nullif(trimmed(F.col("period_raw")), F.lit("")), trimmed(carried), F.lit(""))
    rows = rows.withColumns({"label": F.col("_head.indicator"), "projection": F.size("_head.projection") > 0, "period_raw": given})
    rows = rows.withColumn("measurement", routing.measurement_type(F.col("label"), F.col("unit"), F.col("tail"))).withColumn("_spans_cells", is_operation(F.col("period_raw"), F.col("sentence")))
    # The other side of a comparison: read as a change, from the period before the comparing words.
    rows = rows.withColumn("_than", comparison(F.col("sentence"), F.lit("CHANGE_RATE"), merge))
    aside = (F.coalesce("indicator_pairing", F.lit("")) == "PARENTHESIZED_BASELINE") & (F.col("_than.basis") != "NONE")
    rows = rows.withColumn("_aside", aside)
    raw = F.when(F.col("_aside"), F.coalesce(F.nullif(preceding(F.col("sentence"), F.col("_than.start")), F.lit("")), F.col("period_raw"))).when(F.col("_spans_cells"), "").otherwise(F.col("period_raw"))
    rows = period_pair(rows, raw, F.col("sentence"), F.when(F.col("_aside"), "CHANGE_RATE").otherwise(F.col("measurement")), F.col("_day"), F.col("region_period_raw"), "_pair", merge)
    of = lambda side, other: F.when(F.col("_aside"), F.col(f"_pair.{other}") if other else F.lit("")).otherwise(F.col(f"_pair.{side}"))
    shown = of("measurement_raw", "baseline_raw")
    rows = rows.withColumns({
        "measured_raw": shown, "period": of("measurement", "baseline"), "baseline": of("baseline", None), "basis": F.when(F.col("_aside"), "NONE").otherwise(F.col("_pair.basis")),
        "period_role": F.when(F.col("_spans_cells") | F.col("operation_raw").isNotNull(), "DURATION_OR_RANGE").otherwise(F.col("_pair.role")),
    })
    region_period = _text(F.col("region_period_raw"))
    rows = rows.withColumns({
        "period_grain": granularity(F.col("measured_raw")), "period_basis": F.when(F.col("period") == "", "UNRESOLVED").when(F.col("measured_raw").rlike(r"\d{4}\s*년"), "EXPLICIT_SPAN").otherwise("PUBLISHED_AT"),
        "period_fallback": F.when((F.col("measured_raw") != "") & (F.col("measured_raw") == region_period) & (F.col("measured_raw") != F.col("period_raw")), "SOURCE_REGION_OPENING_PERIOD").otherwise("NONE"),
        "population": routing.population_terms(F.col("label"), F.col("sentence")), "item": routing.item_terms(F.col("label")), "dimension": routing.dimension_terms(F.col("label"), F.col("sentence")),
        "direction": text.value_direction(F.col("sentence"), F.col("at"), F.col("end")),
    })
    return rows.drop("_day", "_whole", "_bare", "_head", "_spans_cells", "_than", "_aside", "_pair")
