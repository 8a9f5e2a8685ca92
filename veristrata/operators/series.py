"""Findings that sentences claim about a series: what periods they need, and whether the official cells bear them out.

``range_specs`` reads sentences, ``evaluate_ranges`` holds what they claim against cells. Both work on
all articles at once: the sentence before comes by one window, the cells by one equi-join on series and period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .binding import family_key
from .context import checkpointed

# How sentences name months, and the four findings that are read.
MONTH = r"(0?[1-9]|1[0-2])월"
DATED_MONTH = r"(?<![0-9])([0-9]{4})년\s*" + MONTH
NAMED_MONTH = r"(올해|지난)\s*" + MONTH
AS_OF_MONTH = MONTH + r"\s*기준"
STREAK = r"([0-9]{4})년\s*" + MONTH + r"부터\s*(올해|지난해|작년|[0-9]{4}년)\s*" + MONTH + r"까지\s*([0-9]+)개월\s*연속"
MONTH_MAX = r"([0-9]{4})년\s*" + MONTH + r"[^.]{0,100}?이후\s*[0-9]+년\s*만에\s*가장\s*(?:많|높|큰)"
RATE_MAX = r"([0-9]{4})년\s*통계\s*집계\s*이래"
DIFFERENCE_MAX = r"([0-9]{4})년\s*" + MONTH + r"[^.]{0,100}?이후\s*[0-9]+년\s*만에\s*가장\s*컸"
#: A sentence's own topic, one that only names a measure, and labels that do.
TOPIC = r"([^,;:()]+?)\s*(?:은|는|이|가)(?=\s|,|$)"
GENERIC_TOPIC = r"((?:증가|감소|상승|하락|증감|변화|변동)\s*(?:율|폭|량))\s*(?:은|는|이|가)(?=\s|,|$)"
GENERIC = r"^(?:증가|감소|상승|하락|증감|변화|변동)\s*(?:율|폭|량)$"


def serial(period: Column) -> Column:
    """Months since year 0 of ``YYYY-MM``; null for any other text."""
    p = F.regexp_extract(F.coalesce(period, F.lit("")), r"^([0-9]{4})-(0[1-9]|1[0-2])$", 0)
    return F.when(p != "", F.substring(p, 1, 4).cast("int") * 12 + F.substring(p, 6, 2).cast("int") - 1)


def month_of(serial_: Column) -> Column:
    return F.concat(F.lpad(F.floor(serial_ / 12).cast("string"), 4, "0"), F.lit("-"), F.lpad((serial_ % 12 + 1).cast("string"), 2, "0"))


def shift_month(period: Column, by: int) -> Column:
    """Empty for what is no month."""
    return F.coalesce(month_of(serial(period) + by), F.lit(""))


def _last(text: Column, pattern: str, group: int) -> Column:
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1)), F.lit(""))


def _year_month(year: Column, month: Column) -> Column:
    return F.when((year != "") & (month != ""), F.concat(year, F.lit("-"), F.lpad(month, 2, "0"))).otherwise("")


def named_month(qualifier: Column, month: Column, published: Column) -> Column:
    """``올해 M월`` is in the year of publication; ``지난 M월`` too, if M is before the month of publication, else in the year before."""
    year, at = F.regexp_extract(F.coalesce(published, F.lit("")), r"^([0-9]{4})-([0-9]{1,2})", 1), F.regexp_extract(F.coalesce(published, F.lit("")), r"^([0-9]{4})-([0-9]{1,2})", 2)
    ok = (year != "") & (month != "") & at.try_cast("int").between(1, 12)
    y = F.when((qualifier == "지난") & (month.try_cast("int") >= at.try_cast("int")), year.try_cast("int") - 1).otherwise(year.try_cast("int"))
    return F.when(ok, _year_month(F.lpad(y.cast("string"), 4, "0"), month)).otherwise("")


def _own_month(text: Column, published: Column, hint: Column) -> Column:
    """The month that a text speaks of: as of a month of the hint's year, else its last dated month, else its last named one. A hint's year replaces the text's."""
    hinted = lambda m, own: F.when((hint != "") & (m != ""), _year_month(F.substring(hint, 1, 4), m)).otherwise(own)
    as_of = F.regexp_extract(text, AS_OF_MONTH, 1)
    year, month = _last(text, DATED_MONTH, 1), _last(text, DATED_MONTH, 2)
    word, named = _last(text, NAMED_MONTH, 1), _last(text, NAMED_MONTH, 2)
    return (
        F.when((hint != "") & (as_of != ""), _year_month(F.substring(hint, 1, 4), as_of)).when(month != "", hinted(month, _year_month(year, month)))
        .when(named != "", hinted(named, named_month(word, named, published))).otherwise("")
    )


def _carried_month(text: Column, hint: Column) -> Column:
    """What a sentence hands on to the next: its last dated month, else, by the hint's year, the month as of which it speaks."""
    year, month, as_of = _last(text, DATED_MONTH, 1), _last(text, DATED_MONTH, 2), F.regexp_extract(text, AS_OF_MONTH, 1)
    own = F.when(month != "", F.when(hint != "", _year_month(F.substring(hint, 1, 4), month)).otherwise(_year_month(year, month)))
    return own.when((as_of != "") & (hint != ""), _year_month(F.substring(hint, 1, 4), as_of)).otherwise("")


def _family(label: Column) -> Column:
    key = family_key(label)
    flat = F.trim(F.regexp_replace(label, r"\s+", " "))
    return F.when(flat.rlike(GENERIC) | key.rlike(GENERIC), "").otherwise(key)


def with_context(sentences: DataFrame) -> DataFrame:
    """Adds ``family``, ``month`` and ``month_source`` to ``sentences(article, idx, paragraph, text, indicator, published, hint)``.

    What a sentence lacks comes from the one just before it in its paragraph: the family if it names
    none of its own (a measure alone is none), and the month if both are of one family.
    """
    before = Window.partitionBy("article").orderBy("idx")
    blank = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    t = F.coalesce("text", F.lit(""))
    topic, generic = F.trim(F.regexp_extract(t, TOPIC, 1)), F.regexp_extract(t, GENERIC_TOPIC, 1)
    rows = sentences.withColumn("hint", F.when(serial(F.col("hint")).isNotNull(), F.col("hint")).otherwise("")).select(
        "*", _family(F.coalesce(blank("indicator"), F.nullif(generic, F.lit("")), topic)).alias("_own"), _family(F.coalesce(blank("indicator"), topic)).alias("_gives"),
        _own_month(t, F.col("published"), F.col("hint")).alias("_month"), _carried_month(t, F.col("hint")).alias("_hands"),
    )
    last = rows.select("*", *[F.lag(c).over(before).alias(f"_before{c}") for c in ("_gives", "_hands")], F.lag("paragraph").over(before).eqNullSafe(F.col("paragraph")).alias("_same"), F.lag("idx").over(before).isNotNull().alias("_any"))
    # A family that the sentence before took over itself is handed on as a month's company, not as a family.
    beside = F.col("_any") & F.col("_same")
    family = F.when(F.col("_own") != "", F.col("_own")).when(beside, F.col("_before_gives")).otherwise("")
    named = last.withColumn("family", F.coalesce(family, F.lit("")))
    kin = (F.col("family") != "") & F.lag("family").over(before).eqNullSafe(F.col("family"))
    known = named.withColumn("_kin", F.coalesce(kin, F.lit(False)))
    taken = F.when(beside & F.col("_kin"), F.coalesce("_before_hands", F.lit(""))).otherwise("")
    month = F.when(F.col("_month") != "", F.col("_month")).otherwise(taken)
    source = F.when(F.col("_month") != "", "explicit").when(taken != "", "adjacent_inherited")
    return known.withColumn("month", month).withColumn("month_source", source).drop("_own", "_gives", "_month", "_hands", "_before_gives", "_before_hands", "_same", "_any", "_kin")


def range_specs(sentences: DataFrame) -> DataFrame:
    """One row for each finding that a sentence claims: ``(article, idx, operator, start, end, expected, comparison, anchor, inclusion, claim_count, family, month, month_source)``.

    expected are all periods whose cells are needed, comparison those that are compared, the anchor
    among them or not by ``inclusion``. Both are empty where the sentence's month is unknown or not the anchor's.
    """
    t = F.coalesce("text", F.lit(""))
    number = lambda p, i: F.regexp_extract(t, p, i).try_cast("int")
    at = lambda p, y=1, m=2: number(p, y) * 12 + number(p, m) - 1
    none = F.lit(None).cast("int")
    word = F.regexp_extract(t, STREAK, 3)
    # Of the words for a year, only this year and a written one give a month here.
    year = F.when(word == "올해", F.substring("published", 1, 4).try_cast("int")).when(word.endswith("년"), F.substring(word, 1, 4).try_cast("int"))
    said = {"YOY_STREAK": (STREAK, at(STREAK), number(STREAK, 5)), "MONTH_OF_YEAR_MAX_SINCE": (MONTH_MAX, at(MONTH_MAX), none), "YOY_RATE_MAX_SINCE": (RATE_MAX, number(RATE_MAX, 1) * 12 + F.col("now") % 12, none), "YOY_DIFFERENCE_MAX_SINCE": (DIFFERENCE_MAX, at(DIFFERENCE_MAX), none)}
    claims = [F.when(t.rlike(p), F.struct(F.lit(name).alias("operator"), anchor.alias("anchor_at"), (year * 12 + number(STREAK, 4) - 1 if name == "YOY_STREAK" else F.col("now")).alias("now_at"), count.alias("claim_count"))) for name, (p, anchor, count) in said.items()]
    # Most sentences claim nothing: only those that may are read closer.
    context = with_context(sentences).where(t.rlike("연속|이후|이래")).withColumn("now", serial(F.col("month")))
    each = context.select("article", "idx", "family", "month", "month_source", F.explode(F.array_compact(F.array(*claims))).alias("s")).select("*", "s.*").drop("s")
    # Where the periods begin that are needed and that are compared, in months from the anchor; all months, or the same month of each year.
    streak, rate, level = F.col("operator") == "YOY_STREAK", F.col("operator") == "YOY_RATE_MAX_SINCE", F.col("operator") == "MONTH_OF_YEAR_MAX_SINCE"
    anchor, end = F.col("anchor_at"), F.col("now_at")
    placed = each.select(
        "*", F.when(streak, 1).otherwise(12).alias("step"), (anchor - F.when(level, 0).otherwise(12)).alias("first"), (anchor + F.when(streak | rate, 0).otherwise(12)).alias("compared"),
        F.coalesce(F.when(streak, end.isNotNull()).otherwise(end % 12 == anchor % 12), F.lit(False)).alias("ok"),
    )
    periods = lambda a: F.when(F.col("ok") & (F.col(a) <= end), F.transform(F.sequence(F.col(a), F.when(F.col("ok") & (F.col(a) <= end), end).otherwise(F.col(a)), F.col("step")), month_of)).otherwise(F.array().cast("array<string>"))
    text = lambda c: F.coalesce(month_of(c), F.lit(""))
    inclusion = F.when(streak, "NONE").when(rate, "SINCE_INCLUSIVE").otherwise("AFTER_ANCHOR_EXCLUSIVE")
    return placed.select(
        "article", "idx", "operator", F.when(streak | F.col("ok"), text(F.col("first"))).otherwise("").alias("start"), F.when(F.col("ok"), text(end)).otherwise("").alias("end"), periods("first").alias("expected"), periods("compared").alias("comparison"),
        F.when(~streak, text(anchor)).alias("anchor"), inclusion.alias("inclusion"), "claim_count", "family", "month", "month_source",
    )


def evaluate_ranges(specs: DataFrame, cells: DataFrame, spec_id: list[str], series: list[str], period: str, value: str) -> DataFrame:
    """``(*spec_id, status, reason, finding)`` of ``specs(*spec_id, *series, operator, expected, comparison, claim_count, current)``.

    All expected periods must have exactly one cell before anything is said. YOY_STREAK: as many comparisons as claimed, each above
    the year before. MONTH_OF_YEAR_MAX_SINCE: the current value strictly above all others compared; YOY_DIFFERENCE_MAX_SINCE and
    YOY_RATE_MAX_SINCE: so the change to the year before (rates by cross products, without division). ``cells`` hold decimals.
    """
    specs = checkpointed(specs)  # read twice, and made of texts
    counted = cells.groupBy(*series, F.col(period).alias("_p")).agg(F.count("*").alias("_n"), F.min(value).alias("_v"))
    asked = specs.select(*spec_id, *series, "operator", F.explode("expected").alias("_p"))
    found = asked.join(counted, [*series, "_p"], "left")
    bad = F.when(F.col("_n").isNull(), "RANGE_CELLS_MISSING").when(F.col("_n") > 1, "RANGE_CELLS_DUPLICATED")
    held = found.groupBy(*spec_id).agg(
        F.map_from_entries(F.collect_list(F.struct("_p", "_v"))).alias("m"),  # the periods of one spec
        F.min(F.when(bad.isNotNull(), F.struct("_p", bad.alias("why"))))["why"].alias("first_bad"), F.max(F.col("_n") > 1).alias("twice"),
    )
    m, now = F.col("m"), F.col("current")
    # A streak is one request for all months, which shows duplicates first; the others are read month by month.
    gap = F.when((F.col("operator") == "YOY_STREAK") & F.col("twice"), "RANGE_CELLS_DUPLICATED").otherwise(F.col("first_bad"))
    has, base = lambda p: F.try_element_at(m, p), lambda p: F.try_element_at(m, shift_month(p, -12))
    up = F.forall("comparison", lambda p: has(p) > base(p))
    others = lambda better: F.array_contains("comparison", now) & F.forall("comparison", lambda p: (p == now) | better(p))
    change = lambda p: has(p) - base(p)
    highest, widest = others(lambda p: has(now) > has(p)), others(lambda p: change(now) > change(p))
    steepest = others(lambda p: change(now) * F.abs(base(p)) > change(p) * F.abs(base(now)))
    changes = F.col("operator").isin("YOY_RATE_MAX_SINCE", "YOY_DIFFERENCE_MAX_SINCE")
    reason = (
        F.when(F.size("expected") == 0, "RANGE_CLAIM_MONTH_SCOPE_AMBIGUOUS").when(gap.isNotNull(), gap)
        .when(changes & F.exists("comparison", lambda p: base(p) == 0), "RANGE_ZERO_BASELINE")
    )
    finding = (
        F.when(F.col("operator") == "YOY_STREAK", (F.size("comparison") == F.col("claim_count")) & up).when(F.col("operator") == "MONTH_OF_YEAR_MAX_SINCE", highest)
        .when(F.col("operator") == "YOY_RATE_MAX_SINCE", steepest).otherwise(widest)
    )
    out = specs.join(held, spec_id, "left").withColumn("reason", reason)
    return out.select(*spec_id, F.when(F.col("reason").isNull(), "evaluated").otherwise("not_evaluated").alias("status"), "reason", F.when(F.col("reason").isNull(), F.coalesce(finding, F.lit(False))).alias("finding"))
