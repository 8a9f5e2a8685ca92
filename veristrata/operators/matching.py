"""Binding a claim to a table's cells: items and axis values by label, defaults, all assignments, and what decides among them.

Claims ``(target_id, indicator, unit, region, population)``, candidates ``(target_id, table_key, rank)``,
items ``(table_key, itm_id, itm_nm, unit)``, values ``(table_key, obj_id, obj_nm, level, value_id, value_name, value_unit)``.
Labels are looked up once for each different indicator, in an index of all labels, then joined by table key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of geographic axes, and of a value that stands for the whole country (fixed values).
GEOGRAPHIC, WHOLE = ("행정구역", "지역", "시도"), ("전국", "전체", "총계", "계")
#: Roles of slots, and reasons of a projection without an answer.
EMPTY_STRINGS = "array<string>"


def loose(text: Column) -> Column:
    """A label without case, white space and light punctuation."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\-_./:(),]+", ""))


def base_label(label: Column) -> Column:
    """A label without what stands in brackets at its end."""
    return F.trim(F.regexp_replace(label, r"\s*\([^()]*\)\s*$", ""))


def labels_of(label: Column, aliases: list[tuple[str, str]], bracketed: bool = True) -> Column:
    """Ways to say a label, each with its rule: as it is; without its bracket; with an alias for a word of it."""
    way = lambda rule, text: F.struct(F.lit(rule).alias("rule"), loose(text).alias("said"))
    base = base_label(label)
    ways = [way("EXACT_LABEL", label)]
    if bracketed:
        ways.append(F.when(base != F.trim(label), way("BRACKET_BASE", base)))
    ways += [F.when(F.contains(base, F.lit(canonical)), way("SEMANTIC_ALIAS", F.replace(base, F.lit(canonical), F.lit(common)))) for canonical, common in aliases]
    return F.filter(F.array_compact(F.array(*ways)), lambda w: w["said"] != "")


def spoken(claims: DataFrame, candidates: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """``(target_id, table_key, *keys, rule, start, size)``: what of its candidates' labels each claim's ``surface`` says.

    ``labels(table_key, *keys, ways)`` are of all tables. The different labels are an index: each different surface is cut into the
    pieces that are as long as some label, and each piece is looked up once, by an equi-join, however many
    candidates there are; what it says is then joined to the labels of the candidates' tables. Of one label the first way counts, at its first place.
    """
    ways = labels.select("table_key", *keys, F.posexplode("ways").alias("way", "w")).select("table_key", *keys, "way", "w.rule", "w.said")
    known = ways.select("said").distinct()
    sizes = sorted(r["n"] for r in known.select(F.length("said").alias("n")).distinct().collect())  # lengths of labels: at most the longest
    if not sizes:
        known, sizes = known.limit(0), [1]
    surface = F.col("surface")
    cuts = F.flatten(F.transform(F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.length(surface)), lambda n: F.transform(F.sequence(F.lit(1), F.length(surface) - n + 1), lambda i: F.struct(F.substring(surface, i, n).alias("said"), (i - 1).alias("start")))))
    pieces = claims.select("surface").where(surface != "").distinct().select("surface", F.explode(cuts).alias("c")).select("surface", "c.said", "c.start")
    heard = pieces.join(known, "said", "left_semi").groupBy("surface", "said").agg(F.min("start").alias("start"))
    asked = candidates.select("target_id", "table_key").join(claims.select("target_id", "surface"), "target_id").join(heard, "surface")
    met = asked.join(ways, ["table_key", "said"])
    first = met.groupBy("target_id", "table_key", *keys).agg(F.min(F.struct("way", "rule", "start", F.length("said").alias("size"))).alias("h"))
    return first.select("target_id", "table_key", *keys, "h.rule", "h.start", "h.size")


def item_match(claims: DataFrame, candidates: DataFrame, items: DataFrame, aliases: list[tuple[str, str]]) -> DataFrame:
    """``(target_id, table_key, itm_id, item_unit, rule, start, size)``: items whose label the indicator says; the only item of a table if it says none.

    A candidate without either is one row with the rule NO_SUBSPAN_MATCH and no item. Places count loose characters.
    """
    said = claims.select("target_id", loose(F.col("indicator")).alias("surface"))
    offered = items.select("table_key", "itm_id", F.col("unit").alias("item_unit"), labels_of(F.col("itm_nm"), aliases).alias("ways"))
    found = spoken(said, candidates, offered, ["itm_id", "item_unit"])
    # One row a table: its items, and the one if it is the only one.
    tables = items.groupBy("table_key").agg(F.count("*").alias("n"), F.min(F.struct("itm_id", F.col("unit").alias("item_unit"))).alias("only"))
    rest = candidates.select("target_id", "table_key").join(said.select("target_id"), "target_id").join(found.select("target_id", "table_key").distinct(), ["target_id", "table_key"], "left_anti").join(tables, "table_key", "left")
    alone = F.coalesce(F.col("n") == 1, F.lit(False))
    others = rest.select("target_id", "table_key", F.when(alone, F.col("only.itm_id")).alias("itm_id"), F.when(alone, F.col("only.item_unit")).alias("item_unit"), F.when(alone, "SINGLETON_INVENTORY").otherwise("NO_SUBSPAN_MATCH").alias("rule"))
    return found.unionByName(others, allowMissingColumns=True)


def dim_match(claims: DataFrame, candidates: DataFrame, values: DataFrame, aliases: list[tuple[str, str]], nationwide: bool = True) -> DataFrame:
    """``(target_id, table_key, obj_id, level, value_id, value_unit, rule, start, size)``: values of each axis that a claim names.

    The claim's region or population names a value by its whole label; the indicator by holding it,
    where a hit strictly inside another of its axis does not count. An axis that nothing names takes
    its only value if the indicator holds the axis's name, or, if it is geographic and the claim has
    no region, the one value for the whole country (DISCLOSED_NATIONWIDE_DEFAULT). An axis without
    any is one row with the rule UNBOUND and no value.
    """
    said = claims.select("target_id", loose(F.col("indicator")).alias("surface"), loose(F.col("region")).alias("of_region"), loose(F.col("population")).alias("of_population"))
    asked = candidates.select("target_id", "table_key").join(said, "target_id")
    label = loose(F.col("value_name"))
    hits = spoken(said, candidates, values.select("table_key", "obj_id", "value_id", "value_unit", labels_of(F.col("value_name"), aliases).alias("ways")), ["obj_id", "value_id", "value_unit"])
    named = values.select("table_key", "obj_id", "value_id", "value_unit", label.alias("label")).where("label <> ''")
    atoms = F.explode(F.array(*[F.struct(F.lit(i).alias("order"), F.lit(rule).alias("atom"), F.col(c).alias("label")) for i, (rule, c) in enumerate((("REGION", "of_region"), ("POPULATION", "of_population")))]))
    by_atom = asked.select("target_id", "table_key", atoms.alias("a")).select("target_id", "table_key", "a.*").where("label <> ''").join(named, ["table_key", "label"]).select("target_id", "table_key", "obj_id", "value_id", "value_unit", F.struct("order", "atom").alias("by"))
    key = ["target_id", "table_key", "obj_id", "value_id"]
    both = hits.unionByName(by_atom, allowMissingColumns=True).groupBy(*key).agg(F.max("value_unit").alias("value_unit"), F.min("by")["atom"].alias("atom"), F.max(F.struct("rule", "start", "size")).alias("hit"))
    ends = F.struct(F.col("hit.start").alias("a"), (F.col("hit.start") + F.col("hit.size")).alias("b"))
    # At most the values of one axis that an indicator says, so each is held against the others of its axis.
    met = both.withColumn("spans", F.collect_set(F.when(F.col("atom").isNull(), ends)).over(Window.partitionBy("target_id", "table_key", "obj_id")))
    inside = F.exists("spans", lambda s: (s["a"] <= F.col("hit.start")) & (s["b"] >= F.col("hit.start") + F.col("hit.size")) & (s["b"] - s["a"] > F.col("hit.size")))
    bound = met.where(F.col("atom").isNotNull() | ~inside).select(*key, "value_unit", F.coalesce("atom", "hit.rule").alias("rule"), "hit.start", "hit.size")
    # One row an axis: its values, the only one, and the one for the whole country.
    whole, value = label.isin(*WHOLE), F.struct("value_id", "value_unit")
    axes = values.groupBy("table_key", "obj_id").agg(
        F.min("obj_nm").alias("obj_nm"), F.min("level").alias("level"), F.count("*").alias("n"), F.min(value).alias("only"), F.count_if(whole).alias("wholes"), F.min(F.when(whole, value)).alias("whole")
    )
    found = bound.join(axes.select("table_key", "obj_id", "level"), ["table_key", "obj_id"])
    open_axes = asked.join(axes, "table_key").join(bound.select("target_id", "table_key", "obj_id").distinct(), ["target_id", "table_key", "obj_id"], "left_anti")
    name = loose(F.col("obj_nm"))
    geographic = reduce(lambda a, b: a | b, [F.contains(name, F.lit(w)) for w in GEOGRAPHIC]) & (F.col("of_region") == "")
    single = (F.col("n") == 1) & F.contains("surface", name) & (name != "")
    country = F.lit(nationwide) & geographic & (F.col("wholes") == 1)
    taken = lambda c: F.when(single, F.col(f"only.{c}")).when(country, F.col(f"whole.{c}")).alias(c)
    rule = F.when(single, "AXIS_SINGLETON").when(country, "DISCLOSED_NATIONWIDE_DEFAULT").otherwise("UNBOUND")
    rest = open_axes.select("target_id", "table_key", "obj_id", "level", taken("value_id"), taken("value_unit"), rule.alias("rule"))
    columns = ["target_id", "table_key", "obj_id", "level", "value_id", "value_unit", "rule", "start", "size"]
    return found.select(*columns).unionByName(rest, allowMissingColumns=True).select(*columns)


def assignment_product(claims: DataFrame, item_hits: DataFrame, dim_hits: DataFrame) -> DataFrame:
    """``(target_id, table_key, itm_id, value_ids, series_unit, reason, signature)``: every item with one value of every axis, in order of level.

    The choices of one candidate are gathered by axis into one row, and multiplied there. An
    assignment is refused with a reason if an axis has no value, units conflict or differ from the
    claim's, or the same words of the indicator are used twice; else its signature names it.
    """
    choice = F.struct("value_id", "value_unit", F.when(~F.col("rule").isin("REGION", "POPULATION"), F.struct("start", "size")).alias("span"), F.col("rule").alias("rule"))
    axes = dim_hits.groupBy("target_id", "table_key", "level", "obj_id").agg(F.array_sort(F.collect_set(choice)).alias("choices"))
    per = axes.groupBy("target_id", "table_key").agg(F.array_sort(F.collect_list(F.struct("level", "obj_id", "choices"))).alias("axes"))
    kind = per.schema["axes"].dataType.elementType["choices"].dataType.simpleString()
    start = F.array(F.array().cast(kind)).cast(f"array<{kind}>")
    many = F.aggregate(F.transform("axes", lambda a: a["choices"]), start, lambda done, c: F.flatten(F.transform(done, lambda d: F.transform(c, lambda x: F.concat(d, F.array(x))))))
    picked = per.select("target_id", "table_key", F.explode(many).alias("picked"))
    both = item_hits.withColumnRenamed("rule", "item_rule").withColumnRenamed("start", "item_start").withColumnRenamed("size", "item_size").join(picked, ["target_id", "table_key"], "left")
    out = both.join(claims.select("target_id", F.col("unit").alias("claim_unit")), "target_id")
    some = F.coalesce("picked", F.array().cast(kind))
    plain = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    units = F.filter(F.concat(F.array(F.coalesce("item_unit", F.lit(""))), F.transform(some, lambda x: F.coalesce(x["value_unit"], F.lit("")))), lambda u: F.trim(u) != "")
    spans = F.filter(F.concat(F.array(F.when(F.col("item_start").isNotNull(), F.struct(F.col("item_start").alias("start"), F.col("item_size").alias("size")))), F.transform(some, lambda x: x["span"])), lambda s: s["start"].isNotNull())
    ordered = F.array_sort(spans)
    reused = F.exists(F.zip_with(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))), lambda b, a: a["start"] + a["size"] > b["start"]), lambda x: x)
    unbound = F.exists(some, lambda x: x["value_id"].isNull())
    out = out.withColumn("series_unit", F.get(units, F.lit(0)))
    reason = (
        F.when(F.col("itm_id").isNull(), "ITEM_MISSING").when(unbound, "DIMENSION_MISSING").when(F.size(F.array_distinct(F.transform(units, plain))) > 1, "UNIT_CONFLICT")
        .when((plain(F.col("claim_unit")) != "") & (plain(F.col("series_unit")) != "") & (plain(F.col("claim_unit")) != plain(F.col("series_unit"))), "UNIT_MISMATCH").when(reused, "SPAN_REUSE")
    )
    ids = F.transform(some, lambda x: x["value_id"])
    signature = F.concat_ws("|", "table_key", "itm_id", F.array_join(ids, ","))
    return out.select("target_id", "table_key", "itm_id", ids.alias("value_ids"), "series_unit", reason.alias("reason"), F.when(reason.isNull(), signature).alias("signature"))


def resolve_top(projections: DataFrame, candidates: DataFrame, k: int = 50, titled: str | None = None) -> DataFrame:
    """Projections of each target's first ``k`` candidates; if a candidate's title fits (a boolean column), only those that fit."""
    ranked = candidates.where(F.col("rank") <= k)
    if titled:
        any_fits = F.max(F.col(titled).cast("int")).over(Window.partitionBy("target_id"))
        ranked = ranked.withColumn("_any", any_fits).where((F.col("_any") == 0) | F.col(titled)).drop("_any")
    return projections.join(ranked.select("target_id", "table_key"), ["target_id", "table_key"], "left_semi")


def resolve_monthly(projections: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(target_id, status, reason, signature, receipt)``: as unique resolution, but held unless every candidate's profile is COMPLETE.

    ``profiles(target_id, table_key, status)``; the receipt is a hash of the candidates that were met, in order.
    """
    whole = profiles.groupBy("target_id").agg(F.bool_and(F.coalesce(F.col("status") == "COMPLETE", F.lit(False))).alias("whole"), F.sha2(F.array_join(F.array_sort(F.collect_set("table_key")), ",").cast("binary"), 256).alias("receipt"))
    found = projections.groupBy("target_id").agg(F.count_distinct("signature").alias("n"), F.min("signature").alias("signature"))
    out = whole.join(found, "target_id", "left")
    reason = F.when(~F.col("whole"), "PROFILE_COVERAGE_INCOMPLETE").when(F.col("n") > 1, "MULTIPLE_COMPATIBLE_SERIES").when(F.coalesce("n", F.lit(0)) == 0, "NO_COMPATIBLE_SERIES")
    return out.select("target_id", F.when(reason.isNull(), "QUERY_READY").otherwise("HOLD").alias("status"), reason.alias("reason"), F.when(reason.isNull(), F.col("signature")).alias("signature"), "receipt")


def slot_diagnostics(dim_hits: DataFrame, values: DataFrame) -> DataFrame:
    """``(target_id, table_key, obj_id, status, options)``: is each axis resolved, ambiguous or missing, and which labels it offers if it is not resolved."""
    held = dim_hits.groupBy("target_id", "table_key", "obj_id").agg(F.count_distinct("value_id").alias("n"))
    offered = values.groupBy("table_key", "obj_id").agg(F.array_sort(F.collect_set("value_name")).alias("offered"))
    status = F.when(F.col("n") == 1, "RESOLVED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("MISSING")
    out = held.join(offered, ["table_key", "obj_id"], "left")
    return out.select("target_id", "table_key", "obj_id", status.alias("status"), F.when(status == "RESOLVED", F.array().cast(EMPTY_STRINGS)).otherwise(F.coalesce("offered", F.array().cast(EMPTY_STRINGS))).alias("options"))


def multi_question(labels: DataFrame, slots: DataFrame, targets: DataFrame, most: int = 20) -> DataFrame:
    """``(target_id, role, options, kind)``: what to ask about a target with several answers.

    ``labels(target_id, role, label)`` are those of its answers: the first role, by name, with more
    than one label is asked for; else the options of its first slot that is not resolved; else a free
    text. More than ``most`` options are searched, not listed.
    """
    by_role = labels.groupBy("target_id", "role").agg(F.array_sort(F.collect_set("label")).alias("options")).where(F.size("options") > 1)
    first = by_role.groupBy("target_id").agg(F.min(F.struct("role", "options")).alias("a"))
    open_slots = slots.where((F.col("status") != "RESOLVED") & (F.size("options") > 0)).groupBy("target_id").agg(F.min(F.struct(F.col("obj_id").alias("role"), "options")).alias("b"))
    out = targets.select("target_id").distinct().join(first, "target_id", "left").join(open_slots, "target_id", "left")
    options = F.coalesce("a.options", "b.options", F.array().cast(EMPTY_STRINGS))
    kind = F.when(F.size(options) == 0, "FREE_TEXT").when(F.size(options) > most, "SEARCHABLE").otherwise("LIST")
    return out.select("target_id", F.coalesce("a.role", "b.role").alias("role"), options.alias("options"), kind.alias("kind"))


def official_unit(item_unit: Column, value_units: Column) -> Column:
    """The one unit that the chosen values name; else the item's; else empty."""
    named = F.array_distinct(F.filter(F.transform(value_units, lambda u: F.trim(F.coalesce(u, F.lit("")))), lambda u: u != ""))
    return F.when(F.size(named) == 1, F.get(named, F.lit(0))).otherwise(F.trim(F.coalesce(item_unit, F.lit(""))))


def period_only_identity(a: DataFrame, b: DataFrame, by: str, same: list[str], period: list[str]) -> DataFrame:
    """``(by, identical, moved)``: do two plans agree in everything but their period, and does the period differ?"""
    mark = lambda cs: F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(cs)])).cast("binary"), 256)
    x = a.select(by, mark(same).alias("x"), mark(period).alias("px"))
    y = b.select(by, mark(same).alias("y"), mark(period).alias("py"))
    return x.join(y, by).select(by, (F.col("x") == F.col("y")).alias("identical"), (F.col("px") != F.col("py")).alias("moved"))


def baseline_plan(plans: DataFrame, year: Column) -> DataFrame:
    """Annual plans moved to an earlier year, all else unchanged; an error code instead where the plan is not annual or the year not earlier."""
    now = F.col("period").try_cast("int")
    error = F.when(F.col("freq") != "Y", "BASELINE_NOT_ANNUAL").when(now.isNull() | ~F.col("period").rlike(r"^\d{4}$"), "PERIOD_MALFORMED").when(year.isNull() | (year >= now), "BASELINE_NOT_EARLIER")
    moved = F.when(error.isNull(), F.lpad(year.cast("string"), 4, "0"))
    return plans.withColumn("_e", error).withColumn("period", moved).withColumn("error", F.col("_e")).drop("_e")


def family_groups(rows: DataFrame, family: Column) -> DataFrame:
    """Members of each article, sentence, family of indicators and period, as sorted target ids; groups of one too."""
    return rows.groupBy("article", "sentence", family.alias("family"), "period").agg(F.array_sort(F.collect_set("target_id")).alias("members"), F.count("*").alias("n"))


def cell_memo(requests: DataFrame, keys: list[str], fetch) -> tuple[DataFrame, DataFrame]:
    """Answers for all requests, each different plan being fetched once; and ``(requests, fetched, hits)``."""
    counted = requests.groupBy(*keys).agg(F.count("*").alias("_asked"))
    answers = fetch(counted.select(*keys))
    stats = counted.agg(F.coalesce(F.sum("_asked"), F.lit(0)).alias("requests"), F.count("*").alias("fetched"))
    return requests.join(answers, keys, "left"), stats.withColumn("hits", F.col("requests") - F.col("fetched"))
