"""The stricter monthly projection: options of every axis are propagated before any product is taken.

Each candidate is one row with its axes and the options of each. What a period, a region, a
population or a derived count rules out goes first; then options that overlap all options of some other axis (arc
consistency). Axes that nothing ties to another only multiply the number of series, so the
product is taken of the tied ones alone, and a candidate with 10^8 series is counted, not listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.legacy import unit_compatible
from .matching import base_label, dim_match, item_match, loose

#: Why a candidate has no series, most telling first.
REASONS = ("PERIOD_INVALID", "PROFILE_INCOMPLETE", "FREQUENCY_MISMATCH", "PERIOD_OUT_OF_RANGE", "REGION_UNBOUND", "POPULATION_UNBOUND", "MULTIPLE_COMPATIBLE_SERIES", "ITEM_MISSING", "DIMENSION_MISSING", "SPAN_REUSE", "UNIT_MISMATCH")
#: What makes a subject the count of it (fixed value).
COUNT = "수"
MONTHLY = r"^[0-9]{4}-(0[1-9]|1[0-2])$"
_CHOICE = "struct<id:string,unit:string,s:int,e:int>"
_AXES = f"array<struct<level:int,obj:string,choices:array<{_CHOICE}>>>"
_PARTIAL = "array<struct<picked:array<struct<obj:string,id:string>>,used:array<struct<s:int,e:int>>,units:array<string>>>"


def derived_counts(claims: DataFrame, candidates: DataFrame, values: DataFrame) -> DataFrame:
    """``(target_id, table_key, obj_id, level, value_id, value_unit)``: values whose label is the count of the claim's subject, with its unit in brackets at the end."""
    in_brackets = F.trim(F.regexp_extract("value_name", r"\(([^()]*)\)\s*$", 1))
    counted = values.where((in_brackets != "") & (in_brackets == F.trim(F.coalesce("value_unit", F.lit(""))))).select("table_key", "obj_id", "level", "value_id", "value_unit", loose(base_label(F.col("value_name"))).alias("label"))
    asked = candidates.select("target_id", "table_key").join(claims.where(F.coalesce("subject", F.lit("")) != "").select("target_id", loose(F.concat("subject", F.lit(COUNT))).alias("label")), "target_id")
    return asked.join(counted, ["table_key", "label"]).select("target_id", "table_key", "obj_id", "level", "value_id", "value_unit")


def _apart(c: Column, d: Column) -> Column:
    """Do two options not use the same place of the indicator? One without a place uses none."""
    return c["s"].isNull() | d["s"].isNull() | (c["e"] <= d["s"]) | (d["e"] <= c["s"])


def consistent(axes: Column) -> Column:
    """Axes without the options that overlap all options of another axis."""
    kept = lambda a, i: F.filter(a["choices"], lambda c: F.forall(F.filter(axes, lambda b, j: j != i), lambda b: F.exists(b["choices"], lambda d: _apart(c, d))))
    return F.transform(axes, lambda a, i: F.struct(a["level"].alias("level"), a["obj"].alias("obj"), kept(a, i).alias("choices"))).cast(_AXES)


def count_series(options: DataFrame, claim_unit: str) -> DataFrame:
    """Adds ``n`` (a double), ``signature`` (if n is 1) and ``reason`` (if n is 0) to ``options(…, table_key, axes, claim_unit)``, whose first axis is the item.

    A stated unit must be compatible with that of the series, which the item and the chosen values must agree on.
    """
    once = options.withColumn("axes", consistent(F.col("axes")))
    axes = F.col("axes")
    blank = lambda u: F.trim(F.coalesce(u, F.lit(""))) == ""
    free = lambda a, i: (a["level"] > 0) & F.forall(a["choices"], lambda c: blank(c["unit"]) & F.forall(F.filter(axes, lambda b, j: j != i), lambda b: F.forall(b["choices"], lambda d: _apart(c, d))))
    split = once.withColumn("axes", consistent(axes)).withColumn("tied", F.filter("axes", lambda a, i: ~free(a, i))).withColumn("n_free", F.aggregate(F.filter("axes", free), F.lit(1.0), lambda n, a: n * F.size(a["choices"])))

    def take(done: Column, axis: Column) -> Column:
        """Every partial series with every option of one more tied axis that uses none of its places."""
        more = lambda p: F.transform(F.filter(axis["choices"], lambda c: F.forall(p["used"], lambda u: _apart(c, u))), lambda c: F.struct(
            F.concat(p["picked"], F.array(F.struct(axis["obj"].alias("obj"), c["id"].alias("id")))).alias("picked"), F.concat(p["used"], F.array(F.struct(c["s"].alias("s"), c["e"].alias("e")))).alias("used"),
            F.concat(p["units"], F.filter(F.array(F.trim(c["unit"])), lambda u: ~blank(u))).alias("units"),
        ))
        return F.flatten(F.transform(done, more)).cast(_PARTIAL)

    start = F.array(F.struct(F.array().cast("array<struct<obj:string,id:string>>").alias("picked"), F.array().cast("array<struct<s:int,e:int>>").alias("used"), F.array().cast("array<string>").alias("units"))).cast(_PARTIAL)
    tried = split.withColumn("whole", F.aggregate("tied", start, take))
    same = lambda us: F.size(F.array_distinct(F.transform(us, lambda u: F.lower(F.regexp_replace(u, r"\s+", ""))))) <= 1
    # The values' unit goes before the item's, which is the first.
    fits = lambda p: same(p["units"]) & (blank(F.col(claim_unit)) | (F.size(p["units"]) > 0) & F.coalesce(unit_compatible(F.trim(F.col(claim_unit)), F.element_at(p["units"], -1)), F.lit(False)))
    held = tried.withColumn("fitting", F.filter("whole", fits))
    n = F.col("n_free") * F.size("fitting")
    id_of = lambda a: F.coalesce(F.get(F.filter(F.get("fitting", F.lit(0))["picked"], lambda p: p["obj"] == a["obj"]), 0)["id"], F.get(a["choices"], 0)["id"])
    ids = F.transform("axes", id_of)
    signature = F.concat_ws("|", "table_key", F.get(ids, 0), F.array_join(F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))), ","))
    reason = F.when(n > 0, None).when(F.size("whole") == 0, "SPAN_REUSE").otherwise("UNIT_MISMATCH")
    return held.select(*options.columns, n.alias("n"), F.when(n == 1, signature).alias("signature"), reason.alias("reason"))


def project_monthly(claims: DataFrame, candidates: DataFrame, items: DataFrame, values: DataFrame, coverage: DataFrame, aliases: list[tuple[str, str]], nationwide: bool = False) -> DataFrame:
    """``(target_id, table_key, n, signature, reason)``, one row a candidate: how many series fit, which one if it is one, and why none does.

    ``claims(target_id, indicator, subject, unit, region, population, period)``; a period is a month, ``YYYY-MM``, and nothing
    coarser stands in for it. A stated region or population must name a value, and is then its axis's only option.
    If the count of the subject is a value of several axes, the candidate is refused as ambiguous.
    """
    key = ["target_id", "table_key"]
    pairs = candidates.select(*key)
    month = F.coalesce(F.col("period").rlike(MONTHLY), F.lit(False))
    ranged = pairs.join(claims.select("target_id", month.alias("monthly"), F.replace("period", F.lit("-"), F.lit("")).try_cast("int").alias("ord")), "target_id").join(coverage, "table_key", "left")
    covered = ranged.groupBy(*key).agg(F.first("monthly").alias("monthly"), F.count("freq").alias("any"), F.count_if(F.col("freq") == "M").alias("months"), F.count_if((F.col("freq") == "M") & F.col("ord").between(F.col("lo"), F.col("hi"))).alias("fits"))
    when = F.when(~F.col("monthly"), "PERIOD_INVALID").when(F.col("any") == 0, "PROFILE_INCOMPLETE").when(F.col("months") == 0, "FREQUENCY_MISMATCH").when(F.col("fits") == 0, "PERIOD_OUT_OF_RANGE")
    timed = covered.select(*key, when.alias("period_reason"))
    # Candidates whose period does not fit are not matched at all.
    open_ = timed.where("period_reason IS NULL").select(*key)
    hits = dim_match(claims.select("target_id", "indicator", "region", "population"), open_, values, aliases, nationwide)
    counts = derived_counts(claims, open_, values)
    axes_of = counts.groupBy(*key).agg((F.count_distinct("obj_id") > 1).alias("ambiguous"))
    both = hits.select(*key, "obj_id", "level", "value_id", "value_unit", "rule", "start", "size").unionByName(counts.withColumn("rule", F.lit("DERIVED_COUNT")), allowMissingColumns=True)
    atom = F.col("rule").isin("REGION", "POPULATION")
    span = lambda c: F.when(atom, None).otherwise(c)  # noqa: E731 - a region or population stands at a place of its own
    option = F.struct(F.col("value_id").alias("id"), F.coalesce("value_unit", F.lit("")).alias("unit"), span(F.col("start")).cast("int").alias("s"), span(F.col("start") + F.col("size")).cast("int").alias("e"))
    axes = both.groupBy(*key, "obj_id", "level").agg(
        F.collect_set(F.when(atom, option)).alias("fixed"), F.collect_set(F.when(F.col("value_id").isNotNull() & ~atom, option)).alias("named"), F.max(F.col("rule") == "REGION").alias("region"), F.max(F.col("rule") == "POPULATION").alias("population")
    )
    # One option a value: that with a place, if it has one.
    choices = F.when(F.size("fixed") > 0, F.col("fixed")).otherwise(F.filter("named", lambda c: c["s"].isNotNull() | ~F.exists("named", lambda d: (d["id"] == c["id"]) & d["s"].isNotNull())))
    dims = axes.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("level").cast("int").alias("level"), F.col("obj_id").alias("obj"), F.array_sort(choices).alias("choices")))).alias("dims"), F.max("region").alias("has_region"), F.max("population").alias("has_population"))
    item = F.struct(F.col("itm_id").cast("string").alias("id"), F.coalesce("item_unit", F.lit("")).alias("unit"), F.col("start").cast("int").alias("s"), (F.col("start") + F.col("size")).cast("int").alias("e"))
    found = item_match(claims.select("target_id", "indicator"), open_, items, aliases).groupBy(*key).agg(F.array_sort(F.collect_set(F.when(F.col("itm_id").isNotNull(), item))).alias("items"))
    whole = open_.join(found, key, "left").join(dims, key, "left").join(axes_of, key, "left").join(claims.select("target_id", F.col("unit").alias("claim_unit"), "region", "population"), "target_id")
    said = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    lacks = (
        F.when(said("region") & ~F.coalesce("has_region", F.lit(False)), "REGION_UNBOUND").when(said("population") & ~F.coalesce("has_population", F.lit(False)), "POPULATION_UNBOUND")
        .when(F.col("ambiguous"), "MULTIPLE_COMPATIBLE_SERIES").when(F.coalesce(F.size("items"), F.lit(0)) <= 0, "ITEM_MISSING").when(F.exists("dims", lambda a: F.size(a["choices"]) == 0), "DIMENSION_MISSING")
    )
    first = F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("obj"), F.col("items").alias("choices"))).cast(_AXES)
    ready = whole.select(*key, "claim_unit", lacks.alias("lacks"), F.concat(first, F.coalesce(F.col("dims").cast(_AXES), F.array().cast(_AXES))).alias("axes"))
    counted = count_series(ready.where("lacks IS NULL"), "claim_unit").select(*key, "n", "signature", "reason")
    refused = ready.where("lacks IS NOT NULL").select(*key, F.lit(0.0).alias("n"), F.lit(None).cast("string").alias("signature"), F.col("lacks").alias("reason"))
    untimed = timed.where("period_reason IS NOT NULL").select(*key, F.lit(0.0).alias("n"), F.lit(None).cast("string").alias("signature"), F.col("period_reason").alias("reason"))
    return counted.unionByName(refused).unionByName(untimed)


def resolve(projections: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(target_id, status, reason, signature)``: ready with exactly one series over all candidates; held if a profile is not COMPLETE, if there are several, or for the best reason."""
    whole = profiles.groupBy("target_id").agg(F.bool_and(F.coalesce(F.col("status") == "COMPLETE", F.lit(False))).alias("whole"))
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason")), F.lit(0)), F.lit(99))
    total = projections.groupBy("target_id").agg(F.sum("n").alias("n"), F.min("signature").alias("signature"), F.min(F.when(F.col("reason").isNotNull(), F.struct(order.alias("o"), F.col("reason").alias("r"))))["r"].alias("why"))
    out = whole.join(total, "target_id", "left")
    reason = F.when(~F.col("whole"), "PROFILE_COVERAGE_INCOMPLETE").when(F.coalesce("n", F.lit(0.0)) > 1, "MULTIPLE_COMPATIBLE_SERIES").when(F.coalesce("n", F.lit(0.0)) == 0, F.coalesce("why", F.lit("NO_COMPATIBLE_SERIES")))
    return out.select("target_id", F.when(reason.isNull(), "QUERY_READY").otherwise("HOLD").alias("status"), reason.alias("reason"), F.when(reason.isNull(), F.col("signature")).alias("signature"))
