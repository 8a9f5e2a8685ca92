"""Cells of official facts: exact lookup, series of periods, and findings about a series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_cell(plans: DataFrame, cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each plan with the one cell at its coordinates: CELL_RESOLVED, NO_CELL or MULTIPLE_CELLS (and no value).

    A null coordinate in a plan leaves that axis open. Plans are split by which axes they leave
    open (at most ``2 ** len(keys)`` ways, of which the driver reads the ones met); each part is an
    equi-join on all given axes with cells counted by these axes, so no join multiplies rows.
    """
    settled = []
    for way in plans.select(*[F.col(k).isNull().alias(k) for k in keys]).distinct().collect():
        given = [k for k in keys if not way[k]]
        mine = plans.where(reduce(lambda a, b: a & b, [F.col(k).isNull() == F.lit(bool(way[k])) for k in keys]))
        counts = cells.groupBy(*given).agg(F.count(value).alias("n_cells"), F.min(value).alias("cell_value"))
        settled.append(mine.join(counts, given, "left") if given else mine.crossJoin(counts))  # without any axis: one row of counts
    if not settled:
        settled = [plans.join(cells.groupBy(*keys).agg(F.count(value).alias("n_cells"), F.min(value).alias("cell_value")), keys, "left")]
    n = F.coalesce("n_cells", F.lit(0))
    status = F.when(n == 0, "NO_CELL").when(n > 1, "MULTIPLE_CELLS").otherwise("CELL_RESOLVED")
    done = [x.select(*plans.columns, n.cast("bigint").alias("n_cells"), F.when(n == 1, F.col("cell_value")).alias("cell_value"), status.alias("cell_status")) for x in settled]
    return reduce(lambda a, b: a.unionByName(b), done)


def month_periods(first: Column, last: Column, step: int = 1) -> Column:
    """All months from first to last, ``step`` apart; empty if reversed."""
    return F.when(first <= last, F.sequence(first, last, F.expr(f"interval {step} months"))).otherwise(F.array().cast("array<date>"))


def range_cells(expected: DataFrame, cells: DataFrame, series: str, period: str) -> DataFrame:
    """For each series of ``expected(series, period)``: are exactly these periods there, once each?

    DUPLICATED before MISSING before UNEXPECTED; a full outer join of the two sets.
    """
    counted = cells.groupBy(series, period).agg(F.count("*").alias("n"))
    wanted = expected.select(series, period).distinct().withColumn("wanted", F.lit(True))
    both = wanted.join(counted, [series, period], "full_outer")
    out = both.groupBy(series).agg(
        F.count_if(F.col("wanted") & F.col("n").isNull()).alias("missing"), F.count_if(F.col("wanted") & (F.col("n") > 1)).alias("duplicated"), F.count_if(F.col("wanted").isNull()).alias("unexpected")
    )
    status = F.when(F.col("duplicated") > 0, "RANGE_CELLS_DUPLICATED").when(F.col("missing") > 0, "RANGE_CELLS_MISSING").when(F.col("unexpected") > 0, "RANGE_CELLS_UNEXPECTED").otherwise("RANGE_RESOLVED")
    return out.withColumn("status", status)


def year_ago(cells: DataFrame, series: list[str], month: str, value: str) -> DataFrame:
    """Adds ``base``: the value twelve months before, by an equi-join on the shifted month (gaps stay null)."""
    past = cells.select(*series, F.add_months(month, 12).cast("date").alias(month), F.col(value).alias("base"))
    return cells.join(past, [*series, month], "left")


def yoy_streak(cells: DataFrame, series: list[str], month: str, value: str) -> DataFrame:
    """Adds ``streak``: how many months in a row, this one included, are above the month a year before."""
    up = F.coalesce(F.col(value) > F.col("base"), F.lit(False))
    in_time = Window.partitionBy(*series).orderBy(month)
    runs = year_ago(cells, series, month, value).withColumn("up", up).withColumn("run", F.sum(F.when(F.col("up"), 0).otherwise(1)).over(in_time))
    within = Window.partitionBy(*series, "run").orderBy(month)
    return runs.withColumn("streak", F.when(F.col("up"), F.sum(F.col("up").cast("int")).over(within)).otherwise(0).cast("bigint")).drop("run", "up")


def month_max_since(cells: DataFrame, series: list[str], month: str, value: str) -> DataFrame:
    """Adds ``is_max``: strictly above the same month of every earlier year; null without an earlier one."""
    earlier = Window.partitionBy(*series, F.month(month)).orderBy(month).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("is_max", F.col(value) > F.max(value).over(earlier))


def yoy_max_since(cells: DataFrame, series: list[str], month: str, value: str, rate: bool) -> DataFrame:
    """Adds ``change`` to the year before (a rate by its absolute value, null at 0) and ``is_max``: strictly the highest so far."""
    based = year_ago(cells, series, month, value)
    change = F.try_divide(F.col(value) - F.col("base"), F.abs("base")) if rate else F.col(value) - F.col("base")
    earlier = Window.partitionBy(*series).orderBy(month).rowsBetween(Window.unboundedPreceding, -1)
    changed = based.withColumn("change", change)
    return changed.withColumn("is_max", F.col("change") > F.max("change").over(earlier))


def period_coverage(claims: DataFrame, coverage: DataFrame, key: list[str]) -> DataFrame:
    """Claims ``(…, freq, ord)`` with the least coverage ``(…, freq, lo, hi)`` that holds them, else a reason.

    An equi-join on the table's key with the bounds as residual; one aggregation settles all.
    """
    own = claims.columns
    c = coverage.select(*key, F.col("freq").alias("c_freq"), "lo", "hi")
    same = F.col("freq") == F.col("c_freq")
    joined = claims.join(c, key, "left")
    out = joined.groupBy(*own).agg(
        F.min(F.when(same & F.col("ord").between(F.col("lo"), F.col("hi")), F.struct("lo", "hi"))).alias("hit"), F.count_if(same).alias("same"), F.count("c_freq").alias("any")
    )
    reason = F.when(F.col("hit").isNotNull(), "COVERED").when(F.col("any") == 0, "PROFILE_INCOMPLETE").when(F.col("same") == 0, "FREQUENCY_MISMATCH").otherwise("OUT_OF_RANGE")
    return out.select(*own, "hit.lo", "hit.hi", reason.alias("reason"))


def annual_change(cells: DataFrame, series: list[str], year: str, value: str) -> DataFrame:
    """Adds ``change`` and ``rate`` (per cent of the absolute baseline) to the year before, where there is one."""
    past = cells.select(*series, (F.col(year) + 1).alias(year), F.col(value).alias("base"))
    return cells.join(past, [*series, year]).withColumn("change", F.col(value) - F.col("base"))


def primary_target(rows: DataFrame, by: list[str]) -> DataFrame:
    """``(…, target_id, siblings, baseline, error)``: of each unit ``by`` the level of the one series that has one level, some changes, and one common baseline.

    ``rows(…, sentence, family, period, measurement, baseline, target_id)``. None or several such
    series: PRIMARY_TARGET_AMBIGUOUS, and no target.
    """
    moved = F.col("measurement").isin("CHANGE_POINT", "CHANGE_RATE")
    groups = rows.where(moved | (F.col("measurement") == "LEVEL")).groupBy(*by, "sentence", "family", "period").agg(
        F.count_if(F.col("measurement") == "LEVEL").alias("levels"), F.min(F.when(F.col("measurement") == "LEVEL", F.col("target_id"))).alias("level"), F.count_if(moved).alias("siblings"),
        F.count_distinct(F.when(moved, F.coalesce("baseline", F.lit("")))).alias("bases"), F.min(F.when(moved, F.coalesce("baseline", F.lit("")))).alias("base"),
    )
    good = groups.where("levels = 1 AND siblings > 0 AND bases = 1 AND base <> ''")
    one = good.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct("level", "siblings", "base")).alias("g"))
    out = rows.select(*by).distinct().join(one, by, "left")
    sure = F.coalesce("n", F.lit(0)) == 1
    return out.select(*by, F.when(sure, F.col("g.level")).alias("target_id"), F.when(sure, F.col("g.siblings")).alias("siblings"), F.when(sure, F.col("g.base")).alias("baseline"), F.when(~sure, "PRIMARY_TARGET_AMBIGUOUS").alias("error"))
