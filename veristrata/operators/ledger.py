"""Event ledgers, newest records, evaluation metrics, partitions and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_state(events: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """The last state of each key by a total order: one aggregation, no correlated subquery."""
    return events.groupBy(key).agg(F.max(F.struct(*order, F.col(state).alias("s"))).alias("m")).select(key, F.col("m.s").alias("state"), *[F.col(f"m.{c}").alias(c) for c in order])


def first_and_latest(events: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    at = F.struct(*order, F.col(state).alias("s"))
    return events.groupBy(key).agg(F.min(at)["s"].alias("first_state"), F.max(at)["s"].alias("last_state"), F.count("*").alias("n_events"))


def stale(latest: DataFrame, open_state: str, at: str, now: Column, lease_seconds: int) -> DataFrame:
    """Keys whose last state is still open after the lease: to be closed as UNKNOWN."""
    return latest.where((F.col("state") == open_state) & (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col(at).cast("timestamp")) > lease_seconds))


def keep_latest(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("pos") <= k)


def freshness(at: Column, now: Column, max_age_seconds: int) -> Column:
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))
    return F.when(at.isNull(), "MISS").when(age <= max_age_seconds, "FRESH").otherwise("STALE")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def binary_prf(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """Counts, precision, recall and F1, zero where undefined, rounded to six places."""
    tp, fp, fn = (F.count_if(c) for c in (truth & predicted, ~truth & predicted, truth & ~predicted))
    counted = df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return _with_prf(counted)


def _with_prf(counted: DataFrame) -> DataFrame:
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counted.withColumn("precision", F.round(p, 6)).withColumn("recall", F.round(r, 6)).withColumn("f1", F.round(_ratio(2 * p * r, p + r), 6))


def per_label_prf(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One against the rest for each label of either side, in one pass over the confusion counts."""
    pairs = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    sides = F.when(F.col(truth).eqNullSafe(F.col(predicted)), F.array(F.struct(F.col(truth).alias("label"), F.lit("tp").alias("k")))).otherwise(
        F.array(F.struct(F.col(truth).alias("label"), F.lit("fn").alias("k")), F.struct(F.col(predicted).alias("label"), F.lit("fp").alias("k")))
    )
    rows = pairs.select("n", F.explode(sides).alias("x")).where("x.label IS NOT NULL")
    total = lambda k: F.coalesce(F.sum(F.when(F.col("x.k") == k, F.col("n"))), F.lit(0)).cast("bigint").alias(k)
    return _with_prf(rows.groupBy(F.col("x.label").alias("label")).agg(total("tp"), total("fp"), total("fn")))


def macro_prf(per_label: DataFrame) -> DataFrame:
    """Means of the scores of all labels ``(label, tp, fp, fn)``, rounded once; the sums are of decimals, so their order does not matter."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    scores = {"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)}
    mean = lambda c: F.round(F.coalesce(F.sum(c.cast("decimal(17,15)")).cast("double") / F.count("*"), F.lit(0.0)), 6)
    return per_label.agg(F.count("*").alias("labels"), *[mean(c).alias(n) for n, c in scores.items()])


def counts_by(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each column apart, in one pass: ``(column, value, n)``."""
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(parts).alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("n"))


def errors(*rules: tuple[str, Column]) -> Column:
    """The codes of all rules that a row breaks, in order; a rule that is null is not broken."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules]))


def terminal_partition(targets: DataFrame, rows: DataFrame, key: str, priority: Column, taxonomy: Column) -> DataFrame:
    """Exactly one row a target: the most terminal one; targets without any are MISSING, rows without a target are ORPHAN."""
    best = rows.groupBy(key).agg(F.min(F.struct(priority.alias("p"), taxonomy.alias("t"))).alias("b"), F.count("*").alias("n"))
    both = targets.select(key, F.lit(True).alias("known")).join(best, key, "full_outer")
    cls = F.when(F.col("known").isNull(), "ORPHAN").when(F.col("b").isNull(), "MISSING").otherwise(F.col("b.t"))
    return both.select(key, cls.alias("terminal"), F.coalesce("n", F.lit(0)).alias("n"))


def inventory_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with their multiplicity: ``side`` is EXTRA or MISSING."""
    columns = left.columns
    tagged = left.withColumn("_w", F.lit(1)).unionByName(right.withColumn("_w", F.lit(-1)))
    net = tagged.groupBy(*columns).agg(F.sum("_w").alias("w")).where("w <> 0")
    return net.select(*columns, F.when(F.col("w") > 0, "EXTRA").otherwise("MISSING").alias("side"), F.abs("w").alias("n"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def article_summary(answers: DataFrame, numbers: DataFrame, values: DataFrame, article: str) -> DataFrame:
    """``(article, answers, verdicts, blockers, numbers, covered)``: counts by verdict and by reason of a hold, and how many numbers of the text some value covers.

    ``answers(article, verdict, blocker)``, ``numbers(article, surface)``, ``values(article, value_text)``;
    a number is covered if it holds a value of its article, or a value holds it, commas aside. Counts
    only: nothing is said about the article as a whole.
    """
    tally = lambda c: answers.where(F.col(c).isNotNull()).groupBy(article, c).agg(F.count("*").alias("n")).groupBy(article).agg(F.array_sort(F.collect_list(F.struct(c, "n"))).alias(f"{c}s"))
    plain = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(","), F.lit(""))
    held = values.groupBy(article).agg(F.collect_set(F.nullif(plain(F.col("value_text")), F.lit(""))).alias("held"))  # one article's values
    near = lambda v: F.contains(v, plain(F.col("surface"))) | F.contains(plain(F.col("surface")), v)
    told = numbers.join(held, article, "left").withColumn("c", F.coalesce(F.exists("held", near), F.lit(False)))
    coverage = told.groupBy(article).agg(F.count("*").alias("numbers"), F.count_if("c").alias("covered"))
    total = answers.groupBy(article).agg(F.count("*").alias("answers"))
    out = total.join(tally("verdict"), article, "left").join(tally("blocker"), article, "left").join(coverage, article, "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(article, zero("answers"), "verdicts", "blockers", zero("numbers"), zero("covered"))


def routing_eval(gold: DataFrame, routed: DataFrame, key: list[str], positive: str) -> DataFrame:
    """One row: counts of ``gold(…, judged_class)`` held against ``routed(…, routing_class)``, precision, recall, F1, and how many of the blocked were rightly so.

    Gold rows without a class do not count; a missing prediction is a miss if gold is positive.
    """
    rows = gold.where(F.coalesce(F.trim("judged_class"), F.lit("")) != "").join(routed.select(*key, "routing_class"), key, "left")
    g, p, there = F.col("judged_class") == positive, F.coalesce(F.col("routing_class") == positive, F.lit(False)), F.col("routing_class").isNotNull()
    counted = rows.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p & there).alias("tn"), F.count_if(~there).alias("missing"))
    return _with_prf(counted).withColumn("abstention_precision", F.round(_ratio(F.col("tn"), F.col("tn") + F.col("fn")), 6))


def metrics_all(rows: DataFrame) -> DataFrame:
    """One row over ``(status, gold_*, pred_*, latency_ms, tokens)``: detection, class accuracy and macro scores, exact rates, units with a denominator of at least one, latency and tokens.

    Scores count rows that are ok, sums of cost all rows.
    """
    ok = rows.where("status = 'ok'")
    same = lambda f: F.coalesce(F.col(f"gold_{f}").eqNullSafe(F.col(f"pred_{f}")), F.lit(False))
    named = (F.coalesce("gold_unit", F.lit("")) != "") | (F.coalesce("pred_unit", F.lit("")) != "")
    rate = lambda c: F.round(_ratio(F.count_if(c), F.count("*")), 6)
    exact = ok.agg(F.count("*").alias("rows_ok"), rate(same("claim_class")).alias("class_accuracy"), rate(same("source_scope")).alias("scope_exact"), rate(same("source_role")).alias("role_exact"), F.round(F.count_if(named & same("unit")) / F.greatest(F.count_if(named), F.lit(1)), 6).alias("unit_exact"))
    detection = binary_prf(ok, F.col("gold_is_claim"), F.col("pred_is_claim")).select(*[F.col(c).alias(f"claim_{c}") for c in ("precision", "recall", "f1")])
    macro = macro_prf(per_label_prf(ok, "gold_claim_class", "pred_claim_class")).select(*[F.col(c).alias(f"class_macro_{c}") for c in ("precision", "recall", "f1")])
    cost = rows.agg(F.count("*").alias("rows_total"), F.round(F.sum("latency_ms"), 3).alias("total_latency_ms"), F.sum("tokens").alias("total_tokens"))
    return cost.crossJoin(exact).crossJoin(detection).crossJoin(macro)  # one row each
