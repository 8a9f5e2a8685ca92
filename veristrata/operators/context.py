"""Context carried along sentences or turns: as-of inheritance, look-back windows, pointer chains."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.period import let


def inherit(df: DataFrame, by: list[str], order: str, value: Column, name: str) -> DataFrame:
    """Adds the nearest earlier non-null ``value`` of the group, and the position it comes from."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(value.isNotNull(), F.struct(F.col(order).alias("at"), value.alias("v"))), ignorenulls=True).over(before)
    return df.withColumn("_i", last).withColumn(name, F.col("_i.v")).withColumn(f"{name}_from", F.col("_i.at")).drop("_i")


def look_back(df: DataFrame, by: list[str], order: str, term: Column, rows: int = 3) -> DataFrame:
    """Adds ``context`` and ``context_status``: the only distinct term of the last rows, or why there is none."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(-rows, -1)
    seen = F.array_sort(F.collect_set(term).over(window))
    out = df.withColumn("_s", seen)
    status = F.when(F.size("_s") == 1, "RESOLVED").when(F.size("_s") > 1, "AMBIGUOUS").otherwise("MISSING")
    return out.withColumn("context", F.when(F.size("_s") == 1, F.col("_s")[0])).withColumn("context_status", status).drop("_s")


def resolve_context(df: DataFrame, by: list[str], order: str, own: Column, term: Column, title: Column, rows: int = 3) -> DataFrame:
    """Adds ``context`` and ``context_status``: a row's own term (EXPLICIT); else the only term of the last rows (RESOLVED), or several (AMBIGUOUS); else the title's (REFERENT_CANDIDATE); else MISSING."""
    marked = look_back(df.withColumns({"_own": own, "_title": title}), by, order, term, rows)
    status = F.when(F.col("_own").isNotNull(), "EXPLICIT").when(F.col("context_status") != "MISSING", F.col("context_status")).when(F.col("_title").isNotNull(), "REFERENT_CANDIDATE").otherwise("MISSING")
    context = F.when(status == "EXPLICIT", F.col("_own")).when(status == "REFERENT_CANDIDATE", F.col("_title")).otherwise(F.col("context"))
    return marked.withColumns({"context": context, "context_status": status}).drop("_own", "_title")


def region_chain(layout: DataFrame, depth: int = 50) -> DataFrame:
    """For each sentence the sentence that opens its region, found along pointers; null for a cycle, a gap or more than 50 hops.

    ``layout(article, sid, opens, governing)``, one row a sentence. An article's pointers are
    gathered into one row, and doubled there: a pointer's pointer takes it twice as far, so six
    rounds reach 50 hops. One shuffle, however long the chains and however many the articles.
    """
    nodes = layout.groupBy("article").agg(F.array_sort(F.collect_list(F.struct("sid", F.coalesce("opens", F.lit(False)).alias("opens"), "governing"))).alias("nodes"))
    placed = nodes.withColumn("sids", F.transform("nodes", lambda x: x["sid"]))
    jump = F.transform("nodes", lambda x, i: F.when(x["opens"], i).otherwise(F.nullif(F.array_position("sids", x["governing"]).cast("int"), F.lit(0)) - 1))
    hops = F.transform("nodes", lambda x: F.when(x["opens"], 0).when(x["governing"].isNotNull(), 1))

    def twice(s: Column, _: Column) -> Column:
        return F.struct(
            F.transform(s["jump"], lambda j: F.get(s["jump"], j)).alias("jump"), F.transform(s["hops"], lambda h, i: h + F.get(s["hops"], F.get(s["jump"], i))).alias("hops")
        )

    rounds = max(1, (depth - 1).bit_length())
    ended = placed.withColumn("end", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(jump.alias("jump"), hops.alias("hops")), twice))
    region = lambda i: let(F.get("nodes", F.get("end.jump", i)), lambda last: F.when(last["opens"] & (F.get("end.hops", i) <= depth), last["sid"]))
    rows = F.transform("nodes", lambda x, i: F.struct(x["sid"].alias("sid"), region(i).alias("region")))
    return ended.select("article", F.explode(F.array_distinct(rows)).alias("r")).select("article", "r.sid", "r.region")


def walk_tree(edges: DataFrame) -> DataFrame:
    """``(node, depth)`` of every node reached from the roots of ``edges(parent, child)``, those with a null parent; each once, at its least depth.

    One join a level, without a limit of levels; each level is checkpointed, so a lost executor repeats one level at most.
    """
    links = edges.distinct()
    level = checkpointed(links.where("parent IS NULL").select(F.col("child").alias("node"), F.lit(0).alias("depth")).distinct())
    seen, depth = level, 0
    while level.head(1):
        depth += 1
        after = links.join(level.select("node"), F.col("parent") == F.col("node")).select(F.col("child").alias("node"), F.lit(depth).alias("depth")).distinct()
        level = checkpointed(after.join(seen.select("node"), "node", "left_anti"))
        seen = checkpointed(seen.unionByName(level))
    return seen


def checkpointed(df: DataFrame) -> DataFrame:
    """Lineage cut in the shared folder that the cluster names; on one machine, where none is set, in a temporary one."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="veristrata-steps-"))
    return df.checkpoint()


def nearest_scope(values: DataFrame, scopes: DataFrame, by: list[str]) -> DataFrame:
    """Each value ``(…, vid, a, b)`` with the scope ``(…, sa, sb, label)`` of least gap; none if all of several gaps are equal.

    A scope that alone touches the value is SPAN_CONTAINS; ties go to the first scope.
    """
    gap = F.greatest(F.lit(0), F.col("sa") - F.col("b"), F.col("a") - F.col("sb"))
    joined = values.join(scopes, by, "left").withColumn("gap", F.when(F.col("sa").isNotNull(), gap))
    out = joined.groupBy(*by, "vid", "a", "b").agg(F.min(F.struct("gap", "sa", "label")).alias("best"), F.count("sa").alias("n"), F.count_distinct("gap").alias("gaps"), F.count_if(F.col("gap") == 0).alias("touching"))
    flat = (F.col("n") > 1) & (F.col("gaps") == 1)
    pairing = F.when(F.col("n") == 0, "NONE").when(F.col("touching") == 1, "SPAN_CONTAINS").when(flat, "AMBIGUOUS").otherwise("NEAREST")
    return out.select(*by, "vid", F.when(pairing.isin("SPAN_CONTAINS", "NEAREST"), F.col("best.label")).alias("label"), pairing.alias("pairing"))


def prune_subsumed(spans: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Spans without those strictly inside another of the same group.

    In order of start (longest first) a span is inside an earlier one exactly if the running
    maximum of ends before it reaches its end, so one window does instead of comparing pairs.
    Equal spans do not contain each other.
    """
    distinct_spans = spans.select(*by, a, b).distinct()
    before = Window.partitionBy(*by).orderBy(a, F.desc(b)).rowsBetween(Window.unboundedPreceding, -1)
    kept = distinct_spans.withColumn("_m", F.max(b).over(before)).where(F.col("_m").isNull() | (F.col("_m") < F.col(b))).drop("_m")
    return spans.join(kept, [*by, a, b], "left_semi")


def region_evidence(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Of region spans ``(…, start, end, text)`` of each sentence: the only one is EXACT, several are AMBIGUOUS with their surfaces in order; a sentence without any has no row."""
    spans = candidates.groupBy(*by).agg(F.collect_set(F.struct("start", "end", "text")).alias("spans"))
    one = F.when(F.size("spans") == 1, F.get("spans", F.lit(0)))
    surfaces = F.array_sort(F.array_distinct(F.filter(F.transform("spans", lambda s: s["text"]), lambda t: t != "")))
    return spans.select(*by, F.when(F.size("spans") == 1, "EXACT").otherwise("AMBIGUOUS").alias("status"), one["text"].alias("surface"), one["start"].alias("start"), one["end"].alias("end"), F.when(F.size("spans") > 1, surfaces).alias("surfaces"))


def local_indicator(values: DataFrame, scopes: DataFrame, by: list[str]) -> DataFrame:
    """``(…, vid, label, pairing)``: the nearest scope's label; else, where scopes and values are equally many, the one at the value's place; else the last one not behind it.

    ``values(…, vid, a, b)``, ``scopes(…, sa, sb, label)``; scopes without a label do not count.
    """
    usable = scopes.where(F.coalesce(F.trim("label"), F.lit("")) != "")
    near = nearest_scope(values, usable, by)
    gathered = usable.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("sa", "label"))).alias("scopes"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("a", "vid")) - 1
    counted = values.withColumn("place", place).withColumn("n_values", F.count("*").over(Window.partitionBy(*by)))
    out = near.join(counted.select(*by, "vid", "place", "n_values"), [*by, "vid"]).join(gathered, by, "left")
    n = F.coalesce(F.size("scopes"), F.lit(0))
    at = F.get("scopes", F.least(F.col("place"), n - 1))["label"]
    pairing = F.when(n == 0, "NONE").when(F.col("label").isNotNull(), F.col("pairing")).when(n == F.col("n_values"), "POSITIONAL").otherwise("COUNT_MISMATCH_FALLBACK")
    return out.select(*by, "vid", F.when(n > 0, F.coalesce("label", at)).alias("label"), pairing.alias("pairing"))


def assignment_summary(assigned: DataFrame) -> DataFrame:
    """``(what, name, n)``: values in all, with an indicator, a source and a period, and their numbers by source of indicator and by subtype; one pass."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    marks = F.array_compact(F.array(
        F.struct(F.lit("values").alias("what"), F.lit("").alias("name")), *[F.when(filled(c), F.struct(F.lit(f"with_{n}").alias("what"), F.lit("").alias("name"))) for c, n in (("indicator", "indicator"), ("source_subtype", "source_subtype"), ("period_raw", "period"))],
        F.struct(F.lit("indicator_source").alias("what"), F.col("indicator_source").alias("name")), F.struct(F.lit("source_subtype").alias("what"), F.when(filled("source_subtype"), F.col("source_subtype")).otherwise("(없음)").alias("name")),
    ))
    return assigned.select(F.explode(marks).alias("m")).groupBy("m.what", "m.name").agg(F.count("*").alias("n"))


def article_period(rows: DataFrame, usable: Column, blocked: Column) -> DataFrame:
    """Adds ``period`` and ``period_from``: a row's own period, else the only usable one of the sentence right before, unless its sentence names a time (``blocked``).

    ``rows(article, sid, period_raw, …)``; periods that differ by white space only are one.
    """
    flat = F.regexp_replace(F.coalesce("period_raw", F.lit("")), r"\s+", "")
    given = rows.where((flat != "") & usable).groupBy("article", (F.col("sid") + 1).alias("sid")).agg(F.count_distinct(flat).alias("_n"), F.min("period_raw").alias("_raw"))
    out = rows.join(given, ["article", "sid"], "left")
    inherits = (flat == "") & ~blocked & (F.col("_n") == 1)
    return out.select(*rows.columns, F.when(flat != "", F.col("period_raw")).when(inherits, F.col("_raw")).alias("period"), F.when(flat != "", "OWN").when(inherits, "INHERITED_ARTICLE_SCOPE").otherwise("NONE").alias("period_from"))
