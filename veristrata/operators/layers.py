"""From articles and their layout to routed values: the layers composed, keyed by article throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import tasks_for
from . import fields, roles, routing

#: Articles of one task at most, on average.
ARTICLES = 10_000


def compose_and_route(assigned: DataFrame, articles: DataFrame, threshold: float = 0.5, tasks: int | None = None) -> DataFrame:
    """Adds the fields that a value is searched by, routing and query variants."""
    dated = assigned.repartition(tasks or tasks_for(articles, ARTICLES), "article_idx").join(articles.select("article_idx", F.to_date("date").alias("published")), "article_idx")
    out = fields.compose_fields(dated, F.col("published"))
    routed = routing.route(F.col("source_subtype"), F.col("label"), F.concat("value", "unit"), F.col("clarify"), threshold)
    variants = routing.query_variants(F.col("label"), F.coalesce(F.get("item", F.lit(0)), F.lit("")), F.col("sentence"))
    return out.withColumn("r", routed).select("*", "r.routing_class", "r.confidence", "r.reason", variants.alias("queries")).drop("r", "published")


def run_stack(articles: DataFrame, layout: DataFrame) -> DataFrame:
    """Every value of the articles with its roles, fields and route; ``layout`` as of ``roles.assign_roles``, ``articles(article_idx, article_text, date)``."""
    tasks = tasks_for(articles, ARTICLES)
    return compose_and_route(roles.assign_roles(roles.sentence_values(articles), layout, tasks), articles, tasks=tasks)


def query_register(targets: DataFrame) -> DataFrame:
    """The six search paths of every target that has text for them: indicator x 3 channels, item x 2, sentence x 1."""
    paths = [("indicator", "official"), ("indicator", "bm25"), ("indicator", "dense"), ("item", "bm25"), ("item", "dense"), ("sentence", "dense")]
    plain = F.trim(F.regexp_replace(F.regexp_replace("sentence", r"[-−]?\d[\d,.]*", " "), r"\s+", " "))
    words = {"indicator": F.col("indicator"), "item": F.col("item"), "sentence": plain}
    rows = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("channel"), words[r].alias("query")) for r, c in paths])
    return targets.select("target_id", F.explode(rows).alias("x")).select("target_id", "x.*").where(F.coalesce(F.trim("query"), F.lit("")) != "")
