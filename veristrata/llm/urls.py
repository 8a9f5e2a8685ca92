"""URL filters: rules by host and path first, gradient-boosted trees on lexical features for the rest.

The trees learn from URLs that carry a label: those that a rule decides. Features are length,
depth, digits, entropy, parameters and how the URL's suffix went with labels over the whole
table (grouped counts, smoothed, all rows of the URL itself left out while learning).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast, read, ship

#: (action, host and path). A rule fits its host and all subdomains, if the path starts with its own; the longest wins.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: The most different labelled URLs that the trees are fitted on, each weighted by its rows; a hash of the URL picks them.
SAMPLE = 40_000
TREES, DEPTH, RATE, CELLS = 40, 3, 0.2, 32


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), upper, lower)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its action, null if none fits. A handful of rules is an expression, not a join."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


NUMBERS = ("length", "host_length", "depth", "dots", "digits", "digit_ratio", "entropy", "parameters", "hyphens", "secure", "last_length", "suffix_rate", "host_rate")


def lexical(url: Column, host: Column, path: Column) -> list[Column]:
    """Lexical numbers of a URL, by JVM functions; the two rates are joined to them later."""
    size = F.greatest(F.length(url), F.lit(1))
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    marks = "abcdefghijklmnopqrstuvwxyz0123456789./-_?&=%"
    shares = [(F.length(url) - F.length(F.replace(F.lower(url), F.lit(c), F.lit("")))) / size for c in marks]
    entropy = reduce(lambda a, b: a + b, [F.when(s > 0, -s * F.log(s)).otherwise(0.0) for s in shares])
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return [
        F.length(url), F.length(host), F.size(F.split(path, "/")) - 1, F.size(F.split(host, r"\.")) - 1, digits, digits / size, entropy,
        F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), F.length(url) - F.length(F.replace(url, F.lit("-"), F.lit(""))),
        url.startswith("https:").cast("int"), F.length(F.element_at(F.split(path, "/"), -1)),
    ]


class Trees:
    """Gradient-boosted regression trees for a yes-or-no label, on features cut into cells."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> None:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CELLS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        self.rate, self.depth = rate, depth
        weight = np.ones(len(y)) if weight is None else weight
        p = ((y * weight).sum() + 1) / (weight.sum() + 2)
        self.base = float(np.log(p / (1 - p)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        cells = self._cells(x)
        score = np.full(len(y), self.base)
        for _ in range(trees if len(np.unique(y)) > 1 else 0):
            chance = 1 / (1 + np.exp(-score))
            grad, curve = weight * (y - chance), weight * chance * (1 - chance) + 1e-9
            feature, limit, value = np.zeros(2**depth - 1, int), np.full(2**depth - 1, CELLS), np.zeros(2**depth)
            node = np.zeros(len(y), int)
            for level in range(depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    at = np.flatnonzero(node == k)
                    if len(at) < 2:
                        continue
                    g, h = grad[at], curve[at]
                    best = 1e-6
                    for f in range(x.shape[1]):
                        gs, hs = (np.cumsum(np.bincount(cells[at, f], w, CELLS)) for w in (g, h))
                        gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                        if gain[:-1].max() > best:
                            best, feature[k], limit[k] = gain[:-1].max(), f, int(gain[:-1].argmax())
                rows = np.arange(len(y))
                node = 2 * node + 1 + (cells[rows, feature[node]] > limit[node])
            leaf = node - (2**depth - 1)
            value = np.bincount(leaf, grad, 2**depth) / (np.bincount(leaf, curve, 2**depth) + 1)
            self.trees.append((feature, limit, value))
            score += rate * value[leaf]

    def _cells(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)

    def chance(self, x: np.ndarray) -> np.ndarray:
        cells, score, rows = self._cells(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (cells[rows, feature[node]] > limit[node])
            score += self.rate * value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-score))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE) -> DataFrame:
    """``(id_col, host, path, rule, verdict, block_chance)`` of every row.

    verdict is that of the longest fitting rule, else block if the trees find blocking at least
    as likely as not. They learn from at most ``sample`` different URLs that a rule decides (those of the
    smallest hashes), each weighted by its number of rows. A null URL, and one without ``://``, has empty host and path and is judged
    by the trees. With no labelled URL the chance is one half. Repeated rows are judged alike; an
    empty table gives an empty result; other columns are not read.
    """
    spark = pages.sparkSession
    ship(spark)
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    parts = pages.select(F.col(id_col).cast("bigint").alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    suffix = F.substring_index("host", ".", -1)
    numbers = F.array(*[c.cast("double") for c in lexical(F.col("url"), F.col("host"), F.col("path"))])
    facts = cut(parts.select("id", "host", "path", rule.alias("rule"), action.alias("action"), suffix.alias("suffix"), F.xxhash64("url").alias("h"), numbers.alias("x")))
    label = (F.col("action") == "block").cast("int")
    told = facts.where("action IS NOT NULL")
    total = told.agg(F.count("*").alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("b")).first()
    base = (total["b"] + 1) / (total["n"] + 2)
    of_suffix = maybe_broadcast(cut(told.groupBy("suffix").agg(F.count("*").alias("suffix_n"), F.sum(label).alias("suffix_b"))))
    of_host = maybe_broadcast(cut(told.groupBy("host").agg(F.count("*").alias("host_n"), F.sum(label).alias("host_b"))))
    rated = facts.join(of_suffix, "suffix", "left").join(of_host, "host", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))

    def rates(own: Column, seen: Column) -> list[Column]:
        """Smoothed block rates, without the ``seen`` rows of the URL itself, of which ``own`` are blocked."""
        suffix_rate = (zero(F.col("suffix_b")) - own + 10 * base) / (zero(F.col("suffix_n")) - seen + 10)
        return [suffix_rate, (zero(F.col("host_b")) - own + 5 * suffix_rate) / (zero(F.col("host_n")) - seen + 5)]

    # Rows of one URL are one example, so a common URL is one row here; a hard limit bounds what the driver gets.
    urls = told.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("of"))
    picked = maybe_broadcast(cut(urls.orderBy("h").limit(sample)))
    examples = rated.where(F.col("action").isNotNull()).join(picked.withColumnRenamed("h", "picked"), (F.col("h") == F.col("picked")) & F.col("id").eqNullSafe(F.col("of")))
    learn = examples.select("h", F.concat("x", F.array(*rates(label * F.col("n"), F.col("n")))).alias("x"), label.alias("y"), "n").dropDuplicates(["h"]).orderBy("h").limit(sample).toPandas()
    trees = Trees(np.stack(learn["x"].to_numpy()) if len(learn) else np.zeros((0, len(NUMBERS))), learn["y"].to_numpy(float), learn["n"].to_numpy(float))
    sent = spark.sparkContext.broadcast(trees)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        for b in batches:
            x = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NUMBERS))
            chance = trees.chance(x)
            given = b.column(5).to_pylist()
            verdict = [g or ("block" if c >= 0.5 else "allow") for g, c in zip(given, chance, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(verdict, pa.string()), pa.array(chance)], names=[id_col, "host", "path", "rule", "verdict", "block_chance"])

    ready = rated.select("id", "host", "path", "rule", F.concat("x", F.array(*rates(F.lit(0), F.lit(0)))).alias("x"), "action")
    return ready.mapInArrow(scored, f"{id_col} bigint, host string, path string, rule string, verdict string, block_chance double")


def op2_url_filter(spark, sf_dir):
    """A verdict for every page's url."""
    return judge(read(spark, sf_dir, "pages"))
