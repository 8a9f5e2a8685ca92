"""Language identification by Bayesian evidence fusion.

For each text, log likelihoods under a byte-trigram model of each declared language; for each row
the declared (markup) language by how often it goes with each language; for each host a prior from
the texts of its other rows, smoothed towards that of its suffix and that towards the corpus. All
models are counts over the whole table, made by grouped aggregation or partition sums: no sample
is taken, and the driver gets one row of counts for each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast, read, small_batches, texts_of

#: Hash buckets of byte trigrams.
BUCKETS = 1 << 14
#: Trigrams overlap and repeat, so their evidence is counted by a share of itself.
TEMPER = 0.3
#: Languages so much less likely than the best, as a logarithm, are left out of a row: no prior or declaration makes up for it.
FAR = 80.0
#: Pseudo-counts by which a host's prior leans on its suffix's, and that on the corpus's.
HOST_WEIGHT, SUFFIX_WEIGHT = 5.0, 20.0
#: A text with fewer letters than this, and nothing declared, is undetermined.
LEAST_LETTERS = 1
#: Languages whose counts a task holds at a time.
HELD = 256
UNDETERMINED = "und"

_CLASS = np.full(256, 32, np.uint32)
for _c in range(256):
    if 97 <= _c <= 122 or _c >= 128:
        _CLASS[_c] = _c
    elif 65 <= _c <= 90:
        _CLASS[_c] = _c + 32


def trigram_codes(text: str) -> np.ndarray:
    """Buckets of the text's byte trigrams; letters in lower case, all else as one space."""
    x = _CLASS[np.frombuffer(f" {text} ".lower().encode(), np.uint8)]
    blank = x == 32
    x = x[~(blank & np.r_[False, blank[:-1]])]
    if len(x) < 3:
        return np.zeros(0, np.int64)
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
    return ((h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS)).astype(np.int64)


def _clean(name: Column) -> Column:
    """A declared language's primary tag in lower case; null unless it has two or three letters, as languages do."""
    tag = F.lower(F.substring_index(F.trim(name.cast("string")), "-", 1))
    return F.when(tag.rlike("^[a-z]{2,3}$"), tag)


def trigram_counts(rows: DataFrame, languages: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each language, by number, the buckets that its texts use and how often: over all texts that declare it, summed within partitions, then by language.

    A task holds ``HELD`` languages' counts at most; the driver only what is not zero.
    """
    number = {x: i for i, x in enumerate(languages)}

    def vectors(seen: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array([x.astype("<f8").tobytes() for x in seen.values()], pa.binary())], names=["i", "v"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for b in batches:
            for text, name in zip(texts_of(b.column(0)), b.column(1).to_pylist(), strict=True):
                if name in number:
                    if number[name] not in seen and len(seen) >= HELD:
                        yield vectors(seen)
                        seen = {}
                    total = seen.setdefault(number[name], np.zeros(BUCKETS))
                    total += np.bincount(trigram_codes(text), minlength=BUCKETS)
        yield vectors(seen)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(BUCKETS)
        for b in batches:  # in the order of languages
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i != at:
                    if at is not None:
                        yield vectors({at: total})
                    at, total = i, np.zeros(BUCKETS)
                total += np.frombuffer(v.as_buffer(), "<f8")
        if at is not None:
            yield vectors({at: total})

    summed = rows.where("declared IS NOT NULL").select("text", "declared").mapInArrow(first, "i int, v binary").repartition("i").sortWithinPartitions("i").mapInArrow(add, "i int, v binary")
    out = {}
    for r in summed.toLocalIterator():
        v = np.frombuffer(bytes(r["v"]), "<f8")
        out[r["i"]] = (np.flatnonzero(v), v[v > 0])
    return out


class Trigrams:
    """Smoothed rates of trigram buckets by language, kept by bucket and only where a language uses it: a few bytes for each such pair."""

    def __init__(self, counts: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> None:
        both = np.ones(BUCKETS)
        self.total = np.zeros(k)
        for i, (at, n) in counts.items():
            both[at] += n
            self.total[i] = n.sum()
        # What every language is leant on: the corpus's rates, so one with few texts is like the corpus.
        self.lean = 0.5 * both / both.sum() * BUCKETS * 0.01
        self.lean_sum = self.lean.sum()
        at = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in counts.values())])
        order = np.argsort(at, kind="stable")
        self.language = np.concatenate([np.zeros(0, np.int32), *(np.full(len(x), i, np.int32) for i, (x, _) in counts.items())])[order]
        self.n = np.concatenate([np.zeros(0), *(n for _, n in counts.values())])[order]
        self.ends = np.searchsorted(at[order], np.arange(BUCKETS + 1))

    def log_likelihoods(self, codes: np.ndarray, own: int | None) -> np.ndarray:
        """Tempered log likelihoods of a text by language, the best being 0; ``own`` is the language among whose counts the text's own are, which do not count."""
        used, times = np.unique(codes, return_counts=True)
        size = self.ends[used + 1] - self.ends[used]
        flat = np.repeat(self.ends[used] - np.cumsum(size) + size, size) + np.arange(size.sum())
        language, n, m, lean = self.language[flat], self.n[flat], np.repeat(times, size), np.repeat(self.lean[used], size)
        total = self.total + self.lean_sum
        if own is not None:
            n = np.where(language == own, n - m, n)
            total = total.copy()
            total[own] -= len(codes)
        # Against what the lean alone would give, which is the same for all languages.
        ll = np.bincount(language, m * np.log1p(n / lean), len(total)) - len(codes) * np.log(total)
        ll *= TEMPER
        return ll - ll.max()


def language_evidence(rows: DataFrame, languages: list[str]) -> DataFrame:
    """``(id, declared, host, suffix, letters, langs, ll)`` of ``(id, text, declared, host, suffix)``: numbers of the likely languages and their log likelihoods, without the row's own text as evidence of what it declares."""
    sent = rows.sparkSession.sparkContext.broadcast(Trigrams(trigram_counts(rows, languages), len(languages)))
    number = {x: i for i, x in enumerate(languages)}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            letters, langs, lls, ends = [], [], [], [0]
            for text, declared in zip(texts_of(b.column(1)), b.column(2).to_pylist(), strict=True):
                codes = trigram_codes(text)
                ll = model.log_likelihoods(codes, number.get(declared))
                near = np.flatnonzero(ll > -FAR)
                letters.append(len(codes))
                langs.append(near)
                lls.append(ll[near])
                ends.append(ends[-1] + len(near))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*x, np.zeros(0)]).astype(t))) for x, t in ((langs, np.int32), (lls, np.float64))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(i) for i in range(2, 5)), pa.array(letters, pa.int64()), *lists], names=["id", "declared", "host", "suffix", "letters", "langs", "ll"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text", "declared", "host", "suffix").mapInArrow(scored, f"id {kind}, declared string, host string, suffix string, letters bigint, langs array<int>, ll array<double>")


def _soft(logs: Column) -> Column:
    """Probabilities from log weights."""
    return F.transform(F.array(logs), lambda x: F.transform(x, lambda y: F.exp(y - F.array_max(x))))[0]


def _shares(weights: Column) -> Column:
    return F.transform(F.array(F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)), lambda total: F.transform(weights, lambda x: x / total))[0]


def identify(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host_col: str | None = "source", suffix_col: str | None = None, least: float = 0.5) -> DataFrame:
    """``(id_col, language, probability, declared, keep)`` of every row.

    language is the most probable one (ties: the first by name) given text, declared language,
    suffix and host; ``und`` when there are no letters to go by. ``keep`` is false for ``und``
    and for a probability under ``least``. All declared languages are modelled; a declaration that
    is no tag of two or three letters is none. Null text counts as empty; a null declaration, host
    or suffix is no evidence; a table without any declared language is all ``und``; rows are
    judged one by one, repeated ones alike, and each is evidence for the others about its declared language and its
    host, not for itself, so a lone wrong declaration does not prove itself; the model takes some bytes for each
    bucket that a language uses, at most 16,384 buckets of as many languages as there are tags; an empty table gives an empty result; other columns are not read; ids may be of any type.
    """
    spark = rows.sparkSession
    small_batches(spark)
    none = F.lit(None).cast("string")
    named = rows.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
        _clean(F.col(declared_col)).alias("declared") if declared_col else none.alias("declared"),
        F.col(host_col).cast("string").alias("host") if host_col else none.alias("host"),
        F.col(suffix_col).cast("string").alias("suffix") if suffix_col else none.alias("suffix"),
    )
    languages = sorted(r["declared"] for r in named.where("declared IS NOT NULL").select("declared").distinct().collect())  # tags of two or three letters
    if not languages:
        return named.select(F.col("id").alias(id_col), F.lit(UNDETERMINED).alias("language"), F.lit(0.0).alias("probability"), "declared", F.lit(False).alias("keep"))
    k = len(languages)
    evidence = cut(language_evidence(named, languages).withColumn("p", _shares(_soft(F.col("ll")))))
    spoken = evidence.where(F.col("letters") >= LEAST_LETTERS).select("declared", "host", "suffix", F.explode(F.arrays_zip("langs", "p")).alias("e")).select("declared", "host", "suffix", F.col("e.langs").alias("i"), F.col("e.p").alias("p"))
    # What the texts alone say of each host; of each suffix and the corpus; and of each declaration.
    by_host = cut(spoken.groupBy("host", "suffix", "i").agg(F.sum("p").alias("c")))
    corpus = np.ones(k)
    for r in by_host.groupBy("i").agg(F.sum("c").alias("c")).collect():
        corpus[r["i"]] += r["c"]
    base = F.array(*[F.lit(float(x)) for x in corpus / corpus.sum()])
    counts_of = lambda df, *by: df.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("i", "c"))).alias("counts"), F.sum("c").alias("total"))
    by_suffix = counts_of(by_host.groupBy("suffix", "i").agg(F.sum("c").alias("c")), "suffix").select(F.col("suffix").alias("suffix2"), F.col("counts").alias("suffix_counts"), F.col("total").alias("suffix_total"))
    hosts = counts_of(by_host, "host", "suffix").join(by_suffix, F.col("suffix").eqNullSafe(F.col("suffix2"))).select(F.col("host").alias("host2"), "suffix2", "counts", "total", "suffix_counts", "suffix_total")
    hosts = maybe_broadcast(cut(hosts))
    told = np.zeros((k, k))
    for r in spoken.where("declared IS NOT NULL").groupBy("declared", "i").agg(F.sum("p").alias("c")).collect():  # at most one row for two languages
        told[languages.index(r["declared"]), r["i"]] = r["c"]
    rates = np.log((told + 1) / (told.sum(axis=0) + k))
    said = maybe_broadcast(spark.createDataFrame([(d, x.tolist()) for d, x in zip(languages, rates, strict=True)], "declared2 string, said array<double>"))
    joined = evidence.join(hosts, F.col("host").eqNullSafe(F.col("host2")) & F.col("suffix").eqNullSafe(F.col("suffix2")), "left").join(said, F.col("declared") == F.col("declared2"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))

    def weight(e: Column) -> Column:
        i, own = e["langs"], e["p"]
        of_suffix = (zero(F.col("suffix_counts")[i]) + SUFFIX_WEIGHT * F.get(base, i)) / (zero(F.col("suffix_total")) + SUFFIX_WEIGHT)
        others = F.greatest(zero(F.col("counts")[i]) - own, F.lit(0.0))
        of_host = (others + HOST_WEIGHT * of_suffix) / (F.greatest(zero(F.col("total")) - 1, F.lit(0.0)) + HOST_WEIGHT)
        return e["ll"] + F.log(F.when(F.col("host").isNull(), of_suffix).otherwise(of_host)) + zero(F.get(F.col("said"), i))

    posterior = _shares(_soft(F.transform(F.arrays_zip("langs", "ll", "p"), weight)))
    scored = joined.select("id", "declared", "letters", "langs", posterior.alias("post"))
    best = F.array_max("post")
    name = F.get(F.array(*map(F.lit, languages)), F.get("langs", (F.array_position("post", best) - 1).cast("int")))
    mute = F.col("letters") < LEAST_LETTERS
    return scored.select(
        F.col("id").alias(id_col), F.when(mute, F.lit(UNDETERMINED)).otherwise(name).alias("language"), F.when(mute, F.lit(0.0)).otherwise(F.round(best, 6)).alias("probability"),
        "declared", (~mute & (best >= least)).alias("keep"),
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages as rows for ``identify``: visible text, the markup's language, host and suffix."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))
    text = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style|nav|footer)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return pages.select(
        F.col("page_id"), text.alias("text"), F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html[^>]*\blang=[\"']?([A-Za-z-]+)", 1).alias("markup"),
        F.nullif(host, F.lit("")).alias("host"), F.nullif(F.substring_index(host, ".", -1), F.lit("")).alias("suffix"),
    )


def op4_language_id(spark, sf_dir):
    """Every document's language, from its text, its declared language and its source's prior."""
    return identify(read(spark, sf_dir, "documents"))


def language_id_pages(spark, sf_dir):
    """Every page's language, from its text, markup, address suffix and host prior."""
    return identify(page_evidence(read(spark, sf_dir, "pages")), "page_id", "text", "markup", "host", "suffix")
