"""Document quality: random Fourier features, ridge regression, isotonic calibration.

Each text is described by statistics of its characters, words and lines. Random Fourier
features of the standardised statistics approximate a Gaussian kernel. Ridge weights solve
normal equations that every partition sums for its labelled rows. Out-of-fold scores of the
same rows give an isotonic calibration, fitted on sums in fixed bins of the raw score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, read, small_batches, sum_arrays, texts_of

FEATURES = 256
FOLDS = 3
#: Bins of the raw score, over [-0.5, 1.5], in which the calibration is fitted.
BINS = 400

STATS = (
    "log_chars log_words mean_word long_words short_words upper digit punct space other ascii_marks line_count mean_line repeated_words "
    "top_word repeated_lines repeated_pairs end_marks doubled_marks pipes first_upper adjacent_same word_entropy char_entropy hash_marks mean_sentence bracket slash"
).split()


def statistics(text: str) -> list[float]:
    """One number for each name in ``STATS``; finite for every text, the empty one included."""
    data = np.frombuffer(text.encode(), np.uint8)
    n = max(len(data), 1)
    counts = np.bincount(data, minlength=256).astype(float)
    words = text.split()
    k = max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    sizes = np.array([len(w) for w in words] or [0])
    by_word: dict[str, int] = {}
    for w in words:
        by_word[w] = by_word.get(w, 0) + 1
    often = np.array(list(by_word.values()) or [1], float)
    share = often / often.sum()
    present = counts[counts > 0] / n
    distinct_pairs = len(set(zip(words, words[1:], strict=False)))
    letters = counts[97:123].sum() + counts[65:91].sum()
    marks = {c: counts[ord(c)] for c in ".,!?;:#$%&*|()[]{}<>=/\\"}
    return [
        np.log1p(len(data)), np.log1p(len(words)), sizes.mean(), (sizes > 12).mean(), (sizes < 3).mean(),
        counts[65:91].sum() / max(letters, 1), counts[48:58].sum() / n, sum(marks.values()) / n, (counts[32] + counts[10] + counts[9]) / n, counts[128:].sum() / n,
        (marks["."] + marks[","]) / k, np.log1p(len(lines)), np.log1p(n / max(len(lines), 1)), 1 - len(by_word) / k,
        often.max() / k, 1 - len(set(lines)) / max(len(lines), 1), 1 - distinct_pairs / max(len(words) - 1, 1), sum(x.rstrip()[-1] in ".!?" for x in lines) / max(len(lines), 1),
        marks["!"] / k, marks["|"] / k, sum(w[0].isupper() for w in words) / k, sum(map(str.__eq__, words, words[1:])) / k,
        float(-(share * np.log(share)).sum()), float(-(present * np.log(present)).sum()) if len(data) else 0.0, (marks["#"] + marks["$"] + marks["%"] + marks["&"] + marks["*"]) / k,
        np.log1p(k / max(marks["."] + marks["!"] + marks["?"], 1)), (marks["("] + marks["["] + marks["{"] + marks["<"] + marks["="]) / k, (marks["/"] + marks["\\"]) / k,
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, s)``: the statistics of every whole text, null as empty."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([statistics(x) for x in texts_of(batch.column(1))], float).reshape(-1, len(STATS))
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * len(STATS), pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), column], names=[id_col, "s"])

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string")).mapInArrow(rows, f"{id_col} bigint, s array<double>")


def remainder(doc_id: int) -> int:
    """crc32 of the id's text, modulo 3; rows with 1 are held out of learning."""
    return zlib.crc32(str(doc_id).encode()) % 3


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))


class Model:
    """Scores ``(n, len(STATS))`` matrices; all of it is fixed size, whatever the corpus."""

    def __init__(self, mean, sd, seed: int = 7, width: float = 6.0) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.sd = mean, sd
        self.directions = rng.standard_normal((len(STATS), FEATURES)) / width
        self.shift = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros((FOLDS + 1, FEATURES + 1))
        self.edges, self.levels = np.array([0.0]), np.array([0.5])

    def features(self, s: np.ndarray) -> np.ndarray:
        z = np.clip((s - self.mean) / self.sd, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.shift), np.ones((len(z), 1))])

    def scores(self, s: np.ndarray) -> np.ndarray:
        return np.interp(self.features(s) @ self.weights[FOLDS], self.edges, self.levels)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Non-decreasing values nearest to ``values`` by weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else values


def fit(labelled: DataFrame, id_col: str = "doc_id", ridge: float = 1e-3) -> Model:
    """Learn from all rows of ``labelled(id_col, s, label)``; the label is 0 or 1."""
    m, d = len(STATS), FEATURES + 1
    rows = labelled.select(F.col(id_col).cast("bigint"), "s", F.col("label").cast("double"))

    def moments(batches):
        total = np.zeros(2 * m + 1)
        for b in batches:
            s = _matrix(b.column(1))
            total += np.r_[s.sum(axis=0), (s**2).sum(axis=0), len(s)]
        return total

    total = sum_arrays(rows, moments, 2 * m + 1)
    n = max(total[-1], 1)
    mean = total[:m] / n
    model = Model(mean, np.sqrt(np.clip(total[m:-1] / n - mean**2, 1e-8, None)))
    folds = lambda ids: np.array([zlib.crc32(f"fold{i}".encode()) % FOLDS for i in ids.to_pylist()], np.int64)

    def normal(batches):
        out = np.zeros((FOLDS, d, d + 1))
        for b in batches:
            x, y, fold = model.features(_matrix(b.column(1))), b.column(2).to_numpy(), folds(b.column(0))
            for k in range(FOLDS):
                at = fold == k
                out[k] += x[at].T @ np.hstack([x[at], y[at, None]])
        return out.ravel()

    sums = sum_arrays(rows, normal, FOLDS * d * (d + 1)).reshape(FOLDS, d, d + 1)
    whole = sums.sum(axis=0)
    for k, part in enumerate([*(whole - sums), whole]):
        a = part[:, :d] + ridge * max(part[d - 1, d - 1], 1) / FEATURES * np.diag(np.r_[np.ones(d - 1), 1e-6])
        model.weights[k] = np.linalg.solve(a + 1e-9 * np.eye(d), part[:, d])

    def binned(batches):
        out = np.zeros((2, BINS))
        for b in batches:
            x, y, fold = model.features(_matrix(b.column(1))), b.column(2).to_numpy(), folds(b.column(0))
            raw = (x * model.weights[fold]).sum(axis=1)
            at = np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
            out += [np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)]
        return out.ravel()

    number, positive = sum_arrays(rows, binned, 2 * BINS).reshape(2, BINS)
    full = number > 0
    if full.any():
        rate = isotonic((positive[full] + 0.5 * whole[d - 1, d] / n) / (number[full] + 0.5), number[full])
        model.edges, model.levels = ((np.arange(BINS) + 0.5) / BINS * 2 - 0.5)[full], np.clip(rate, 0, 1)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``(id_col, held_out, score, predicted)`` of every row of ``docs``.

    Rows whose crc32(id as text) mod 3 is 1 are held out: their labels are never read. The
    score depends on the text alone. Null text counts as empty and gets a score as well; a
    document labelled twice counts twice, a null label not at all; without labels every score
    is 0.5. Repeated rows get equal scores, an empty table an empty result.
    """
    stats = cut(document_statistics(docs, id_col, text_col))
    spark = docs.sparkSession
    held = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held).select(F.col(id_col).cast("bigint").alias("label_id"), F.col(label_col).alias("label"))
    model = fit(cut(stats.join(known, stats[id_col] == known.label_id).select(id_col, "s", "label")), id_col)
    sent = spark.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(_matrix(b.column(1))))], names=[id_col, "score"])

    scored = stats.mapInArrow(rows, f"{id_col} bigint, score double")
    return scored.select(id_col, F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality(spark, sf_dir):
    """Every document's calibrated quality score."""
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
