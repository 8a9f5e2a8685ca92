"""Near-duplicate removal on top of SimHash links: one document of each group stays.

Rows of equal text are one class, told by 128 bits of hash, so exact copies always go, whatever
their ids. Classes are linked by fingerprints and by bands of minima; within a linked set exact
similarity decides, by rising id. Rows are told apart by their text and id, never by id alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import content_key, cut, fresh, maybe_broadcast, small_batches, texts_of
from .components import connected_components
from .simhash import _mix, fingerprint, links, shingle_hashes

#: Shingle length and similarity by which a copy is confirmed.
WORDS, SIMILARITY = 5, 0.8
#: Bands of so many minima: a pair of similarity 0.8 agrees in one with probability 1 - (1 - 0.8 ** 5) ** 24 = 0.9999.
BANDS, MINIMA = 24, 5
#: Shingles whose hashes are permuted at a time.
CHUNK = 2048
#: Members of a component that are settled in one task in the first round, and that meet those that stay in one part.
MEMBERS = 500


def similarity(a: str, b: str, words: int = WORDS) -> float:
    """Jaccard similarity of the sets of word shingles; 1 for two texts without words."""
    x, y = (np.unique(np.concatenate([*shingle_hashes(t, words), np.zeros(0, np.uint64)])) for t in (a, b))
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common) if len(x) or len(y) else 1.0


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    a, b = rng.integers(0, 1 << 63, (2, BANDS * MINIMA), dtype=np.uint64)
    return 2 * a + np.uint64(1), b


def band_keys(text: str, words: int = WORDS) -> np.ndarray:
    """A key for each band of minima of the permuted shingle hashes; a text without words has none."""
    a, b = _permutations()
    low = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    some = False
    for hashes in shingle_hashes(text, words):
        some = True
        for i in range(0, len(hashes), CHUNK):
            np.minimum(low, (hashes[i : i + CHUNK, None] * a + b).min(axis=0), out=low)
    if not some:
        return np.zeros(0, np.int64)
    key = np.arange(BANDS, dtype=np.uint64)
    for x in low.reshape(BANDS, MINIMA).T:
        key = _mix(key ^ x) + np.uint64(0x9E3779B97F4A7C15)
    return key.view(np.int64)


#: Stands for a null id: behind all others.
NO_ID = (1 << 63) - 1


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``(a, b, id, fp, keys)`` of every row: hashes of its text, its id, its fingerprint (4-word shingles), its band keys."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(3))
            fps = np.array([fingerprint(x, 4) for x in texts], np.uint64).view(np.int64)
            keys = [band_keys(x, words) for x in texts]
            ends = np.cumsum([0, *map(len, keys)])
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(fps), column], names=["a", "b", "id", "fp", "keys"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.select(content_key(text).alias("key"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), text.alias("text"))
    return named.select("key.a", "key.b", "id", "text").mapInArrow(rows, "a bigint, b bigint, id bigint, fp bigint, keys array<bigint>")


def node_links(nodes: DataFrame, radius: int) -> DataFrame:
    """``(a, b)``: links of ``nodes(node, fp, keys)``, as stars: equal fingerprints, fingerprints within the radius, and equal keys of a band."""
    fps = cut(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    out = nodes.join(fps, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    out = out.unionByName(links(fps, radius)) if fps.head(1) else out
    # Nodes that agree in all bands probe once.
    alike = cut(nodes.where(F.size("keys") > 0).groupBy("keys").agg(F.min("node").alias("rep")))
    same = nodes.join(alike, "keys").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    probes = alike.select("rep", F.explode("keys").alias("key"))
    first = probes.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    met = probes.join(first, "key").where("rep <> a").select("a", F.col("rep").alias("b"))
    return out.unionByName(same).unionByName(met).distinct()


class Kept:
    """Shingle sets of kept texts, looked up by prefix filtering: of two sets that are similar enough,
    the ``n - ceil(least * n) + 1`` smallest hashes of each have one in common, so none is missed."""

    def __init__(self, words: int, least: float) -> None:
        self.words, self.least = words, least
        self.sets: list[tuple[int, np.ndarray]] = []
        self.at: dict[int, list[int]] = {}
        self.blank: int | None = None

    def set_of(self, text: str) -> np.ndarray:
        return np.unique(np.concatenate([*shingle_hashes(text, self.words), np.zeros(0, np.uint64)]))

    def _prefix(self, x: np.ndarray) -> list[int]:
        return x[: len(x) - math.ceil(self.least * len(x) - 1e-9) + 1].tolist()

    def find(self, x: np.ndarray) -> int | None:
        """The first kept id whose text is similar; None if there is none."""
        if not len(x):
            return self.blank
        n = len(x)
        for i in sorted({i for h in self._prefix(x) for i in self.at.get(h, ())}):
            kept_id, y = self.sets[i]
            if min(n, len(y)) >= self.least * max(n, len(y)) - 1e-9:
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common / (n + len(y) - common) >= self.least:
                    return kept_id
        return None

    def add(self, kept_id: int, x: np.ndarray) -> None:
        if not len(x):
            self.blank = kept_id if self.blank is None else self.blank
            return
        for h in self._prefix(x):
            self.at.setdefault(h, []).append(len(self.sets))
        self.sets.append((kept_id, x))


def _settle(words: int, least: float, grow: bool):
    """Rows ``(group, part, ahead, id, text)``, sorted so, to ``(group, id, kept_id)``; kept_id is null for texts like none kept.

    Rows ``ahead`` are kept unseen; if ``grow``, others are kept where no kept text is similar.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, own, waits = None, Kept(words, least), None, []
        hit: int | None = None

        def settled():  # all texts of one id are judged together
            if grow and hit is None:
                for x in waits:
                    kept.add(own[1], x)
            return (own[0], own[1], hit)

        for b in batches:
            out = []
            for group, part, behind, at, text in zip(*(b.column(i).to_pylist() for i in range(4)), texts_of(b.column(4)), strict=True):
                if own is not None and own != (group, at):
                    out.append(settled())
                    own, waits, hit = None, [], None
                if now != (group, part):
                    now, kept = (group, part), Kept(words, least)
                x = kept.set_of(text)
                if not behind:
                    kept.add(at, x)
                    continue
                own = (group, at)
                waits.append(x)
                hit = kept.find(x) if hit is None else hit
            yield _batch(out)
        if own is not None:
            yield _batch([settled()])

    return rows


def _batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(3)], names=["root", "member", "kept_id"])


def _settled(docs: DataFrame, radius: int, words: int, least: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows; classes ``(a, b, rep, node)``, numbered by rising ``rep``, their smallest id; ``(member, kept_id)``: nodes that go, and for which."""
    spark = docs.sparkSession
    small_batches(spark)
    signed = cut(signatures(docs, words, id_col, text_col))
    classes = signed.groupBy("a", "b").agg(F.min("id").alias("rep"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    ordered = classes.repartitionByRange("rep", "a", "b").sortWithinPartitions("rep", "a", "b")
    nodes = cut(ordered.withColumn("node", F.monotonically_increasing_id()))
    grouped = cut(connected_components(node_links(nodes.select("node", "fp", "keys"), radius)).select(F.col("node").alias("member"), F.col("component").alias("root")))
    roots = maybe_broadcast(cut(grouped.where("root <> member").select("root").distinct()))
    members = grouped.join(roots, "root").distinct()
    of_class = members.join(nodes.select("a", "b", "rep", "node"), members["member"] == nodes["node"]).select("a", "b", F.col("rep").alias("id"), "root", "member")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(content_key(text).alias("key"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), text.alias("text")).select("key.a", "key.b", "id", "text")
    pending = cut(texts.join(of_class, ["a", "b", "id"]).select("root", "member", "text").dropDuplicates(["member"]))
    schema = "root bigint, member bigint, kept_id bigint"
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found: list[DataFrame] = []
    size = MEMBERS

    def settle(rows: DataFrame, grow: bool) -> DataFrame:
        dealt = rows.select("root", "part", "behind", "member", "text").repartition(width, "root", "part").sortWithinPartitions("root", "part", "behind", "member", "text")
        return cut(dealt.mapInArrow(_settle(words, least, grow), schema))

    while True:
        # The first ids of each component: up to the id at that place, found without moving texts.
        counts = pending.select("root", "member").distinct().groupBy("root").agg(F.count("*").alias("n"))
        large = cut(counts.where(F.col("n") > size).select("root", F.ceil(F.col("n") / size).cast("int").alias("parts")))
        if not large.head(1):
            found.append(settle(pending.withColumns({"part": F.lit(0), "behind": F.lit(1)}), True).where("kept_id IS NOT NULL"))
            break
        place = F.row_number().over(Window.partitionBy("root").orderBy("member"))
        first = pending.select("root", "member").distinct().join(maybe_broadcast(large), "root").withColumn("place", place).where(F.col("place") <= size)
        ends = maybe_broadcast(cut(first.groupBy("root").agg(F.max("member").alias("end"), F.max("parts").alias("parts"))))
        marked = pending.join(ends, "root", "left")
        early = F.col("end").isNull() | (F.col("member") <= F.col("end"))
        judged = settle(marked.where(early).withColumns({"part": F.lit(0), "behind": F.lit(1)}), True)
        found.append(judged.where("kept_id IS NOT NULL"))
        ahead = judged.where("kept_id IS NULL").select("root", "member")
        stay = marked.where(F.col("end").isNotNull() & early).join(ahead, ["root", "member"]).select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("behind"), "member", "text")
        rest = marked.where(~early).select("root", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("behind"), "member", "text")
        met = settle(stay.unionByName(rest), False)
        found.append(met.where("kept_id IS NOT NULL"))
        pending = cut(rest.select("root", "member", "text").join(met.where("kept_id IS NULL").select("root", "member"), ["root", "member"]))
        size *= 4
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return signed, nodes.select("a", "b", "rep", "node"), cut(out.select("member", "kept_id"))


def copies(docs: DataFrame, radius: int = 6, words: int = WORDS, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, kept_id)``: rows that are exact or near copies of a row with a smaller id that stays.

    Rows of equal text are one class, which has its smallest id. A linked set joins classes whose
    fingerprints (of 4-word shingles) lie within ``radius`` bits, and those that agree in a band of
    minima of their shingle hashes, as nearly every pair of similarity 0.8 does, however far apart
    its fingerprints are. In it, by rising id, a class stays if no class that stays before it has an
    exact shingle similarity of ``least`` or more; so no two that stay are similar, and each that
    goes is similar to one that stays. Texts without words are copies of each other. Null text counts
    as empty. A null id comes behind all others. Rows that repeat text and id are not listed.

    The first ``MEMBERS`` classes of each set are settled in one task; the rest meets those
    of them that stay in several parts, and what is like none goes on to the next round, in
    which that number is four times as large.
    """
    signed, nodes, gone = _settled(docs, radius, words, least, id_col, text_col)
    kept = nodes.select(F.col("node").alias("kept_id"), F.col("rep").alias("kept_rep"))
    fate = nodes.join(gone, nodes["node"] == gone["member"], "left").join(kept, "kept_id", "left").select("a", "b", "rep", F.coalesce("kept_rep", "rep").alias("kept_id"), F.col("kept_rep").isNotNull().alias("goes"))
    out = signed.select("a", "b", "id").join(fate, ["a", "b"]).where("goes OR id <> rep")
    return out.select(F.nullif("id", F.lit(NO_ID)).alias(id_col), F.nullif("kept_id", F.lit(NO_ID)).alias("kept_id"))


def keep_one(docs: DataFrame, radius: int = 6, words: int = WORDS, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without exact and near copies (see ``copies``): one row of each group stays, with all its columns.

    Of rows that repeat text and id, one stays, whichever. Input columns may have any names.
    An empty table stays empty.
    """
    signed, nodes, gone = _settled(docs, radius, words, least, id_col, text_col)
    names = fresh(docs, "text_a", "text_b", "row_id")
    keyed = docs.withColumn(names[0], content_key(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    keyed = keyed.withColumns({names[1]: F.col(f"{names[0]}.b"), names[2]: F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID))}).withColumn(names[0], F.col(f"{names[0]}.a"))
    kept = nodes.join(gone, nodes["node"] == gone["member"], "left_anti").select(*[F.col(x).alias(y) for x, y in zip(("a", "b", "rep"), names, strict=True)])
    stay = keyed.join(kept, names, "left_semi")
    tied = cut(signed.groupBy("a", "b", "id").count().where("count > 1").select(*[F.col(x).alias(y) for x, y in zip(("a", "b", "id"), names, strict=True)]))
    if tied.head(1):
        tied = maybe_broadcast(tied)
        stay = stay.join(tied, names, "left_anti").unionByName(stay.join(tied, names, "left_semi").dropDuplicates(names))
    return stay.drop(*names)
