"""Benchmark decontamination with DataFrame functions only.

A window of a document is as many words as the benchmark item it is held against. Where a
document's shingle equals an indexed shingle of an item, all windows that hold it are tried;
an item indexes just so many of its shingles that a window with the wanted similarity must
hold one (prefix filtering), so none goes unseen, whatever is cut or left out of the item. Each
window's SimHash is then looked up in a multi-index of the items' SimHashes: 64 bits in
blocks, ``sum(1 + 1 bit tolerance) = radius + 1``, so that by the pigeonhole principle every
item fingerprint within the radius is met in some block. The exact similarity of weighted
shingles (sum of the smaller counts by sum of the larger ones) verifies what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, is_small, maybe_broadcast, read

WORDS = 5
SIMILARITY = 0.8
#: Ten blocks, each with a tolerance of one bit: every fingerprint within 19 bits is met.
BLOCKS = 10
RADIUS = 2 * BLOCKS - 1


def words_of(text: Column) -> Column:
    """Lower-cased words between white space; null and blank texts have none."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    for other in "\t\n\x0b\f\r":  # then a split at one character needs no regular expression
        plain = F.replace(plain, F.lit(other), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def shingle_hashes(words: Column, n: int = WORDS) -> Column:
    """A hash for each run of ``n`` words; a shorter text is one run, an empty one has none."""
    last = F.greatest(F.size(words) - n + 1, F.least(F.size(words), F.lit(1)))
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, n)))).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """Bit b is set if it is set in over half of the hashes.

    Bits are counted side by side, in sixteen sums of four 16-bit lanes; a window of 65,536
    or more shingles would overflow a lane, so there each bit is counted by itself.
    """
    ones, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    shift = lambda x, by: F.call_function("shiftrightunsigned", x, by)
    lanes = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.aggregate(hashes, zero, lambda n, h: n + shift(h, k).bitwiseAND(F.lit(0x0001000100010001))))
    counts = F.flatten(F.transform(F.array(*[F.lit(16 * j) for j in range(4)]), lambda by: F.transform(lanes, lambda x: shift(x, by).bitwiseAND(F.lit(0xFFFF).cast("bigint")))))
    plain = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(hashes, zero, lambda n, h: n + shift(h, b).bitwiseAND(ones)))
    placed = F.transform(F.when(F.size(hashes) < 65536, counts).otherwise(plain), lambda n, b: F.when(2 * n > F.size(hashes), F.call_function("shiftleft", ones, b)).otherwise(zero))
    return F.aggregate(placed, zero, lambda x, y: x.bitwiseOR(y))


def _block(fp: Column, k: int) -> Column:
    low, high = 64 * k // BLOCKS, 64 * (k + 1) // BLOCKS
    return F.call_function("shiftrightunsigned", fp, F.lit(low)).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("bigint"))


def _key(k: int, flip: int) -> Column:
    return F.struct(F.lit(k).alias("k"), _block(F.col("item_fp"), k).bitwiseXOR(F.lit(flip).cast("bigint")).alias("v"))


def _widths() -> list[int]:
    return [64 * (k + 1) // BLOCKS - 64 * k // BLOCKS for k in range(BLOCKS)]


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def counted(hashes: Column) -> Column:
    """The distinct values in order, each with how often it occurs, from one sort."""

    def runs(x: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(x)), lambda i: (i == 1) | (F.get(x, i - 1) != F.get(x, i - 2)))
        return _bound(begins, lambda s: F.transform(s, lambda i, k: F.struct(F.get(x, i - 1).alias("v"), (F.coalesce(F.get(s, k + 1), F.size(x) + 1) - i).alias("c"))))

    return F.when(F.size(hashes) > 0, _bound(F.array_sort(hashes), runs)).otherwise(F.array().cast("array<struct<v:bigint,c:int>>"))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Of two ``counted`` multisets: the sum of smaller counts by the sum of larger counts. Both are merged by one sort."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda n, y: n + y["c"])
    meet = lambda x: F.aggregate(F.sequence(F.lit(1), F.size(x)), F.lit(0), lambda n, i: n + F.when(F.get(x, i - 1)["v"] == F.get(x, i)["v"], F.least(F.get(x, i - 1)["c"], F.get(x, i)["c"])).otherwise(0))
    return _bound(_bound(F.array_sort(F.concat(a, b)), meet), lambda common: common / (total(a) + total(b) - common))


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, words, hashes, fp)`` of every item that has words."""
    words = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), words_of(F.col(text_col)).alias("item_words")).where(F.size("item_words") > 0)
    hashed = words.withColumn("hashes", shingle_hashes(F.col("item_words")))
    return hashed.withColumn("item_fp", simhash(F.col("hashes")))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, item_id, similarity, start_word)``: for each document and item of which it holds a similar window, the best.

    start_word counts from 0; of equally similar windows the first is named, those with a
    shingle at the same place as in the item before others. Null, empty and
    blank texts and items hold nothing; items or documents shorter than a shingle are one
    shingle. Repeated rows with one id count as one document, a null id as one too; ids may be
    of any type that can be compared; empty tables give an empty result; other columns are not read.
    """
    items = cut(items_of(benchmark))
    # 1. Shingles to look for: n - ceil(2 n s / (1 + s)) + 1 of the item's, as one of them must be shared;
    #    those with the longest first words, as documents hold few of these. Documents are probed by that word.
    n = F.size("hashes")
    need = n - F.ceil(n * (2 * similarity / (1 + similarity)) - 1e-9).cast("int") + 1
    places = F.transform(F.sequence(F.lit(1), n), lambda q: F.struct((-F.length(F.element_at("item_words", q))).alias("long"), (q - 1).alias("q")))
    picked = items.select("item_words", F.size("item_words").alias("size"), F.explode(F.slice(F.array_sort(places), F.lit(1), need)).alias("x")).select("item_words", "size", "x.q")
    index = cut(picked.select(F.get("item_words", F.col("q")).alias("word"), F.slice("item_words", F.col("q") + 1, WORDS).alias("shingle"), "size").distinct())
    # 2. All windows as large as the item that hold the shingle.
    split = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    at = split.select("id", "words", F.posexplode("words").alias("p", "word"))
    if is_small(index):  # the words stay where they are; only hits are built
        hits = at.join(F.broadcast(index), "word").where(F.slice("words", F.col("p") + 1, F.size("shingle")) == F.col("shingle"))
    else:  # only a shingle goes along with each place, and the words are joined to the hits again
        near = at.select("id", "p", "word", F.slice("words", F.col("p") + 1, WORDS).alias("near"))
        found = near.join(index, "word").where(F.slice("near", 1, F.size("shingle")) == F.col("shingle")).select(F.col("id").alias("of"), "p", "size", "shingle")
        hits = found.join(split, F.col("of").eqNullSafe(F.col("id")))
    low, high = F.greatest(F.col("p") + F.size("shingle") - F.col("size"), F.lit(0)), F.least(F.col("p"), F.size("words") - F.col("size"))
    starts = hits.where(low <= high).select("id", "words", "size", F.explode(F.sequence(low, high)).alias("start_word"))
    windows = starts.select("id", "start_word", "size", F.array_join(F.slice("words", F.col("start_word") + 1, F.col("size")), " ").alias("window"))
    windows = cut(windows.distinct())
    # 3. Their fingerprints meet those of items in one block at least; equal windows are looked up once.
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = windows.select("window", "size").distinct().repartition(width, "window").withColumn("hashes", shingle_hashes(F.split("window", " ")))
    texts = cut(texts.withColumn("fp", simhash(F.col("hashes"))))
    blocks = F.flatten(F.array(*[F.array(*[_key(k, flip) for flip in (0, *(1 << j for j in range(w)))]) for k, w in enumerate(_widths())]))
    lookup = items.select("item_id", F.size("item_words").alias("size"), "item_fp", F.explode(blocks).alias("b")).select("item_id", "size", "item_fp", F.col("b.k").alias("k"), F.col("b.v").alias("v"))
    probes = texts.select("window", "size", "fp", F.posexplode(F.array(*[_block(F.col("fp"), k) for k in range(BLOCKS)])).alias("k", "v"))
    met = probes.join(maybe_broadcast(lookup), ["size", "k", "v"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    met = met.select("window", "item_id").distinct()
    # 4. The exact similarity decides; the shingles of both sides are joined to the few pairs that are left.
    sides = met.join(texts.select("window", "hashes"), "window").join(maybe_broadcast(items.select("item_id", F.col("hashes").alias("item_hashes"))), "item_id")
    similar = sides.withColumn("similarity", F.round(weighted_similarity(counted(F.col("hashes")), counted(F.col("item_hashes"))), 6)).where(F.col("similarity") >= similarity)
    aligned = F.exists(F.zip_with("hashes", "item_hashes", lambda a, b: a == b), lambda x: x)
    found = windows.join(similar.select("window", "item_id", "similarity", aligned.alias("aligned")), "window")
    best = F.max(F.struct("similarity", "aligned", (-F.col("start_word")).alias("at"))).alias("best")
    return found.groupBy("id", "item_id").agg(best).select(F.col("id").alias(id_col), "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.at")).alias("start_word"))


def op5_decontamination(spark, sf_dir):
    """Documents that hold a benchmark item, or most of one, and where."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM benchmark
), ds AS (
  SELECT doc_id, p, array_to_string(w[p:p+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)
), bs AS (
  SELECT item_id, q, array_to_string(w[q:q+4], ' ') AS s, len(w) AS size, greatest(len(w) - 4, 1) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS q FROM b WHERE len(w) > 0)
), win AS (
  SELECT DISTINCT doc_id, item_id, size, n, unnest(range(low, high + 1)) AS start
  FROM (SELECT ds.doc_id, bs.item_id, bs.size, bs.n, greatest(ds.p - bs.n, 0) AS low, least(ds.p - 1, len(d.w) - bs.size) AS high FROM ds JOIN bs USING (s) JOIN d ON d.doc_id = ds.doc_id)
  WHERE low <= high
), ws AS (
  SELECT win.doc_id, win.item_id, win.start, win.n, ds.s, count(*) AS c, coalesce(bool_or(bs.s = ds.s), false) AS same
  FROM win JOIN ds ON ds.doc_id = win.doc_id AND ds.p > win.start AND ds.p <= win.start + win.n
  LEFT JOIN bs ON bs.item_id = win.item_id AND bs.q = ds.p - win.start GROUP BY ALL
), bc AS (SELECT item_id, s, count(*) AS c FROM bs GROUP BY ALL
), sim AS (
  SELECT ws.doc_id, ws.item_id, ws.start, sum(least(ws.c, bc.c)) AS common, any_value(ws.n) AS n, bool_or(ws.same) AS aligned
  FROM ws JOIN bc ON bc.item_id = ws.item_id AND bc.s = ws.s GROUP BY 1, 2, 3
), ok AS (
  SELECT doc_id, item_id, start, aligned, round(common / (2 * n - common), 6) AS similarity FROM sim WHERE round(common / (2 * n - common), 6) >= 0.8
)
SELECT doc_id, item_id, max(similarity) AS similarity, CAST(arg_max(start, (similarity, aligned, -start)) AS INTEGER) AS start_word FROM ok GROUP BY 1, 2
"""
