"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, so words of the same letters share it,
and one letter put in, taken out or exchanged changes it by that letter's value or by the difference
of two. Keys that differ so are met by integers alone: each key is joined with what remains of every other
when one letter's value is taken away (an exchange leaves the same remainder in both; a removal
leaves the other key itself). Words of keys that meet are then verified for letter order: the
letter in question is taken out at each place where it stands, and what is left, told by 124 bits of
polynomial hash, must be equal (and at the same place, for an exchange).

No pairs are listed: what is left of a word at a place is shared by at most one word a letter of the alphabet,
and of these only their number, the first and the second by rank are kept. A word has as many
remainders as letters, so rows grow with the letters of the vocabulary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read, ship

#: Letters of a word, and the power of a letter's code point that it adds to the key.
LETTERS, POWER = "A-Za-zÀ-ÿ", 5
#: Primes and bases of the polynomial hashes of letter order.
PRIMES, BASES = (2147483647, 2147483629, 2147483587, 2147483579), (1103515245, 69069, 16807, 40692)
#: Words shorter or rarer than this are left out; a form is so many times as frequent as its variant.
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: The misspellings that the query makes: of one run in so many, by crc32, a letter is taken out.
DROP_ONE_IN = 31


def runs(docs: DataFrame, least_length: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, run)``: the maximal runs of letters of whole texts with at least ``least_length`` of them, A-Z lower-cased."""
    found = F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    lower = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(F.col(id_col).cast("string").alias("id"), F.explode(found).alias("run")).select("id", lower.alias("run"))


def with_slips(id: Column, run: Column) -> Column:
    """The run or, where crc32 of ``id:run`` is divisible by 31, the run without its code point number crc32 % length; a null id is empty."""
    h = F.crc32(F.concat(F.coalesce(id, F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DROP_ONE_IN == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def counted(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of rows ``(word)``: those long and frequent enough. Counts are summed before the shuffle, so a hot word is few rows."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words of a batch, and where each word begins (and the last ends)."""
    words = column.to_pylist()
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.cumsum([0, *map(len, words)])


def letter_values(points: np.ndarray) -> np.ndarray:
    """Powers of code points, modulo 2^64."""
    return points.astype(np.uint64) ** np.uint64(POWER)


def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, key, rest)`` of ``(id, word)``: the anagram key, and the key without each of the word's different letters."""
    for b in batches:
        points, ends = _points(b.column(1))
        values = letter_values(points)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
        key = sums[ends[1:]] - sums[ends[:-1]]
        which = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        letters = np.unique(which * (1 << 32) + points)
        owner = letters >> 32
        rest = (key[owner] - letter_values(letters & ((1 << 32) - 1))).view(np.int64)
        offsets = np.searchsorted(owner, np.arange(len(ends)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rest))], names=["id", "key", "rest"])


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.int64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * pow(base, done, prime) % prime
        done += more
    return out


def orders(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two 62-bit numbers for each word's letter order, and two for the order without each of its letters, letter by letter."""
    size = np.diff(ends)
    which, place = np.repeat(np.arange(len(size)), size), np.arange(len(points)) - np.repeat(ends[:-1], size)
    whole, without = [], []
    for prime, base in zip(PRIMES, BASES, strict=True):
        term = (points + 1) * _powers(base, prime, int(size.max(initial=0)))[place] % prime
        sums = np.concatenate([[0], np.cumsum(term)])
        before = sums[:-1] - sums[ends[:-1]][which]
        after = sums[ends[1:]][which] - sums[1:]
        whole.append((sums[ends[1:]] - sums[ends[:-1]]) % prime)
        without.append((before % prime + after % prime * pow(base, -1, prime)) % prime)
    pair = lambda x, i: (x[i] << 31) | x[i + 1]
    return pair(whole, 0), pair(whole, 2), pair(without, 0), pair(without, 2)


def letter_orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, a, b, at)`` of ``(id, word, key, live)``: of each word, what is left without the letter at place ``at``, for letters whose removal leaves a key in ``live``; ``at`` -1: the word itself, if its key is."""
    for b in batches:
        points, ends = _points(b.column(1))
        if not len(ends) - 1:
            continue
        size = np.diff(ends)
        which = np.repeat(np.arange(len(size)), size)
        key = b.column(2).to_numpy().view(np.uint64)
        live, owner = b.column(3).flatten().to_numpy(), np.repeat(np.arange(len(size)), np.diff(b.column(3).offsets.to_numpy()))
        # Pairs (word, key) that are live, as sorted records to look others up in.
        record = np.dtype([("w", np.int64), ("k", np.int64)])
        wanted = np.empty(len(live), record)
        wanted["w"], wanted["k"] = owner, live
        ask = np.empty(len(points) + len(size), record)
        ask["w"] = np.concatenate([which, np.arange(len(size))])
        ask["k"] = np.concatenate([key[which] - letter_values(points), key]).view(np.int64)
        hit = np.isin(ask, wanted)
        a, c, ra, rc = orders(points, ends)
        place = np.arange(len(points)) - np.repeat(ends[:-1], size)
        ids = b.column(0).to_numpy()
        columns = [np.concatenate(x)[hit] for x in ((ids[which], ids), (ra, a), (rc, c), (place, np.full(len(size), -1)))]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["id", "a", "b", "at"])


def near_words(words: DataFrame) -> DataFrame:
    """``(id, n_near, best)`` of ``words(id, word)``, different words: how many others differ by exactly one letter put in, taken out or exchanged, and the smallest of their ids. Words without any are left out."""
    keyed = cut(words.select("id", "word").mapInArrow(keys_of, "id bigint, key bigint, rest array<bigint>"))
    met = keyed.select("key", F.explode(F.concat(F.array("key"), "rest")).alias("of")).distinct()
    live = met.groupBy("of").agg(F.count("*").alias("keys")).where("keys > 1").select("of")
    # At most one remainder a letter of the alphabet, and the key itself.
    chosen = met.join(live, "of").groupBy("key").agg(F.collect_list("of").alias("live"))
    asked = words.join(keyed.select("id", "key"), "id").join(chosen, "key").select("id", "word", "key", "live")
    left = cut(asked.mapInArrow(letter_orders, "id bigint, a bigint, b bigint, at int"))
    # Exchanges: words that leave the same at the same place, at most one a letter of the alphabet.
    same = Window.partitionBy("a", "b", "at")
    ranked = same.orderBy("id")
    exchanged = (
        left.where("at >= 0").select("id", F.count("*").over(same).alias("m"), F.min("id").over(same).alias("first"), F.lead("id").over(ranked).alias("next"))
        .where("m > 1").select("id", (F.col("m") - 1).alias("k"), F.when(F.col("id") == F.col("first"), F.col("next")).otherwise(F.col("first")).alias("best"))
    )
    longer = left.where("at >= 0").select("a", "b", F.col("id").alias("long")).distinct()
    pairs = cut(longer.join(left.where("at < 0").select("a", "b", F.col("id").alias("short")), ["a", "b"]).select("long", "short"))
    count_of = lambda by, other: pairs.groupBy(F.col(by).alias("id")).agg(F.count("*").alias("k"), F.min(other).alias("best"))
    return exchanged.unionByName(count_of("long", "short")).unionByName(count_of("short", "long")).groupBy("id").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every row of ``counts(word, n)``, whose words differ.

    form is the near word of the largest n (ties: the first in code-point order), if that is at
    least ``ratio`` times the word's own; root follows forms to the last. Null words are left out. An empty table
    gives an empty result; other columns are not read.
    """
    ship(counts.sparkSession)
    counts = cut(counts.where("word IS NOT NULL").select("word", F.col("n").cast("bigint")))
    # Numbers in the order by which a form is chosen, so the best of near words is the smallest number.
    words = cut(counts.orderBy(F.desc("n"), "word").withColumn("id", F.monotonically_increasing_id()))
    near = near_words(words)
    other = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    ruled = words.join(near, "id", "left").join(other, "best", "left")
    fits = F.col("form_n") >= ratio * F.col("n")
    ruled = cut(ruled.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), *[F.when(fits, F.col(c)).alias(c) for c in ("best", "form", "form_n")]))
    pointers = cut(ruled.where("best IS NOT NULL").select("id", F.col("best").alias("to")))
    # n grows by the ratio at each step, which bounds the steps; each round doubles those taken.
    span = counts.agg((F.max("n") / F.min("n")).alias("span")).first()["span"] or 1
    steps = max(1, math.floor(math.log(span, ratio) + 1e-9)) if ratio > 1 else 64
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ahead = pointers.select(F.col("id").alias("to"), F.col("to").alias("then"))
        pointers = cut(pointers.join(ahead, "to", "left").select("id", F.coalesce("then", "to").alias("to")))
    roots = pointers.join(words.select(F.col("id").alias("to"), F.col("word").alias("root")), "to").select("id", "root")
    return ruled.join(roots, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """``(word)``: every word of every whole text, with the query's slips; null text has none, repeated rows count each."""
    return runs(docs, least_length, id_col, text_col).select(with_slips(F.col("id"), F.col("run")).alias("word"))


def op11_spelling(spark, sf_dir):
    """Every frequent long word of all documents with its more frequent near word."""
    return variants(counted(document_words(read(spark, sf_dir, "documents"))))


#: The same by definition: all ways of taking a letter out, joined. crc32 is folded over bytes by its table, which is made from its rule.
OP11_SQL = """
WITH RECURSIVE bits(b, c, k) AS (
  SELECT b, b::BIGINT, 0 FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY b) AS tab FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), told AS (SELECT id, run, count(*) AS k FROM runs GROUP BY ALL),
bytes AS (
  SELECT id, run, k, list_transform(range(0, length(hex(encode(id || ':' || run))) // 2), lambda i: ('0x' || hex(encode(id || ':' || run))[2 * i + 1 : 2 * i + 2])::BIGINT) AS x FROM told
), hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, x), lambda c, d: xor(c >> 8, tab[(xor(c, d) & 255) + 1])), 4294967295) AS h FROM bytes, crc
), slipped AS (
  SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed
), words AS (SELECT word, sum(k)::BIGINT AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
rest AS (SELECT DISTINCT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS r FROM (SELECT word, n, unnest(range(0, length(word)))::INT AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM rest a JOIN rest b ON a.r = b.r AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM rest a JOIN words b ON a.r = b.word
  UNION SELECT b.word, a.word, a.n FROM rest a JOIN words b ON a.r = b.word
), ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS place, count(*) OVER (PARTITION BY word) AS m FROM near),
formed AS (
  SELECT w.word, w.n, coalesce(r.m, 0) AS n_near, CASE WHEN r.other_n >= 10 * w.n THEN r.other END AS form, CASE WHEN r.other_n >= 10 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.place = 1
), walk(word, last, form) AS (
  SELECT word, word, form FROM formed UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN formed f ON walk.form = f.word
)
SELECT formed.word, formed.form, walk.last AS root, n, n_near, form_n FROM formed JOIN walk ON formed.word = walk.word AND walk.form IS NULL
"""
