"""Repeated passages by sparse suffix arrays.

Of each text only the suffixes at minimiser positions are kept: among every ``WINDOW``
consecutive word positions the one whose 3-word hash is smallest, a choice that depends on the
words alone, so two copies of a passage keep the same positions. The suffixes are sorted by the
hash of their first ``least - WINDOW + 1`` words, then by text and place, over ranges of the
whole order that hold equally many rows: a head that a third of all texts share fills several
tasks. Neighbours in the order are compared; what is equal to none is dropped. Passages of
``least`` words that repeat hold a kept position within their first ``WINDOW`` words, so each
remaining suffix is extended to the left, by each number of words under ``WINDOW`` with which it
is still the one chosen, and to the right as far as ``least`` words together. The extensions
are sorted and compared with their neighbours in the same way, by 128 bits of hash: a passage
that occurs at two places is a repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, read, small_batches, texts_of

LEAST, WINDOW, GRAM = 50, 16, 3
#: Turns word hashes into others, for the second half of a passage's 128 bits.
_OTHER = np.uint64(0xD6E8FEB86659FD93)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def word_spans(text: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) words between white space, and their starts and ends in code points."""
    spans = [m.span() for m in re.finditer(r"[^ \t-\r]+", text)]
    words = text.encode().lower().split()
    return words, np.array([a for a, _ in spans], np.int64), np.array([b for _, b in spans], np.int64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes, modulo 2**64 with mixed word hashes, of all runs of ``size`` words."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        # Horner by doubling: hashes of runs of powers of two, combined.
        out, done, power = None, 0, h.copy()
        width, bits = 1, size
        while bits:
            if bits & 1:
                part = power[done : done + len(h) - size + 1]
                out = part.copy() if out is None else out * np.uint64(pow(int(_MULT), width, 1 << 64)) + part
                done += width
            bits >>= 1
            if bits:
                power = power[:-width] * np.uint64(pow(int(_MULT), width, 1 << 64)) + power[width:]
                width *= 2
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def chosen(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """For each run of ``window`` positions the one of the smallest gram hash, the last of equals: it depends on the run's words alone."""
    g = window_hashes(h, gram)
    if len(g) < window:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g[::-1], window)
    return (len(g) - 1 - (view.argmin(axis=1) + np.arange(len(view))))[::-1]


def minimisers(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Positions kept: all that are chosen in some run."""
    return np.unique(chosen(h, window, gram))


def _joined(parts: list[np.ndarray], kind: type) -> pa.Array:
    return pa.array(np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind))


def heads(rows: DataFrame, least: int = LEAST, window: int = WINDOW) -> DataFrame:
    """``(t, at, key)`` of ``rows(t, text)``: each kept suffix and the hash of its first words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners, ats, keys = [], [], []
            for t, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                h = word_hashes(text.encode().lower().split())
                if len(h) >= least:
                    head = window_hashes(h, least - window + 1)
                    at = minimisers(h, window)
                    at = at[at < len(head)]
                    owners.append(np.full(len(at), t, np.int64))
                    ats.append(at)
                    keys.append(head[at].view(np.int64))
            yield pa.RecordBatch.from_arrays([_joined(owners, np.int64), _joined(ats, np.int32), _joined(keys, np.int64)], names=["t", "at", "key"])

    return rows.mapInArrow(run, "t bigint, at int, key bigint")


def extended(rows: DataFrame, least: int = LEAST, window: int = WINDOW) -> DataFrame:
    """``(t, at, h, g)`` of ``rows(t, text, ats)``: passages of ``least`` words about the suffixes ``ats``, where they start, and their hashes.

    A suffix is extended to the left as far as it is still the one chosen among the first
    ``window`` words, and to the right up to ``least`` words: copies of a passage choose alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners, starts, hs, gs = [], [], [], []
            for t, text, ats in zip(b.column(0).to_pylist(), texts_of(b.column(1)), b.column(2).to_pylist(), strict=True):
                if not ats:
                    continue
                h = word_hashes(text.encode().lower().split())
                full, other = window_hashes(h, least), window_hashes((h ^ (h >> np.uint64(31))) * _OTHER, least)
                s = np.flatnonzero(np.isin(chosen(h, window)[: len(full)], ats))
                owners.append(np.full(len(s), t, np.int64))
                starts.append(s)
                hs.append(full[s].view(np.int64))
                gs.append(other[s].view(np.int64))
            yield pa.RecordBatch.from_arrays([_joined(owners, np.int64), _joined(starts, np.int32), _joined(hs, np.int64), _joined(gs, np.int64)], names=["t", "at", "h", "g"])

    return rows.mapInArrow(run, "t bigint, at int, h bigint, g bigint")


def with_equal_neighbour(suffixes: DataFrame, *keys: str) -> DataFrame:
    """``(t, at)`` of ``suffixes(t, at, *keys)`` whose keys are those of another ``(t, at)`` too.

    Rows are sorted by keys, text and place, in ranges; each is compared with the one before and
    the one after it. Rows at the edges of a range, two at most, are compared with those of the
    other ranges. ``suffixes`` should be a written table, as its order is sampled first.
    """
    order = [*keys, "t", "at"]
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: np.ndarray | None = None  # the last row so far, and whether it has an equal neighbour
        first: np.ndarray | None = None
        last_hit = first_hit = False
        for b in batches:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(n + 2)])
            if last is not None:
                x = np.concatenate([last[:, None], x], axis=1)
            x = x[:, np.r_[True, (x[:, 1:] != x[:, :-1]).any(axis=0)]]  # rows of equal texts are one
            same = (x[:n, 1:] == x[:n, :-1]).all(axis=0)
            hit = np.r_[False, same] | np.r_[same, False]
            new = hit.copy()
            if last is None:
                first = x[:, 0]
            else:
                new[0] = hit[0] and not last_hit
                hit[0] |= last_hit
            if (first == x[:, 0]).all():
                first_hit = bool(hit[0])
            last, last_hit = x[:, -1], bool(hit[-1])
            yield _edges(x[:, new], 0)
        if last is not None:
            yield _edges(first[:, None], 2 if first_hit else 1)
            if (first != last).any():
                yield _edges(last[:, None], 2 if last_hit else 1)

    def _edges(x: np.ndarray, edge: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in x[: n + 1]), pa.array(x[n + 1].astype(np.int32)), pa.array(np.full(x.shape[1], edge, np.int32))], names=[*order, "edge"])

    sorted_rows = suffixes.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    out = cut(sorted_rows.mapInArrow(run, ", ".join(f"{k} bigint" for k in keys) + ", t bigint, at int, edge int"))
    edges = out.where("edge > 0")  # of 1: no neighbour in its own range is equal; of 2: some is
    met = edges.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return out.where("edge = 0").select("t", "at").unionByName(edges.where("edge = 1").join(met, list(keys), "left_semi").select("t", "at"))


def repeats(docs: DataFrame, least: int = LEAST, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_words, repeated_words, spans)`` of the rows that hold a passage of ``least`` words found elsewhere too.

    A passage counts if it occurs at two places, of one text or of two rows; letter case A-Z
    and the kind of white space do not matter. spans is the union of all such passages as an
    array of (start, end) in code points, in order. Rows of equal text are one class whose text, if it has
    ``least`` words, is repeated whole; so are rows that repeat an id and text. Null, empty and
    shorter texts are never in the result; an empty table gives an empty result; a null id is
    an id; other columns are not read.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.struct(F.xxhash64("text").alias("t"), F.xxhash64(F.lit(7), "text").alias("t2"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text")).select("id", "text", key.alias("key")).select("id", "key.t", "key.t2", "text")
    member = cut(rows.select("id", "t", "t2"))
    classes = cut(member.groupBy("t", "t2").agg(F.min("id").alias("id"), (F.count("*") > 1).alias("copied")))
    by_text = with_equal_neighbour(cut(heads(rows.select("t", "text"), least, window)), "key").groupBy("t").agg(F.collect_list("at").alias("ats"))  # at most one text's words
    wanted = cut(classes.join(by_text, "t", "left").where("copied OR ats IS NOT NULL"))
    one = F.coalesce(F.col("id"), F.lit(0)).alias("id")  # a class has a null id only if all its rows have
    texts = cut(rows.select("t", "t2", one, "text").join(wanted.select("t", "t2", one, "copied", "ats"), ["t", "t2", "id"]).dropDuplicates(["t", "t2", "id"]))
    passages = cut(extended(texts.select("t", "text", "ats"), least, window))
    starts = with_equal_neighbour(passages, "h", "g").groupBy("t").agg(F.collect_list("at").alias("starts"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            keep, sizes, hits, found = [], [], [], []
            for i, (text, copied, at) in enumerate(zip(texts_of(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                if not copied and not at:
                    continue
                words, begin, end = word_spans(text)
                if len(words) < least:
                    continue
                cover = np.zeros(len(words) + 1, np.int64)
                if copied:
                    cover[0] += 1
                else:
                    s = np.unique(at)
                    np.add.at(cover, s, 1)
                    np.add.at(cover, s + least, -1)
                inside = np.cumsum(cover)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.r_[0, inside.astype(np.int8), 0]))
                keep.append(i)
                sizes.append(len(words))
                hits.append(int(inside.sum()))
                found.append([{"start": int(begin[a]), "end": int(end[z - 1])} for a, z in zip(edge[::2], edge[1::2], strict=True)])
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(sizes, pa.int64()), pa.array(hits, pa.int64()), pa.array(found, kind)], names=["t", "t2", "n_words", "repeated_words", "spans"])

    of_class = texts.join(starts, "t", "left").select("t", "t2", "text", "copied", "starts").mapInArrow(spans, "t bigint, t2 bigint, n_words bigint, repeated_words bigint, spans array<struct<start:bigint,end:bigint>>")
    return member.join(cut(of_class), ["t", "t2"]).select(F.col("id").alias(id_col), "n_words", "repeated_words", "spans")


def op6_repeats(spark, sf_dir):
    """Documents that hold a passage of 50 words or more which occurs elsewhere too, and where."""
    found = repeats(read(spark, sf_dir, "documents"))
    return found.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ","))
