"""Token sequences packed by hierarchical best fit.

Documents are tokenized where they lie. Pieces of full length are sequences at once; the
others are dealt to partitions, which pack them by best fit, longest first. Bins that are
nearly full are emitted. The others go, as items of their fill, to a coarser level of the
tree, where they are packed again, until one node is left. A node hands at most ``keep``
bins upwards, the emptiest ones; the others are sequences as they are, so memory at every
node is bounded and no piece is lost. Nothing is gained by more: best fit leaves at most one
bin of a node half full or less, for of two such bins the pieces of the later one would have
gone to the earlier. Higher up, bins over half full never fit together, so a join takes one
of the at most ``fan_in`` bins that are not, and the emptiest partners have the most room.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, read, small_batches, texts_of

#: Words whose ids are remembered by a Python worker; the memory is emptied when it is full.
CACHE_WORDS = 300_000
ITEM = "array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
BIN = f"fill bigint, first bigint, items {ITEM}"


class Tokenizer:
    """Ids of ``byte_bpe_50k.json``, equal to those of the tokenizers library, made faster.

    A single space before a visible character always begins a new pre-token, and so does a
    single line break between visible characters; the words between them are looked up. A
    word met first goes to tiktoken, which has the same ranks, or to tokenizers when it
    holds rarer characters. A text with other white space, or with the special token's
    string, is encoded as a whole.
    """

    def __init__(self) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer as Library

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.library = Library.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.bare, self.spaced = _Words(self, ""), _Words(self, " ")
        self.newline = self.bytes_of("\n")

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if "<|endoftext|>" in text:
            return self.bytes_of(text)
        lines, bare, spaced = [], self.bare, self.spaced
        for line in text.split("\n"):
            words = line.split(" ")
            if not all(words) or any(map(str.isspace, words)) or len(line.split()) != len(words) or line[0].isspace() or line[-1].isspace():
                return self.bytes_of(text)
            lines.append(bare[words[0]] + b"".join(map(spaced.__getitem__, words[1:])))
        return self.newline.join(lines)

    def bytes_of(self, text: str) -> bytes:
        if "<|endoftext|>" not in text and (text.isascii() or max(text) < "ɐ"):
            return np.array(self.fast(text), "<u4").tobytes()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class _Words(dict):
    """Ids by word, each with a prefix before it."""

    def __init__(self, tokenizer: Tokenizer, prefix: str) -> None:
        self.tokenizer, self.prefix = tokenizer, prefix

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = ids = self.tokenizer.bytes_of(self.prefix + word)
        return ids


def cut_pieces(ids: bytes, limit: int) -> list[tuple[int, int, int]]:
    """``(start, length, crc32)`` of each piece; longer documents are cut so that only the first may be shorter."""
    n = len(ids) // 4
    head = n % limit or min(n, limit)
    starts = [0, *range(head, n, limit)]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def pieces(docs: DataFrame, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of each document's tokens and the closing id 0."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = Tokenizer(), np.zeros(1, "<u4").tobytes()
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                for k, (start, length, crc) in enumerate(cut_pieces(tokenizer.encode(text) + end, limit)):
                    for column, value in zip(out, (doc_id, k, start, length, crc), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(rows, schema)


def best_fit(fills: list[int], limit: int) -> list[list[int]]:
    """Bins of indexes: each item, longest first, goes to the fullest bin that has room for it.

    The free sizes of open bins are bits of one number, so the tightest is found at once.
    """
    order = sorted(range(len(fills)), key=lambda i: -fills[i])
    bins: list[list[int]] = []
    open_by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms = 0
    for i in order:
        need = fills[i]
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            k = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms &= ~(1 << room)
            bins[k].append(i)
        else:
            room, k = limit, len(bins)
            bins.append([i])
        if left := room - need:
            open_by_room[left].append(k)
            rooms |= 1 << left
    return bins


def _node(limit: int, slack: int, keep: int, level: int, last: bool):
    """Pack one node's bins; emits ``(sequence_id, fill, first, items)``, the id null for bins that go up."""
    bin_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fills: list[int] = []
        held: list[pa.Array] = []
        for batch in batches:
            fills += batch.column(0).to_pylist()
            held.append(batch.column(2))
        if not fills:
            return
        items = pa.chunked_array(held).combine_chunks()
        values, offsets = items.flatten(), np.concatenate([[0], np.cumsum(items.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        bins = best_fit(fills, limit)
        totals = np.array([sum(fills[i] for i in b) for b in bins])
        up = np.zeros(len(bins), bool)
        if not last:
            under = np.flatnonzero(totals < limit - slack)
            up[under[np.argsort(totals[under], kind="stable")[:keep]]] = True
        base = (level << 56) + (TaskContext.get().partitionId() << 32)
        for a in range(0, len(bins), 2000):
            part = bins[a : a + 2000]
            take = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for b in part for i in b])
            sizes = [sum(int(offsets[i + 1] - offsets[i]) for i in b) for b in part]
            column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values.take(pa.array(take)))
            ids = pa.array(base + np.arange(a, a + len(part)), mask=up[a : a + len(part)])
            first = pa.array([min((x for i in b if (x := values[int(offsets[i])]["doc_id"].as_py()) is not None), default=None) for b in part], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(totals[a : a + len(part)]), first, column.cast(bin_type)], names=["sequence_id", "fill", "first", "items"])

    return rows


def pack(docs: DataFrame, limit: int = 2048, slack: int = 8, keep: int = 20_000, leaf_pieces: int = 40_000, fan_in: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is the empty text (one piece: the closing id). Documents over ``limit`` ids are
    cut; no piece is dropped or lies in two sequences. Ties are broken by doc_id and piece, so
    a task that is run again packs the same. Repeated rows are packed once each; an empty
    table gives an empty result; other columns are not read.
    """
    cut_up = cut(pieces(docs, limit, id_col, text_col))
    whole = cut_up.where(F.col("length") == limit)
    count = cut_up.where(F.col("length") < limit).count()
    parts = max(1, -(-count // leaf_pieces))
    level_bins = cut_up.where(F.col("length") < limit).select(
        F.col("length").alias("fill"), F.col("doc_id").alias("first"), F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).alias("items")
    )
    done: list[DataFrame] = []
    level = 0
    while True:
        last = parts == 1
        # Dealt in turn, not by a key: ids that are null or repeated do not meet in one node.
        dealt = level_bins.repartition(parts).sortWithinPartitions("fill", "first", F.col("items")[0]["piece"], F.col("items")[0]["ids_crc32"])
        out = cut(dealt.mapInArrow(_node(limit, slack, keep, level, last), f"sequence_id bigint, {BIN}"))
        done.append(out.where("sequence_id IS NOT NULL").select("sequence_id", "items"))
        if last:
            break
        level_bins, parts, level = out.where("sequence_id IS NULL").select("fill", "first", "items"), -(-parts // fan_in), level + 1
    packed = done[0]
    for more in done[1:]:
        packed = packed.unionByName(more)
    before = F.aggregate(F.slice("items", 1, F.col("k")), F.lit(0).cast("bigint"), lambda total, x: total + x["length"])
    placed = packed.select("sequence_id", "items", F.posexplode("items").alias("k", "item")).select(
        "item.doc_id", "item.piece", "item.start", "item.length", "item.ids_crc32", "sequence_id", before.alias("offset")
    )
    alone = whole.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return placed.unionByName(alone)


def op7_packing(spark, sf_dir):
    """All documents in as few sequences of 2048 tokens as best fit finds."""
    return pack(read(spark, sf_dir, "documents"))
