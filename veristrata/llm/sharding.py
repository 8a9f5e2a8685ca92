"""Shards of like size: minimax contiguous partition of ordered groups.

Rows that belong together (equal texts) are one group, which is not cut. Groups stand in a fixed order, and
each shard takes a contiguous run of them. The largest shard is made as small as it can be: the
smallest capacity is found by binary search, in which a greedy pass over the groups checks whether the
shards suffice; there the groups are cut. A group larger than the capacity has a shard of its
own, so that one huge group does not leave the others' shards uneven.

A greedy pass asks only where the last group ends at or before a given byte. The driver answers that from a
bounded table of cells with the first and the last end in each, which gives bounds on the capacity and on every cut;
cells that may hold a cut are divided again, until the answers are exact. The driver holds a bounded number of
cells, however many groups there are, and nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import content_key, cut, fresh, maybe_broadcast, read, ship

#: Cells of one round, over all that is still uncertain.
CELLS = 1 << 16
#: A group of more than this share of all rows is joined by broadcast: there are at most so many.
HOT_GROUPS = 1000


class Ends:
    """What is known of where groups end: ascending, disjoint cells with the first and the last end in each. ``points`` are ends known for themselves."""

    def __init__(self, low: np.ndarray, high: np.ndarray, points: list[int]) -> None:
        self.low, self.high, self.points = low, high, np.array(sorted({0, *points}), np.int64)

    def cell(self, x: int) -> int:
        return int(np.searchsorted(self.low, x, side="right")) - 1

    def at_or_before(self, x: int) -> tuple[int, int]:
        """Bounds on the largest end that is at most x."""
        i, least = self.cell(x), int(self.points[np.searchsorted(self.points, x, side="right") - 1])
        if i < 0:
            return least, least
        high = int(self.high[i])
        return (high, high) if x >= high else (max(least, int(self.low[i])), x)


def greedy(known: Ends, capacity: int, shards: int, total: int, large: list[tuple[int, int]], side: int) -> list[int]:
    """How far each shard reaches in a greedy pass, by the low (0) or the high (1) bounds; ``large`` are (start, end) of all groups that may exceed the capacity, which then stand alone."""
    alone, at, cuts = [g for g in large if g[1] - g[0] > capacity], 0, []
    for _ in range(shards):
        ahead = next((g for g in alone if g[0] >= at), None)
        if ahead and ahead[0] == at:
            at = ahead[1]
        elif at < total:
            at = max(at, known.at_or_before(min(at + capacity, total, ahead[0] if ahead else total))[side])
        cuts.append(at)
    return cuts


def smallest_capacity(known: Ends, shards: int, total: int, large: list[tuple[int, int]], least: int, side: int) -> int:
    """The smallest capacity, from ``least`` on, by which a greedy pass reaches the end."""
    low, high = least, max(least, total)
    while low < high:
        middle = (low + high) // 2
        if greedy(known, middle, shards, total, large, side)[-1] >= total:
            high = middle
        else:
            low = middle + 1
    return low


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and the sum of sizes up to each row."""
    part, total = TaskContext.get().partitionId(), 0
    for b in batches:
        sums = pc.add(pc.cumulative_sum(b.column(b.schema.get_field_index("size"))), total)
        total = sums[-1].as_py() if len(sums) else total
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), sums], names=[*b.schema.names, "part", "upto"])


def cut_points(groups: DataFrame, shards: int, cells: int = CELLS) -> tuple[list[int], int]:
    """The ends of all shards, and the capacity, for ``groups(size, start, end)``: sizes over 0 that follow each other without gaps.

    Each round is one filtered aggregation. It divides the cells that a cut may lie in. By the
    bounds the cut after j shards is uncertain by about 2 j cells, so about ``shards`` squared of them remain each time, and
    each is at least halved: the driver holds some ``cells``, or two times ``shards`` squared if that is more.
    """
    total = groups.agg(F.max("end").alias("total")).first()["total"] or 0
    # More than ``shards`` groups over the capacity would not fit, so those that exceed it are among the largest few.
    top = groups.orderBy(F.desc("size"), "start").limit(shards + 1).select("size", "start", "end").collect()
    large, least = sorted((r["start"], r["end"]) for r in top), top[-1]["size"] if len(top) > shards else 1
    points = [x for g in large for x in g]
    low = high = np.zeros(0, np.int64)
    spans, width = [(0, total)], 2 * max(1, total)  # ends over a and up to b are to be told apart
    while True:
        width = max(1, min(width // 2, -(-sum(b - a for a, b in spans) // cells)))
        number, first = F.lit(None).cast("bigint"), 0
        for a, b in spans:
            number = F.when((F.col("end") > a) & (F.col("end") <= b), F.floor((F.col("end") - (a + 1)) / width) + first).otherwise(number)
            first += -(-(b - a) // width)
        inside = " OR ".join(f"end > {a} AND end <= {b}" for a, b in spans)
        found = groups.where(inside).groupBy(number.alias("cell")).agg(F.min("end").alias("low"), F.max("end").alias("high")).toPandas()
        stay = np.ones(len(low), bool)
        for a, b in spans:
            stay &= (high <= a) | (low > b)
        low, high = np.concatenate([low[stay], found["low"].to_numpy(np.int64)]), np.concatenate([high[stay], found["high"].to_numpy(np.int64)])
        order = np.argsort(low)
        low, high = low[order], high[order]
        known = Ends(low, high, points)
        best, sure = (smallest_capacity(known, shards, total, large, least, side) for side in (1, 0))
        behind, ahead = greedy(known, best, shards, total, large, 0), greedy(known, sure, shards, total, large, 1)
        if best == sure and behind == ahead:
            return behind, best
        # Cells of more than one end that a pass with a capacity between the two may ask about; neighbours are taken together.
        open_cells = sorted({i for x, y in zip(behind, ahead, strict=True) for i in range(max(known.cell(x), 0), known.cell(y) + 1) if high[i] > low[i]})
        spans = []
        for i in open_cells:
            a, b = int(low[i]) - 1, int(high[i])
            if spans and a - spans[-1][1] <= width:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))


def even_ends(groups: DataFrame, shards: int, cells: int = CELLS) -> list[int]:
    """The ends of all shards. Where groups over the capacity stand alone, the shards between two of them are made alike in turn, as their number is fixed by then."""
    ends, capacity = cut_points(groups, shards, cells)
    starts = [0, *ends[:-1]]
    lone = [b - a > capacity for a, b in zip(starts, ends, strict=True)]
    if not any(lone):
        return ends
    out, i = [], 0
    while i < shards:
        j = i
        while j < shards and not lone[j] and ends[j] > starts[j]:
            j += 1
        if j - i > 1:
            base = starts[i]
            between = groups.where((F.col("start") >= base) & (F.col("end") <= ends[j - 1])).select("size", (F.col("start") - base).alias("start"), (F.col("end") - base).alias("end"))
            out += [base + x for x in even_ends(between, j - i, cells)]
        else:
            j = i + 1
            out.append(ends[i])
        i = j
    return out


def _sorted_with_place(df: DataFrame, *order: Column) -> DataFrame:
    """Written in this order, with the partition (``part``) and place (``row``) of each row."""
    row = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mono", row)
    return cut(placed.withColumn("part", F.shiftright("mono", 33).cast("int")).withColumn("row", F.col("mono").bitwiseAND((1 << 33) - 1)).drop("mono"))


def shards_of_texts(rows: DataFrame, shards: int, cells: int = CELLS) -> DataFrame:
    """``(key, n, start, shard)`` of each different key of ``rows(id, key, bytes)``: its rows, the byte where its group begins, and its shard."""
    # Summed before the shuffle: a text of a third of all rows is one row a partition.
    by_text = cut(rows.groupBy("key").agg(F.sum("bytes").alias("size"), F.count("*").alias("n"), F.min("id").alias("first")))
    order = (F.col("first").asc_nulls_last(), F.col("key"))
    summed = cut(by_text.repartitionByRange(*order).sortWithinPartitions(*order).select("key.a", "key.b", "n", "size").mapInArrow(_running, "a bigint, b bigint, n bigint, size bigint, part int, upto bigint"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = summed.groupBy("part").agg(F.max("upto").alias("held")).select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))  # one row a partition
    end = F.col("base") + F.col("upto")
    groups = cut(summed.join(maybe_broadcast(parts), "part").select("a", "b", "n", "size", (end - F.col("size")).alias("start"), end.alias("end")))
    cuts = even_ends(groups, shards, cells)[:-1]
    shard = sum((F.when(F.col("start") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    return groups.select(F.struct("a", "b").alias("key"), "n", "start", shard.alias("shard"))


def _join_groups(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """``rows`` with the start and shard of their ``key``. Groups with a large share of all rows are broadcast; there are ``HOT_GROUPS`` at most."""
    total = placed.agg(F.sum("n").alias("n")).first()["n"] or 0
    large = F.col("n") > max(1000, total // HOT_GROUPS)
    hot = placed.where(large).select("key", F.col("start").alias("hot_start"), F.col("shard").alias("hot_shard"))
    marked = rows.join(F.broadcast(hot), "key", "left")
    cold = marked.where("hot_shard IS NULL").drop("hot_start", "hot_shard").join(placed.where(~large).select("key", "start", "shard"), "key")
    return cold.unionByName(marked.where("hot_shard IS NOT NULL").withColumnsRenamed({"hot_start": "start", "hot_shard": "shard"}))


def _text(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))


def assign(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` of every row, under the law ``bytes``.

    A row's size is the UTF-8 bytes of its text, plus 1; rows of equal text are one group and never parted; a null text counts as the empty one.
    Groups stand in the order of their smallest id (ties, and groups of null ids only, which come last, by a
    hash of the text). Slots number a shard's rows from 0 by group, id and place in the input. Ids may be null or repeated;
    repeated rows each have a slot; an empty table gives an empty result; other columns are not read. Fewer groups than shards leave shards empty.
    """
    ship(docs.sparkSession)
    text = _text(docs, text_col)
    rows = cut(docs.select(docs[id_col].alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("bytes"), F.crc32(text.cast("binary")).alias("text_crc32"), content_key(text).alias("key")))
    placed = shards_of_texts(rows, shards, cells)
    numbered = cut(_join_groups(rows, placed).drop("key").withColumn("tie", F.monotonically_increasing_id()))
    ordered = _sorted_with_place(numbered, F.col("start"), F.col("id").asc_nulls_last(), F.col("tie"))
    held = ordered.groupBy("part", "shard").agg(F.count("*").alias("n"), F.min("row").alias("row0"))  # at most a row a partition, and one a cut
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = maybe_broadcast(held.select(F.col("part").alias("p"), F.col("shard").alias("s"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("row0")).alias("add")))
    return ordered.join(offsets, (F.col("part") == F.col("p")) & (F.col("shard") == F.col("s"))).select("id", F.col("bytes").alias("size"), "text_crc32", "shard", (F.col("row") + F.col("add")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all rows and columns of ``docs`` under ``path/shard_number=K``, by the shards of ``assign``.

    Each task writes the rows that it holds of each shard, so no task takes a whole shard.
    """
    ship(docs.sparkSession)
    text, (key, start, shard) = _text(docs, text_col), fresh(docs, "key", "start", "shard")
    placed = shards_of_texts(docs.select(docs[id_col].alias("id"), content_key(text).alias("key"), (F.octet_length(text) + 1).cast("bigint").alias("bytes")), shards)
    by_key = placed.select(F.col("key").alias(key), F.col("start").alias(start), F.col("shard").alias(shard))
    docs.withColumn(key, content_key(text)).join(by_key, key).drop(key, start).withColumnRenamed(shard, "shard_number").write.partitionBy("shard_number").parquet(path)


def op13_sharding(spark, sf_dir):
    """Every document's shard of 16 of like bytes."""
    out = assign(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").cast("bigint").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
