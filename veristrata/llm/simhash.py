"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint has 64 bits. Two fingerprints are linked when they differ in at
most ``radius`` bits. All such pairs are found without comparing all pairs:

1. Bits that are correlated over the corpus are grouped, so that the groups are as
   independent as can be (``group_bits``).
2. Each group gets a threshold of its own, -1 (not probed) or more, with
   ``sum(threshold + 1) = radius + 1``. By the pigeonhole principle every linked pair is
   within the threshold in one group at least. A dynamic programme picks the thresholds
   that need the least work, from candidate counts estimated by sketches over all
   fingerprints (``allocate``).
3. A group with threshold t is probed by the keys that masking any t of its bits gives.
   Fingerprints that share a key are candidates; their distance is verified in numpy.

Fingerprints are made distinct first, so exact copies cost nothing further, and a task
reports for its candidates a spanning star of every linked set, not all pairs in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast, small_batches, sum_arrays, texts_of
from .components import connected_components

BITS = 64
#: Shingles hashed at a time, which bounds the memory that a very long text needs.
CHUNK = 1 << 15
#: Rows of sorted keys that are verified together.
RUN_ROWS = 1 << 17
#: Keys of more fingerprints than this are split by ``radius + 1`` disjoint bit blocks once more, before the shuffle.
LONG_RUN = 4096
#: Keys of more fingerprints than this are walked instead of compared pair by pair.
WALKED = 128
#: Buckets of one count sketch, by which pairs that share a key are estimated.
SKETCH = 1024


def shingle_hashes(text: str, words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of ``words`` words of the ASCII-lower-cased text, in chunks.

    Words are runs of other than space and U+0009 to U+000D. A text of fewer words is one
    shingle; one without words has none.
    """
    tokens = text.encode().lower().split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(tokens) > words:
        starts, ends = starts[: -(words - 1) or None], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), CHUNK):
        pairs = zip(starts[i : i + CHUNK].tolist(), ends[i : i + CHUNK].tolist(), strict=True)
        yield np.array([digest(joined[a:b], seed) for a, b in pairs], dtype=np.uint64)


def fingerprint(text: str, words: int = 4) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes; without words all are 0."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, words):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fp)`` of every row; fp is the fingerprint as a signed 64-bit number. Null text: the empty one."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x, words) for x in texts_of(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=[id_col, "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string")).mapInArrow(rows, f"{id_col} bigint, fp bigint")


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_correlation(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and the absolute correlation of their bits, over all of them."""

    def partial(batches):
        total = np.zeros((BITS + 1, BITS + 1))
        for batch in batches:
            bits = bits_of(batch.column(0).to_numpy())
            x = np.hstack([bits, np.ones((len(bits), 1), np.uint8)]).astype(np.float32)
            total += x.T @ x
        return total.ravel()

    m = sum_arrays(nodes.select("fp"), partial, (BITS + 1) ** 2).reshape(BITS + 1, BITS + 1)
    n = int(m[-1, -1])
    mean = m[-1, :-1] / max(n, 1)
    cov = m[:-1, :-1] / max(n, 1) - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    return n, np.abs(cov / np.outer(sd, sd))


def group_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """Deal the bits to ``m`` groups of equal size (by one), correlated bits together, greedily."""
    left, groups = set(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        group = [max(sorted(left), key=lambda b: sum(correlation[b, c] for c in left))]
        left.remove(group[0])
        while len(group) < width:
            group.append(b := max(sorted(left), key=lambda b: sum(correlation[b, c] for c in group)))
            left.remove(b)
        groups.append(sorted(group))
    return groups


def masks_of(group: list[int], threshold: int) -> list[int]:
    """For each way to leave out ``threshold`` bits of the group: the mask of its other bits."""
    if threshold < 0:
        return []
    return [sum(1 << b for b in group if b not in out) for out in combinations(group, threshold)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def estimated_pairs(nodes: DataFrame, masks: list[int]) -> np.ndarray:
    """For each mask, an estimate of the pairs of fingerprints that agree on its bits.

    A signed count sketch of the masked keys estimates the sum of their squared counts; the
    sketches of all partitions are added up, so every fingerprint counts.
    """

    def partial(batches):
        sketch = np.zeros((len(masks), SKETCH + 1))
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for row, mask in zip(sketch, masks, strict=True):
                h = _mix((fps & np.uint64(mask)) + np.uint64(1))
                sign = 1.0 - 2.0 * (h >> np.uint64(63)).astype(np.float64)
                row[:SKETCH] += np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), sign, SKETCH)
                row[SKETCH] += len(fps)
        return sketch.ravel()

    sketch = sum_arrays(nodes.select("fp"), partial, len(masks) * (SKETCH + 1)).reshape(len(masks), -1)
    squares = (sketch[:, :SKETCH] ** 2).sum(axis=1)
    return np.clip((squares - sketch[:, SKETCH]) / 2, 0, None)


@dataclass(frozen=True)
class Probe:
    """Groups of bits and the threshold of each; ``masks`` are the keys that are probed."""

    groups: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    cost: float

    @property
    def masks(self) -> list[int]:
        return [m for g, t in zip(self.groups, self.thresholds, strict=True) for m in masks_of(list(g), t)]


def allocate(costs: list[dict[int, float]], radius: int) -> tuple[float, tuple[int, ...]]:
    """Thresholds, one a group, of the least total cost with ``sum(t + 1) = radius + 1``."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for cost in costs:
        then: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (total, chosen) in best.items():
            for t, c in cost.items():
                key, value = used + t + 1, (total + c, (*chosen, t))
                if key <= radius + 1 and (key not in then or value < then[key]):
                    then[key] = value
        best = then
    return best[radius + 1]


def plan_probe(nodes: DataFrame, radius: int, row_cost: float = 1.5, pair_cost: float = 0.01) -> Probe:
    """The cheapest grouping and thresholds; a key row is taken to cost ``row_cost``, a verified pair ``pair_cost`` (in µs)."""
    n, correlation = bit_correlation(nodes)
    choices: list[tuple[float, list[list[int]], tuple[int, ...]]] = []
    counts = [m for m in range(max(2, (radius + 1) // 3), min(radius + 1, BITS) + 1)]
    groupings = {m: group_bits(correlation, m) for m in counts}
    wanted = sorted({mask for g in groupings.values() for x in g for t in (0, 1) for mask in masks_of(x, t)})
    pairs = dict(zip(wanted, estimated_pairs(nodes, wanted), strict=True))
    for groups in groupings.values():
        costs = []
        for g in groups:
            at = [pairs[masks_of(g, 0)[0]], sum(pairs[x] for x in masks_of(g, 1))]
            # Beyond one masked bit: as if every further bit multiplied the pairs as the first did.
            grow = max(2.0, at[1] / max(at[0] * len(g), 1e-9)) if at[0] else 2.0
            at.append(at[1] * (len(g) - 1) / 2 * min(grow, 4.0))
            ways = [1, len(g), len(g) * (len(g) - 1) // 2]
            costs.append({-1: 0.0} | {t: row_cost * n * ways[t] + pair_cost * at[t] for t in range(3)})
        try:
            cost, thresholds = allocate(costs, radius)
        except KeyError:
            continue
        choices.append((cost, groups, thresholds))
    cost, groups, thresholds = min(choices)
    return Probe(tuple(map(tuple, groups)), thresholds, cost)


def _close(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def _run_links(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j), i < j, of one key and at most ``radius`` bits apart; keys are sorted."""
    left, right = [], []
    at = np.arange(len(key) - 1)
    step = 1
    while len(at := at[at + step < len(key)]):
        at = at[key[at] == key[at + step]]
        hit = at[_close(fp[at], fp[at + step], radius)]
        left.append(hit)
        right.append(hit + step)
        step += 1
    return np.concatenate(left or [at]), np.concatenate(right or [at])


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The linked sets of pairs (a, b), each as pairs of a member and its smallest member."""
    if not len(a):
        return a, b
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _walk(fp: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint of one key the first of its linked set, by walking from one to the next among those not met yet.

    A dense set is met in few steps, and no pairs are kept, so memory is that of the key's rows.
    """
    root, left = np.arange(len(fp)), np.arange(len(fp))
    while len(left):
        first, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            hit = _close(fp[left], fp[queue.pop()], radius)
            if hit.any():
                root[left[hit]] = first
                queue += left[hit].tolist()
                left = left[~hit]
    return root


def _links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (member, smallest member) of the linked sets of each key; keys are sorted. Short keys are compared pair by pair, side by side, long ones are walked."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    short = np.repeat(sizes <= WALKED, sizes)
    a, b = [], []
    for s, n in zip(starts[sizes > WALKED].tolist(), sizes[sizes > WALKED].tolist(), strict=True):
        root = _walk(fp[s : s + n], radius)
        own = np.flatnonzero(root != np.arange(n))
        a.append(rep[s : s + n][own])
        b.append(rep[s : s + n][root[own]])
    if short.sum() > 1:
        i, j = _run_links(key[short], fp[short], radius)
        a.append(rep[short][i])
        b.append(rep[short][j])
    return star(np.concatenate(a), np.concatenate(b)) if a else (rep[:0], rep[:0])


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """``(a, b)``: for fingerprints ``nodes(fp, rep)``, distinct in fp, pairs of rep that join all linked sets.

    No linked set is lost: each task reports, for its candidates, every set as a star. A key that
    more than ``LONG_RUN`` fingerprints share is dealt to several tasks by the pigeonhole principle
    again: of ``radius + 1`` blocks of bits, fingerprints within the radius are equal in one.
    """
    probe = plan_probe(nodes, radius)
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(probe.masks)])
    probes = nodes.where("rep IS NOT NULL").select("fp", "rep", F.explode(keys).alias("k")).select(F.col("k.part").alias("part"), F.col("k.key").alias("key"), "fp", "rep")
    hot = cut(probes.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > LONG_RUN).drop("n"))
    if hot.head(1):
        masks = [sum(1 << int(x) for x in block) for block in np.array_split(np.arange(BITS), radius + 1)]
        blocks = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks)])
        own = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).cast("bigint").alias("bits")))
        marked = probes.join(maybe_broadcast(hot.withColumn("hot", F.lit(True))), ["part", "key"], "left")
        probes = marked.select("part", "key", "fp", "rep", F.explode(F.when(F.col("hot"), blocks).otherwise(own)).alias("s")).select(F.struct("part", "s.i").alias("part"), F.struct("key", "s.bits").alias("key"), "fp", "rep")
    mixed = F.xxhash64("part", "key")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        held = 0

        def flush(last: bool):
            nonlocal rest, held
            table = np.concatenate(rest, axis=1)
            end = table.shape[1]
            if not last:  # the last key may go on in the next batch
                changes = np.flatnonzero(table[0][1:] != table[0][:-1])
                end = int(changes[-1]) + 1 if len(changes) else 0
            now, rest = table[:, :end], [table[:, end:]]
            held = table.shape[1] - end
            a, b = _links(now[0], now[1].view(np.uint64), now[2], radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        limit = RUN_ROWS
        for batch in batches:
            rest.append(np.stack([batch.column(i).to_numpy() for i in range(3)]))
            held += batch.num_rows
            if held >= limit:
                yield flush(False)
                limit = max(RUN_ROWS, 2 * held)  # one key may fill more than a batch
        if held:
            yield flush(True)

    dealt = probes.select(mixed.alias("h"), "fp", "rep").repartition("h").sortWithinPartitions("h", "fp")
    return dealt.mapInArrow(rows, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fp, component_id)`` of every row of ``docs``.

    component_id is the smallest id whose fingerprint can be reached through links of at
    most ``radius`` differing bits, the row's own included. Null text counts as empty; texts
    without words have fingerprint 0, linked like any other; repeated rows stay, and an
    empty table gives an empty result. Columns other than the two named are not read.
    """
    fps = cut(fingerprints(docs, words, id_col, text_col))
    nodes = cut(fps.groupBy("fp").agg(F.min(id_col).alias("rep")))
    if not nodes.head(1):
        return fps.withColumn("component_id", F.col(id_col))
    components = connected_components(links(nodes, radius))
    named = cut(nodes.join(components, nodes.rep == components.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id")))
    return fps.join(named, "fp").select(id_col, "fp", "component_id")


def op3_simhash(spark, sf_dir):
    """Every document's fingerprint (4-word shingles) and component at 4 or fewer differing bits."""
    from .common import read

    out = near_duplicates(read(spark, sf_dir, "documents"), words=4, radius=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
