"""Hard negatives by one-dimensional distance keys.

Nearness is the inner product. A vector x with one more component, sqrt(M^2 - |x|^2), where M is the
largest norm, lies on a sphere of radius M; a query (q, 0) has an angle to it whose cosine
is q.x / (|q| M). So the order by inner product is the order by angle, and angles obey the triangle inequality.

Rows are stored sorted by (pivot, angle to the pivot), the pivot being the nearest of a bounded set, and cut into blocks of like size.
A query's angle to a pivot and the interval of keys of a block bound the scores that the block can hold. Queries
read the blocks that can hold their best scores first, then wider rings of blocks, until no block
that is left can hold a row better than the last that they have found. Where no bound excludes
anything, all blocks are read; the result is exact either way.

Queries are taken together in blocks too, and a task meets one block of queries with a bounded
run of blocks of rows; what it returns is as large as its queries. Of rows of equal
vector and label only the few smallest ids can be found, which is settled before anything is joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ann import kmeans
from .common import cut, read, ship

#: Rows that pivots are fitted on (those of the smallest hashes), the most pivots, and rows for each.
SAMPLE, PIVOTS, PIVOT_ROWS = 20_000, 256, 1024
#: Rows of a block, more where there would be over so many blocks; queries that are taken together.
BLOCK, MOST_BLOCKS, QUERIES = 2048, 1 << 16, 512
#: Blocks read in the first round; the factor by which the rounds grow, and the most blocks of one round.
FIRST, WIDER, MOST = 16, 4, 4096
#: Bytes of blocks that one task meets with a block of queries, and runs of a round at most.
RUN_BYTES, RUNS = 16 << 20, 256
#: Errors of angles computed in double precision stay far below this.
SLACK = 1e-6
NONE = np.iinfo(np.int64).min


@dataclass
class Request:
    """Many queries' vectors, labels and ids, the range of scores wanted, and what is found so far: (score, id), best first."""

    ids: np.ndarray
    numbers: np.ndarray
    labels: np.ndarray
    low: np.ndarray
    high: np.ndarray
    vectors: np.ndarray
    scores: np.ndarray
    found: np.ndarray


FIELDS = ("ids", "numbers", "labels", "low", "high", "vectors", "scores", "found")
_NUMBERS = ", ".join(f"{f} binary" for f in FIELDS)


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, dtype="<i8").tobytes()


def _long(value) -> np.ndarray:
    return np.frombuffer(value, "<i8")


def _request(row: dict, dim: int, k: int) -> Request:
    x = {f: _long(row[f]) for f in FIELDS}
    return Request(**{f: x[f] for f in FIELDS[:5]}, vectors=x["vectors"].reshape(-1, dim), scores=x["scores"].reshape(-1, k), found=x["found"].reshape(-1, k))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point where no sum can pass 2^53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def _augmented(v: np.ndarray, largest: float) -> np.ndarray:
    """Unit vectors with one more component. A zero table has M 0 and lies at one point."""
    x = v / largest if largest else v.astype(np.float64)
    return np.hstack([x, np.sqrt(np.clip(1 - (x * x).sum(axis=1), 0, None))[:, None]])


class Directory:
    """The pivots, and of each block its number, pivot, interval of angles, and a mask of its labels."""

    def __init__(self, pivots: np.ndarray, largest: float, blocks: list) -> None:
        self.pivots, self.largest = pivots, largest
        self.number, self.pivot = (np.array([b[i] for b in blocks], np.int64) for i in (0, 1))
        self.first, self.last = (np.array([b[i] for b in blocks], np.float64) for i in (2, 3))
        self.mask = np.array([b[4] for b in blocks], np.int64).view(np.uint64)

    def bounds(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score that each block may hold for each vector, a column a block."""
        norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        unit = np.hstack([vectors / np.maximum(norm, 1e-300)[:, None], np.zeros((len(vectors), 1))])
        angle = _angles(unit, self.pivots)[:, self.pivot]
        near = np.maximum(0.0, np.maximum(angle - self.last, self.first - angle) - SLACK)
        far = np.minimum(np.pi, angle + self.last + SLACK)
        scale = (norm * self.largest)[:, None]
        edge = 1 + 1e-9 * scale
        return scale * np.cos(far) - edge, scale * np.cos(near) + edge


def label_bit(labels: np.ndarray) -> np.ndarray:
    return np.uint64(1) << (labels.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58))


def wanted_blocks(request: Request, directory: Directory, done: np.ndarray, same: bool, k: int, count: int) -> list[int]:
    """The next blocks to read, by number: of those that may still change a result, the ``count`` that meet the queries' ranges nearest to their upper end."""
    left = np.flatnonzero(~np.isin(directory.number, done))
    urgency = np.full(len(left), np.inf)
    for at in range(0, len(request.ids), 64):
        part = slice(at, at + 64)
        least, most = (x[:, left] for x in directory.bounds(request.vectors[part]))
        full = request.found[part, k - 1] != NONE
        need = np.where(full, np.maximum(request.scores[part, k - 1], request.low[part]), request.low[part])
        high = request.high[part].astype(np.float64)
        useful = (most >= need[:, None]) & (least <= high[:, None])
        if same:
            useful &= (label_bit(request.labels[part])[:, None] & directory.mask[left][None]) != 0
        off = np.abs(np.minimum(high[:, None], np.iinfo(np.int64).max) - (least + most) / 2) if not same else -most
        urgency = np.minimum(urgency, np.where(useful, off, np.inf).min(axis=0, initial=np.inf))
    order = np.argsort(urgency, kind="stable")
    return directory.number[left[order[np.isfinite(urgency[order])]]][:count].tolist()


def merge(scores: np.ndarray, found: np.ndarray, new_scores: np.ndarray, new_found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of both for each row: larger scores first, then smaller ids; missing ones have score and id ``NONE``."""
    s, f = np.hstack([scores, new_scores]), np.hstack([found, new_found])
    missing = f == NONE
    rows = np.arange(len(s))[:, None]
    order = np.argsort(np.where(missing, np.iinfo(np.int64).max, f), axis=1, kind="stable")
    s, f, missing = s[rows, order], f[rows, order], missing[rows, order]
    order = np.argsort(np.where(missing, np.iinfo(np.int64).max, -s), axis=1, kind="stable")
    order = order[rows, np.argsort(missing[rows, order], axis=1, kind="stable")][:, :k]
    return s[rows, order], f[rows, order]


def meet(request: Request, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of a block for each query: of its label or of any other, within its range of scores, itself left out."""
    scores = np.full((len(request.ids), k), NONE)
    found = np.full((len(request.ids), k), NONE)
    order = np.argsort(ids, kind="stable")
    ids, labels, vectors = ids[order], labels[order], vectors[order]
    for at in range(0, len(request.ids), 128):
        part = slice(at, at + 128)
        s = products(request.vectors[part], vectors)
        fits = ((request.labels[part, None] == labels[None]) == same) & (s <= request.high[part, None]) & (s >= request.low[part, None]) & (request.ids[part, None] != ids[None])
        s = np.where(fits, s, NONE)
        take = min(k, s.shape[1])
        # The least of the k best; ties beyond are settled by id, as columns are in the order of ids.
        limit = np.partition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take]
        for i in range(len(s)):
            near = np.flatnonzero((s[i] >= limit[i]) & fits[i])
            near = near[np.argsort(-s[i, near], kind="stable")][:k]
            scores[at + i, : len(near)], found[at + i, : len(near)] = s[i, near], ids[near]
    return scores, found


def store(rows: DataFrame, dim: int, n: int, largest: float) -> tuple[DataFrame, Directory]:
    """Rows ``(id, label, v)`` sorted by (pivot, angle), as blocks, and their directory."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v").toPandas()
    x = np.unique(_augmented(np.stack(sample["v"].to_numpy()).astype(np.float64), largest), axis=0)
    pivots = kmeans(x, int(min(PIVOTS, len(x), max(1, n // PIVOT_ROWS))))
    sent = spark.sparkContext.broadcast((pivots, largest))
    size = max(BLOCK, -(-n // MOST_BLOCKS))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, largest = sent.value
        for b in batches:
            if b.num_rows:
                angle = _angles(_augmented(_vectors(b.column(2), dim).astype(np.float64), largest), pivots)
                nearest = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest.astype(np.int32)), pa.array(angle[np.arange(len(angle)), nearest])], names=["id", "label", "v", "pivot", "angle"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, have, number = [], 0, TaskContext.get().partitionId() << 24

        def packed(table: pa.Table) -> pa.RecordBatch:
            ids, labels, v, angle = table["id"].to_numpy(), table["label"].to_numpy(), _vectors(table["v"].combine_chunks(), dim), table["angle"].to_numpy()
            mask = int(np.bitwise_or.reduce(label_bit(labels)).view(np.int64))
            columns = [[number], [table["pivot"][0].as_py()], [angle.min()], [angle.max()], [mask], [_pack(ids)], [_pack(labels)], [_pack(v)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, BLOCK_TYPES, strict=True)], names=BLOCK_NAMES)

        for b in batches:
            # A block lies within one pivot.
            pivots = b.column(3).to_numpy()
            for lo, hi in zip(edges := np.flatnonzero(np.r_[True, pivots[1:] != pivots[:-1]]), [*edges[1:], len(pivots)], strict=True):
                piece = pa.Table.from_batches([b.slice(lo, hi - lo)])
                if held and held[0]["pivot"][0].as_py() != piece["pivot"][0].as_py():
                    yield packed(pa.concat_tables(held))
                    held, have, number = [], 0, number + 1
                held.append(piece)
                have += piece.num_rows
                while have >= size:
                    whole = pa.concat_tables(held)
                    yield packed(whole.slice(0, size))
                    number += 1
                    held, have = ([whole.slice(size)], have - size) if have > size else ([], 0)
        if held:
            yield packed(pa.concat_tables(held))

    keyed = cut(rows.mapInArrow(keys, "id bigint, label bigint, v array<bigint>, pivot int, angle double"))
    ordered = keyed.repartitionByRange("pivot", "angle", "id").sortWithinPartitions("pivot", "angle", "id")
    stored = cut(ordered.mapInArrow(blocks, "block bigint, pivot int, first double, last double, mask bigint, ids binary, labels binary, vectors binary"))
    # At most MOST_BLOCKS full blocks, and one a partition and pivot.
    return stored, Directory(pivots, largest, [tuple(r) for r in stored.select("block", "pivot", "first", "last", "mask").collect()])


BLOCK_NAMES = ["block", "pivot", "first", "last", "mask", "ids", "labels", "vectors"]
BLOCK_TYPES = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def nearest(stored: DataFrame, directory: Directory, asked: DataFrame, dim: int, k: int, same: bool) -> DataFrame:
    """``(query, number, rank, id, score)``: the k best rows for each of ``asked(query, number, label, low, high, v)``, of the same label or of others, with scores from low to high."""
    spark = stored.sparkSession
    sent = spark.sparkContext.broadcast(directory)
    run = int(max(1, RUN_BYTES // max(1, 8 * dim * BLOCK)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries that stand together in the order of pivot and angle, as one row."""
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for at in range(0, b.num_rows, QUERIES):
                c = b.slice(at, QUERIES)
                none = np.full((c.num_rows, k), NONE)
                v = _vectors(c.column(5), dim)
                data = [c.column(i).to_numpy() for i in range(5)]
                state = Request(*data, vectors=v, scores=none, found=none)
                yield _row(number, state, [], wanted_blocks(state, sent.value, np.zeros(0, np.int64), same, k, FIRST))
                number += 1

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory = sent.value
        for b in batches:
            if b.num_rows:
                v = _vectors(b.column(5), dim).astype(np.float64)
                unit = np.hstack([v / np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-300)[:, None], np.zeros((len(v), 1))])
                angle = _angles(unit, directory.pivots)
                near = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(angle[np.arange(len(v)), near])], names=[*b.schema.names, "pivot", "angle"])

    def _row(number: int, s: Request, done: list[int], wanted: list[int]) -> pa.RecordBatch:
        columns = [pa.array([number]), pa.array([done], pa.list_(pa.int64())), pa.array([wanted], pa.list_(pa.int64())), *(pa.array([_pack(getattr(s, f))], pa.binary()) for f in FIELDS)]
        return pa.RecordBatch.from_arrays(columns, names=["of", "done", "wanted", *FIELDS])

    state_type = f"of bigint, done array<bigint>, wanted array<bigint>, {_NUMBERS}"
    part_type = "of bigint, scores binary, found binary"

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("of", pa.int64()), ("scores", pa.binary()), ("found", pa.binary())])
        if not left.num_rows:
            return out.empty_table()
        request = _request({f: left[f][0].as_buffer() for f in FIELDS}, dim, k)
        scores, found = np.full_like(request.scores, NONE), np.full_like(request.found, NONE)
        for i in range(right.num_rows):
            ids, labels, vectors = (_long(right[c][i].as_buffer()) for c in ("ids", "labels", "vectors"))
            scores, found = merge(scores, found, *meet(request, ids, labels, vectors.reshape(-1, dim), same, k), k)
        return pa.table([left["of"].slice(0, 1), pa.array([_pack(scores)], pa.binary()), pa.array([_pack(found)], pa.binary())], schema=out)

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {f: left[f][0].as_buffer() for f in FIELDS}
        request, done, last = _request(row, dim, k), left["done"][0].as_py(), left["wanted"][0].as_py()
        for i in range(right.num_rows):
            new = (_long(right[c][i].as_buffer()).reshape(-1, k) for c in ("scores", "found"))
            request.scores, request.found = merge(request.scores, request.found, *new, k)
        done = done + last
        wanted = wanted_blocks(request, sent.value, np.array(done, np.int64), same, k, min(MOST, WIDER * len(last)))
        return pa.Table.from_batches([_row(left["of"][0].as_py(), request, done, wanted)])

    columns = ["query", "number", "label", "low", "high", "v"]
    keyed = asked.select(*columns).mapInArrow(keys, "query bigint, number bigint, label bigint, low bigint, high bigint, v array<bigint>, pivot int, angle double")
    ordered = cut(keyed).repartitionByRange("pivot", "angle", "query", "number").sortWithinPartitions("pivot", "angle", "query", "number")
    open_, closed = cut(ordered.mapInArrow(pack, state_type)), []
    while open_.where(F.size("wanted") > 0).head(1):
        closed.append(open_.where(F.size("wanted") == 0))
        open_ = open_.where(F.size("wanted") > 0)
        each = F.greatest(F.lit(run), F.ceil(F.size("wanted") / RUNS).cast("int"))
        pairs = open_.select("of", each.alias("each"), F.posexplode("wanted").alias("i", "block")).select("of", "block", F.floor(F.col("i") / F.col("each")).cast("int").alias("run"))
        left = open_.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.size("wanted") - 1) / each).cast("int")))).select("of", "run", *FIELDS)
        right = stored.select("block", "ids", "labels", "vectors").withColumnsRenamed({f: f"of_{f}" for f in ("ids", "labels", "vectors")})
        right = pairs.join(right, "block").select(F.col("of").alias("for"), F.col("run").alias("turn"), *[F.col(f"of_{f}").alias(f) for f in ("ids", "labels", "vectors")])
        parts = left.groupBy("of", "run").cogroup(right.groupBy("for", "turn")).applyInArrow(scan, part_type)
        open_ = cut(open_.groupBy("of").cogroup(parts.groupBy("of")).applyInArrow(settle, state_type))
    for c in closed:
        open_ = open_.unionByName(c)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.select(list(FIELDS)).to_pylist():
                r = _request(row, dim, k)
                who, rank = np.nonzero(r.found != NONE)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (r.ids[who], r.numbers[who], (rank + 1).astype(np.int32), r.found[who, rank], r.scores[who, rank])], names=["query", "number", "rank", "id", "score"])

    return open_.mapInArrow(unpack, "query bigint, number bigint, rank int, id bigint, score bigint")


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label: F.Column | str, scale: float) -> DataFrame:
    """``(id, label, v)`` in whole numbers, floor(scale x); rows with a null id, label, vector or component, or one that is not finite, are left out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("label"), x.alias("x"))
    return rows.where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(~bad).select("id", "label", F.transform("x", lambda c: F.floor(c * scale).cast("bigint")).alias("v"))


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, percent: tuple[int, int] = (50, 95)) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows`` and ``anchors`` are ``(id, label, v)`` of whole numbers; a score is the inner product with the anchor, higher
    ones come first, ties by smaller id. An anchor's positives are its first other rows of its label; for each, the first rows of other labels are returned
    whose score is within ``percent`` of the positive's. Vectors of each length are mined by themselves.
    Rows of one id, label and vector count once, and of one id with several vectors or labels each; rows of one id are never each other's
    result, and the anchor is the one of the smallest label, then vector. Vectors without components take no part.
    Fewer are returned if there are fewer; an empty table gives an empty result. Inner products must fit 64 bits.
    """
    spark = rows.sparkSession
    ship(spark)
    out = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    rows = cut(rows.where(F.size("v") > 0).distinct())
    anchors = cut(anchors.where(F.size("v") > 0).groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.label", "a.v"))
    for dim in sorted(r["dim"] for r in anchors.select(F.size("v").alias("dim")).distinct().collect()):  # one row a length
        ours, theirs = (x.where(F.size("v") == dim) for x in (rows, anchors))
        out = out.unionByName(_mine(ours, theirs, dim, positives, negatives, percent))
    return out


def _mine(rows: DataFrame, anchors: DataFrame, dim: int, positives: int, negatives: int, percent: tuple[int, int]) -> DataFrame:
    # Of equal vectors of one label no more than the smallest ids can be among the first.
    rank = F.row_number().over(Window.partitionBy("v", "label").orderBy("id"))
    rows = cut(rows.withColumn("place", rank).where(F.col("place") <= max(positives, negatives) + 1).drop("place"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    seen = rows.agg(F.count("*").alias("n"), F.max(square).alias("m")).first()
    if not seen["n"]:
        return rows.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    stored, directory = store(rows, dim, seen["n"], float(np.sqrt(seen["m"])))
    least, most = (F.lit(x).cast("bigint") for x in (-(2**62), 2**62))
    asked = anchors.select(F.col("id").alias("query"), F.lit(0).cast("bigint").alias("number"), "label", least.alias("low"), most.alias("high"), "v")
    best = cut(nearest(stored, directory, asked, dim, positives, True))
    # Whole scores from ceil(50 p / 100) to floor(95 p / 100).
    upper, lower = F.expr(f"div({percent[1]} * score - pmod({percent[1]} * score, 100), 100)"), F.expr(f"-div({-percent[0]} * score - pmod({-percent[0]} * score, 100), 100)")
    ranges = best.select("query", F.col("id").alias("number"), upper.alias("high"), lower.alias("low"), "score")
    again = ranges.where("low <= high").join(anchors.select(F.col("id").alias("query"), "label", "v"), "query").select("query", "number", "label", "low", "high", "v")
    hard = nearest(stored, directory, again, dim, negatives, False)
    return hard.select("query", "number", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(ranges.select("query", "number", "score"), ["query", "number"]).select(
        F.col("query").alias("anchor_id"), F.col("number").alias("positive_id"), "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score"
    )


def op12_hard_negatives(spark, sf_dir):
    """Hard negatives of every vector whose id is divisible by 50, among all vectors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = cut(prepared(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, 256.0))
    return mine(rows, rows.where("id % 50 = 0"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id::BIGINT AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)
), pos AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
  SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id))::INT AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
  FROM pos p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT * FROM ranked WHERE rank <= 3
"""
