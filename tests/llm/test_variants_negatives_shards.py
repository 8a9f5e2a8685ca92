"""Spelling variants, hard negatives and shards: against brute force, the queries' SQL, and odd rows."""

import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veristrata.llm import negatives, sharding, spelling

SF = "/root/testdata/sf0.001"


def same_rows(spark, query, sql):
    got = query(spark, SF).toArrow()
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(sql).to_arrow_table()
    columns = sorted(want.column_names)
    assert columns == sorted(got.column_names)
    rows = lambda t: sorted(map(str, zip(*[t[c].to_pylist() for c in columns], strict=True)))
    assert rows(got) == rows(want) and got.num_rows


def test_spelling_sql(spark):
    same_rows(spark, spelling.op11_spelling, spelling.OP11_SQL)


def test_negatives_sql(spark):
    same_rows(spark, negatives.op12_hard_negatives, negatives.OP12_SQL)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        friends = [v for v in counts if near(w, v)]
        best = min(friends, key=lambda v: (-counts[v], v), default=None)
        ok = best is not None and counts[best] >= ratio * n
        out[w] = (best if ok else None, n, len(friends), counts[best] if ok else None)
    root = {}
    for w in counts:
        r = w
        while out[r][0]:
            r = out[r][0]
        root[w] = r
    return {w: (f, root[w], n, k, m) for w, (f, n, k, m) in out.items()}


def test_variants_by_brute_force(spark):
    rng = random.Random(8)
    counts = {}
    for _ in range(120):  # few letters: anagrams, runs of one letter, and dense neighbourhoods
        counts["".join(rng.choice("abÀ÷") for _ in range(rng.randint(1, 6)))] = 10 ** rng.randint(0, 4) * rng.randint(1, 3)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéÿ") for _ in range(3000))
    counts |= {long: 1000, long[:1500] + long[1501:]: 100, long[:1500] + "q" + long[1502:]: 9, long[:700] + "x" + long[700:]: 1, "lone": 5, "": 3, "𝒳y": 50, "𝒴y": 5}
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")).collect()}
    assert got == brute_variants(counts)


def test_spelling_of_documents(spark):
    odd = [(1, None), (None, "Abcdefgh abcdefgh"), (3, ""), (4, "ABCDEFGH1abcdefgh_ÉCOLIERS écoliers"), (4, "abcdefgh " * 4000), (5, "short x"), (6, "abcdefg÷ab" * 2)]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in odd], "doc_id bigint, text string, word string, n bigint")

    def words():
        import re

        for i, t in odd:
            for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                yield run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run

    want = {}
    for w in words():
        want[w] = want.get(w, 0) + 1
    assert {r.word: r.n for r in spelling.counted(spelling.document_words(docs)).collect()} == {w: n for w, n in want.items() if n >= 2 and len(w) >= 7}
    assert spelling.variants(spelling.counted(spelling.document_words(docs.limit(0)))).count() == 0
    assert spelling.variants(spark.createDataFrame([(None, 4), ("a", 1)], "word string, n bigint")).collect()[0].root == "a"


def test_slips(spark):
    rows = [(str(i), w) for i in range(400) for w in ("spelling", "écoliers")]
    got = spark.createDataFrame(rows, "id string, run string").select("id", "run", spelling.with_slips(F.col("id"), F.col("run")).alias("w")).collect()
    for r in got:
        h = zlib.crc32(f"{r.id}:{r.run}".encode())
        assert r.w == (r.run if h % 31 else r.run[: h % len(r.run)] + r.run[h % len(r.run) + 1 :])
    assert any(r.w != r.run for r in got)


def brute_negatives(rows, anchors, positives=5, count=3):
    out = set()
    for a, label, v in anchors:
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), i, o) for i, o, w in rows if i != a and len(w) == len(v)))
        for p, pos, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:count]
            out |= {(a, pos, r, i, -p, -s) for r, (s, i, _) in enumerate(fits, 1)}
    return out


@pytest.mark.parametrize(("kind", "spread"), [("even", 1.0), ("clusters", 0.05), ("copies", 0.0)])
def test_negatives_by_brute_force(spark, monkeypatch, kind, spread):
    for name, value in {"BLOCK": 16, "QUERIES": 4, "FIRST": 1, "WIDER": 2, "MOST": 8, "PIVOT_ROWS": 40, "RUN_BYTES": 1024, "RUNS": 3}.items():
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(len(kind))
    centres = rng.normal(size=(9, 6))
    x = centres[rng.integers(0, 9, 400)] + spread * rng.normal(size=(400, 6))
    rows = [(int(i), int(rng.integers(0, 4)), np.floor(256 * v).astype(int).tolist()) for i, v in enumerate(x)]
    rows += [(1000, 77, rows[0][2]), (1001, 78, [0] * 6), (1002, 0, [0] * 6), (1003, 0, [5, 5]), (1004, 0, [4, 4]), (1005, 1, [4, 3]), (1006, 9, [1])]
    anchors = [r for r in rows if r[0] % 20 == 0 or r[0] > 999]
    table = lambda r: spark.createDataFrame(r, "id bigint, label bigint, v array<bigint>")
    got = negatives.mine(table(rows + rows[:5]), table(anchors)).collect()
    assert {tuple(r) for r in got} == brute_negatives(rows, anchors) and len(got) == len({tuple(r) for r in got})


def test_negatives_skip_blocks(spark, monkeypatch):
    """On clustered vectors the bounds leave most blocks unread."""
    monkeypatch.setattr(negatives, "BLOCK", 32)
    monkeypatch.setattr(negatives, "PIVOT_ROWS", 64)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 4000)] + 0.02 * rng.normal(size=(4000, 16))
    v = np.floor(256 * x).astype(np.int64)
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(4000), "label": np.arange(4000) % 7, "v": v.tolist()}))
    stored, directory = negatives.store(rows, 16, 4000, float(np.sqrt((v * v).sum(axis=1).max())))
    least, most = directory.bounds(v[:50])
    held = {}
    for r in stored.collect():
        held[r.block] = np.frombuffer(bytes(r.vectors), "<i8").reshape(-1, 16)
    for j, number in enumerate(directory.number):
        s = v[:50] @ held[number].T
        assert (s.min(axis=1) >= least[:, j]).all() and (s.max(axis=1) <= most[:, j]).all()
    fifth = np.sort(v[:50] @ v.T, axis=1)[:, -6]
    assert (most >= fifth[:, None]).mean() < 0.35


def test_negatives_odd_rows(spark):
    schema = "vec_id bigint, embedding array<double>, label int, id string, v string"
    rows = [(0, [1.0, 0.0], 1, "x", "y"), (1, None, 1, "x", "y"), (2, [1.0, None], 1, "x", "y"), (3, [float("nan"), 1.0], 1, "x", "y"), (4, [1.0, 0.1], None, "x", "y"), (None, [1.0, 0.1], 1, "x", "y"), (5, [float("inf"), 1.0], 1, "x", "y"), (6, [0.9, 0.0], 1, "x", "y"), (7, [0.6, 0.0], 2, "x", "y")]
    ready = negatives.prepared(spark.createDataFrame(rows, schema), "vec_id", "embedding", "label", 256.0)
    assert sorted(r.id for r in ready.collect()) == [0, 6, 7]
    got = [tuple(r) for r in negatives.mine(ready, ready.where("id = 0")).collect()]
    assert got == [(0, 6, 1, 7, 256 * 230, 256 * 153)]
    table = lambda r: spark.createDataFrame(r, "id bigint, label bigint, v array<bigint>")
    several = table([(0, 2, [9, 9]), (0, 1, [10, 0]), (0, 1, [10, 0]), (1, 1, [10, 0]), (2, 2, [7, 1]), (2, 2, [8, 0]), (3, 3, []), (4, 1, [])])
    assert sorted(tuple(r) for r in negatives.mine(several, several.where("id = 0 OR id = 3")).collect()) == [(0, 1, 1, 2, 100, 80), (0, 1, 2, 2, 100, 70)]
    assert negatives.mine(ready.limit(0), ready.limit(0)).count() == 0 and negatives.mine(ready, ready.limit(0)).count() == 0


def brute_capacity(sizes, shards):
    def needs(c):
        n, room = 0, 0
        for x in sizes:
            if x > c:
                n, room = n + 1, 0
            elif x <= room:
                room -= x
            else:
                n, room = n + 1, c - x
        return n

    low, high = 1, max(1, sum(sizes))
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if needs(middle) <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize(("n", "shards", "cells", "huge"), [(0, 4, 64, 0), (1, 4, 64, 0), (3, 16, 64, 0), (300, 5, 8, 2), (3000, 16, 64, 2), (3000, 16, 65536, 0), (2000, 7, 16, 0), (400, 1, 8, 1)])
def test_smallest_capacity(spark, n, shards, cells, huge):
    rng = random.Random(n + shards)
    sizes = [rng.choice([1, 2, 5, rng.randint(1, 10**6)]) for _ in range(n)]
    for i in range(huge):
        sizes[rng.randrange(n)] = 10 ** (9 - i)
    ends = np.cumsum(np.array([0, *sizes]))
    groups = spark.createDataFrame([(s, int(a), int(b)) for s, a, b in zip(sizes, ends[:-1], ends[1:], strict=True)], "size bigint, start bigint, end bigint")
    cuts, capacity = sharding.cut_points(groups, shards, cells)
    assert capacity == brute_capacity(sizes, shards)
    bounds = [0, *cuts]
    assert bounds[-1] == int(ends[-1]) and len(cuts) == shards
    even = sharding.even_ends(groups, shards, cells)
    assert set(even) <= set(ends.tolist()) and len(even) == shards and max((b - a for a, b in zip([0, *even], even)), default=0) <= max([capacity, *sizes])
    assert set(bounds) <= set(ends.tolist()) and bounds == sorted(bounds)
    assert all(b - a <= capacity or b - a in sizes for a, b in zip(bounds, bounds[1:], strict=False))


def test_shards_of_documents(spark, tmp_path):
    rng = random.Random(6)
    texts = ["é" * rng.randint(0, 300) + str(rng.randint(0, 400)) for _ in range(1500)] + [None, "", None, " ", "x" * 50_000]
    rows = [(rng.choice([None, *range(900)]), t, "s", 1, "z") for t in texts] + [(7, "hot text", "s", 1, "z")] * 1600 + [(i, "hot text", "s", 1, "z") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string, start bigint, shard_number_ string")
    got = sharding.assign(docs, 16).collect()
    assert len(got) == len(rows)
    facts = lambda i, t: (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted(map(str, ((r.id, r.size, r.text_crc32) for r in got))) == sorted(str(facts(r[0], r[1])) for r in rows)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r)
    assert set(by_shard) <= set(range(16)) and all(sorted(r.slot for r in x) == list(range(len(x))) for x in by_shard.values())
    of_text = {}
    for r in got:
        of_text.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(x) == 1 for x in of_text.values())
    group_bytes = {}
    for r in got:
        group_bytes[r.size, r.text_crc32] = group_bytes.get((r.size, r.text_crc32), 0) + r.size
    load = sorted((sum(r.size for r in x) for x in by_shard.values()), reverse=True)
    # The 50 kB text stands alone; the others are alike before it, and behind it.
    assert load[0] == max(group_bytes.values()) and load[1] <= 2 * load[-1]
    again = {(r.id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.assign(docs.repartition(7), 16, cells=16).collect()}
    assert again == {(r.id, r.size, r.text_crc32, r.shard, r.slot) for r in got}
    sharding.write_shards(docs, str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert set(written.columns) == {*docs.columns, "shard_number"} and written.count() == len(rows)
    counts = {r.shard_number: r["count"] for r in written.groupBy("shard_number").count().collect()}
    assert counts == {k: len(x) for k, x in by_shard.items()}
    assert sharding.assign(docs.limit(0)).count() == 0


def test_sharding_query(spark):
    got = sharding.op13_sharding(spark, SF).toPandas()
    assert got["law"].eq("bytes").all() and got["grown_shard"].isna().all() and sorted(got["shard"].unique()) == list(range(16))
    load = got.groupby("shard")["size"].sum()
    assert load.max() <= 1.2 * load.mean()
