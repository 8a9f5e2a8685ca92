"""Counting series of propagated options, against all products; and what a strict projection refuses."""

import itertools
import random

from pyspark.sql import functions as F

from veristrata.operators import monthly

SCHEMA = "i int, table_key string, axes array<struct<level:int,obj:string,choices:array<struct<id:string,unit:string,s:int,e:int>>>>, claim_unit string"


def brute(axes, claim_unit):
    """Signatures of all series: no place used twice, one unit, which a stated one is compatible with."""
    won = {"원", "천원", "만원", "백만원", "억원", "조원"}
    whole, out = 0, []
    for pick in itertools.product(*[a[2] for a in axes]):
        spans = [(c[2], c[3]) for c in pick if c[2] is not None]
        if any(a[0] < b[1] and b[0] < a[1] for a, b in itertools.combinations(spans, 2)):
            continue
        whole += 1
        units = [c[1].strip() for c in pick if c[1].strip()]
        same = len({u.lower().replace(" ", "") for u in units}) <= 1
        fits = not claim_unit.strip() or (units and (units[-1].lower().replace(" ", "") == claim_unit.lower().replace(" ", "") or {units[-1], claim_unit.strip()} <= won))
        if same and fits:
            out.append("|".join(["T", pick[0][0], ",".join(c[0] for c in pick[1:])]))
    return out, whole


def test_series_by_all_products(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        axes = []
        for level in range(rng.randint(1, 4)):
            choices = []
            for n in range(rng.randint(1, 3)):
                at = rng.choice([None, rng.randint(0, 8)])
                choices.append((f"v{n}", rng.choice(["", "", "명", "원"]), at, None if at is None else at + rng.randint(1, 4)))
            axes.append((level, f"o{level}" if level else "", choices))
        rows.append((i, "T", axes, rng.choice(["", "명", "억원"])))
    got = {r.i: r for r in monthly.count_series(spark.createDataFrame(rows, SCHEMA), "claim_unit").collect()}
    seen = set()
    for i, _, axes, unit in rows:
        want, whole = brute(axes, unit)
        assert got[i].n == len(want) and got[i].signature == (want[0] if len(want) == 1 else None)
        assert got[i].reason == (None if want else "UNIT_MISMATCH" if whole else "SPAN_REUSE")
        seen.add((min(len(want), 2), got[i].reason))
    assert len(seen) == 4


def test_many_series_are_counted_not_listed(spark):
    axes = [(0, "", [("A", "", 0, 2)])] + [(level, f"o{level}", [(f"v{n}", "", None, None) for n in range(10)]) for level in range(1, 9)]
    r = monthly.count_series(spark.createDataFrame([(1, "T", axes, "")], SCHEMA), "claim_unit").first()
    assert (r.n, r.signature, r.reason) == (1e8, None, None)


def test_strict_projection(spark):
    make = spark.createDataFrame
    values = make([("T", "G", "시도별", 1, "00", "전국", ""), ("T", "G", "시도별", 1, "21", "부산", ""), ("T", "C", "항목별", 2, "b", "출생아 수(명)", "명"), ("T", "C", "항목별", 2, "d", "사망자 수(건)", "명")], "table_key string, obj_id string, obj_nm string, level int, value_id string, value_name string, value_unit string")
    items = make([("T", "A", "인구", "")], "table_key string, itm_id string, itm_nm string, unit string")
    coverage = make([("T", "M", 202001, 202412)], "table_key string, freq string, lo int, hi int")
    rows = [(1, "출생아", "출생아", "명", "", "", "2024-03"), (2, "출생아", "출생아", "명", "부산", "", "2024-03"), (3, "출생아", "출생아", "명", "달", "", "2024-03"), (4, "출생아", "출생아", "원", "", "", "2024-03"), (5, "출생아", "출생아", "", "", "", "2024-Q1"), (6, "사망자", "사망자", "", "", "", "2024-03"), (7, "출생아", "출생아", "", "", "달사람", "2024-03"), (8, "출생아", "출생아", "", "", "", "2025-03"), (9, None, None, None, None, None, None)]
    claims = make(rows, "target_id int, indicator string, subject string, unit string, region string, population string, period string")
    candidates = claims.select("target_id", F.lit("T").alias("table_key"))
    got = {r.target_id: (r.n, r.signature, r.reason) for r in monthly.project_monthly(claims, candidates, items, values, coverage, [], True).collect()}
    # A bracket that is not the value's unit makes no count.
    assert got == {1: (1.0, "T|A|00,b", None), 2: (1.0, "T|A|21,b", None), 3: (0.0, None, "REGION_UNBOUND"), 4: (0.0, None, "UNIT_MISMATCH"), 5: (0.0, None, "PERIOD_INVALID"), 6: (0.0, None, "DIMENSION_MISSING"), 7: (0.0, None, "POPULATION_UNBOUND"), 8: (0.0, None, "PERIOD_OUT_OF_RANGE"), 9: (0.0, None, "PERIOD_INVALID")}
    done = {r.target_id: (r.status, r.reason) for r in monthly.resolve(monthly.project_monthly(claims, candidates, items, values, coverage, []), claims.select("target_id", F.lit("COMPLETE").alias("status"))).collect()}
    assert done[1] == ("HOLD", "DIMENSION_MISSING") and done[2] == ("QUERY_READY", None)
