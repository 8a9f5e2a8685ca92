"""The live loop on a small release: rounds, budgets, several answers, and what is held."""

import pytest
from pyspark.sql import functions as F

from veristrata.operators import live, matching

TARGET = "target_id int, routing_class string, indicator string, unit string, region string, population string, freq string, period string, ord int, value_text string"


@pytest.fixture(scope="module")
def release(spark):
    make = spark.createDataFrame
    titles = make([("T1", "고용 동향"), ("T2", "고용 지수"), ("D", "월간 운항")], "table_key string, title string")
    items = make([("T1", "A", "실업률", "%"), ("T1", "B", "취업자 수", "천명"), ("T2", "C", "고용 지수", ""), ("T2", "E", "실업률", "%"), ("D", "A", "운항 편수", "편"), ("D", "B", "결항 편수", "편")], "table_key string, itm_id string, itm_nm string, unit string")
    values = make([("T1", "G", "행정구역별", 1, "00", "전국", ""), ("T1", "G", "행정구역별", 1, "21", "부산", "")], "table_key string, obj_id string, obj_nm string, level int, value_id string, value_name string, value_unit string")
    coverage = make([("T1", "M", 202001, 202412), ("T2", "M", 202001, 202412)], "table_key string, freq string, lo int, hi int")
    cells = make([("T1", "B", "00", "2024-03", "2800", "천명"), ("T1", "B", "21", "2024-03", "170", "천명"), ("T1", "B", "21", "2024-03", "171", "천명"), ("T2", "C", "", "2024-03", "101.2", "%")], "table_key string, itm_id string, value_ids string, period string, value string, unit string")
    return live.Catalog(titles, items, values, coverage, cells)


def targets(spark, rows):
    full = [(i, "KOSIS_CANDIDATE" if c else "OUT_OF_SCOPE", ind, u, reg, "", "M", p, int(p.replace("-", "")), v) for i, c, ind, u, reg, p, v in rows]
    return spark.createDataFrame(full, TARGET)


ROWS = [
    (1, True, "고용 취업자 수", "천명", "", "2024-03", "2,800"), (2, True, "고용 취업자 수", "천명", "", "2024-03", "2,801"), (3, True, "고용 취업자 수", "천명", "부산", "2024-03", "170"), (4, True, "고용 취업자 수", "천명", "", "2024-04", "5"),
    (5, True, "고용 취업자 수", "천명", "", "2025-01", "5"), (6, True, "고용 실업률", "%", "", "2024-03", "3"), (7, True, "월간 고용 취업자 수", "천명", "", "2024-03", "2800"), (8, True, "없는 말", "", "", "2024-03", "1"), (9, False, "고용", "", "", "2024-03", "1"),
    (10, True, "고용 취업자 수", "명", "", "2024-03", "1"), (11, True, "월간 운임", "", "", "2024-03", "1"), (12, True, None, "", "", "2024-03", "1"),
]


def test_rounds(spark, release):
    answers, ledger = live.run(targets(spark, ROWS), release)
    got = {r.target_id: (r.round, r.verdict, r.status) for r in answers.collect()}
    assert len(got) == len(ROWS) == answers.count()
    assert got == {
        1: (0, "VERIFIED", "MATCH"), 2: (0, "REFUTED", "VALUE_MISMATCH"), 3: (0, "UNVERIFIABLE", "MULTIPLE_CELLS"), 4: (0, "UNVERIFIABLE", "NO_CELL"), 5: (0, "UNVERIFIABLE", "PERIOD_OUT_OF_RANGE"),
        6: (0, "UNVERIFIABLE", "MULTIPLE_COMPATIBLE_SERIES"), 7: (1, "VERIFIED", "MATCH"), 8: (1, "UNVERIFIABLE", "NO_CANDIDATE"), 9: (0, "UNVERIFIABLE", "ROUTED_OUT_OF_SCOPE"),
        10: (0, "UNVERIFIABLE", "UNIT_MISMATCH"), 11: (1, "UNVERIFIABLE", "ITEM_MISSING"), 12: (1, "UNVERIFIABLE", "NO_CANDIDATE"),
    }
    told = {r.round: r for r in ledger.collect()}
    assert (told[0].open, told[0].answered, told[0].corrected) == (11, 7, 4) and (told[1].open, told[1].answered, told[1].corrected) == (4, 4, 0)
    # Targets 1 and 2 ask for one cell, which is looked up once.
    assert told[0].ready == 4 and told[0].cells == 3


def test_budgets(spark, release):
    some = targets(spark, ROWS)
    none = {r.target_id: r.status for r in live.run(some, release, budgets={"search": 3})[0].collect()}
    assert none.pop(9) == "ROUTED_OUT_OF_SCOPE" and set(none.values()) == {"BUDGET_EXHAUSTED"} and len(none) == 11
    first = {r.target_id: r.status for r in live.run(some, release, budgets={"search": 11, "cell": 2})[0].collect()}
    assert {first[i] for i in (1, 2, 3, 4, 7)} == {"BUDGET_EXHAUSTED"} and first[6] == "MULTIPLE_COMPATIBLE_SERIES"
    assert live.run(some.limit(0), release)[0].count() == 0 and live.run(some, release, rounds=1)[0].where("round = 1").count() == 0


def test_labels_by_brute_force(spark):
    import random

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("가나다 ") for _ in range(rng.randint(0, n)))
    claims = [(i, word(9)) for i in range(60)] + [(60, None), (61, "가" * 40)]
    items = [(f"T{rng.randint(0, 5)}", i, word(3) + rng.choice(["", "(다)"])) for i in range(80)]
    candidates = [(i, f"T{t}") for i, _ in claims for t in rng.sample(range(8), 3)]
    got = matching.item_match(
        spark.createDataFrame(claims, "target_id int, indicator string"), spark.createDataFrame(candidates, "target_id int, table_key string"),
        spark.createDataFrame([(*x, "") for x in items], "table_key string, itm_id int, itm_nm string, unit string"), [("가", "나")],
    )
    flat = lambda t: "".join(c for c in (t or "") if c not in " -_./:(),")

    def ways(label):
        base = label[: label.index("(")].strip() if label.endswith(")") else label.strip()
        out = [("EXACT_LABEL", flat(label))]
        if base != label.strip():
            out.append(("BRACKET_BASE", flat(base)))
        if "가" in base:
            out.append(("SEMANTIC_ALIAS", flat(base.replace("가", "나"))))
        return [w for w in out if w[1]]

    want = set()
    said = dict(claims)
    for i, t in candidates:
        mine = [(k, n) for tt, k, n in items if tt == t]
        hits = [(k, next(((r, flat(said[i]).index(s), len(s)) for r, s in ways(n) if s in flat(said[i])), None)) for k, n in mine]
        found = [(i, t, k, *h) for k, h in hits if h]
        want |= set(found) if found else {(i, t, mine[0][0], "SINGLETON_INVENTORY", None, None)} if len(mine) == 1 else {(i, t, None, "NO_SUBSPAN_MATCH", None, None)}
    assert {(r.target_id, r.table_key, r.itm_id, r.rule, r.start, r["size"]) for r in got.collect()} == want and got.where(F.col("rule") == "SEMANTIC_ALIAS").count() > 5


def test_equal_claims_are_worked_out_once(spark, release, monkeypatch):
    """Many targets that say the same cost one binding, and each gets the answer that it would get alone."""
    times, asked = 4, []
    many = targets(spark, [(i + 100 * j, *rest) for j in range(times) for i, *rest in ROWS])
    alone = {r.target_id: tuple(r)[1:] for r in live.run(targets(spark, ROWS), release)[0].collect()}
    match = live.item_match
    monkeypatch.setattr(live, "item_match", lambda claims, *more: asked.append(claims.count()) or match(claims, *more))
    answers, ledger = live.run(many, release, budgets={"search": 11 * times + 4 * times})
    # Eight different (indicator, unit, region, population) are open at first, a null one among them, then four; not 44 and 16.
    assert asked == [8, 4]
    got = {r.target_id: tuple(r)[1:] for r in answers.collect()}
    assert answers.count() == len(got) == times * len(ROWS)
    assert got == {i + 100 * j: alone[i] for j in range(times) for i in alone}
    told = {r.round: r for r in ledger.collect()}
    assert (told[0].open, told[0].answered, told[0].corrected, told[0].ready, told[0].cells) == (11 * times, 7 * times, 4 * times, 4 * times, 3) and (told[1].open, told[1].answered) == (4 * times, 4 * times)
    short = {r.status for r in live.run(many, release, budgets={"search": 11 * times - 1})[0].where("target_id % 100 <> 9").collect()}
    assert short == {"BUDGET_EXHAUSTED"}


def test_a_search_may_tell_equal_claims_apart(spark, release):
    only_first = lambda work, broad: work.where("target_id = 1").select("target_id", F.lit("T1").alias("table_key"), F.lit(1).alias("rank"))
    got = {r.target_id: r.status for r in live.run(targets(spark, [(i, *ROWS[0][1:]) for i in (1, 2)]), release, only_first)[0].collect()}
    assert got == {1: "MATCH", 2: "NO_CANDIDATE"}


def test_orders_are_read_once(spark, monkeypatch):
    from veristrata.plans import live as plan

    read, table = [], plan.table
    monkeypatch.setattr(plan, "table", lambda s, d, name: read.append(name) or table(s, d, name))
    assert plan.live_loop(spark, "/root/testdata/sf0.001").count() and read.count("orders") == 1


def test_the_ledger_counts_its_budget_without_numbers(spark, monkeypatch):
    """The orders are read once, and the claims with their numbers are made once, for the rounds."""
    from veristrata.plans import live as plan

    read, ran, table, run = [], [], plan.table, live.run
    monkeypatch.setattr(plan, "table", lambda s, d, name: read.append(name) or table(s, d, name))
    monkeypatch.setattr(live, "run", lambda some, *more, **named: ran.append((named["budgets"]["search"], some.where("routing_class = 'KOSIS_CANDIDATE'").count())) or run(some, *more, **named))
    assert plan.live_ledger(spark, "/root/testdata/sf0.001").count() == 2 and read.count("orders") == 1
    assert len(ran) == 1 and ran[0][0] == ran[0][1] > 0
