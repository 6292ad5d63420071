import math
import random

import pytest

from ledgerlens.llm import ideal_rank, topn
from ledgerlens.plans.ranking import group_quantiles
from tests.conftest import rows

NAN = float("nan")


def scored(seed, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        group = "hot" if rng.random() < 0.4 else f"g{rng.randint(0, 30)}"
        pick = lambda scale: rng.choice([None, NAN, *[round(rng.random() * scale, 1)] * 8])
        out.append((group, i, pick(100.0), pick(1.0), pick(1e6)))
    return out + out[:50]


SCHEMA = "qid string, idx bigint, bm25 double, cos double, score double"


@pytest.mark.parametrize("n", [1, 3])
@pytest.mark.parametrize("parts", [1, 7])
def test_top_n_against_a_plain_version(spark, n, parts):
    data = scored(1)
    df = spark.createDataFrame(data, SCHEMA).repartition(parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        got = {tuple(r) for r in topn.top_n(df, ["qid"], "idx", "bm25", n).select("qid", "idx", "score").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == topn.brute_top_n([(g, i, b) for g, i, b, _, _ in data], n)


def test_top_n_edges(spark):
    data = [("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 5.0), ("a", 4, NAN), ("a", None, 9.0), ("a", 5, None), ("a", 1, 5.0), ("a", 3, 7.0), (None, 9, 1.0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in data], "g string, i bigint, s double, rank string, bound int")
    assert rows(topn.top_n(df, ["g"], "i", "s", 2)) == sorted([("a", 3, 7.0, 1), ("a", 1, 5.0, 2), (None, 9, 1.0, 1)], key=repr)
    assert rows(topn.top_n(df.where("false"), ["g"], "i", "s", 2)) == []
    with pytest.raises(ValueError):
        topn.top_n(df, ["g"], "i", "s", 0)


def plain_closeness(items, tail=ideal_rank.TAIL):
    """Relative closeness of one group's items {item: [scores]}."""
    width = len(next(iter(items.values())))
    up, down = dict.fromkeys(items, 0.0), dict.fromkeys(items, 0.0)
    for k in range(width):
        known = sorted(v[k] for v in items.values() if v[k] is not None)
        if not known:
            continue
        low, high = (known[max(0, math.ceil(p * len(known)) - 1)] for p in (tail, 1 - tail))
        cut = {i: min(max(v[k], low), high) - low if v[k] is not None else 0.0 for i, v in items.items()}
        norm = math.sqrt(sum(x * x for x in cut.values()))
        if norm:
            for i, x in cut.items():
                up[i] += ((max(cut.values()) - x) / norm / width) ** 2
                down[i] += (x / norm / width) ** 2
    return {i: math.sqrt(down[i]) / (math.sqrt(up[i]) + math.sqrt(down[i])) if up[i] + down[i] else 0.5 for i in items}


def test_joint_ranking_against_a_plain_version(spark):
    data = scored(2)
    got = {(r["qid"], r["idx"]): (r["closeness"], r["rank"]) for r in ideal_rank.ideal_rank(spark.createDataFrame(data, SCHEMA), "qid", "idx", ["bm25", "cos", "score"]).collect()}
    groups = {}
    for g, i, *values in data:
        groups.setdefault(g, {})[i] = [None if v is None or math.isnan(v) else v for v in values]
    for g, items in groups.items():
        expected = plain_closeness(items)
        assert all(got[g, i][0] == pytest.approx(v, abs=1e-9) for i, v in expected.items())
        order = sorted(items, key=lambda i: (-got[g, i][0], i))
        assert [got[g, i][1] for i in order] == list(range(1, len(items) + 1))


def test_large_groups_spread_over_parts_rank_the_same(spark):
    df = spark.createDataFrame(scored(4), SCHEMA)
    one = rows(ideal_rank.closeness(df, "qid", "idx", ["bm25", "cos", "score"]).select("qid", "idx", "closeness"))
    assert rows(ideal_rank.closeness(df, "qid", "idx", ["bm25", "cos", "score"], hot_rows=20).select("qid", "idx", "closeness")) == one


def test_limits_are_exact_in_large_groups(spark):
    """Beyond 10,000 items, with a long run of equal values, the limits are still the values at their ranks."""
    df = spark.range(30_000).selectExpr("'g' as q", "id as i", "cast(if(id < 590, id, if(id < 20000, 590, id)) as double) as s").repartition(9)
    found = {r["share_no"]: r["s"] for r in group_quantiles(df, ["q"], "s", "i", [0.02, 0.5, 0.98, 0.0, 1.0], (1, 3, 40_000)).collect()}
    assert found == {0: 590.0, 1: 590.0, 2: 29_399.0, 3: 0.0, 4: 29_999.0, 5: 29_999.0, 6: 29_997.0, 7: 0.0}


def test_no_score_dominates_by_its_range(spark):
    data = [("q", i, 1e9 * i, 1.0 - i / 10) for i in range(10)]
    df = spark.createDataFrame(data, "q string, i bigint, big double, small double")
    near = {r["i"]: r["closeness"] for r in ideal_rank.closeness(df, "q", "i", ["big", "small"], tail=0.0).collect()}
    assert near[0] == pytest.approx(near[9], abs=1e-9)
    one = {r["i"]: r["closeness"] for r in ideal_rank.closeness(df, "q", "i", ["big", "small"], [1.0, 0.0], tail=0.0).collect()}
    assert sorted(one, key=one.get) == list(range(10))


def test_leaders_against_their_definition(spark):
    data = scored(3)
    got = {tuple(r) for r in ideal_rank.leaders(spark.createDataFrame(data, SCHEMA), "qid", "idx", ["bm25", "cos", "score"]).collect()}
    distinct = {(g, i): v for g, i, *v in data}
    ok = lambda v: v is not None and not math.isnan(v)
    expected = {(g, i) for (g, i), v in distinct.items() if all(ok(v[k]) and sum(1 for (h, j), w in distinct.items() if h == g and j != i and ok(w[k]) and w[k] > v[k]) < 3 for k in range(3))}
    assert got == expected and got


def test_joint_ranking_edges(spark):
    data = [("same", 1, 2.0, 2.0), ("same", 2, 2.0, 2.0), ("null", 1, None, NAN), ("one", 5, 1.0, 1.0), (None, 1, 1.0, 1.0), ("same", None, 3.0, 3.0)]
    df = spark.createDataFrame([(*r, "x", 3) for r in data], "q string, i bigint, a double, b double, closeness string, rank int")
    assert rows(ideal_rank.ideal_rank(df, "q", "i", ["a", "b"])) == [("null", 1, 0.5, 1), ("one", 5, 0.5, 1), ("same", 1, 0.5, 1), ("same", 2, 0.5, 2)]
    assert rows(ideal_rank.leaders(df, "q", "i", ["a", "b"])) == [("one", 5), ("same", 1), ("same", 2)]
    assert rows(ideal_rank.ideal_rank(df.where("false"), "q", "i", ["a", "b"])) == []
    with pytest.raises(ValueError):
        ideal_rank.closeness(df, "q", "i", ["a", "b"], [1.0, -1.0])
