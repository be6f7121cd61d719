from datetime import datetime

from pyspark.sql import functions as F

from kgloom.llm import fusion, groups

A = "alias_id long, alias string, canonical_name string, entity_type string, group_id long"
D = lambda n: datetime(2024, 1, n)


def test_components_equal_union_find(spark):
    import random

    random.seed(2)
    edges = [(i, i + 1) for i in range(1, 60)] + [(500, x) for x in range(501, 640)] + [
        (random.randrange(1000, 1200), random.randrange(1000, 1200)) for _ in range(90)] + [(7, 7), (3, 4), (4, 3), (None, 5)]
    up: dict[int, int] = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.group_id for r in groups.connected_groups(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
    assert groups.connected_groups(spark.createDataFrame([], "a long, b long")).count() == 0


def test_alias_groups(spark):
    rows = [(1, "A ", "B", "T", 9), (2, "b", "C", "T", 9), (3, "a", "x", "U", 9), (4, "q", None, "T", 9), (5, "q", " ", "T", 9),
        (6, "z", None, None, 9), (7, "Z", "k", None, 9), (8, None, None, "T", 9), (9, "L" * 50_000, "c", "T", 9), (1, "A ", "B", "T", 9)]
    got = sorted((r.alias_id, r.group_id) for r in groups.alias_groups(spark.createDataFrame(rows, A)).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 6), (7, 6), (8, 8), (9, 1)]
    assert groups.alias_groups(spark.createDataFrame([], A)).count() == 0


E = "entity_id long, name string, entity_type string, aliases string, confidence double, source string, updated_at timestamp, key string, src string"


def tables(spark, rows):
    return (spark.createDataFrame([(*r, "clash", "clash") for r in rows], E),
        spark.createDataFrame([("hi", 100), ("lo", 10)], "source string, priority int"),
            spark.createDataFrame([("People",), ("Places",)], "type_name string"))


ROWS = [
    (1, "Ann  Lee", "People", '["A. Lee", "a lee", "Ann Lee", ""]', 0.5, " HI", D(1)), (2, "ann lee", "Places", "x|y", 0.9, "lo", D(5)),
        (3, "ANN-LEE", "person", "p,q", float("nan"), None, None), (4, "Ａｎｎ Lee", None, None, 1.5, "hi", D(9)),
    (5, "Solo", "People", "a", 0.1, "hi", D(1)), (6, None, "People", "a", 0.1, "hi", D(1)), (7, "?!", "People", "a", 0.1, "hi", D(1)),
        (8, "--", "People", "a", 0.1, "hi", D(1)),
    (9, "Tie", "People", "b", 0.3, "lo", D(2)), (10, "tie", "Places", "c", 0.3, "lo", D(2)), (9, "Tie", "People", "b", 0.3, "lo", D(2)),
        (11, "none", "zz", None, None, "q", None), (12, "None", None, "[]", -1.0, "q", None),
            (13, "W" * 40_000, None, None, None, None, None),
]


def test_supplying_rows(spark):
    got = sorted(tuple(r) for r in fusion.supplying_rows(*tables(spark, ROWS)).collect())
    # 2 has two distinct aliases and is later than 3; 1 has one (its own name and blanks left out)
    assert got == [(1, 1, 2, 2), (9, 9, 9, 9), (11, 0, 0, 0)]
    assert fusion.supplying_rows(*tables(spark, [])).count() == 0


def test_fusion_discounts_copies(spark):
    # a, d and e err each for themselves; c copies b, errors included
    rows, n, right = [], 0, {}
    for g in range(60):
        truth, wrong = ("People", "Places") if g % 2 else ("Places", "People")
        for s, bad in (("a", g % 11 == 1), ("d", g % 11 == 2), ("e", g % 11 == 3), ("b", g % 3 == 0), ("c", g % 3 == 0)):
            n += 1
            rows.append((n, f"name {g}", wrong if bad else truth, "al", 0.5, s, D(1)))
        right[n - 4] = truth
    e, _, t = tables(spark, rows)
    src = spark.createDataFrame([(s, 1) for s in "abcde"], "source string, priority int")
    pat = fusion.votes(fusion.keyed_rows(e, src, t)).groupBy("field", "claims").agg(F.count("*").alias("weight"))
    acc, cop = fusion.source_model(pat)
    assert acc["type"]["a"] > acc["type"]["b"] and cop["type"][("c", "b")] > 0.5 > cop["type"][("a", "d")]
    out = {r.group_id: r for r in fusion.fuse(e, src, t).collect()}
    assert len(out) == 60 and sum(out[g].entity_type == v for g, v in right.items()) >= 58
    assert fusion.fuse(*tables(spark, [])).count() == 0


def test_fused_confidence_is_a_claimed_value(spark):
    rows = [(1, "Ann", "People", "", 0.764, "hi", D(1)), (2, "ann", "People", "", 0.81, "lo", D(2)),
        (3, "ANN", "People", "", 0.79, "q", D(3)), (4, "Bo", "People", "", None, "hi", D(1)), (5, "bo", "People", "", None, "lo", D(1))]
    got = {r.group_id: r.confidence for r in fusion.fuse(*tables(spark, rows)).collect()}
    assert got[1] in (0.764, 0.81, 0.79) and got[4] is None
