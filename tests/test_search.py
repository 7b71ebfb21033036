"""The block search against scoring all pairs, and its bounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwright.operators import dedupe, graph, search

from .oracles import jaro_winkler as jaro_winkler_py


def names(n, seed, letters="abc 12"):
    rnd = random.Random(seed)
    return sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 12))) for _ in range(n)})


def test_scores_and_bounds():
    a, b = names(800, 1), names(800, 2)
    n = min(len(a), len(b))
    got = search.jaro_winkler_scores(a[:n], b[:n])
    assert got.tolist() == [jaro_winkler_py(x, y) for x, y in zip(a, b)]
    x, y = search.zones_of_rows(a[:120]), search.zones_of_rows(b[:120])
    true = np.array([[jaro_winkler_py(u, v) for v in b[:120]] for u in a[:120]])
    rows = search.jaro_winkler_bound(x, y)
    zones = search.jaro_winkler_bound(x, np.concatenate([search.zone_of(y[i:i + 10]) for i in range(0, 120, 10)]))
    assert (rows >= true - 1e-12).all()
    assert (zones >= rows.reshape(120, 12, 10).max(2) - 1e-12).all()


def test_blend_bound_covers_absent_components():
    metric = search.Blend({"h": 0.4, "u": 0.1, "z": 0.1})

    def side(n, seed):
        pick = random.Random(seed)
        return [names(3 * n, seed)[:n], *[[pick.choice([None, "", "12", "13", "9"]) for _ in range(n)] for _ in range(3)]]

    a, b = side(60, 5), side(60, 6)
    za, zb = ([search.zones_of_rows(f) for f in x] for x in (a, b))
    i, j = np.indices((60, 60)).reshape(2, -1)
    true = metric.score([[f[x] for x in i] for f in a], [[f[x] for x in j] for f in b]).reshape(60, 60)
    zones = [np.concatenate([search.zone_of(f[k:k + 6]) for k in range(0, 60, 6)]) for f in zb]
    assert (metric.bound(za, zb) >= true - 1e-12).all()
    assert (metric.bound(za, zones) >= true.reshape(60, 10, 6).max(2) - 1e-12).all()


@pytest.mark.parametrize("t", [0.0, 0.8])
def test_best_partners_equal_all_pairs(spark, monkeypatch, t):
    monkeypatch.setattr(search, "BLOCK", 7)
    monkeypatch.setattr(search, "CHUNK", 20)
    monkeypatch.setattr(search, "GROUP", 5)
    ls, rs = names(70, 7), names(90, 8)
    order = {r: (i * 37) % len(rs) for i, r in enumerate(rs)}
    L = spark.createDataFrame([(x,) for x in ls], "k string")
    R = spark.createDataFrame([(x, order[x]) for x in rs], "k string, o long")
    got = {r.k: (r.r_k, r.score) for r in search.best_partners(L, R, t, search.Name()).collect()}
    want = {}
    for x in ls:
        s, o = max((jaro_winkler_py(x, y), -order[y]) for y in rs)
        if s >= t:
            want[x] = (rs[[order[y] for y in rs].index(-o)], s)
    assert got == want


def test_all_partners_equal_all_pairs(spark):
    ns = names(150, 9)
    df = spark.createDataFrame([(x, i) for i, x in enumerate(ns)], "k string, o long")
    got = {(r.k, r.r_k): r.score for r in search.all_partners(df.select("k"), df, 0.85, search.Name()).collect()}
    want = {(x, y): s for x in ns for y in ns if (s := jaro_winkler_py(x, y)) >= 0.85}
    assert got == want


def test_few_pairs_are_scored(spark):
    rnd = random.Random(8)
    ns = sorted({"".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(8, 14))) for _ in range(4000)})
    R = spark.createDataFrame([(x, i) for i, x in enumerate(ns)], "k string, o long")
    L = spark.createDataFrame([(x[:4] + "q" + x[5:],) for x in ns[::4]], "k string").distinct()
    stats = {}
    search.best_partners(L, R, 0.8, search.Name(), stats=stats)
    assert 0 < stats["scored"] < 0.01 * L.count() * len(ns)


def sequential(n, edges):
    near = {}
    for a, b in edges:
        near.setdefault(b, set()).add(a)
    leader = {}
    for i in range(n):
        mine = [j for j in sorted(near.get(i, ())) if leader[j] == j]
        leader[i] = mine[0] if mine else i
    return leader


@pytest.mark.parametrize("task_edges", [10, 200_000])
def test_leaders_of_components(spark, task_edges):
    """Large components in rounds, small ones inside a task: the same result."""
    rnd = random.Random(11)
    n = 400
    edges = {tuple(sorted(rnd.sample(range(i, min(n, i + 12)), 2))) for i in range(0, n - 2, 3) for _ in range(4)}
    e = spark.createDataFrame(sorted(edges), "src long, dst long")
    got = {r.ord: r.leader for r in dedupe.elect_leaders(spark.range(n).toDF("ord"), e, task_edges).collect()}
    assert got == sequential(n, edges)


def test_long_chain_needs_few_rounds(spark, monkeypatch):
    """10,000 points, each near the next one only: one dependency chain."""
    runs = []
    real = graph.components
    monkeypatch.setattr(dedupe, "components", lambda e: runs.append(1) or real(e))
    n = 10_000
    e = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    out = dedupe.elect_leaders(spark.range(n).toDF("ord"), e).collect()
    assert {r.rounds for r in out} == {0} and len(runs) == 1
    assert all(r.leader == r.ord - r.ord % 2 for r in out)


def test_components(spark):
    e = spark.createDataFrame([(5, 3), (3, 9), (7, 8), (8, 8), (20, 21), (21, 22), (22, 20)], "src long, dst long")
    got = {r.id: r.component for r in graph.components(e).collect()}
    assert got == {3: 3, 5: 3, 9: 3, 7: 7, 8: 7, 20: 20, 21: 20, 22: 20}
    assert graph.components(e.limit(0)).count() == 0


def test_bits_match_the_characters_that_jaro_matches():
    rnd = random.Random(8)
    a, b = (["".join(rnd.choice("ab é1") for _ in range(rnd.randint(0, 30))) for _ in range(500)] for _ in range(2))
    (x, n), (y, m) = search.encode(a), search.encode(b)
    for got, want in zip(search._matched_bits(x, n, y, m), search._matched(x, n, y, m)):
        assert (got == want).all()


def test_components_alone_rule_pairs_out():
    metric = search.Blend({"house_number": 0.4, "unit": 0.1, "zipcode": 0.1})
    a = [["1 elm st", "9 oak st", "elm"], ["1", "9", ""], ["", "2", ""], ["62701", "", ""]]
    b = [["1 elm st", "1 oak st", "elk"], ["1", "1", "3"], ["4", "8", ""], ["62702", "", ""]]
    score, above = metric.score(a, b), metric.score_above(a, b, 0.85)
    assert np.isnan(above[1]) and score[1] <= 0.85
    assert above[[0, 2]].tolist() == score[[0, 2]].tolist()
