"""Dedupe rounds, proximity join and name linkage against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from .oracles import jaro_winkler as jaro_winkler_py
from linkwright.operators import dedupe as D
from linkwright.operators import pairs as P
from linkwright.operators import spatial as SP


def sequential_dedupe(keys, t):
    """The rule as a loop (test oracle)."""
    leaders, lead = [], {}
    for i, k in enumerate(keys):
        hit = next((j for j in leaders if jaro_winkler_py(keys[j], k, 0.1) >= t), None)
        if hit is None:
            leaders.append(i)
            lead[i] = i
        else:
            lead[i] = hit
    return lead


CUSTOMERS = [(1, "John Smith"), (2, "Jon Smith"), (3, "Jane Doe"), (4, "Janes Does"),
             (5, "Robert Johnson"), (6, "Robert Jonson"), (7, "Sarah Williams"), (8, "Alex Johnson")]


def test_dedupe_customer_fixture(spark):
    df = spark.createDataFrame(CUSTOMERS, "pos long, name string")
    out = {r.pos: r.leader for r in D.dedupe(df, "name", 0.90, "pos").collect()}
    keys = [n.lower() for _, n in CUSTOMERS]
    exp = sequential_dedupe(keys, 0.90)
    assert out == {i + 1: exp[i] + 1 for i in range(len(keys))}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dedupe_random_vs_loop(spark, seed):
    random.seed(seed)
    base = ["martha", "marhta", "dixon", "dicksonx", "jones", "johnson", "smith", "smyth",
            "smithe", "jellyfish", "smellyfish", "marta", "mart"]
    keys = [random.choice(base) + random.choice(["", "s", "x", ""]) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(keys)), "pos long, k string")
    for t in (0.8, 0.85, 0.9):
        out = {r.pos: r.leader for r in D.dedupe(df, "k", t, "pos").collect()}
        assert out == sequential_dedupe(keys, t)


def test_elect_leaders_random_graphs(spark):
    random.seed(11)
    for _ in range(3):
        n = 30
        edges = [(i, j) for i in range(n) for j in range(i + 1, n) if random.random() < 0.12]
        adj = {j: [i for i, jj in edges if jj == j] for j in range(n)}
        lead = {}
        for v in range(n):
            ls = [u for u in adj[v] if lead.get(u) == u]
            lead[v] = min(ls) if ls else v
        nodes = spark.createDataFrame([(i,) for i in range(n)], "ord long")
        e = spark.createDataFrame(edges or [(0, 0)], "src long, dst long").where("src < dst")
        got = {r.ord: r.leader for r in D.elect_leaders(nodes, e).collect()}
        assert got == lead


def test_near_join_vs_brute_force(spark):
    random.seed(5)
    a = [(i, round(random.uniform(0, 0.05), 5), round(random.uniform(0, 0.05), 5)) for i in range(150)]
    b = [(i, round(random.uniform(0, 0.05), 5), round(random.uniform(0, 0.05), 5)) for i in range(150)]
    A = spark.createDataFrame(a, "id long, latitude double, longitude double")
    B = spark.createDataFrame(b, "id long, latitude double, longitude double")
    got = {(r.l_id, r.r_id) for r in SP.near_join(A, B, 0.004).collect()}
    exp = {(x[0], y[0]) for x in a for y in b
           if abs(x[1] - y[1]) < 0.004 and abs(x[2] - y[2]) < 0.004}
    assert got == exp


def test_dedupe_near_and_insert(spark):
    pts = [(1, 10.0, 10.0), (2, 10.0005, 10.0005), (3, 10.0009, 10.0009), (4, 10.0014, 10.0014)]
    df = spark.createDataFrame(pts, "pos long, latitude double, longitude double")
    out = {r.pos: r.leader for r in D.dedupe_near(df, 0.001).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 4: 4}  # 4 is near 3 only, and 3 is a follower
    base = spark.createDataFrame([(7, 10.0, 10.0)], "id long, latitude double, longitude double")
    new = spark.createDataFrame([(1, 10.0002, 10.0002), (2, 0.0, 5.0), (3, 20.0, 20.0),
                                 (4, 20.0003, 20.0003)], "pos long, latitude double, longitude double")
    res = {r.pos: (r.outcome, r.existing_id) for r in SP.insert_if_not_near(base, new).collect()}
    assert res == {1: ("existing", 7), 2: ("rejected", None), 3: ("inserted", None),
                   4: ("duplicate of new row", None)}


def test_link_names_fixture(spark):
    db1 = [("DB1-001", "John Smith"), ("DB1-002", "Jane Doe"), ("DB1-003", "Robert Johnson")]
    db2 = [("DB2-001", "Jon Smith"), ("DB2-002", "Jane D."), ("DB2-003", "Bob Johnson"),
           ("DB2-004", "Sarah Williams")]
    L = spark.createDataFrame(db1, "id string, customer string")
    R = spark.createDataFrame([(i, c, n) for n, (i, c) in enumerate(db2)], "id string, customer string, pos long")
    exp = {}
    for i, c in db1:
        best = None
        for j, d in db2:
            s = jaro_winkler_py(c.lower(), d.lower())
            if s > 0.8 and (best is None or s > best[1]):
                best = (j, s)
        if best:
            exp[i] = best[0]
    got = {r.left_id: r.right_id for r in P.link_names(L, R, 0.8, right_order="pos").collect()}
    assert got == exp


def _names(n, seed):
    rnd = random.Random(seed)
    parts = ["al", "ber", "cor", "dan", "el", "fer", "gan", "hol", "is", "jor", "kel", "lun"]
    return sorted({"".join(rnd.choice(parts) for _ in range(rnd.randint(2, 4))) + " "
                   + "".join(rnd.choice(parts) for _ in range(rnd.randint(2, 5))) for _ in range(n)})


@pytest.mark.parametrize("t", [0.8, 0.88, 0.95])
def test_link_names_equals_all_pairs(spark, t):
    ls, rs = _names(60, 1) + ["", "ab", "a"], _names(80, 2) + ["", "abc", "b", "ab"]
    L = spark.createDataFrame(list(enumerate(ls)) + [(900, None), (901, ls[0].upper())], "id long, customer string")
    R = spark.createDataFrame(list(enumerate(rs)), "id long, customer string")
    got = {r.left_id: (r.right_id, round(r.score, 9)) for r in P.link_names(L, R, t).collect()}
    exp = {}
    for i, a in list(enumerate(ls)) + [(900, ""), (901, ls[0])]:
        best = max(((jaro_winkler_py(a, b), -j) for j, b in enumerate(rs)))
        if best[0] > t:
            exp[i] = (-best[1], round(best[0], 9))
    assert got == exp


def test_fuzzy_lookup(spark):
    ref = spark.createDataFrame([("123 Main St, New York, NY 10001",), ("456 Oak Ave, Los Angeles, CA 90001",),
                                 ("789 Pine Rd, Chicago, IL 60601",), ("321 Cedar Blvd, San Francisco, CA 94101",)],
                                "address string")
    inp = spark.createDataFrame([("123 Main Street, New York NY",), ("zzzz",)], "address string")
    out = {r.address: (r.best_match, r.matched) for r in P.fuzzy_lookup(inp, ref).collect()}
    assert out["123 Main Street, New York NY"] == ("123 Main St, New York, NY 10001", True)
    assert out["zzzz"] == (None, False)


def test_dedupe_near_hot_spot(spark):
    pts = [(i, 5.0, 5.0) for i in range(1, 40)] + [(40, 5.0005, 5.0), (41, 5.0012, 5.0), (0, 9.0, 9.0)]
    df = spark.createDataFrame(pts, "pos long, latitude double, longitude double")
    out = {r.pos: r.leader for r in D.dedupe_near(df, 0.001).collect()}
    assert out[0] == 0 and all(out[i] == 1 for i in range(1, 41)) and out[41] == 41


def test_keyed_pairs_salting_is_exact(spark):
    random.seed(3)
    left = [(i, [f"k{random.choice([0, 0, 0, 1, 2])}", f"x{random.randint(0, 3)}"]) for i in range(60)]
    right = [(i, [f"k{random.choice([0, 0, 1, 3])}", f"x{random.randint(0, 3)}"]) for i in range(50)]
    L = spark.createDataFrame(left, "id long, keys array<string>")
    R = spark.createDataFrame(right, "id long, keys array<string>")
    plain = sorted((r.l_id, r.r_id) for r in P.keyed_pairs(L, R).collect())
    salted = sorted((r.l_id, r.r_id) for r in
                    P.keyed_pairs(L, R, key_rows=5).collect())
    exp = sorted((a, b) for a, ka in left for b, kb in right if set(ka) & set(kb))
    assert plain == salted == exp
