"""O-PRS4: Viterbi decoding against enumerating all tag sequences; addresses without commas."""

import itertools
import math
import random

from pyspark.sql import functions as F

from linkwright.functions import text
from linkwright.operators import tagger as G

STREETS = ["Main", "Oak Hill", "Pine", "Maple Grove", "River", "Sunset"]
CITIES = ["Springfield", "North Haven", "Salem", "San Jose", "Dayton"]


def addresses(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        unit = rnd.choice(["", ", Suite 4", ", Apt 12B", ", #7"])
        out.append(f"{rnd.randint(1, 9999)} {rnd.choice(['', 'N ', 'East '])}{rnd.choice(STREETS)} "
                   f"{rnd.choice(['Street', 'Ave', 'Blvd', 'Lane'])}{unit}, {rnd.choice(CITIES)}, IL 627{rnd.randint(10, 99)}")
    return out


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, address string")


def test_city_without_commas(spark):
    model = G.fit(frame(spark, addresses(300, 1)), "address")
    full = addresses(120, 2)
    bare = G.tag_sequences(frame(spark, [a.replace(",", "") for a in full]), "address", model).collect()
    rule = text.with_tags(frame(spark, full), "address").collect()
    want, got = ({r.id: r.tags.asDict() for r in x} for x in (rule, bare))
    right = sum(got[i] == want[i] for i in want)
    assert right >= 0.97 * len(want)
    kept = G.tag_sequences(frame(spark, full), "address", model).collect()  # commas: the rules' answer
    assert {r.id: r.tags.asDict() for r in kept} == want


def test_decoding_finds_the_best_sequence(spark):
    rnd = random.Random(5)

    def weights(n):
        return [math.log(rnd.random()) for _ in range(n)]

    k = len(G.LETTERS)
    model = G.ChainModel(weights(k), [weights(k) for _ in range(k)], weights(k), [weights(len(G.KINDS)) for _ in range(k)],
                         {a: weights(G.BUCKETS) for a in G.WORDED})
    rows = ["12 Oak", "N Main St", "x", "# 4B Apt", "", None, "7 East Haven"]
    df = frame(spark, rows).withColumn("t", G.tokens(F.col("address")))
    got = {r.id: r for r in G.decode(df, model, "t", "path").withColumn("k", F.transform("t", G.kind)).withColumn(
        "b", F.transform("t", G.bucket)).collect()}
    for i, r in got.items():
        def score(path):
            s = model.start[path[0]] + model.end[path[-1]] + sum(model.step[x][y] for x, y in zip(path, path[1:]))
            for tag, kind, b in zip(path, r.k, r.b):
                word = model.words[G.LETTERS[tag]][b] if G.LETTERS[tag] in G.WORDED else -math.log(G.BUCKETS)
                s += model.kinds[tag][kind] + (word if kind == 5 else 0.0)
            return s

        n = len(r.t)
        best = max(itertools.product(range(k), repeat=n), key=score) if n else ()
        assert r.path == "".join(G.LETTERS[x] for x in best)
    assert got[5].path == "" and got[3].t == ["#", "4B", "Apt"]


def test_weights_of_no_rows(spark):
    model = G.fit(frame(spark, []), "address")
    assert all(abs(math.exp(x) - 1 / 9) < 1e-12 for x in model.start)
    assert G.tag_sequences(frame(spark, []), "address", model).count() == 0


def test_rules_run_once_and_above_a_repartitioning(spark):
    """Counting reads the rows once; nothing of the rules moves below the input's repartitioning."""
    events = G._events(frame(spark, addresses(5, 3)).repartition(4), "address")
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1
    below = plan[plan.index("Repartition"):]
    assert "Filter" not in below and "regexp" not in below
    chain = spark.createDataFrame([(1, "12 Oak Road, Salem, IL 62701")], "id long, address string")
    n = {(r.what, r.a, r.b): r["count"] for r in G._events(chain, "address").groupBy("what", "a", "b").count().collect()}
    assert n.pop(("word", "S", "%d" % chain.select(G.bucket(F.lit("Oak"))).first()[0])) == 1
    assert n.pop(("word", "C", "%d" % chain.select(G.bucket(F.lit("Salem"))).first()[0])) == 1
    assert n == {("move", a, b): 1 for a, b in ["<N", "NS", "ST", "TC", "C>"]} | {
        ("kind", a, b): 1 for a, b in ["N0", "S5", "T3", "C5"]}
