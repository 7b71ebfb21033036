"""Order-dependent deduplication (O-DED1, O-DED2).

Rule being reproduced: walk rows in order; a row is a *leader* unless an
earlier leader is similar to it; a follower belongs to its earliest similar
leader. Not transitive.

Spark plan:
1. Collapse equal keys to one representative (smallest order): equal keys
   have identical neighbourhoods, so this is exact.
2. Similar pairs (i < j) as edges. For Jaro-Winkler they come from the
   block search by upper bounds (:mod:`.search`), lossless at any threshold.
3. Connected components of the edges. Nothing crosses a component, so those of
   at most ``TASK_EDGES`` edges are walked in order inside one bounded task
   each, many to a task, whatever the length of their chains.
4. Larger components run leader election in rounds: an undecided node with a
   leader among its smaller neighbours is a follower; one with no undecided or
   leader smaller neighbour is a leader. Each round's node state is a reliable
   checkpoint under ``spark.checkpoint.dir``; edges shrink as nodes get decided.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import search
from .graph import components
from .spatial import near_join

#: edges of the largest component that one task may walk
TASK_EDGES = 200_000


def _walk(edges: pd.DataFrame) -> pd.DataFrame:
    """The sequential rule on whole components: (ord, leader) of every node
    with a smaller neighbour; all other nodes lead."""
    leader: dict[int, int] = {}  # of followers
    edges = edges.sort_values(["dst", "src"])
    for src, dst in zip(edges["src"].tolist(), edges["dst"].tolist()):
        # edges into a node come together, smallest neighbour first; all of its
        # smaller neighbours are decided by then
        if dst not in leader and src not in leader:
            leader[dst] = src
    return pd.DataFrame({"ord": list(leader), "leader": list(leader.values())}, dtype="int64")


def elect_leaders(nodes: DataFrame, edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """Sequential leader rule on a graph. ``nodes``: (ord); ``edges``: (src,
    dst) with src < dst, whole numbers. Returns (ord, leader, rounds) where
    leader == ord for leaders; rounds counts those of the largest components."""
    ensure_checkpoint_dir(nodes.sparkSession)
    # edges are scored once and cut from lineage
    edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")) \
        .checkpoint(eager=True)
    comp = components(edges)
    placed = edges.join(comp, edges["src"] == comp["id"]).select("src", "dst", "component").checkpoint(eager=True)
    sizes = placed.groupBy("component").agg(F.count("*").alias("n")).checkpoint(eager=True)
    large = sizes.where(F.col("n") > task_edges)
    total = sizes.where(F.col("n") <= task_edges).agg(F.sum("n")).first()[0] or 0
    # components are dealt into tasks of about task_edges edges
    pack = F.pmod(F.xxhash64("component"), F.lit(-(-total // task_edges) or 1))
    small = placed.join(large, "component", "left_anti").withColumn("pack", pack)
    walked = small.select("pack", "src", "dst").groupBy("pack").applyInPandas(_walk, "ord long, leader long")
    followers, rounds = walked, 0
    if not large.isEmpty():
        rest = placed.join(large, "component", "left_semi").select("src", "dst").checkpoint(eager=True)
        late, rounds = _elect_in_rounds(rest)
        followers = walked.unionByName(late)
    return nodes.join(followers, "ord", "left").select(
        "ord", F.coalesce("leader", F.col("ord")).alias("leader"), F.lit(rounds).alias("rounds"))


def _elect_in_rounds(edges: DataFrame) -> tuple[DataFrame, int]:
    """((ord, leader) of followers, number of rounds) by rounds over all edges."""
    nodes = edges.select(F.col("src").alias("ord")).unionByName(edges.select(F.col("dst").alias("ord"))).distinct()
    state = nodes.select("ord", F.lit("U").alias("st")).checkpoint(eager=True)
    live, rounds, undecided = edges, 0, True
    while undecided:  # every round decides at least the smallest undecided node
        rounds += 1
        agg = live.join(state.select(F.col("ord").alias("src"), F.col("st").alias("sst")), "src").groupBy("dst").agg(
            F.max((F.col("sst") == "L").cast("int")).alias("has_l"),
            F.max((F.col("sst") == "U").cast("int")).alias("has_u"))
        state = state.join(agg.withColumnRenamed("dst", "ord"), "ord", "left").select(
            "ord",
            F.when(F.col("st") != "U", F.col("st"))
            .when(F.coalesce(F.col("has_l"), F.lit(0)) == 1, F.lit("F"))
            .when(F.coalesce(F.col("has_u"), F.lit(0)) == 0, F.lit("L"))
            .otherwise(F.lit("U")).alias("st")).checkpoint(eager=True)
        undecided = not state.where(F.col("st") == "U").isEmpty()
        # only edges into undecided nodes still matter
        live = edges.join(state.where(F.col("st") == "U").select(F.col("ord").alias("dst")), "dst", "left_semi")
    leaders = state.where(F.col("st") == "L").select(F.col("ord").alias("src"))
    follow = edges.join(leaders, "src", "left_semi").groupBy(F.col("dst").alias("ord")).agg(
        F.min("src").alias("leader"))
    return follow.join(state.where(F.col("st") == "F").select("ord"), "ord"), rounds


def dedupe(df: DataFrame, key_col: str, threshold: float = 0.85, order_col: str = "pos",
           p: float = 0.1) -> DataFrame:
    """O-DED1: Jaro-Winkler (lower-cased key, missing -> '') leader rule.

    Returns the input rows plus ``leader`` (order value of the group's
    leader) and ``is_leader``. Unique rows = ``is_leader``; groups = rows
    grouped by ``leader`` having more than one member.
    """
    k = F.lower(F.coalesce(F.col(key_col).cast("string"), F.lit("")))
    rows = df.withColumn("_k", k)
    reps = rows.groupBy(F.col("_k").alias("k")).agg(F.min(order_col).alias("ord"))
    reps = reps.checkpoint(eager=True)
    named = reps.where("k <> ''").select("k", F.col("ord").alias("o"))
    pairs = search.all_partners(named.select("k"), named, threshold, search.Name(p))
    ids = reps.select("k", F.col("ord").alias("src")), reps.select(F.col("k").alias("r_k"), F.col("ord").alias("dst"))
    edges = pairs.join(ids[0], "k").join(ids[1], "r_k").where("src < dst").select("src", "dst")
    lead = elect_leaders(reps.select("ord"), edges)
    rep_lead = reps.join(lead, "ord").select(F.col("k").alias("_k"), F.col("ord").alias("_rep"),
                                             "leader", "rounds")
    # every member of an equal-key group shares its representative's leader:
    # the representative's own leader, or the representative itself
    out = rows.join(rep_lead, "_k")
    return out.withColumn("is_leader", F.col(order_col) == F.col("leader")).drop("_k", "_rep")


def dedupe_near(df: DataFrame, tol: float, order_col: str = "pos", lat: str = "latitude",
                lon: str = "longitude") -> DataFrame:
    """O-DED2: the same leader rule with |dlat| < tol and |dlon| < tol.

    Identical coordinates are collapsed to their earliest row first (they
    have identical neighbourhoods, so this is exact), so a hot spot of
    repeated points costs one representative, not a quadratic edge set.
    """
    pts = df.select(F.col(order_col).alias("_o"), F.col(lat).alias("_la"), F.col(lon).alias("_lo"))
    reps = pts.groupBy("_la", "_lo").agg(F.min("_o").alias("ord")) \
        .select("ord", F.col("_la").alias("latitude"), F.col("_lo").alias("longitude"))
    pairs = near_join(reps, reps, tol)
    edges = pairs.where(F.col("l_ord") < F.col("r_ord")).select(
        F.col("l_ord").alias("src"), F.col("r_ord").alias("dst"))
    lead = elect_leaders(reps.select("ord"), edges)
    rep_lead = reps.join(lead, "ord").select(F.col("latitude").alias("_la"),
                                             F.col("longitude").alias("_lo"), "leader", "rounds")
    out = df.join(rep_lead, (df[lat].eqNullSafe(rep_lead["_la"])) & (df[lon].eqNullSafe(rep_lead["_lo"])),
                  "left").drop("_la", "_lo")
    return out.withColumn("is_leader", F.col(order_col) == F.col("leader"))
