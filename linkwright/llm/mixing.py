"""Mixing sources to target weights (operator 3) by subset-sum budget fitting.

1. Documents are counted by exact length per source (one partial aggregate).
2. The budget is shared by weight; a source is capped at ``max_repeats`` times
   its size and the excess is reshared among the others.
3. Whole passes are taken first. For what remains of a source's target, each
   length first gives its proportional share; a bounded knapsack over the
   counts that are left then closes the gap, which is at most four times the
   longest text, exactly wherever some subset of lengths does.
4. Documents are picked by length count in the order of a seeded hash. A
   (source, length) with n documents is dealt into about sqrt(n) hash buckets:
   buckets below the cut are taken whole, and only the bucket at the cut is
   ranked, so no task ever sees all documents of a hot group.

The driver sees one row per source (weights are configured per source);
lengths are solved per source in one task, which receives one row per
distinct length.

Defined results: a null text has size 0; a null source is a source of its
own, last in order; documents of size 0 take 0; with total size 0 all
targets are 0; among rows with equal hash the smaller doc_id, then text hash
is picked first, and equal rows are interchangeable; extra columns of the
input are dropped by :func:`mix` and kept by :func:`mixed_documents`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BREAK_PATTERN, prepare, staged, take_columns

SEED = 20240229
CYCLE = (3.0, 1.0, 2.0)


def size_of(text: Column) -> Column:
    """Number of words of the whole text; null: 0."""
    t = F.coalesce(text, F.lit(""))
    return F.size(F.array_remove(F.split(t, WORD_BREAK_PATTERN), "")).cast("long")


def share_budget(sizes: Sequence[int], weights: Sequence[float], budget: float,
                 max_repeats: float) -> list[float]:
    """Targets by weight, none above ``max_repeats`` times its size."""
    target = [0.0] * len(sizes)
    free = [i for i in range(len(sizes))]
    left = float(budget)
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > max_repeats * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = float(max_repeats * sizes[i])
        left -= sum(target[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return target


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their sizes add up
    to ``budget`` as nearly as possible (never above it)."""
    total = int((lengths * counts).sum())
    take = np.zeros(len(lengths), dtype=np.int64)
    if budget <= 0 or total <= 0:
        return take
    if budget >= total:
        return counts.astype(np.int64)
    take = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    rest = budget - int((lengths * take).sum())
    spare = counts - take
    # one more document of a length at a time, until the gap fits the knapsack
    room = 4 * int(lengths.max())
    for j in np.random.default_rng(SEED).permutation(len(lengths)):
        if rest <= room:
            break
        if spare[j] > 0 and lengths[j] > 0:
            take[j] += 1
            spare[j] -= 1
            rest -= int(lengths[j])
    if rest == 0:
        return take
    # bounded knapsack for the gap plus one given-back document at a time
    best_sum, best = 0, None
    back = [-1] + [int(j) for j in np.argsort(lengths, kind="stable") if take[j] > 0 and lengths[j] > 0]
    for tries, j in enumerate(back):
        goal = rest + (int(lengths[j]) if j >= 0 else 0)
        avail = spare.copy()
        pick = _knapsack(lengths, avail, goal)
        got = sum(int(lengths[i]) * k for i, k in pick.items()) - (goal - rest)
        if got > best_sum:
            best_sum, best = got, (j, pick)
        if best_sum == rest or tries >= 64:
            break
    if best is not None:
        j, pick = best
        if j >= 0:
            take[j] -= 1
        for i, k in pick.items():
            take[i] += k
    return take


def _knapsack(lengths: np.ndarray, counts: np.ndarray, goal: int) -> dict[int, int]:
    """Bounded subset sum by dynamic programming: the largest sum <= goal."""
    reach = 1
    full = (1 << (goal + 1)) - 1
    steps: list[tuple[int, int, int]] = []  # (length index, copies, reach before)
    for i in np.argsort(-lengths, kind="stable"):
        size, c = int(lengths[i]), int(counts[i])
        if size <= 0 or size > goal or c <= 0:
            continue
        c = min(c, goal // size)
        k = 1
        while c > 0:  # copies in powers of two
            k = min(k, c)
            after = (reach | (reach << (size * k))) & full
            if after != reach:
                steps.append((int(i), k, reach))
                reach = after
            c -= k
            k *= 2
        if reach >> goal & 1:
            break
    at = reach.bit_length() - 1
    pick: dict[int, int] = {}
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            pick[i] = pick.get(i, 0) + k
            at -= int(lengths[i]) * k
    return pick


def plan_takes(hist: DataFrame, max_repeats: float) -> DataFrame:
    """(src, size, passes, extra, bucketing) from (src, size, n, target)."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        lengths = pdf["size"].to_numpy(np.int64)
        counts = pdf["n"].to_numpy(np.int64)
        total, target = int((lengths * counts).sum()), float(pdf["target"].iloc[0])
        passes = min(int(target // total), int(max_repeats)) if total else 0
        left = int(round(target - passes * total)) if passes < max_repeats else 0
        return pd.DataFrame({"src": pdf["src"].to_numpy(), "size": lengths, "n": counts,
                             "passes": np.int64(passes),
                             "extra": fit_counts(lengths, counts, left)})

    return hist.groupBy("src").applyInPandas(
        solve, "src long, size long, n long, passes long, extra long")


def mix(df: DataFrame, weights: dict | None = None, budget_ratio: float = 1.5,
        max_repeats: int = 2, seed: int = SEED) -> DataFrame:
    """For every row of ``df`` its doc_id, tie (hash of the text), source, size,
    source_size, target, taken (words that the mix takes of it, repeats
    counted) and times. ``weights``: by source (a missing
    one weighs 1); default: 3, 1, 2 repeating over the sources in order."""
    spark = df.sparkSession
    prepare(spark)
    docs = take_columns(df, ["doc_id", "text", "source"])
    narrow = docs.select("doc_id", F.col("source").cast("string").alias("source"),
                         size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    narrow = staged(narrow, "mix-sizes")
    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size")).collect()
    sources.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    w = [CYCLE[i % len(CYCLE)] if weights is None else float(weights.get(r["source"], 1.0))
         for i, r in enumerate(sources)]
    sizes = [int(r["source_size"] or 0) for r in sources]
    targets = share_budget(sizes, w, budget_ratio * sum(sizes), max_repeats) if sum(sizes) else [0.0] * len(sizes)
    table = spark.createDataFrame(
        [(i, r["source"], sizes[i], float(targets[i])) for i, r in enumerate(sources)],
        "src long, source string, source_size long, target double")
    rows = narrow.join(F.broadcast(table), narrow["source"].eqNullSafe(table["source"])).select(
        "doc_id", "src", table["source"], "size", "tie", "source_size", "target")
    hist = rows.groupBy("src", "size").agg(F.count("*").alias("n"), F.first("target").alias("target"))
    plan = staged(plan_takes(hist, max_repeats), "mix-plan")
    return _select(rows, plan, seed)


def _select(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    h = F.xxhash64(F.lit(seed), "doc_id", "tie")
    # only lengths of which some but not all documents are taken need an order
    keyed = rows.join(plan.select("src", "size", "passes", "extra", F.col("n").alias("cnt")),
                      ["src", "size"])
    whole = keyed.where("extra = 0 or extra = cnt").select(
        "doc_id", "tie", "source", "size", "source_size", "target",
        (F.col("passes") + F.when(F.col("extra") > 0, 1).otherwise(0)).alias("times"))
    part = keyed.where("extra > 0 and extra < cnt").withColumn("h", h).withColumn(
        "bucket", F.floor((F.shiftrightunsigned("h", 1) / F.lit(float(2 ** 63)))
                          * F.ceil(F.sqrt("cnt"))).cast("long"))
    part = staged(part, "mix-part")
    by = Window.partitionBy("src", "size").orderBy("bucket")
    cuts = (part.groupBy("src", "size", "bucket").agg(F.count("*").alias("c"), F.first("extra").alias("extra"))
            .withColumn("upto", F.sum("c").over(by.rowsBetween(Window.unboundedPreceding, 0)))
            .select("src", "size", "bucket",
                    F.greatest(F.lit(0), F.least("c", F.col("extra") - F.col("upto") + F.col("c")))
                    .alias("room"), "c"))
    cut = part.join(cuts, ["src", "size", "bucket"])
    clear = cut.where("room = 0 or room = c").select(
        "doc_id", "tie", "source", "size", "source_size", "target",
        (F.col("passes") + F.when(F.col("room") > 0, 1).otherwise(0)).alias("times"))
    rank = F.row_number().over(Window.partitionBy("src", "size", "bucket").orderBy("h", "doc_id", "tie"))
    edge = cut.where("room > 0 and room < c").withColumn("rk", rank).select(
        "doc_id", "tie", "source", "size", "source_size", "target",
        (F.col("passes") + F.when(F.col("rk") <= F.col("room"), 1).otherwise(0)).alias("times"))
    out = whole.unionByName(clear).unionByName(edge)
    return out.select("doc_id", "tie", "source", "size", "source_size", "target",
                      (F.col("size") * F.col("times")).alias("taken"), "times")


def mixed_documents(df: DataFrame, picks: DataFrame) -> DataFrame:
    """The mix itself: every row as often as :func:`mix` takes it. Documents of
    size 0 stay once. Rows of one doc_id, text and source share what the mix
    takes of them evenly, the first ones by their other columns first."""
    cols, rest = df.columns, [c for c in df.columns if c not in ("doc_id", "text", "source")]
    flat = df.toDF(*[f"_{i}" for i in range(len(cols))])
    at = {c: F.col(f"_{cols.index(c)}") for c in ("doc_id", "text", "source")}
    key = F.xxhash64(F.coalesce(at["doc_id"].cast("string"), F.lit("-")), F.xxhash64(at["text"]),
                     F.coalesce(F.concat(F.lit("+"), at["source"].cast("string")), F.lit("-")))
    often = staged(picks.groupBy(F.xxhash64(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "tie",
        F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("-"))).alias("_key")).agg(
        F.sum("times").alias("_sum"), F.count("*").alias("_rows"), F.max("size").alias("_size")), "mix-often")
    even = F.when(F.col("_size") == 0, F.col("_rows")).otherwise(F.col("_sum"))
    keyed = flat.withColumn("_key", key)
    uneven = often.where((F.col("_size") > 0) & (F.col("_sum") % F.col("_rows") > 0))
    times = keyed.join(often, "_key").where((F.col("_size") == 0) | (F.col("_sum") % F.col("_rows") == 0)).withColumn(
        "_times", F.floor(even / F.col("_rows")))
    if not uneven.isEmpty():
        rank = F.row_number().over(Window.partitionBy("_key").orderBy(*[f"_{cols.index(c)}" for c in rest] or ["_key"]))
        shared = keyed.join(uneven, "_key").withColumn("_rank", rank)
        times = times.unionByName(shared.withColumn("_times", F.floor(F.col("_sum") / F.col("_rows")) + F.when(
            F.col("_rank") <= F.col("_sum") % F.col("_rows"), 1).otherwise(0)).drop("_rank"))
    return times.where("_times > 0").select(
        *flat.columns, F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_n")).drop("_n").toDF(*cols)
