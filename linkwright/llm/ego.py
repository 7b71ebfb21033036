"""Embedding near-duplicates (operator 10): epsilon grid order join.

Unit vectors have cosine >= c exactly where their distance is at most
eps = sqrt(2 - 2c). Vectors are projected on their leading principal
dimensions (a projection never lengthens a distance), cut into a grid of
cells of width eps and sorted by (label, cells). Two vectors closer than eps
differ by at most one cell in every projected dimension.

1. Equal vectors of one label collapse into a class with a count.
2. The sorted classes are dealt into sequences of at most ``BLOCK`` rows by
   range partitioning and counts per partition.
3. Sequences whose cell bounds are further than one cell apart in any
   dimension, or whose labels differ, are skipped. Candidate pairs of
   sequences come from an equi-join on (label, first cell, second cell) of
   the cells that a sequence covers, not from all pairs.
4. A pair of sequences is joined in one task: both are halved recursively,
   provably distant halves are skipped, and small blocks are compared by
   exact dot products in double precision. The task returns, per class, the
   number of linked vectors and spanning edges of what it found linked, never
   the pairs themselves.

Principal dimensions are fitted on at most ``FIT_ROWS`` classes; they decide
only what is skipped for being provably distant, never what is linked.

Defined results: vectors that are null, empty, zero, or hold null or
non-finite components, and rows whose label is null, link with nothing; so do
vectors of different length; a vec_id that occurs in several rows is one node
per row (each row counts as a vector; the rows share their id in the graph);
a vector without vec_id links and connects its neighbours like any other, its
component is the smallest id reached (null if there is none) and it is not
kept; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, prepare, staged, take_columns

BLOCK = 1024
LEAF = 128
DIMS = 6
FIT_ROWS = 4096
#: nodes of vectors without id are numbered from here on; ids lie below
NAMELESS = 1 << 62


def _rows(col: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix (rows of equal length)."""
    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(len(col), -1)


def _usable(vec):
    """Finite, non-null, not all zero."""
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & F.coalesce(good & F.exists(vec, lambda x: x != 0), F.lit(False))


def _stack(values) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in values])


def _unit(m: np.ndarray) -> np.ndarray:
    scale = np.abs(m).max(axis=1, keepdims=True)
    m = m / scale
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def fit_axes(classes: DataFrame, dims: int) -> dict[int, np.ndarray]:
    """Principal axes per vector length from a bounded sample by hash order."""
    rows = (classes.select("vec").orderBy(F.xxhash64("vec")).limit(FIT_ROWS).collect())
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["vec"]), []).append(r["vec"])
    axes = {}
    for n, vs in by.items():
        u = _unit(_stack(vs))
        _, vec = np.linalg.eigh(np.cov(u, rowvar=False).reshape(n, n) if len(u) > 1 else np.eye(n))
        axes[n] = np.ascontiguousarray(vec[:, ::-1][:, :dims])
    return axes


def _pairs_linked(u: np.ndarray, v: np.ndarray, cu: np.ndarray, cv: np.ndarray,
                  cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Linked index pairs of two sorted sequences, by recursive halving."""
    out_i, out_j = [], []
    todo = [(0, len(u), 0, len(v))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if same and b1 <= a0:
            continue
        far = (cu[a0:a1].min(0) > cv[b0:b1].max(0) + 1) | (cv[b0:b1].min(0) > cu[a0:a1].max(0) + 1)
        if far.any():
            continue
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            dot = u[a0:a1] @ v[b0:b1].T
            i, j = np.nonzero(dot >= cosine - 1e-9)
            if len(i):
                near = dot[i, j] < cosine + 1e-9
                keep = np.ones(len(i), bool)
                for k in np.flatnonzero(near):  # decide ties by a correctly rounded sum
                    x, y = u[a0 + i[k]], v[b0 + j[k]]
                    keep[k] = float(np.sum(x.astype(np.longdouble) * y)) >= cosine
                i, j = i[keep] + a0, j[keep] + b0
                if same:
                    up = i < j
                    i, j = i[up], j[up]
                out_i.append(i)
                out_j.append(j)
            continue
        am, bm = (a0 + a1) // 2, (b0 + b1) // 2
        left = [(a0, am), (am, a1)] if a1 - a0 > LEAF else [(a0, a1)]
        right = [(b0, bm), (bm, b1)] if b1 - b0 > LEAF else [(b0, b1)]
        todo.extend((x0, x1, y0, y1) for x0, x1 in left for y0, y1 in right)
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


def _spanning(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest id of each node's component under the index pairs (i, j)."""
    low = ids.copy()
    while True:
        was = low.copy()
        np.minimum.at(low, i, was[j])
        np.minimum.at(low, j, low[i])
        if (low == was).all():
            return low


def _block_pairs(blocks: DataFrame, dims: int) -> DataFrame:
    """(p, q) of sequences that aren't provably distant, p <= q."""
    def cover(d: int, pad: int):
        return F.explode(F.sequence(F.col("lo")[d] - pad, F.col("hi")[d] + pad))
    second = min(1, dims - 1)
    left = blocks.select("label", "len", "block", "lo", "hi", cover(0, 0).alias("c0")).withColumn(
        "c1", cover(second, 0))
    right = blocks.select("label", "len", F.col("block").alias("q"), F.col("lo").alias("lo2"),
                          F.col("hi").alias("hi2"), "lo", "hi", cover(0, 1).alias("c0")).withColumn(
        "c1", cover(second, 1)).drop("lo", "hi")
    near = F.lit(True)
    for d in range(dims):
        near = near & (F.col("lo")[d] <= F.col("hi2")[d] + 1) & (F.col("lo2")[d] <= F.col("hi")[d] + 1)
    return (left.join(right, ["label", "len", "c0", "c1"]).where(near & (F.col("block") <= F.col("q")))
            .select(F.col("block").alias("p"), "q").distinct())


def near_duplicates(df: DataFrame, cosine: float = 0.93, dims: int = DIMS,
                    block: int = BLOCK) -> DataFrame:
    """One row per row of ``df`` (vec_id, embedding, label): vec_id, n_links,
    component_id, kept."""
    spark = df.sparkSession
    prepare(spark)
    rows = take_columns(df, ["vec_id", "embedding", "label"]).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")
    rows = rows.withColumn("ok", _usable(F.col("vec")) & F.col("label").isNotNull())
    # -0.0 equals 0.0; adding 0.0 makes the bits equal too
    valid = rows.where("ok").select("vec_id", "label", F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec"))
    key = F.sha2(F.to_json(F.struct("vec")).cast("binary"), 256)
    valid = valid.withColumn("vkey", F.concat(F.col("label").cast("string"), F.lit(":"), key))
    classes = staged(valid.groupBy("vkey").agg(
        F.first("label").alias("label"), F.first("vec").alias("vec"),
        F.coalesce(F.min(F.col("vec_id").cast("long")), _nameless(F.col("vkey"))).alias("rep"),
        F.count("*").alias("n")), "ego-classes")
    axes = fit_axes(classes, dims)
    k = min([dims] + [a.shape[1] for a in axes.values()]) if axes else 1
    eps = float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine)))
    width = max(eps, 1e-6) * (1 + 1e-9)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lens = pdf["vec"].map(len)
            cs = np.zeros((len(pdf), k), np.int64)
            for n in lens.unique():
                at = np.flatnonzero((lens == n).to_numpy())
                ax = axes.get(int(n))
                if ax is not None:  # a length outside the sample stays in one cell
                    u = _unit(_stack(pdf["vec"].to_numpy()[at]))
                    cs[at] = np.floor((u @ ax[:, :k]) / width).astype(np.int64)
            yield pdf.assign(cells=list(cs), len=lens.astype("int64"))

    fields = "vkey string, label string, vec array<double>, rep long, n long"
    celled = classes.select("vkey", F.col("label").cast("string").alias("label"), "vec", "rep", "n")
    celled = celled.mapInPandas(cells, fields + ", cells array<long>, len long")
    order = ["label", "len"] + [f"c{i}" for i in range(k)] + ["vkey"]
    flat = celled.select("*", *[F.col("cells")[i].alias(f"c{i}") for i in range(k)])
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = flat.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        part, at, no, fill = TaskContext.get().partitionId(), None, -1, 0
        for pdf in batches:
            ids = np.empty(len(pdf), np.int64)
            for i, here in enumerate(zip(pdf["label"], pdf["len"])):
                if here != at or fill >= block:
                    at, no, fill = here, no + 1, 0
                ids[i] = (part << 32) + no
                fill += 1
            yield pdf[["vkey", "label", "vec", "rep", "n", "cells", "len"]].assign(block=ids)

    seq = staged(ordered.mapInPandas(number, fields + ", cells array<long>, len long, block long"),
                 "ego-sequences")
    blocks = seq.groupBy("label", "len", "block").agg(
        F.array(*[F.min(F.col("cells")[i]) for i in range(k)]).alias("lo"),
        F.array(*[F.max(F.col("cells")[i]) for i in range(k)]).alias("hi"))
    pairs = staged(_block_pairs(blocks, k), "ego-pairs")
    sides = (pairs.select("p", "q", F.col("p").alias("block"))
             .unionByName(pairs.where("p <> q").select("p", "q", F.col("q").alias("block"))))
    work = sides.join(seq.select("block", "vkey", "vec", "rep", "n", "cells"), "block")

    def link(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_c=[tuple(c) for c in pdf["cells"]]).sort_values(["block", "_c", "vkey"])
        first = (pdf["block"] == key[0]).to_numpy()
        u, c = _unit(_stack(pdf["vec"])), np.array(pdf["_c"].to_list(), np.int64)
        ids, n = pdf["rep"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        same = key[0] == key[1]
        ia = np.flatnonzero(first)
        ib = ia if same else np.flatnonzero(~first)
        i, j = _pairs_linked(u[ia], u[ib], c[ia], c[ib], cosine, same)
        i, j = ia[i], ib[j]
        links = np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))
        low = _spanning(ids, i, j)
        some = np.flatnonzero(links > 0)
        return pd.DataFrame({"vkey": pdf["vkey"].to_numpy()[some], "links": links[some].astype(np.int64),
                             "a": ids[some], "b": low[some]})

    found = staged(work.groupBy("p", "q").applyInPandas(link, "vkey string, links long, a long, b long"),
                   "ego-links")
    # a vec_id may stand in several classes; its rows share one node
    members = valid.where("vec_id is not null").select("vkey", "vec_id")
    same_class = members.join(classes.where("n > 1").select("vkey", "rep"), "vkey").where(
        "vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    edges = found.where("a <> b").select("a", "b").unionByName(same_class)
    comp = components(edges)
    per_class = (classes.select("vkey", "rep", (F.col("n") - 1).alias("links"))
                 .unionByName(found.select("vkey", F.lit(None).cast("long").alias("rep"), "links"))
                 .groupBy("vkey").agg(F.max("rep").alias("rep"), F.sum("links").alias("links")))
    linked = valid.select("vec_id", "vkey").join(per_class, "vkey").select(
        "vec_id", F.coalesce("vec_id", "rep").alias("node"), F.col("links").alias("n_links"))
    base = linked.unionByName(rows.where(~F.coalesce("ok", F.lit(False))).select(
        "vec_id", F.col("vec_id").alias("node"), F.lit(0).cast("long").alias("n_links")))
    out = base.join(comp, base["node"] == comp["id"], "left")
    comp_id = F.coalesce("component_id", "node")
    comp_id = F.when(comp_id < F.lit(NAMELESS), comp_id)
    return out.select("vec_id", "n_links", comp_id.alias("component_id"),
                      F.coalesce(comp_id == F.col("vec_id"), F.lit(False)).alias("kept"))


def _nameless(vkey: Column) -> Column:
    """Node of a vector without id: above all ids, so it links its neighbours
    but never names their component."""
    return F.lit(NAMELESS) + F.xxhash64(vkey).bitwiseAND(F.lit(NAMELESS - 1))
