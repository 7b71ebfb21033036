"""Filter interaction audit (operator 13): what each filter removes in every
order of filters, from sorted posting lists.

Every filter keeps, per part and id range, the sorted list of the row ids that
fail it. What a filter removes after others is its list without the union of
theirs. For every set of earlier filters the unions are built once, by
galloping merges of sorted lists, and the differences are taken against them;
sizes of all id ranges are summed. Orders of filters are then only looked up:
what a step does depends on the set of filters before it, not on their order.

Rows are numbered, so rows without doc_id and repeated rows count like any
other. An id range is a run of numbered rows within one file split, so its
lists are bounded whatever the parts are.

Defined results: a null text is empty and equal to an empty one; a null source
is the part ''; a row without doc_id is never a copy of a smaller one (nor is
a repeated row of the smallest doc_id); labels of one doc_id count if any row
says 1; an empty table gives no rows. Extra columns are dropped first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BREAK_PATTERN, staged, take_columns

FILTERS = "ABCDE"
#: rows of one id range
RANGE_ROWS = 1 << 14
#: a text shared by more than this share of rows is hot; there are at most as many
HOT_SHARE = 1000


# ------------------------------------------------------- failing documents
def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, a to e (fails the filter), good, toxic: one row per document."""
    text = F.coalesce("text", F.lit(""))
    rows = take_columns(docs, ["doc_id", "text", "source"]).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("t"))
    worded = rows.select("*", F.array_remove(F.split("t", WORD_BREAK_PATTERN), "").alias("w"))
    n, chars = F.size("w").cast("long"), F.length("t").cast("long")
    capitals = chars - F.length(F.regexp_replace("t", "[A-Z]+", ""))
    flat = staged(worded.select(
        "doc_id", "part", F.unhex(F.sha2("t", 256)).alias("h"), (n < 200).alias("a"),
        (100 * F.size(F.array_distinct("w")).cast("long") < 50 * n).alias("b"),
        (100 * capitals > 2 * chars).alias("c"), F.col("t").rlike("[#$%&*|]").alias("d")), "audit-flags")
    marks = take_columns(labels, ["doc_id", "quality", "toxic"]).where("doc_id is not null").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    named = _copies(flat.where("doc_id is not null")).join(marks, "doc_id", "left").select(
        "part", "a", "b", "c", "d", "e", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return named.unionByName(flat.where("doc_id is null").select(
        "part", "a", "b", "c", "d", no.alias("e"), no.alias("good"), no.alias("toxic")))


def _copies(flat: DataFrame) -> DataFrame:
    """``flat`` with e: an equal text has a smaller doc_id.

    Smallest ids are combined before the shuffle. Texts that hold more than
    one of HOT_SHARE rows (never more than HOT_SHARE texts) are broadcast; any
    other text is too rare to crowd a task.
    """
    many = staged(flat.groupBy("h").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1"),
                  "audit-copies")
    is_hot = F.col("n") * HOT_SHARE > flat.count()
    hot = F.broadcast(many.where(is_hot).select("h", "low"))
    rest = flat.join(hot, "h", "left_anti").join(many.where(~is_hot).select("h", "low"), "h", "left")
    e = F.coalesce(F.col("doc_id") > F.col("low"), F.lit(False)).alias("e")
    cols = ["doc_id", "part", "a", "b", "c", "d", e]
    return flat.join(hot, "h").select(*cols).unionByName(rest.select(*cols))


# ----------------------------------------------------------- posting lists
LISTS = [*FILTERS.lower(), "good", "toxic"]


def posting_lists(flags: DataFrame) -> DataFrame:
    """part, rows, and per filter (and label) the sorted failing row ids: one
    row per part and id range. Rows are numbered within their task, batch by
    batch, so no row is moved."""
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("rows", T.LongType())] + [
        T.StructField(c, T.ArrayType(T.LongType())) for c in LISTS])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, size = 0, [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= RANGE_ROWS:
                yield _range_lists(held, base, names)
                base, held, size = base + size, [], 0
        if size:
            yield _range_lists(held, base, names)

    return flags.select("part", *LISTS).mapInArrow(run, schema)


def _range_lists(batches: list[pa.RecordBatch], base: int, names: list[str]) -> pa.RecordBatch:
    t = pa.Table.from_batches(batches).combine_chunks()
    codes = t["part"].combine_chunks().dictionary_encode()
    code = codes.indices.to_numpy(zero_copy_only=False)
    parts = len(codes.dictionary)
    out = [codes.dictionary.cast(pa.string()), pa.array(np.bincount(code, minlength=parts), pa.int64())]
    for c in LISTS:
        at = np.flatnonzero(t[c].to_numpy())
        at = at[np.argsort(code[at], kind="stable")]
        ends = np.concatenate([[0], np.cumsum(np.bincount(code[at], minlength=parts))])
        out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at + base, pa.int64())))
    return pa.RecordBatch.from_arrays(out, names=names)


def places(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Where each id of the sorted ``few`` belongs in the sorted ``many``.

    The search for an id starts at the place of the id before it (numpy keeps
    that bound for ascending keys), and lists whose id ranges do not overlap
    cost two comparisons.
    """
    if not len(few) or not len(many) or few[-1] < many[0]:
        return np.zeros(len(few), np.int64)
    if few[0] > many[-1]:
        return np.full(len(few), len(many), np.int64)
    return np.searchsorted(many, few)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ids of both sorted lists; the shorter one gallops through the longer."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    at = places(few, many)
    inside = at < len(many)
    hit = np.zeros(len(few), bool)
    hit[inside] = many[at[inside]] == few[inside]
    return few[hit]


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ids of the sorted ``a`` that the sorted ``b`` lacks."""
    if len(a) <= len(b):
        at = places(a, b)
        inside = at < len(b)
        lost = np.zeros(len(a), bool)
        lost[inside] = b[at[inside]] == a[inside]
        return a[~lost]
    hit = common(a, b)
    keep = np.ones(len(a), bool)
    keep[places(hit, a)] = False
    return a[keep]


def union(lists: list[np.ndarray]) -> np.ndarray:
    """K-way merge of sorted lists without repeats, shorter into longer."""
    out = np.zeros(0, np.int64)
    for x in sorted(lists, key=len, reverse=True):
        fresh = minus(x, out)
        out = np.insert(out, places(fresh, out), fresh) if len(out) else fresh
    return out


# -------------------------------------------------------------------- sizes
def _set_steps() -> list[tuple[int, int]]:
    """(filter, set of earlier filters as bits) for every possible step."""
    n = len(FILTERS)
    return [(f, s) for f in range(n) for s in range(1 << n) if not s >> f & 1]


def step_sizes(lists: DataFrame) -> DataFrame:
    """part, f, earlier, removed, good, toxic, summed over id ranges: what
    filter f removes after the set ``earlier``, and how much of it is labelled.
    f = -1: ``removed`` is the size of the union of ``earlier``, for the empty
    set the number of the part's rows."""
    schema = "part string, f int, earlier int, removed long, good long, toxic long"
    n, steps = len(FILTERS), _set_steps()

    def measure(row: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
        fails, good, toxic = row[:n], row[n], row[n + 1]
        before = [union([fails[f] for f in range(n) if s >> f & 1]) for s in range(1 << n)]
        for s in range(1, 1 << n):
            if len(before[s]):
                yield -1, s, len(before[s]), 0, 0
        for f, s in steps:
            gone = minus(fails[f], before[s])
            if len(gone):
                yield f, s, len(gone), len(common(gone, good)), len(common(gone, toxic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns)]
            offs = [c.offsets.to_numpy() for c in cols[2:]]
            flat = [c.values.to_numpy() for c in cols[2:]]
            out = []
            for i, (part, rows) in enumerate(zip(cols[0].to_pylist(), cols[1].to_pylist())):
                out.append((part, -1, 0, rows, 0, 0))
                out += [(part, *m) for m in measure([v[o[i]:o[i + 1]] for o, v in zip(offs, flat)])]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds],
                names=["part", "f", "earlier", "removed", "good", "toxic"])

    return lists.mapInArrow(run, schema).groupBy("part", "f", "earlier").agg(
        F.sum("removed").alias("removed"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def _orders() -> list[tuple]:
    """(i, filter_order, step, f, earlier) of all orders: a fixed 600 rows."""
    out: list[tuple] = []
    for order in permutations(range(len(FILTERS))):
        earlier = 0
        for step, f in enumerate(order, 1):
            out.append((len(out), "".join(FILTERS[i] for i in order), step, f, earlier))
            earlier |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of filters and step: part, filter_order, step,
    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    lists = staged(posting_lists(staged(failures(docs, labels), "audit-rows")), "audit-lists")
    sizes = staged(step_sizes(lists), "audit-sizes")
    n = len(FILTERS)
    full, zero = (1 << n) - 1, F.lit(0).cast("long")
    # orders of n filters in which exactly the set s stands before a given filter
    ways = F.create_map(*[F.lit(x) for s in range(full) for x in (
        s, factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()))])
    # at most 112 sizes per part, as one map; every order only looks sizes up
    wide = sizes.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct(
            _key(F.col("f"), F.col("earlier")), F.struct("removed", "good", "toxic")))).alias("m"),
        *[F.coalesce(F.sum(F.when(F.col("f") == f, F.col("removed") * ways[F.col("earlier")])), zero).alias(f"s{f}")
          for f in range(n)])
    orders = _orders()
    steps = docs.sparkSession.createDataFrame(orders, "i int, filter_order string, step int, f int, earlier int")
    laid = wide.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1)))).join(F.broadcast(steps), "i")
    f, earlier, bit = F.col("f"), F.col("earlier"), F.expr("shiftleft(1, f)")

    def size(f: Column, of: Column, name: str = "removed") -> Column:
        return F.coalesce(F.try_element_at("m", _key(f, of))[name], zero)

    removed = size(f, earlier)
    return laid.select(
        "part", "filter_order", "step",
        (size(F.lit(-1), F.lit(0)) - size(F.lit(-1), earlier.bitwiseOR(bit))).alias("kept"),
        removed.alias("removed"), (size(f, F.lit(0)) - removed).alias("redundant"),
        size(f, F.lit(full).bitwiseXOR(bit)).alias("unique_fails"),
        size(f, earlier, "good").alias("good_lost"), size(f, earlier, "toxic").alias("toxic_lost"),
        F.array(*[F.col(f"s{j}") for j in range(n)])[f].alias("shapley"))


def _key(f: Column, earlier: Column) -> Column:
    return f * (1 << len(FILTERS)) + earlier
