"""Helpers shared by the operators of this subpackage: staged tables in the
shared folder, vectorised word hashing over Arrow buffers, connected
components and bounded per-task caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ensure_checkpoint_dir, scratch_path, ship_package

#: rows of one Arrow batch; texts may be long, so batches are short
BATCH_ROWS = 1000
#: bytes of one Arrow batch, plus one row: long texts make short batches
BATCH_BYTES = 8 << 20
#: characters that separate words: \x20 and \x09-\x0D
WORD_BREAKS = (9, 10, 11, 12, 13, 32)
#: Java pattern of the separators
WORD_BREAK_PATTERN = "[\\x20\\x09-\\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Session state every operator needs: checkpoint folder, shipped package,
    short Arrow batches (texts are long)."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and a
    lost executor costs only the tasks it was running."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; it is installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns, found by exact name where several differ by case."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def take_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keep only ``cols``. Extra columns are dropped first, whatever they are
    called, so operator columns cannot clash with them. Where several columns
    carry a wanted name, the first one counts."""
    names = df.columns
    pos = [names.index(c) for c in cols]
    if len(set(n.lower() for n in names)) == len(names):
        return only(df, *cols)
    flat = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return flat.select(*[F.col(f"_c{i}").alias(c) for i, c in zip(pos, cols)])


# ------------------------------------------------------------- word hashing
_WS = np.zeros(256, dtype=bool)
_WS[list(WORD_BREAKS)] = True
_SPAN = 1 << 20
_tables: tuple[np.ndarray, np.ndarray] | None = None


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hash_tables() -> tuple[np.ndarray, np.ndarray]:
    """A random 64-bit value per byte, and powers of an odd number."""
    global _tables
    if _tables is None:
        byte = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        step = np.full(4096, 0xD1342543DE82EF95, dtype=np.uint64)
        step[0] = 1
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(step)
        _tables = (byte, power)
    return _tables


def utf8_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls are empty."""
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        width = np.int64
    else:
        width = np.int32
    if col.null_count:
        col = col.fill_null("")
    _valid, off, data = col.buffers()
    offs = np.frombuffer(off, dtype=width)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offs


def _cuts(raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte spans of about 1 MB that end at a text's end or at a separator."""
    at, end = int(offs[0]), int(offs[-1])
    while at < end:
        to = min(at + _SPAN, end)
        if to < end:
            inner = offs[np.searchsorted(offs, to, side="right") - 1]
            if inner > at:
                to = int(inner)
            else:  # one text longer than a span: cut before a separator
                gaps = np.flatnonzero(_WS[raw[at:to]])
                if len(gaps) and gaps[-1] > 0:
                    to = at + int(gaps[-1])
                else:
                    nxt = int(offs[np.searchsorted(offs, at, side="right")])
                    later = np.flatnonzero(_WS[raw[to:nxt]])
                    to = to + int(later[0]) if len(later) else nxt
        yield at, to
        at = to


def word_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word ``[^\\x20\\x09-\\x0D]+`` of every text.

    Returns (hashes, first): words of text i are hashes[first[i]:first[i+1]].
    """
    byte, power = _hash_tables()
    hashes, starts = [], []
    for a, b in _cuts(raw, offs):
        chunk = raw[a:b]
        gap = _WS[chunk]
        begin = ~gap
        begin[1:] &= gap[:-1]
        inside = offs[(offs >= a) & (offs < b)] - a
        begin[inside] = ~gap[inside]
        s = np.flatnonzero(begin)
        if not len(s):
            continue
        word = np.cumsum(begin) - 1
        pos = np.arange(len(chunk), dtype=np.int64) - s[np.maximum(word, 0)]
        with np.errstate(over="ignore"):
            v = byte[chunk] * power[pos & 4095]
            v[gap] = 0
            hashes.append(mix64(np.add.reduceat(v, s)))
        starts.append(s + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    at = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(at, offs, side="left")


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` words of one text; a shorter text is
    one window; a text without words has none."""
    n = len(words)
    if n == 0:
        return words
    k = min(size, n)
    with np.errstate(over="ignore"):
        acc = np.full(n - k + 1, np.uint64(k))
        for j in range(k):
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + words[j:n - k + 1 + j])
    return acc


def wide_strings(batch: pa.RecordBatch, name: str) -> pa.Array:
    col = batch.column(batch.schema.get_field_index(name))
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def text_list(col: pa.Array) -> list[str]:
    return ["" if x is None else x for x in col.to_pylist()]


# ----------------------------------------------------- connected components
def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(id, component_id = smallest id reachable) for every id of ``edges``.

    Alternates large-star and small-star rounds (logarithmically many) on
    tables written to the shared folder. A hot node's neighbours are reduced
    by a partially aggregated ``min``; its rows are spread over tasks by the
    join, which Spark may split. Nothing reaches the driver but two counts.
    """
    e = (edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
         .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    e = staged(e, "cc")
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour points to the smallest one
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        big = (both.where("v > u").join(low, "u")
               .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        big = staged(big, "cc")
        # small star: smaller neighbours and the node itself point to the smallest
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        joined = big.join(low, "u")
        e = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
             .unionByName(low.select("u", F.col("m").alias("v")))
             .where("u <> v").distinct())
        e = staged(e, "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = (now[0], now[1])
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    return (e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
            .unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component_id")))
            .groupBy("id").agg(F.min("component_id").alias("component_id")))


def add_column(df: DataFrame, name: str, kind: T.DataType, source: str,
               make: Callable[[pa.Array], Sequence], finish: Callable[[], None] | None = None) -> DataFrame:
    """``df`` with one more column, made from column ``source`` Arrow batch by
    Arrow batch. A column that already bears the name is replaced. ``finish``
    runs when a task has ended."""
    pos = [i for i, c in enumerate(df.columns) if c.lower() != name.lower() or c == source != name]
    src = df.columns.index(source)
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    schema = T.StructType([flat.schema.fields[i] for i in pos] + [T.StructField("_new", kind)])
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                cols = [b.column(i) for i in pos] + [pa.array(make(b.column(src)), arrow)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
        finally:
            if finish is not None:
                finish()

    return flat.mapInArrow(run, schema).toDF(*[df.columns[i] for i in pos], name)


_holders: dict[str, Callable[[], None]] = {}


def claim(name: str, release: Callable[[], None] | None = None) -> None:
    """Called by tasks: workers outlive tasks, so what other operators' tasks
    left in this worker is dropped; ``release`` drops what this one will leave."""
    for other in [n for n in _holders if n != name]:
        _holders.pop(other)()
    if release is not None:
        _holders[name] = release


class TwoAges:
    """A bounded cache: when the young half is full it becomes the old half;
    an old entry that is asked for again becomes young."""

    def __init__(self, limit: int):
        self.half, self.young, self.old = max(1, limit // 2), {}, {}

    def again(self, key):
        """Value of a key that isn't young; None if unknown."""
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[key] = value
