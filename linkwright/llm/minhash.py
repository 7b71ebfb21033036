"""MinHash near-duplicates (operator 1): improved consistent weighted sampling
(ICWS) over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

1. Shingles are the 64-bit hashes of five-word windows of the whole text (a
   shorter text is one shingle). A shingle weighs tf * idf. Document
   frequencies are counted over all documents by feature hashing into
   ``DF_BUCKETS`` buckets, a table of fixed size (4 MB) that may be broadcast;
   idf = 1 + DAMP * ln((1+N)/(1+df)) / ln(1+N), so it lies between 1 and 1+DAMP.
2. Per text, ``BANDS * ROWS`` ICWS samples; two texts agree in a sample with
   probability equal to their weighted Jaccard similarity. Texts that agree in
   all rows of a band share a bucket.
3. Equal texts collapse first; below, "text" means one of each. Texts that
   share a bucket are turned into weighted shingle sets once; nothing later
   carries a text.
4. Rounds 1 and 2: within a bucket (large ones dealt into salted parts, another
   deal each time) a spanning forest of the classes found so far, over the
   pairs that agree in most samples, is verified. Round 3: buckets that still
   hold several classes are dealt into a grid of parts; members with an open
   pair (of different classes, sharing no earlier band) come together with
   their sets, all pairs of a part are verified by products of set matrices
   inside the task, and only a spanning forest of the linked ones leaves it.
   So no pair of bucket mates goes unchecked unless its texts are in one class
   already or agree in fewer than ``ESTIMATE`` of the samples (0: verify all).
   By the binomial distribution a pair of similarity exactly 0.8 agrees in so
   few of 42 samples with 2.5e-6, one of 0.85 with 1e-8: less than the bands lose.
5. Verification computes the weighted Jaccard similarity of whole texts.

The chance that a pair of similarity s never shares a bucket is
(1 - s**ROWS)**BANDS: 4.3e-5 at 0.8, 1.3e-5 at 0.82, 1.6e-6 at 0.85.

Defined results: texts that are null, empty or without words are never
duplicates; a null doc_id is its own class (null) and stays; several rows with
one doc_id are one node; of a class the smallest doc_id stays; an empty table
gives no rows; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (claim, components, mix64, prepare, shingle_hashes, staged, take_columns, utf8_buffers,
                     word_hashes)

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 3
SAMPLES = BANDS * ROWS
#: agreeing samples, as a share, below which bucket mates are not verified
ESTIMATE = 0.5
DF_BUCKETS = 1 << 20
DF_CHUNK = 1 << 14
DAMP = 0.5
PART = 512
HOT = 2 * PART
#: bytes of the shingle sets of one part
PART_BYTES = 8 << 20
#: columns of a set matrix built at once
COLUMNS = 1 << 13
SEED = 7


# ------------------------------------------------------------------- weights
def _shingles(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles, their counts, first index per text) of a column."""
    claim("minhash")
    raw, offs = utf8_buffers(col)
    words, first = word_hashes(raw, offs)
    us, cs, lens = [], [], [0]
    for r in range(len(offs) - 1):
        u, c = np.unique(shingle_hashes(words[first[r]:first[r + 1]], WORDS), return_counts=True)
        us.append(u)
        cs.append(c)
        lens.append(len(u))
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(us) if us else empty, np.concatenate(cs) if cs else empty.astype(np.int64),
            np.cumsum(lens))


def _bucket(u: np.ndarray) -> np.ndarray:
    return (u >> np.uint64(64 - DF_BUCKETS.bit_length() + 1)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """(number of texts with words, document frequency per bucket)."""
    chunks = DF_BUCKETS // DF_CHUNK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros(DF_BUCKETS, np.int64), 0
        for b in batches:
            u, _, first = _shingles(b.column(0))
            table += np.bincount(_bucket(u), minlength=DF_BUCKETS)
            n += int((np.diff(first) > 0).sum())
        rows = [(i, part.tobytes()) for i, part in enumerate(table.reshape(chunks, DF_CHUNK)) if part.any()]
        rows.append((chunks, np.array([n], np.int64).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
            names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(data, np.int64)
                sums[i] = sums[i] + v if i in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                names=["chunk", "counts"])

    fields = "chunk long, counts binary"
    parts = take_columns(docs, ["text"]).mapInArrow(count, fields)
    table, n = np.zeros((chunks, DF_CHUNK), np.int64), 0
    for r in parts.repartition(chunks, "chunk").mapInArrow(add, fields).collect():
        v = np.frombuffer(r["counts"], np.int64)
        if r["chunk"] == chunks:
            n = int(v[0])
        else:
            table[r["chunk"]] = v
    return n, table.reshape(-1)


def idf_table(n: int, df: np.ndarray) -> np.ndarray:
    if n == 0:
        return np.ones(len(df), np.float32)
    return (1 + DAMP * np.log((1 + n) / (1 + np.minimum(df, n))) / np.log(1 + n)).astype(np.float32)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of two weighted sets (sorted keys)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][i], b[1][j]).sum())
    high = float(a[1].sum()) + float(b[1].sum()) - low
    return low / high if high > 0 else 0.0


# ---------------------------------------------------------------------- ICWS
_draws: tuple[np.ndarray, ...] | None = None


def _tables() -> tuple[np.ndarray, ...]:
    """Gamma(2,1) draws r, 1/r, ln of Gamma(2,1) draws c, uniform draws."""
    global _draws
    if _draws is None:
        g = np.random.Generator(np.random.PCG64(SEED))
        r = g.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
        c = np.log(g.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
        _draws = (r, (1 / r).astype(np.float32), c, g.random(1 << 16).astype(np.float32))
    return _draws


def signatures(u: np.ndarray, w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """ICWS samples (32-bit identities) of every text with shingles."""
    R, RI, C, B = _tables()
    lens = np.diff(first)
    out = np.zeros((len(lens), SAMPLES), np.uint32)
    have = np.flatnonzero(lens > 0)
    if not len(have):
        return out
    starts, logw = first[have], np.log(w).astype(np.float32)
    odd = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    step, shift, low = 1 << 15, np.uint64(32), np.int64(0xFFFF)
    best = np.empty(len(u), np.int64)
    with np.errstate(over="ignore"):
        for k in range(SAMPLES):
            for s in range(0, len(u), step):
                x = u[s:s + step]
                z = x * odd[k]
                z ^= z >> shift
                z *= np.uint64(0xD6E8FEB86659FD93)
                bits = z.view(np.int64)
                ri = (bits >> 48) & low
                r = R[ri]
                beta = B[(bits >> 32) & low]
                t = np.floor(logw[s:s + step] * RI[ri] + beta)
                lna = C[(bits >> 16) & low] - r * (t - beta) - r
                i = lna.view(np.int32)
                i = i ^ ((i >> 31) & np.int32(0x7FFFFFFF))
                ident = ((x + t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                         * np.uint64(0xFF51AFD7ED558CCD)) >> shift
                best[s:s + step] = (i.astype(np.int64) << 32) | ident.view(np.int64)
            out[have, k] = (np.minimum.reduceat(best, starts) & 0xFFFFFFFF).astype(np.uint32)
    return out


def _band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.empty((len(sig), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            acc = np.full(len(sig), np.uint64(b + 1))
            for j in range(ROWS):
                acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * ROWS + j])
            keys[:, b] = acc
    return keys.view(np.int64)


def sign(docs: DataFrame, idf) -> DataFrame:
    """(doc_id, tkey, size, sig, bands) of every text that has words; size: bytes of its set."""
    keyed = take_columns(docs, ["doc_id", "text"]).where("doc_id is not null and text is not null").select(
        "doc_id", "text", F.sha2("text", 256).alias("tkey"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for b in batches:
            u, c, first = _shingles(b.column(1))
            sig = signatures(u, c * table[_bucket(u)], first)
            at = np.flatnonzero(np.diff(first) > 0)
            keys, idx = _band_keys(sig[at]), pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(idx), b.column(2).take(idx), pa.array(12 * np.diff(first)[at], pa.int64()),
                 pa.array([x.astype("<u2").tobytes() for x in sig[at]], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)),
                                          pa.array(keys.reshape(-1)))],
                names=["doc_id", "tkey", "size", "sig", "bands"])

    return keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "tkey").mapInArrow(
        run, "doc_id long, tkey string, size long, sig binary, bands array<long>")


# ---------------------------------------------------------------- candidates
def _agree(sig: np.ndarray) -> np.ndarray:
    m = len(sig)
    out = np.zeros((m, m), np.uint8)
    for k in range(sig.shape[1]):
        col = sig[:, k]
        out += col[:, None] == col[None, :]
    return out


def _forest(sig: np.ndarray, cls: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Maximum spanning forest of the classes over the pairs that agree in
    >= need samples; members of one class count as joined already."""
    sim = _agree(sig).astype(np.int16)
    sim[cls[:, None] == cls[None, :]] = SAMPLES + 1
    m = len(sig)
    top, frm = np.full(m, -1, np.int16), np.full(m, -1)
    todo = np.ones(m, bool)
    pairs = []
    for _ in range(m):
        i = int(np.argmax(np.where(todo, top, -2)))
        if need <= top[i] <= SAMPLES:
            pairs.append((int(frm[i]), i))
        todo[i] = False
        better = todo & (sim[i] > top)
        top[better], frm[better] = sim[i][better], i
    return pairs


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Whole groups of rows with equal (bkey, part), a few batches at a time:
    (bounds, rows)."""
    held: list[pa.RecordBatch] = []

    def cut(t: pa.Table, last: bool):
        key = t.column("bkey").to_numpy()
        part = t.column("part").to_numpy()
        new = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        bounds = np.concatenate([[0], new, [len(key)]])
        return bounds if last else bounds[:-1]

    for b in batches:
        held.append(b)
        t = pa.Table.from_batches(held)
        bounds = cut(t, False)
        if len(bounds) > 1:
            yield bounds, t
            held = t.slice(int(bounds[-1])).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        if t.num_rows:
            yield cut(t, True), t


def _signature_matrix(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(-1, SAMPLES)


def _dealt(members: DataFrame, *cols: str) -> DataFrame:
    """Members of one (bkey, part) together, in order."""
    n = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return members.select("bkey", "part", "rep", "cls", *cols).repartition(n, "bkey", "part").sortWithinPartitions(
        "bkey", "part", "rep")


def _forest_pairs(members: DataFrame, estimate: float) -> DataFrame:
    """(a, b) pairs of texts to verify, from (bkey, part, rep, cls, sig)."""
    need = int(np.ceil(estimate * SAMPLES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bounds, t in _segments(batches):
            rep, cls = t.column("rep").to_numpy(), t.column("cls").to_numpy()
            sig = _signature_matrix(t)
            size = np.diff(bounds)
            two = bounds[:-1][size == 2]
            good = two[((sig[two] == sig[two + 1]).sum(axis=1) >= need) & (cls[two] != cls[two + 1])]
            out = [np.stack([rep[good], rep[good + 1]], axis=1)]
            for a, n in zip(bounds[:-1][size > 2], size[size > 2]):
                p = np.array(_forest(sig[a:a + n], cls[a:a + n], need), np.int64).reshape(-1, 2)
                out.append(np.stack([rep[a + p[:, 0]], rep[a + p[:, 1]]], axis=1))
            got = np.sort(np.concatenate(out), axis=1)
            got = np.unique(got[got[:, 0] != got[:, 1]], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    return _dealt(members, "sig").mapInArrow(run, "a long, b long").distinct()


def _open_pairs(sig: np.ndarray, cls: np.ndarray, band: int, need: int) -> np.ndarray:
    """Matrix of pairs still to verify in this bucket: different classes, alike
    enough, and not together in an earlier band's bucket."""
    todo = cls[:, None] != cls[None, :]
    for b in range(band):
        alike = np.ones(todo.shape, bool)
        for k in range(b * ROWS, (b + 1) * ROWS):
            alike &= sig[:, k][:, None] == sig[:, k][None, :]
        todo &= ~alike
    if need > ROWS:
        todo &= _agree(sig) >= need
    return todo


def _open_members(members: DataFrame, estimate: float) -> DataFrame:
    """The (bkey, part, rep, cls, band, sig) that have an open pair."""
    need = int(np.ceil(estimate * SAMPLES))
    fields = "bkey long, part int, rep long, cls long, band int, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bounds, t in _segments(batches):
            cls, band, sig = t.column("cls").to_numpy(), t.column("band").to_numpy(), _signature_matrix(t)
            some = np.zeros(t.num_rows, bool)
            for a, z in zip(bounds[:-1], bounds[1:]):
                if z - a > 1:
                    some[a:z] = _open_pairs(sig[a:z], cls[a:z], int(band[a]), need).any(1)
            yield from t.take(np.flatnonzero(some)).combine_chunks().to_batches()

    return _dealt(members, "band", "sig").mapInArrow(run, fields)


# -------------------------------------------------------------- verification
def shingle_sets(texts: DataFrame) -> DataFrame:
    """(doc_id, keys, counts): distinct shingles of every text, ascending
    (64-bit), and how often each occurs (32-bit), as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, c, first = _shingles(b.column(1))
            c = c.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([u[i:j].tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary()),
                 pa.array([c[i:j].tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())],
                names=["doc_id", "keys", "counts"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, keys binary, counts binary")


def _weighted(keys: bytes, counts: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = np.frombuffer(keys, np.uint64)
    return u, np.frombuffer(counts, "<u4") * idf[_bucket(u)]


def _verify(pairs: DataFrame, sets: DataFrame, idf, similarity: float) -> DataFrame:
    """Pairs whose weighted Jaccard similarity is high enough."""
    right = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("keys").alias("kb"), F.col("counts").alias("cb")), "b")
    both = right.join(sets.select(F.col("doc_id").alias("a"), F.col("keys").alias("ka"), F.col("counts").alias("ca")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for b in batches:
            cols = [b.column(i) for i in range(2, 6)]
            keep = [i for i, (ka, ca, kb, cb) in enumerate(zip(*cols)) if weighted_jaccard(
                _weighted(ka.as_py(), ca.as_py(), table), _weighted(kb.as_py(), cb.as_py(), table)) >= similarity]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())),
                                              b.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return both.select("a", "b", "ka", "ca", "kb", "cb").mapInArrow(run, "a long, b long")


def set_similarities(sets: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of all pairs of different (shingles, counts).

    A shingle that occurs c times is c binary features of its idf each, so the
    sum of minima is a product of binary matrices, built some columns at a time.
    """
    n = len(sets)
    rows = np.repeat(np.arange(n), [len(u) for u, _ in sets])
    u = np.concatenate([u for u, _ in sets])
    c = np.concatenate([x for _, x in sets]).astype(np.int64)
    total = np.bincount(rows, c * idf[_bucket(u)].astype(np.float64), n)
    value = idf[_bucket(u)]
    again = np.repeat(np.arange(len(u)), c)  # one entry per occurrence
    level = np.arange(len(again)) - np.repeat(np.cumsum(c) - c, c)
    with np.errstate(over="ignore"):
        feature = u[again] + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    names, where, times = np.unique(feature, return_inverse=True, return_counts=True)
    shared = times > 1  # a feature of one set only adds nothing
    number = np.cumsum(shared) - 1
    entry = np.flatnonzero(shared[where])
    column, row = number[where[entry]], rows[again[entry]]
    weight = np.sqrt(value[again[entry]])
    order = np.argsort(column, kind="stable")
    column, row, weight = column[order], row[order], weight[order]
    low = np.zeros((n, n))
    for start in range(0, int(shared.sum()), COLUMNS):
        i, j = np.searchsorted(column, [start, start + COLUMNS])
        m = np.zeros((n, min(COLUMNS, int(shared.sum()) - start)), np.float32)
        m[row[i:j], column[i:j] - start] = weight[i:j]
        low += m @ m.T
    high = total[:, None] + total[None, :] - low
    return np.divide(low, high, out=np.zeros_like(low), where=high > 0)


def _linked(open_members: DataFrame, sets: DataFrame, idf, similarity: float, estimate: float) -> DataFrame:
    """(a, b): a spanning forest of the open pairs that are similar, part by part."""
    need = int(np.ceil(estimate * SAMPLES))
    joined = open_members.join(sets.withColumnRenamed("doc_id", "rep"), "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for bounds, t in _segments(batches):
            rep, cls, band = (t.column(c).to_numpy() for c in ("rep", "cls", "band"))
            sig, keys, counts = _signature_matrix(t), t.column("keys"), t.column("counts")
            out = []
            for a, z in zip(bounds[:-1], bounds[1:]):
                todo = _open_pairs(sig[a:z], cls[a:z], int(band[a]), need)
                sets = [(np.frombuffer(keys[int(i)].as_py(), np.uint64), np.frombuffer(counts[int(i)].as_py(), "<u4"))
                        for i in range(a, z)]
                sim = set_similarities(sets, table) if z - a > 1 else np.zeros((1, 1))
                near = np.abs(sim - similarity) < 1e-4  # single precision decides no tie
                for i, j in zip(*np.nonzero(np.triu(near & todo))):
                    sim[i, j] = sim[j, i] = weighted_jaccard(*[(sets[x][0], sets[x][1] * table[_bucket(sets[x][0])])
                                                               for x in (i, j)])
                out += _spanning(rep[a:z], cls[a:z], *np.nonzero(np.triu(todo & (sim >= similarity))))
            got = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    return _dealt(joined, "band", "sig", "keys", "counts").mapInArrow(run, "a long, b long")


def _spanning(rep: np.ndarray, cls: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that join classes not joined before, in the order given."""
    at = {int(c): int(c) for c in cls}

    def root(x: int) -> int:
        while at[x] != x:
            at[x] = x = at[at[x]]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist()):
        p, q = root(int(cls[x])), root(int(cls[y]))
        if p != q:
            at[p] = q
            out.append((int(rep[x]), int(rep[y])))
    return out


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, estimate: float = ESTIMATE) -> DataFrame:
    """(doc_id, class_id, n_same, kept): one row per document; ``n_same`` is
    the number of documents of its class. ``estimate``: bucket mates that agree
    in a smaller share of samples are not verified (0: all are)."""
    spark = docs.sparkSession
    prepare(spark)
    n, df = document_frequencies(docs)
    idf = spark.sparkContext.broadcast(idf_table(n, df))
    signed = staged(sign(docs, idf), "minhash-signed")
    # equal texts: one representative, the smallest doc_id
    reps = staged(signed.groupBy("tkey").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"),
                                             F.first("sig").alias("sig"), F.first("bands").alias("bands")), "minhash-reps")
    narrow = reps.select("rep", "size", F.posexplode("bands").alias("band", "bkey")).groupBy(
        "rep", "band", "bkey").agg(F.max("size").alias("size"))
    shared = narrow.groupBy("bkey").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    members = staged(narrow.drop("size").join(shared, "bkey"), "minhash-members")
    sigs = reps.groupBy("rep").agg(F.min_by("sig", "tkey").alias("sig"))
    parts = F.greatest(F.when(F.col("n") > HOT, F.ceil(F.col("n") / PART)).otherwise(1),
                       F.ceil(F.col("bytes") / PART_BYTES)).cast("int")

    def salt(deal: int):  # another deal in every band and round
        return F.pmod(F.xxhash64(F.lit(SEED + deal), "bkey", "rep"), parts).cast("int")

    # documents with one id are one node; the text of smallest hash speaks for it
    texts = take_columns(docs, ["doc_id", "text"]).where("text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text")
    spoken = signed.groupBy("doc_id").agg(F.min("tkey").alias("m"), F.max("tkey").alias("x")).where("m <> x")
    if not spoken.isEmpty():
        texts = (texts.withColumn("k", F.sha2("text", 256)).groupBy("doc_id")
                 .agg(F.min_by("text", "k").alias("text")))
    # the only pass that moves texts: those that share a bucket
    wanted = staged(members.select(F.col("rep").alias("doc_id")).distinct(), "minhash-wanted")
    sets = staged(shingle_sets(texts.join(wanted, "doc_id", "left_semi")), "minhash-sets")
    edges = tested = None
    labelled = members.withColumn("cls", F.col("rep"))
    for deal in range(2):
        found = _forest_pairs(labelled.withColumn("part", salt(deal)).join(sigs, "rep"), estimate)
        if tested is not None:
            found = found.join(tested, ["a", "b"], "left_anti")
        found = staged(found, "minhash-pairs")
        tested = found
        good = staged(_verify(found, sets, idf, similarity), "minhash-edges")
        edges = good if edges is None else edges.unionByName(good)
        comp = components(edges)
        labelled = staged(members.join(comp, members["rep"] == comp["id"], "left").select(
            "bkey", "band", "rep", "n", "bytes", F.coalesce("component_id", "rep").alias("cls")), "minhash-labelled")
        # buckets that still hold several classes
        mixed = labelled.groupBy("bkey").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where(
            "lo <> hi").select("bkey")
        labelled = staged(labelled.join(mixed, "bkey"), "minhash-mixed")
    open_ = labelled.withColumn("s", salt(0)).withColumn("j", F.explode(F.sequence(F.lit(0), parts - 1)))
    grid = open_.withColumn("part", F.least("s", "j") * parts + F.greatest("s", "j")).join(sigs, "rep")
    waiting = staged(_open_members(grid, estimate), "minhash-open")
    more = staged(_linked(waiting, sets, idf, similarity, estimate), "minhash-more")
    # several texts under one id, and equal texts under several, hang together
    same = signed.join(reps.select("tkey", "rep"), "tkey").where("doc_id <> rep").select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    final = components(edges.unionByName(more).unionByName(same))
    ids = take_columns(docs, ["doc_id"]).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    out = ids.join(final, ids["doc_id"] == final["id"], "left").select(
        "doc_id", F.coalesce("component_id", "doc_id").alias("class_id"))
    out = staged(out, "minhash-classes")
    sizes = out.groupBy(F.col("class_id").alias("k")).agg(F.count("*").alias("n_same"))
    return (out.join(sizes, F.col("class_id").eqNullSafe(F.col("k")))
            .select("doc_id", "class_id", "n_same",
                    F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept")))
