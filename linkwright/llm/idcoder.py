"""Token-id files (operator 5): tokenized documents in binary blocks, coded by
an adaptive context-mixing range coder.

*Blocks.* Ids are written in ascending doc_id order (nulls first, then by text
hash). A block holds whole documents of about ``BLOCK_IDS`` ids, starts from a
reset model and carries its own header, document table and CRC-32, so any
block can be decoded, checked or lost alone. Inside a block the ids are cut
into up to 256 lanes of equal length that are coded in step with one shared
model, which lets numpy code many lanes and blocks at once.

*Model.* The order-2 and order-1 contexts each predict an id with a
confidence; order 0 is an adaptive distribution over all ids. A mixing table,
indexed by both confidences and adapted after every step, splits the
probability of the next id among the order-2 prediction, the order-1
prediction and the order-0 distribution, and a carryless range coder of
64 bits codes the choice and, for order 0, the id.

*Files.* Spark commits the blocks as rows of a Parquet table (part, block,
first, n_ids, data): ``data`` is the block format below, byte for byte. Parts
follow the range partitioning, so (part, block) is file order.

Block format, little endian: magic ``IDB1``; u32 alphabet; u64 ids; u32
documents; u32 lanes; per document u8 null flag, i64 doc_id, u64 ids; per lane
u32 words; the lanes' u16 words; u32 CRC-32 of all before it.

Defined results: ids are those of the library with add_special_tokens=False, so an
added token such as <|endoftext|> that stands in a text is its own id; a null text is empty; every document ends with ``end_id``
(so an empty text has one id); a null doc_id is kept as null and comes first;
repeated rows are written one after the other; an empty table writes no block;
extra columns are dropped; a damaged block raises an error.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TwoAges, claim, prepare, take_columns

MAGIC = b"IDB1"
BLOCK_IDS = 1 << 16
MAX_LANES = 256
LANE_IDS = 128
BATCH_BLOCKS = 16
SLOTS = 1 << 16
GAIN = 24
MIX_LIMIT = 4096
MAX_UNITS = 400_000
#: printable ASCII and Latin-1 letters: composed already, lower case is by character
_PLAIN = regex.compile("[!-~À-ÖØ-öø-ÿ]+")
#: the byte-level alphabet's two characters for the UTF-8 bytes of these letters
_BYTE_LEVEL = {c: "Ã" + chr(b + 162 if b < 161 else 323 if b == 173 else b)
               for c in range(192, 256) for b in [chr(c).encode("utf-8")[1]]}
_TOP, _BOT = np.uint64(1 << 48), np.uint64(1 << 32)
_U16, _U48 = np.uint64(16), np.uint64(48)


# --------------------------------------------------------------- tokenizing
class Encoder:
    """The tokenizers library behind a cache of stretches without white space
    (\\x20, \\x09-\\x0D): tokens never reach across white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # a task is one thread; Spark runs several tasks beside each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        #: stretches with one of these go to the library uncut
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"\Z.").search
        self.cache = TwoAges(MAX_UNITS)
        self.split, self.model = self._lower_case_split(path), self.tok.model

    @staticmethod
    def _lower_case_split(path: str) -> regex.Pattern | None:
        """The file's split pattern, if it lower-cases and drops what lies between matches."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if norm == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in pre] == ["Split", "ByteLevel"] \
                and pre[0].get("behavior") == "Removed" and pre[0].get("invert") and not pre[1].get("use_regex", True) \
                and not pre[1].get("add_prefix_space", True) and pre[0]["pattern"].get("Regex"):
            return regex.compile(pre[0]["pattern"]["Regex"])
        return None

    def _encode_plain(self, text: str) -> bytes:
        """Packed ids of a stretch of plain Latin letters and signs: the library's
        model over its matches of the file's own split pattern."""
        lower, out = text.lower(), []
        for p in (lower,) if text.isalpha() else self.split.findall(lower):
            # a match is a stretch, too, with the same ids
            ids = None if p == text else self.cache.young.get(p) or self.cache.again(p)
            if ids is None:
                ids = array("I", [t.id for t in self.model.tokenize(
                    p if p.isascii() else p.translate(_BYTE_LEVEL))]).tobytes()
                if p != text and len(p) <= 64:
                    self.cache.put(p, ids)
            out.append(ids)
        return b"".join(out)

    def _encode_new(self, new: list[str]) -> dict[str, bytes]:
        """Packed ids of stretches that the cache lacks."""
        out, rest = {}, []
        for p in new:
            if self.split and (p.isascii() and p.isalpha() or _PLAIN.fullmatch(p) and not self.added(p)):
                out[p] = self._encode_plain(p)
            else:
                rest.append(p)
        for at in range(0, len(rest), 10_000):
            some = rest[at:at + 10_000]
            for p, e in zip(some, self.tok.encode_batch_fast(some, add_special_tokens=False)):
                out[p] = array("I", e.ids).tobytes()
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of every text."""
        return [ids.tobytes() for ids in self.encode_column(pa.array(texts, pa.binary()))]

    def encode_column(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text of a binary column without nulls. A batch's different
        stretches are looked up once, and what the cache lacks is encoded once."""
        split = pc.ascii_split_whitespace(texts.view(pa.string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.cache.young.get, words))
        known = {p: self.cache.again(p) for p, x in zip(words, ids) if x is None}
        new = self._encode_new([p for p, x in known.items() if x is None])
        for p, x in new.items():
            if len(p) <= 64:
                self.cache.put(p, x)
        known.update(new)
        ids = [known[p] if x is None else x for p, x in zip(words, ids)]
        size = np.array([len(x) for x in ids], np.int64) // 4
        each = np.frombuffer(b"".join(ids), np.uint32)
        at = coded.indices.to_numpy()
        n = size[at]
        end = np.concatenate([[0], np.cumsum(n)])
        joined = each[np.repeat((np.cumsum(size) - size)[at] - end[:-1], n) + np.arange(end[-1])]
        offsets = split.offsets.to_numpy()
        return np.split(joined, end[offsets[1:-1] - offsets[0]]) if len(texts) else []


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# -------------------------------------------------------------------- model
class _Model:
    """Predictions of order 0 to 2 for many blocks, each with its own tables.
    A slot of the order-1 and order-2 tables holds 4 * id + confidence."""

    def __init__(self, blocks: int, alphabet: int):
        self.n, self.alphabet = blocks, alphabet
        self.t2 = np.zeros(blocks * SLOTS, np.int32)
        self.t1 = np.zeros(blocks * SLOTS, np.int32)
        self.mix = np.tile(np.array([1, 1, 2], np.int64), (blocks * 16, 1))
        self.hist, self.seen = np.ones(blocks * alphabet, np.int64), []
        self.base = np.arange(blocks, dtype=np.int64) << 40
        self._cuts()
        self.refresh(0)

    def _cuts(self) -> None:
        total = self.mix.sum(axis=1)
        self.cut2 = (self.mix[:, 0] << 16) // total
        self.cut1 = self.cut2 + (self.mix[:, 1] << 16) // total

    def refresh(self, step: int) -> None:
        """Order-0 distribution after steps 0, 1, 2, 4 ... 64 and every 64th."""
        if step & (step - 1) and step % 64:
            return
        if self.seen:  # the ids since the last refresh
            self.hist += GAIN * np.bincount(np.concatenate(self.seen), minlength=len(self.hist))
            self.seen = []
        h = self.hist.reshape(self.n, self.alphabet)
        cum = np.empty((self.n, self.alphabet + 1), np.int64)
        cum[:, 0] = self.base
        np.cumsum(h, axis=1, out=cum[:, 1:])
        cum[:, 1:] += self.base[:, None]
        self.total = cum[:, -1] - self.base
        self.cum, self.width = cum.reshape(-1), self.alphabet + 1

    def predict(self, b, c1, c2):
        """Slots and predictions, and the cuts of the unit interval in 2**16."""
        row = b * SLOTS
        self.b = b
        self.s1 = row + (c1 & (SLOTS - 1))
        self.s2 = row + ((c1 * 40503 + c2 * 60493 + (c2 >> 5)) & (SLOTS - 1))
        self.v1, self.v2 = self.t1.take(self.s1), self.t2.take(self.s2)
        self.p1, self.p2 = self.v1 >> 2, self.v2 >> 2
        self.ctx = b * 16 + ((self.v2 & 3) << 2 | (self.v1 & 3))
        self.f2, self.f1 = self.cut2.take(self.ctx), self.cut1.take(self.ctx)

    def choose(self, x):
        """0, 1 or 2: x is the order-2 prediction, the order-1 one, neither."""
        # an empty slot (0) predicts nothing
        first = (x == self.p2) & (self.v2 > 0)
        second = (x == self.p1) & (self.v1 > 0)
        return np.where(first, 0, 2 - second)

    def cut(self, choice):
        low = np.where(choice == 2, self.f1, np.where(choice == 1, self.f2, 0))
        high = np.where(choice == 2, 65536, np.where(choice == 1, self.f1, self.f2))
        return low.astype(np.uint64), (high - low).astype(np.uint64)

    def update(self, x, choice):
        self.mix += np.bincount(self.ctx * 3 + choice, minlength=self.n * 48).reshape(-1, 3)
        over = self.mix.sum(axis=1) > MIX_LIMIT
        if over.any():
            self.mix[over] = (self.mix[over] + 1) >> 1
        self._cuts()
        x32 = x.astype(np.int32)
        for table, slot, v, pred in ((self.t2, self.s2, self.v2, self.p2), (self.t1, self.s1, self.v1, self.p1)):
            conf = v & 3
            same = np.where(conf < 3, v + 1, v)
            other = np.where(conf > 1, v - 1, (x32 << 2) | 1)
            table[slot] = np.where((pred == x32) & (conf > 0), same, other)
        self.seen.append(self.b * self.alphabet + x)


def _lanes(sizes: list[int]) -> list[tuple[int, int, int]]:
    """(block, first id, ids) of every lane, longest first, blocks in order."""
    out = []
    for b, n in enumerate(sizes):
        want = min(MAX_LANES, max(1, n // LANE_IDS))
        seg = -(-n // want) if n else 0
        out.extend((b, at, min(seg, n - at)) for at in range(0, n, max(1, seg)))
    return sorted(out, key=lambda t: -t[2])


def _active(lens: np.ndarray, step: int) -> int:
    return int(np.searchsorted(-lens, -step, side="left"))


def _ripe(at: np.ndarray, low: np.ndarray, rng: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the lanes ``at`` whose leading 16 bits are final, or made so by
    a smaller range, with their low ends and ranges."""
    lo, r = low[at], rng[at]
    go = np.flatnonzero(((lo ^ (lo + r)) < _TOP) | (r < _BOT))
    lo, r = lo[go], r[go]
    tight = (lo ^ (lo + r)) >= _TOP
    r = np.where(tight, (~lo + np.uint64(1)) & (_BOT - np.uint64(1)), r)
    return at[go], lo, r


def compress(blocks: list[np.ndarray], alphabet: int) -> list[list[np.ndarray]]:
    """The u16 words of every lane of every block of ids."""
    lanes = _lanes([len(x) for x in blocks])
    words: list[list[np.ndarray]] = [[] for _ in blocks]
    if not lanes:
        return words
    blk = np.array([t[0] for t in lanes], np.int64)
    lens = np.array([t[2] for t in lanes], np.int64)
    steps = int(lens[0])
    ids = np.zeros((steps, len(lanes)), np.int64)
    for j, (b, at, n) in enumerate(lanes):
        ids[:n, j] = blocks[b][at:at + n]
    low = np.zeros(len(lanes), np.uint64)
    rng = np.full(len(lanes), np.uint64(0xFFFFFFFFFFFFFFFF))
    out = np.zeros((len(lanes), 3 * steps + 8), np.uint16)
    pos = np.zeros(len(lanes), np.int64)
    m = _Model(len(blocks), alphabet)

    def settle(at):
        """Emit the leading 16 bits of the lanes ``at`` while they are final."""
        while len(at):
            at, lo, r = _ripe(at, low, rng)
            out[at, pos[at]] = (lo >> _U48).astype(np.uint16)
            pos[at] += 1
            low[at], rng[at] = lo << _U16, r << _U16

    every = np.arange(len(lanes))
    with np.errstate(over="ignore"):
        for i in range(steps):
            k = _active(lens, i)
            x = ids[i, :k]
            c1 = ids[i - 1, :k] if i else np.zeros(k, np.int64)
            c2 = ids[i - 2, :k] if i > 1 else np.zeros(k, np.int64)
            m.predict(blk[:k], c1, c2)
            choice = m.choose(x)
            cum, size = m.cut(choice)
            r = rng[:k] >> _U16
            low[:k] += cum * r
            rng[:k] = size * r
            settle(every[:k])
            esc = np.flatnonzero(choice == 2)
            if len(esc):
                be = blk[esc]
                at = be * m.width + x[esc]
                r = rng[esc] // m.total[be].astype(np.uint64)
                c = m.cum.take(at)
                low[esc] += (c - m.base[be]).astype(np.uint64) * r
                rng[esc] = (m.cum.take(at + 1) - c).astype(np.uint64) * r
                settle(esc)
            m.update(x, choice)
            m.refresh(i + 1)
    for _ in range(4):  # the last 64 bits of every lane
        out[every, pos] = (low >> _U48).astype(np.uint16)
        pos += 1
        low <<= _U16
    order = sorted(range(len(lanes)), key=lambda j: (lanes[j][0], lanes[j][1]))
    for j in order:
        words[lanes[j][0]].append(out[j, :pos[j]])
    return words


def decompress(words: list[list[np.ndarray]], sizes: list[int], alphabet: int) -> list[np.ndarray]:
    """Inverse of :func:`compress`."""
    lanes = _lanes(sizes)
    out = [np.zeros(n, np.int64) for n in sizes]
    if not lanes:
        return out
    order = sorted(range(len(lanes)), key=lambda j: (lanes[j][0], lanes[j][1]))
    flat = [w for ws in words for w in ws]
    blk = np.array([t[0] for t in lanes], np.int64)
    lens = np.array([t[2] for t in lanes], np.int64)
    steps = int(lens[0])
    first = np.zeros(len(lanes), np.int64)
    stream = np.concatenate(flat + [np.zeros(8, np.uint16)]).astype(np.uint64)
    at = 0
    for j, w in zip(order, flat):
        first[j] = at
        at += len(w)
    pos = first + 4
    code = np.zeros(len(lanes), np.uint64)
    for q in range(4):
        code = (code << _U16) | stream[first + q]
    low = np.zeros(len(lanes), np.uint64)
    rng = np.full(len(lanes), np.uint64(0xFFFFFFFFFFFFFFFF))
    ids = np.zeros((steps, len(lanes)), np.int64)
    m = _Model(len(sizes), alphabet)
    last = len(stream) - 1

    def settle(at):
        while len(at):
            at, lo, r = _ripe(at, low, rng)
            code[at] = (code[at] << _U16) | stream[np.minimum(pos[at], last)]
            pos[at] += 1
            low[at], rng[at] = lo << _U16, r << _U16

    every = np.arange(len(lanes))
    with np.errstate(over="ignore"):
        for i in range(steps):
            k = _active(lens, i)
            b = blk[:k]
            c1 = ids[i - 1, :k] if i else np.zeros(k, np.int64)
            c2 = ids[i - 2, :k] if i > 1 else np.zeros(k, np.int64)
            m.predict(b, c1, c2)
            r = rng[:k] >> _U16
            value = np.minimum((code[:k] - low[:k]) // r, np.uint64(65535)).astype(np.int64)
            choice = np.where(value < m.f2, 0, np.where(value < m.f1, 1, 2))
            cum, size = m.cut(choice)
            low[:k] += cum * r
            rng[:k] = size * r
            settle(every[:k])
            x = np.where(choice == 0, m.p2, m.p1).astype(np.int64)
            esc = np.flatnonzero(choice == 2)
            if len(esc):
                be = b[esc]
                total = m.total[be]
                r = rng[esc] // total.astype(np.uint64)
                value = np.minimum(((code[esc] - low[esc]) // r).astype(np.int64), total - 1)
                key = value + m.base[be]
                order = np.argsort(key)  # neighbours are found sooner
                hit = np.empty(len(key), np.int64)
                hit[order] = np.searchsorted(m.cum, key[order], side="right") - 1
                x[esc] = hit - be * m.width
                c = m.cum.take(hit)
                low[esc] += (c - m.base[be]).astype(np.uint64) * r
                rng[esc] = (m.cum.take(hit + 1) - c).astype(np.uint64) * r
                settle(esc)
            ids[i, :k] = x
            m.update(x, choice)
            m.refresh(i + 1)
    for j, (b, start, n) in enumerate(lanes):
        out[b][start:start + n] = ids[:n, j]
    return out


# ------------------------------------------------------------------- format
def pack_blocks(blocks: list[tuple[list, list[np.ndarray]]], alphabet: int) -> list[bytes]:
    """Bytes of blocks of (doc_ids, ids per document)."""
    joined = [np.concatenate(d) if d else np.zeros(0, np.uint32) for _, d in blocks]
    out = []
    for (names, docs), ids, lanes in zip(blocks, joined, compress(joined, alphabet)):
        parts = [MAGIC, struct.pack("<IQII", alphabet, len(ids), len(docs), len(lanes))]
        parts += [struct.pack("<BqQ", i is None, 0 if i is None else i, len(d)) for i, d in zip(names, docs)]
        parts += [np.array([len(w) for w in lanes], "<u4").tobytes()]
        parts += [w.astype("<u2").tobytes() for w in lanes]
        body = b"".join(parts)
        out.append(body + struct.pack("<I", zlib.crc32(body)))
    return out


def unpack_blocks(datas: list[bytes]) -> list[tuple[list, list[np.ndarray]]]:
    """Inverse of :func:`pack_blocks`; raises ValueError for damaged blocks."""
    heads, words, sizes, alphabets = [], [], [], set()
    for data in datas:
        if data[:4] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("damaged block of token ids")
        alphabet, n, docs, lanes = struct.unpack_from("<IQII", data, 4)
        at = 24
        names, lens = [], []
        for null, doc_id, k in struct.iter_unpack("<BqQ", data[at:at + 17 * docs]):
            names.append(None if null else doc_id)
            lens.append(k)
        at += 17 * docs
        counts = np.frombuffer(data, "<u4", lanes, at)
        at += 4 * lanes
        flat = np.frombuffer(data, "<u2", int(counts.sum()), at)
        words.append(np.split(flat, np.cumsum(counts)[:-1]) if lanes else [])
        heads.append((names, lens))
        sizes.append(n)
        alphabets.add(alphabet)
    if len(alphabets) > 1:
        raise ValueError("blocks of different alphabets")
    out = []
    for (names, lens), ids in zip(heads, decompress(words, sizes, alphabets.pop() if alphabets else 1)):
        out.append((names, np.split(ids.astype(np.uint32), np.cumsum(lens)[:-1]) if lens else []))
    return out


# -------------------------------------------------------------------- Spark
def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1,
              block_ids: int = BLOCK_IDS) -> None:
    """Tokenize every whole text and write the id blocks below ``path``."""
    spark = docs.sparkSession
    prepare(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = take_columns(docs, ["doc_id", "text"]).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "doc_id").sortWithinPartitions(
        "doc_id", "tie").select("doc_id", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim("token-ids", _encoders.clear)
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        ready: list[tuple[list, list[np.ndarray]]] = []
        names, ids, fill, block, first = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ready, block, first
            lens = [sum(map(len, d)) for _, d in ready]
            firsts = first + np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ready), pa.int64()),
                 pa.array(range(block, block + len(ready)), pa.int64()),
                 pa.array(firsts, pa.int64()), pa.array(lens, pa.int64()),
                 pa.array(pack_blocks(ready, max(enc.size, end_id + 1)), pa.binary())],
                names=["part", "block", "first", "n_ids", "data"])
            block, first, ready = block + len(ready), first + sum(lens), []
            return out

        for b in batches:
            for doc_id, own in zip(b.column(0).to_pylist(), enc.encode_column(b.column(1))):
                names.append(doc_id)
                ids.append(np.concatenate([own, end]))
                fill += len(ids[-1])
                if fill >= block_ids:
                    ready.append((names, ids))
                    names, ids, fill = [], [], 0
                    if len(ready) == BATCH_BLOCKS:
                        yield flush()
        if names:
            ready.append((names, ids))
        if ready:
            yield flush()

    rows.mapInArrow(run, "part long, block long, first long, n_ids long, data binary").write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the documents of the blocks below
    ``path``; ids are packed little-endian uint32 values."""
    prepare(spark)
    blocks = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token-id-blocks")  # the encoder isn't needed here
        for b in batches:
            for at in range(0, b.num_rows, BATCH_BLOCKS):
                piece = b.slice(at, BATCH_BLOCKS)
                part, first = piece.column(0).to_pylist(), piece.column(1).to_pylist()
                rows = []
                for p, f, (names, docs) in zip(part, first, unpack_blocks(piece.column(2).to_pylist())):
                    for doc_id, ids in zip(names, docs):
                        rows.append((p, doc_id, f, len(ids), ids.astype("<u4").tobytes()))
                        f += len(ids)
                cols = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(),
                                                           pa.binary()))],
                    names=["part", "doc_id", "first", "n_tokens", "ids"])

    docs = blocks.select("part", "first", "data").mapInArrow(
        run, "part long, doc_id long, first long, n_tokens long, ids binary")
    # one row per file: the ids of all files before it
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        F.col("part").alias("p"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return docs.join(F.broadcast(before), F.col("part") == F.col("p")).select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids")
