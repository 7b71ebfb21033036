"""Cross-tokenizer alignment (operator 12) by pointer jumping.

Two tokenizers cut the same bytes. Every token points to the token that
reaches farthest right among those it overlaps (of two that end together, to
that of tokenizer B). Doubling all pointers of a chunk of texts at once, each
token ends at the token where both tokenizers' cuts meet: the terminal of its
component, which labels the group.

Links are the overlapping A-B token pairs. A chunk of texts keeps the distinct
id pairs of its links with their numbers, and per link the place of its pair.
Corpus-wide counts are sums over chunks, joined back once per chunk and
distinct pair, not once per link; a chunk's bytes are bounded by
``CHUNK_BYTES`` plus one text.

Defined results: null and empty texts, and texts whose tokens do not spell
space + text in both tokenizers (such as those with U+2581), have no tokens:
zeros and an empty digest. Repeated rows are documents of their own and count
each. An empty table gives no rows. Extra columns are dropped first.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, staged, take_columns, text_list

#: text of one chunk
CHUNK_BYTES = 2 << 20
#: text handed to a tokenizer at once
SLICE_CHARS = 1 << 18
#: id pairs are a * PAIR + b
PAIR = 1 << 32


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and
    the others, in order, as the characters from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_ranks(tokenizer) -> dict[bytes, int] | None:
    """Bytes -> id of a byte-level BPE file whose ids follow its merges, None
    for any other. Such a vocabulary is a table of merge ranks."""
    import json

    j = json.loads(tokenizer.to_str())
    model, pre, byte = j["model"], j["pre_tokenizer"] or {}, _byte_of_char()
    plain = (model["type"] == "BPE" and j["normalizer"] is None and pre.get("type") == "ByteLevel"
             and pre["use_regex"] and not pre["add_prefix_space"] and not model["dropout"]
             and not model["continuing_subword_prefix"] and not model["end_of_word_suffix"]
             and not model.get("ignore_merges"))
    special = {x["content"] for x in j["added_tokens"]}
    ids = {e: i for e, i in model["vocab"].items() if e not in special}
    if not plain or any(ids["".join(m.split(" ") if isinstance(m, str) else m)] != i
                        for i, m in enumerate(model["merges"], len(byte))):
        return None
    return {bytes(byte[c] for c in e): i for e, i in ids.items()}


class Tokenizers:
    """Both tokenizers, with the bytes and lengths of every token."""

    _loaded: dict[tuple[str, str], Tokenizers] = {}

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        from .common import split_pattern

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte, vocab = _byte_of_char(), self.a.get_vocab()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for entry, i in vocab.items():
            self.bytes_a[i] = bytes(byte[c] for c in entry)
        self.bytes_b = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
            else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(len(self.b))]
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # the same merges on the same pattern, four times as fast
        ranks = byte_ranks(self.a)
        self.ranked = ranks and tiktoken.Encoding(
            "a", pat_str=split_pattern(), mergeable_ranks=ranks, special_tokens={})
        # what a token writes into the digest, by whether it ends its side of a group
        self.shown = [f"{i}{end}" for i in range(len(self.bytes_a)) for end in ",|"] + [
            f"{i}{end}" for i in range(len(self.bytes_b)) for end in ",;"]

    @classmethod
    def load(cls, path_a: str, path_b: str) -> Tokenizers:
        if (path_a, path_b) not in cls._loaded:
            cls._loaded = {(path_a, path_b): cls(path_a, path_b)}
        return cls._loaded[path_a, path_b]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both tokenizers per text; none where they don't spell it."""
        out_a, out_b = [], []
        none = np.zeros(0, np.int64)
        for part in _slices(texts):
            spaced = [" " + t for t in part]
            if self.ranked:
                ids_a = [self.ranked.encode_to_numpy(t, disallowed_special=()).astype(np.int64) for t in spaced]
            else:
                ids_a = [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
            ids_b = self.b.encode(part, num_threads=1)
            flat = np.fromiter(chain.from_iterable(ids_b), np.int64)
            ends = np.cumsum([len(x) for x in ids_b])
            for t, a, b, end in zip(spaced, ids_a, ids_b, ends):
                want = t.encode()
                # ranked bytes always spell the text
                whole = len(t) > 1 and b"".join(map(self.bytes_b.__getitem__, b)) == want and (
                    self.ranked or b"".join(map(self.bytes_a.__getitem__, a.tolist())) == want)
                out_a.append(a if whole else none)
                out_b.append(flat[end - len(b):end] if whole else none)
        return out_a, out_b


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= SLICE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


# ------------------------------------------------------------ one chunk
def terminals(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """Per A token, then per B token, the B token that ends its component."""
    far_b = np.searchsorted(start_b, end_a, "left") - 1  # last B token begun before A's end
    far_a = np.searchsorted(start_a, end_b, "left") - 1
    n = len(end_a)
    here = np.arange(len(end_b)) + n
    to = np.concatenate([far_b + n, np.where(end_a[far_a] > end_b, far_a, here)])
    while True:
        on = to[to]
        if np.array_equal(on, to):
            return to - n
        to = on


def align_chunk(tok: Tokenizers, texts: list[str]) -> dict[str, object]:
    """Measures and digest per text, distinct id pairs, and per link the place
    of its pair (most frequent pairs first, so places are small numbers)."""
    lists_a, lists_b = tok.encode(texts)
    n_a = np.array([len(x) for x in lists_a], np.int64)
    n_b = np.array([len(x) for x in lists_b], np.int64)
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (lists_a, lists_b))
    first_a, first_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
    if not len(a):
        zero = np.zeros(len(texts), np.int64)
        return dict(n_a=zero, n_b=zero, n_groups=zero, n_links=zero, digest=[""] * len(texts),
                    pairs=zero[:0], pair_n=zero[:0], places=zero[:0])
    # texts lie one after the other; both tokenizers cut at their ends
    end_a, end_b = np.cumsum(tok.len_a[a]), np.cumsum(tok.len_b[b])
    start_a, start_b = end_a - tok.len_a[a], end_b - tok.len_b[b]
    at = terminals(start_a, end_a, start_b, end_b)
    label_a, label_b = at[:len(a)], at[len(a):]
    last = label_b == np.arange(len(b))  # terminals
    group_of = np.cumsum(last) - 1  # number of the group that a terminal ends
    g_a, g_b = group_of[label_a], group_of[label_b]
    size_a, size_b = np.bincount(g_a), np.bincount(g_b)
    # all tokens by group, A before B
    order = np.empty(len(a) + len(b), np.int64)
    ends_a = np.append(g_a[1:] != g_a[:-1], True)
    order[np.arange(len(a)) + (np.cumsum(size_b) - size_b)[g_a]] = a * 2 + ends_a
    order[np.arange(len(b)) + np.cumsum(size_a)[g_b]] = len(tok.bytes_a) * 2 + b * 2 + last
    words = list(map(tok.shown.__getitem__, order.tolist()))
    cut = first_a + first_b
    digest = [hashlib.sha256("".join(words[i:j])[:-1].encode()).hexdigest() if j > i else ""
              for i, j in zip(cut[:-1], cut[1:])]
    # links: the B tokens that end after A's start and start before A's end
    lo, hi = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    per = hi - lo
    upto = np.concatenate([[0], np.cumsum(per)])
    to = np.arange(upto[-1]) - np.repeat(upto[:-1] - lo, per)
    pairs, place, pair_n = np.unique(np.repeat(a, per) * PAIR + b[to], return_inverse=True, return_counts=True)
    rank = np.argsort(-pair_n, kind="stable")
    back = np.empty(len(rank), np.int64)
    back[rank] = np.arange(len(rank))
    n_groups = np.concatenate([[0], np.cumsum(last)])
    return dict(n_a=n_a, n_b=n_b, n_groups=n_groups[first_b[1:]] - n_groups[first_b[:-1]],
                n_links=upto[first_a[1:]] - upto[first_a[:-1]], digest=digest,
                pairs=pairs[rank], pair_n=pair_n[rank], places=back[place])


def _pack(places: np.ndarray) -> bytes:
    """Byte planes, compressed: high bytes of small numbers cost nothing."""
    planes = places.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pa.Codec("zstd").compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(data, n * 4, asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(4, n).T.copy().view("<u4").reshape(-1)


# ------------------------------------------------------------- all chunks
_CHUNK = ("chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
          "n_links array<long>, digest array<string>, pairs array<long>, pair_n array<long>, places binary")
_LONGS = pa.list_(pa.int64())
_CHUNK_ARROW = pa.schema([("chunk", pa.int64())] + [(c, _LONGS) for c in (
    "doc_id", "n_a", "n_b", "n_groups", "n_links")] + [
    ("digest", pa.list_(pa.string())), ("pairs", _LONGS), ("pair_n", _LONGS), ("places", pa.binary())])
_OUT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
        "groups_sha256 string")


def chunks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per chunk of whole texts, with what `align_chunk` finds."""
    rows = take_columns(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, seq = Tokenizers.load(path_a, path_b), TaskContext.get().partitionId(), 0

        def made(ids: list, texts: list[str]) -> pa.RecordBatch:
            got = align_chunk(tok, texts)
            row = {"chunk": part << 32 | seq, "doc_id": ids, **got, "places": _pack(got["places"])}
            return pa.RecordBatch.from_arrays(
                [pa.array([row[f.name]], f.type) for f in _CHUNK_ARROW], schema=_CHUNK_ARROW)

        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), text_list(b.column(1))):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= CHUNK_BYTES:
                    yield made(ids, texts)
                    ids, texts, size, seq = [], [], 0, seq + 1
        if ids:
            yield made(ids, texts)

    return rows.mapInArrow(run, _CHUNK)


def pair_counts(found: DataFrame) -> DataFrame:
    """code (a * 2^32 + b), total (links of this id pair in all texts), best
    (no pair of its B id has more)."""
    total = staged(found.select(F.inline(F.arrays_zip("pairs", "pair_n"))).groupBy(
        F.col("pairs").alias("code")).agg(F.sum("pair_n").alias("total")), "align-pairs")
    b = F.col("code").bitwiseAND(F.lit(PAIR - 1))
    most = total.groupBy(b.alias("b")).agg(F.max("total").alias("most"))
    return total.withColumn("b", b).join(most, "b").select("code", "total", (F.col("total") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    prepare(docs.sparkSession)
    found = staged(chunks(docs, path_a, path_b), "align-chunks")
    known = found.select("chunk", F.posexplode("pairs").alias("pos", "code")).join(pair_counts(found), "code")
    # total of every pair of a chunk in order of place; best ones as negative numbers
    signed = F.when(F.col("best"), -F.col("total")).otherwise(F.col("total"))
    per_chunk = known.groupBy("chunk").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", signed.alias("v")))), lambda x: x["v"]).alias("totals"))
    joined = found.drop("pairs", "pair_n").join(per_chunk, "chunk", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "digest", "places", "totals")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 7 + [pa.string()]
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        for b in batches:
            for i in range(b.num_rows):
                ids, n_a, n_b, n_groups, n_links, digest = (b.column(c)[i].values for c in range(6))
                per = n_links.to_numpy()
                ends = np.concatenate([[0], np.cumsum(per)])
                n = int(ends[-1])
                totals = b.column(7)[i].values.to_numpy() if n else np.zeros(0, np.int64)
                of = totals[_unpack(b.column(6)[i].as_py(), n)] if n else totals
                best, sums = (np.concatenate([[0], np.cumsum(x)]) for x in (of < 0, np.abs(of)))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((
                    ids, n_a, n_b, n_groups, n_links, best[ends[1:]] - best[ends[:-1]],
                    sums[ends[1:]] - sums[ends[:-1]], digest), kinds)], names=names)

    return joined.mapInArrow(run, _OUT)
