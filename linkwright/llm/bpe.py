"""Byte-level BPE encoding and decoding (operator 8).

*Encoding.* The rank table is compiled into a finite-state transducer that is
determinised lazily. A state is the set of positions at which the next token
may still begin, each with its node in the vocabulary trie and the token that
ends there. Reading a byte extends every live position; the last token of each
prefix of a BPE encoding is the one token that ends there and forms a stable
pair with the token before it, so exactly one chain reaches the new position.
Tokens on which all live chains agree are emitted; the lookahead is bounded by
the longest token. States and moves are interned when first met and dropped
when there are too many of them.

*Decoding* streams ids through an incremental UTF-8 state machine, which holds
back the bytes of an unfinished character until the rest of it arrives.

Defined results: a null text is the empty text, which has no ids; ids are
little-endian unsigned 32-bit integers in one binary value; a null ``ids``
decodes to empty bytes; repeated rows give repeated rows; other columns pass
through, and columns of the input that bear the name of an output column are
replaced. Memory per worker is bounded by ``MAX_MOVES``, ``MAX_STATES``, ``SLOTS``, ``MAX_PAIRS``, ``MAX_UNITS`` and
the longest text of a batch.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TwoAges, add_column, claim, prepare, take_columns, text_list

MAX_MOVES = 250_000
MAX_PAIRS = 200_000
MAX_STATES = 150_000
#: bytes of one match after which settled tokens are emitted
SETTLE_BYTES = 256
#: words up to this many bytes are run together
RUN_BYTES = 48
#: places for moves, at most half of which are used
SLOTS = 1 << 20
MAX_UNITS = 120_000
CHUNK_IDS = 8192
#: text whose new words are encoded together
LEARN_CHARS = 1 << 19


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def _exact_classes(pattern: str) -> str:
    """``\\s`` as Unicode's White_Space, which is what rank-file libraries mean."""
    return pattern.replace("\\S", "\\P{White_Space}").replace(
        "[^\\s", "[^\\p{White_Space}").replace("\\s", "\\p{White_Space}")


class Transducer:
    """Lazily determinised encoder of one byte string at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocab = [b""] * (max(ranks.values(), default=-1) + 1)
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        self.depth: list[int] = [0]
        for tok, rank in ranks.items():
            self.vocab[rank] = tok
            node = 0
            for byte in tok:
                nxt = self.children[node].get(byte)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][byte] = nxt
                    self.children.append({})
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.token_at[node] = rank
        self.token_len = np.array([len(t) for t in self.vocab] + [0], np.int64)
        self.pair_ok: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1),)
        self.states = [start]
        self.index = {start: 0}
        self.ends = [-1]
        self.moves: dict[int, int] = {}
        # the same moves for many words at once: an open hash table
        self.slots = np.full(SLOTS, -1, np.int64)
        self.targets = np.zeros(SLOTS, np.int32)
        self.in_slots = 0

    def merge(self, data: bytes, stop: int = 1) -> list[int]:
        """BPE by definition: join the pair of lowest rank, leftmost first,
        until none is left or only ``stop`` parts are."""
        get = self.ranks.get
        parts = [data[i:i + 1] for i in range(len(data))]
        none = len(self.vocab)
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while len(pairs) >= stop:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i:i + 2] = [self.vocab[best]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def _halves(self, tok: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``tok``; None for a single byte, and
        (-1, -1) for a token that merging its bytes does not lead to."""
        if tok not in self.halves:
            data = self.vocab[tok]
            parts = self.merge(data, 2) if len(data) > 1 else None
            made = parts and len(parts) == 2 and self.ranks.get(self.vocab[parts[0]] + self.vocab[parts[1]]) == tok
            self.halves[tok] = tuple(parts) if made else None if parts is None else (-1, -1)
        return self.halves[tok]

    def _stable(self, left: int, right: int) -> bool:
        """Does BPE leave ``left`` and ``right`` side by side?"""
        key = left << 32 | right
        ok = self.pair_ok.get(key)
        if ok is None:
            if left < 0:
                ok = self._halves(right) != (-1, -1)
            else:
                ok = self._side_by_side(left, right)
            if len(self.pair_ok) > MAX_PAIRS:
                self.pair_ok.clear()
            self.pair_ok[key] = ok
        return ok

    def _side_by_side(self, left: int, right: int) -> bool:
        """Both tokens grow by merges of rising rank. Walk back through the
        pairs (last part of ``left``, first part of ``right``) that meet at the
        border meanwhile: the tokens stay apart unless such a pair's own merge
        has a lower rank than the merges that take its parts in (at equal rank
        the one further left comes first)."""
        get, vocab = self.ranks.get, self.vocab
        end_a = end_b = len(vocab)  # ranks of the merges that take the parts in
        a, b = left, right
        while True:
            joint = get(vocab[a] + vocab[b])
            if joint is not None and joint < end_a and joint <= end_b:
                return False
            x, y = self._halves(a), self._halves(b)
            if x == (-1, -1) or y == (-1, -1):  # not made by merges
                return self.merge(vocab[left] + vocab[right]) == [left, right]
            if x is None and y is None:
                return True
            # the part that was made last came from its own parts
            if y is None or x is not None and a > b:
                a, end_a = x[1], a
            else:
                b, end_b = y[0], b

    def _move(self, state: int, byte: int) -> int:
        """The state after ``byte``; -1 if no token can end there."""
        live, chosen = [], -1
        for node, last in self.states[state]:
            nxt = self.children[node].get(byte)
            if nxt is None:
                continue
            tok = self.token_at[nxt]
            if tok >= 0 and chosen < 0 and self._stable(last, tok):
                chosen = tok
            if self.children[nxt]:
                live.append((nxt, last))
        to = -1
        if chosen >= 0:
            live.append((0, chosen))
            key = tuple(live)
            to = self.index.get(key, -1)
            if to < 0:
                to = len(self.states)
                self.index[key] = to
                self.states.append(key)
                self.ends.append(chosen)
        self.moves[state << 8 | byte] = to
        return to

    def _back(self, trail: list[int], at: int) -> list[int]:
        """Boundaries of the chain of tokens that ends at byte ``at``, last first."""
        cuts, ends, vocab = [at], self.ends, self.vocab
        while at > 0:
            at -= len(vocab[ends[trail[at - 1]]])
            cuts.append(at)
        return cuts

    def _settle(self, trail: list[int], ids: list[int]) -> list[int]:
        """Emit the tokens on which the chains of all live positions agree."""
        n = len(trail)
        common = None
        for node, _ in self.states[trail[-1]]:
            cuts = set(self._back(trail, n - self.depth[node]))
            common = cuts if common is None else common & cuts
        upto = max(common)
        ids.extend(self.ends[trail[c - 1]] for c in reversed(self._back(trail, upto)) if c)
        return trail[upto:]

    def encode(self, data: bytes) -> list[int]:
        """Ids of one match of the split pattern. ``trail`` holds the state
        after each byte since the last settled boundary; a state names the
        token that ends there, so the chain is read off backwards."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.moves) > MAX_MOVES:
            self._reset()
        get, state, trail, ids = self.moves.get, 0, [], []
        for byte in data:
            to = get(state << 8 | byte)
            if to is None:
                to = self._move(state, byte)
            if to < 0:  # a rank table whose tokens aren't all reachable by merges
                return self.merge(data)
            state = to
            trail.append(to)
            if len(trail) > SETTLE_BYTES:
                trail = self._settle(trail, ids)
        ends, vocab, at, tail = self.ends, self.vocab, len(trail), []
        while at > 0:
            tok = ends[trail[at - 1]]
            tail.append(tok)
            at -= len(vocab[tok])
        tail.reverse()
        return ids + tail if ids else tail


    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each key or of the free slot that would take it, known?)"""
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        todo = np.flatnonzero((self.slots[at] != keys) & (self.slots[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (SLOTS - 1)
            here = self.slots[at[todo]]
            todo = todo[(here != keys[todo]) & (here >= 0)]
        return at, self.slots[at] == keys

    def _step(self, keys: np.ndarray) -> np.ndarray:
        """States after (state << 8 | byte) of many words; new moves are made once."""
        at, known = self._find(keys)
        if not known.all():
            slots, targets = self.slots, self.targets
            for key in np.unique(keys[~known]).tolist():
                to = self._move(key >> 8, key & 255)
                del self.moves[key]  # the table has it
                place = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 64 - SLOTS.bit_length() + 1
                while slots[place] >= 0:
                    place = (place + 1) & (SLOTS - 1)
                slots[place], targets[place] = key, to
                self.in_slots += 1
            at, _ = self._find(keys)
        return self.targets[at]

    def encode_many(self, words: list[bytes]) -> list[bytes]:
        """Ids of many matches as packed uint32 values: all words step through
        the transducer together, and their chains are read off together."""
        if self.in_slots > SLOTS // 3 or len(self.states) > MAX_STATES:
            self._reset()
        out: list[bytes] = [b""] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= RUN_BYTES]
        for i, w in enumerate(words):
            if len(w) > RUN_BYTES:
                ids = self.encode(w)
                out[i] = struct.pack(f"<{len(ids)}I", *ids)
        short.sort(key=lambda i: -len(words[i]))
        n = np.array([len(words[i]) for i in short], np.int64)
        if not len(n):
            return out
        data = np.zeros((len(n), int(n[0])), np.int64)
        data[np.arange(n[0]) < n[:, None]] = np.frombuffer(b"".join(words[i] for i in short), np.uint8)
        trail, state, lost = np.zeros(data.shape, np.int32), np.zeros(len(n), np.int64), np.zeros(len(n), bool)
        for k in range(int(n[0])):
            act = int(np.searchsorted(-n, -k, "left"))  # words longer than k
            if self.in_slots > SLOTS // 2:
                return [self._packed(w) for w in words]
            to = self._step(state[:act] << 8 | data[:act, k])
            lost[:act] |= to < 0
            state[:act] = np.maximum(to, 0)
            trail[:act, k] = state[:act]
        ends = np.array(self.ends, np.int64)
        at, rows, chain = n.copy(), np.arange(len(n)), []
        at[lost] = 0
        while True:
            live = rows[at[rows] > 0]
            if not len(live):
                break
            tok = ends[trail[live, at[live] - 1]]
            at[live] -= self.token_len[tok]
            chain.append((live, tok))
            rows = live
        count = np.zeros(len(n), np.int64)
        for live, _ in chain:
            count[live] += 1
        upto = np.cumsum(count)
        flat = np.zeros(int(upto[-1]), "<u4")
        for k, (live, tok) in enumerate(chain):  # last tokens first
            flat[upto[live] - 1 - k] = tok
        packed, bounds = flat.tobytes(), np.concatenate([[0], upto * 4]).tolist()
        for j, i in enumerate(short):
            out[i] = packed[bounds[j]:bounds[j + 1]]
        for j in np.flatnonzero(lost):
            out[short[j]] = self._packed(words[short[j]])
        return out

    def _packed(self, word: bytes) -> bytes:
        ids = self.encode(word)
        return struct.pack(f"<{len(ids)}I", *ids)


class Utf8Stream:
    """Incremental UTF-8: feed() returns the bytes of complete characters and
    keeps an unfinished one (at most three bytes) for the next call."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> bytes:
        data = self.held + data
        keep = 0
        for back in range(1, min(4, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                keep = back if need > back else 0
                break
            if byte < 0x80:
                break
        cut = len(data) - keep
        self.held = data[cut:]
        return data[:cut]

    def finish(self) -> bytes:
        rest, self.held = self.held, b""
        return rest


class Codec:
    """A rank file and a split pattern, with bounded caches. A unit is a
    stretch of text that begins with a space between two other characters, so
    no match of the pattern crosses its ends."""

    def __init__(self, path: str, pattern: str):
        self.machine = Transducer(load_ranks(path))
        self.split = regex.compile(_exact_classes(pattern))
        self.spaced, self.bare, self.matches = TwoAges(2 * MAX_UNITS), TwoAges(MAX_UNITS // 2), TwoAges(MAX_UNITS // 2)

    def _ids(self, text: str) -> bytes:
        out = []
        for m in self.split.findall(text):
            ids = self.matches.young.get(m) or self.matches.again(m)
            if ids is None:
                t = self.machine.encode(m.encode("utf-8"))
                ids = struct.pack(f"<{len(t)}I", *t)
                if len(m) <= 64:
                    self.matches.put(m, ids)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        parts = text.split(" ")
        first = parts[0]
        if not first or first[-1].isspace():
            return self._ids(text)
        out = list(map(self.spaced.young.get, parts))
        head = self.bare.young.get(first) or self.bare.again(first)
        if head is None:
            head = self._ids(first)
            if len(first) <= 64:
                self.bare.put(first, head)
        out[0] = head
        if None in out:
            for i in range(1, len(parts)):
                if out[i] is None:
                    p = parts[i]
                    if not p or p[0].isspace() or p[-1].isspace():
                        return self._ids(text)
                    known = self.spaced.young.get(p) or self.spaced.again(p)
                    if known is None:
                        known = self._ids(" " + p)
                        if len(p) <= 64:
                            self.spaced.put(p, known)
                    out[i] = known
        return b"".join(out)

    def learn(self, texts: list[str]) -> None:
        """Encode the new words of some texts together, into the caches."""
        known = self.spaced.young
        fresh = [w for w in set().union(*[t.split(" ") for t in texts]) if w not in known and 0 < len(w) <= 64
                 and not w[0].isspace() and not w[-1].isspace() and self.spaced.again(w) is None]
        ranks, put = self.machine.ranks, self.spaced.put
        # an ASCII word of letters only is one match with its space
        plain, rest = [], []
        for w in fresh:
            (plain if w.isascii() and w.isalpha() else rest).append(w)
        spelt = [b" " + w.encode() for w in plain]
        new = [i for i, d in enumerate(spelt) if d not in ranks]
        units = [self.split.findall(" " + w) for w in rest]
        have, todo = {}, []
        for m in {m for u in units for m in u}:
            ids = self.matches.young.get(m) or self.matches.again(m)
            if ids is None:
                data = m.encode("utf-8")
                whole = ranks.get(data)
                if whole is None:
                    todo.append((m, data))
                    continue
                ids = struct.pack("<I", whole)
            have[m] = ids
        made = self.machine.encode_many([spelt[i] for i in new] + [d for _, d in todo])
        for (m, _), ids in zip(todo, made[len(new):]):
            have[m] = ids
            self.matches.put(m, ids)
        for i, ids in zip(new, made):
            put(plain[i], ids)
        for w, d in zip(plain, spelt):
            whole = ranks.get(d)
            if whole is not None:
                put(w, struct.pack("<I", whole))
        for w, u in zip(rest, units):
            put(w, b"".join([have[m] for m in u]))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, learning the words of some texts at a time."""
        out, part, size = [], [], 0
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and there are many small objects
        try:
            for t in texts:
                part.append(t)
                size += len(t)
                if size >= LEARN_CHARS:
                    self.learn(part)
                    out += [self.encode(x) for x in part]
                    part, size = [], 0
            self.learn(part)
            return out + [self.encode(x) for x in part]
        finally:
            if collects:
                gc.enable()

    def decode(self, ids: bytes) -> bytes:
        vocab = self.machine.vocab
        stream = Utf8Stream()
        arr = np.frombuffer(ids, dtype="<u4")
        pieces = [stream.feed(b"".join([vocab[i] for i in arr[k:k + CHUNK_IDS].tolist()]))
                  for k in range(0, len(arr), CHUNK_IDS)]
        pieces.append(stream.finish())
        return b"".join(pieces)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker, until another operator's task claims it."""
    claim("bpe", release)
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(path, pattern)
    return _codecs[key]


def release() -> None:
    """Drop the codecs: another operator's task needs the memory."""
    _codecs.clear()


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text",
           ids_col: str = "ids") -> DataFrame:
    """Add ``ids_col``: the ids of every whole text as packed uint32 values."""
    prepare(df.sparkSession)

    def make(col: pa.Array) -> list[bytes]:
        return codec(path, pattern).encode_all(text_list(col))

    return add_column(df, ids_col, T.BinaryType(), text_col, make)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids",
           out_col: str = "decoded") -> DataFrame:
    """Add ``out_col``: the bytes that the ids stand for."""
    prepare(df.sparkSession)

    def make(col: pa.Array) -> list[bytes]:
        c = codec(path, pattern)
        return [b"" if x is None else c.decode(x) for x in col.to_pylist()]

    return add_column(df, out_col, T.BinaryType(), ids_col, make)


def round_trip(df: DataFrame, path: str, pattern: str, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded and its
    ids decoded again where it is read, so that no ids travel. ``keep``: the
    codec with what it has learnt stays in the worker for the next task, which
    saves time and holds some 200 MB until another operator claims the worker."""
    prepare(df.sparkSession)
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                         T.StructField("decoded_sha256", T.StringType())])

    def make(col: pa.Array) -> list[dict]:
        c, out = codec(path, pattern), []
        for ids in c.encode_all(text_list(col)):
            out.append({"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(),
                        "decoded_sha256": hashlib.sha256(c.decode(ids)).hexdigest()})
        return out

    docs = take_columns(df, ["doc_id", "text"])
    return add_column(docs, "r", kind, "text", make, None if keep else release).select("doc_id", "r.*")


def digests(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """doc_id with the count of ids and the SHA-256 of ids and decoded bytes."""
    df = take_columns(df, ["doc_id", ids_col, out_col])
    return df.select("doc_id", (F.octet_length(ids_col) / 4).cast("long").alias("n_tokens"),
                     F.sha2(F.col(ids_col), 256).alias("ids_sha256"),
                     F.sha2(F.col(out_col), 256).alias("decoded_sha256"))
