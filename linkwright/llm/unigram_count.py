"""Token counts (operator 6): count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each
character; dynamic programming carries the best score and the number of
pieces of the best path, nothing else. Ties follow the tokenizers library's
unigram model over the same (piece, score) list: of equal scores the path
whose last piece begins earliest wins; a character that is no piece costs the
lowest score less 10 and counts as its bytes where the vocabulary has all byte
pieces, otherwise a run of such characters counts as one unknown token.

A text is normalised as "▁" + text with spaces written "▁". Where
no piece has that sign behind another character and all scores are whole
numbers (sums are exact), stretches between spaces are independent: they are
counted once per worker and kept in a bounded cache. Otherwise the whole text
is one stretch.

Defined results: null and empty texts have 0 tokens; a text of spaces only is
counted like any other; repeated rows give repeated rows; extra columns are
kept; a vocabulary with some but not all byte pieces is refused.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import TwoAges, add_column, prepare, text_list

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MAX_UNITS = 400_000
_STRETCH = re.compile(f"{SPACE}+[^{SPACE}]*")


def load_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) in id order from a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), float(sp.get_score(i))) for i in range(sp.get_piece_size())]


class Counter:
    """Counts pieces of normalised text."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.machine = ahocorasick.Automaton()
        for piece, s in pieces:
            if piece:
                self.machine.add_word(piece, (len(piece), s))
        self.machine.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        known = {p for p, _ in pieces}
        self.singles = {p for p in known if len(p) == 1}
        n_bytes = sum(f"<0x{b:02X}>" in known for b in range(256))
        if n_bytes not in (0, 256):
            raise ValueError("a vocabulary needs all 256 byte pieces or none")
        self.by_bytes = n_bytes == 256
        self.split = (all(s == int(s) for _, s in pieces) and SPACE in known
                      and not any(SPACE in p.lstrip(SPACE) for p in known))
        self.cache = TwoAges(MAX_UNITS)

    def viterbi(self, text: str) -> int:
        """Pieces of the best path over one stretch."""
        n = len(text)
        if self.singles.issuperset(text):
            # every character is a piece; hits come by end, longest first
            best, count = [0.0] + [float("-inf")] * n, [0] * (n + 1)
            for end, (size, s) in self.machine.iter(text):
                b = end + 1 - size
                v = s + best[b]
                if v > best[end + 1]:
                    best[end + 1] = v
                    count[end + 1] = count[b] + 1
            return count[n]
        at: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, hit in self.machine.iter(text):
            at[end + 1].append(hit)
        best, count, unk = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for e in range(1, n + 1):
            top, c, u, single = None, 0, False, False
            hits = at[e]
            if len(hits) > 1:
                hits.sort(reverse=True)  # the longest piece begins earliest
            for size, s in hits:
                b = e - size
                single = single or size == 1
                v = s + best[b]
                if top is None or v > top:
                    top, c = v, count[b] + 1
            if not single:
                v = self.unknown + best[e - 1]
                if top is None or v > top:
                    top, u = v, True
                    if self.by_bytes:
                        c = count[e - 1] + len(text[e - 1].encode("utf-8", "surrogatepass"))
                    else:
                        c = count[e - 1] + (not unk[e - 1])
            best[e], count[e], unk[e] = top, c, u
        return count[n]

    def stretch(self, part: str) -> int:
        """Count of one stretch; ``part`` is what follows a single space."""
        got = self.cache.again(part)
        if got is None:
            got = self.viterbi(SPACE + part)
            if len(part) <= 64:
                self.cache.put(part, got)
        return got

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.split:
            return self.viterbi(SPACE + text.replace(" ", SPACE))
        parts = text.split(" ")
        if SPACE in text or "" in parts:
            whole = SPACE + text.replace(" ", SPACE)
            return sum(self._known(s) for s in _STRETCH.findall(whole))
        got = list(map(self.cache.young.get, parts))
        if None in got:
            for i, g in enumerate(got):
                if g is None:
                    g = self.cache.young.get(parts[i])
                    got[i] = self.stretch(parts[i]) if g is None else g
        return sum(got)

    def _known(self, s: str) -> int:
        if s.count(SPACE) == 1:
            g = self.cache.young.get(s[1:])
            return self.stretch(s[1:]) if g is None else g
        return self.viterbi(s)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter per Python worker."""
    if path not in _counters:
        _counters[path] = Counter(load_pieces(path))
    return _counters[path]


def count_tokens(df: DataFrame, path: str, text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """Every row of ``df`` with the number of tokens of its whole text."""
    prepare(df.sparkSession)

    def make(col: pa.Array) -> list[int]:
        c = counter(path)
        return [c.count(t) for t in text_list(col)]

    return add_column(df, name, T.LongType(), text_col, make)
