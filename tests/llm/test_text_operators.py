"""Rules, mixing, tokenizers: brute force and hostile rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkwright.llm import bpe, idcoder, mixing, queries, rules, unigram_count
from linkwright.llm.common import take_columns

from .data import LONG, documents, frame

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_rules_against_plain_python(spark):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in rules.quality_rules(frame(spark)).collect())
    want = Counter()
    for doc_id, text, *_ in documents():
        t = text or ""
        w = WORD.findall(t)
        at = {}
        for i in range(len(w) - 4):
            at.setdefault(tuple(w[i:i + 5]), []).append(i)
        covered = {i + j for ps in at.values() if len(ps) > 1 for i in ps for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        n = len(w)
        want[(doc_id, n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
              len(covered), n < 10 or 100 * len(covered) > 20 * n)] += 1
    assert got == want


def test_rules_keep_plain_text_and_refuse_junk(spark):
    plain = "the old man and the sea are in a small boat that was not far from the land"
    rows = [(1, plain, "en", "a", 1), (2, " ".join(x + "###" for x in plain.split()), "en", "a", 1),
            (3, " ".join(x.upper() + "!!" for x in plain.split()), "en", "a", 1)]
    got = {r.doc_id: r.kept for r in rules.quality_rules(frame(spark, rows)).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_rules_empty_table(spark):
    assert rules.quality_rules(frame(spark, [])).count() == 0


def test_mix_targets_and_determinism(spark):
    rows = documents()
    df = frame(spark)
    got = [tuple(r) for r in mixing.mix(df).select("doc_id", "size", "source_size", "target", "taken").collect()]
    size = {}
    for doc_id, text, _, source, _ in rows:
        size[source] = size.get(source, 0) + len(WORD.findall(text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    targets = mixing.share_budget([size[s] for s in order], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(order))],
                                  1.5 * sum(size.values()), 2)
    assert sum(targets) == pytest.approx(1.5 * sum(size.values()))
    want = Counter((d, len(WORD.findall(t or "")), size[s], targets[order.index(s)]) for d, t, _, s, _ in rows)
    assert Counter(r[:4] for r in got) == want
    assert all(r[4] <= 2 * r[1] and (r[1] == 0 or r[4] % r[1] == 0) for r in got)
    taken = Counter()
    for r in got:
        taken[(r[2], r[3])] += r[4]
    for s in order:
        # equal (size, target) pairs of two sources add up here, as in taken
        same = [x for x in order if (size[x], targets[order.index(x)]) == (size[s], targets[order.index(s)])]
        lens = {len(WORD.findall(t or "")) for _, t, _, q, _ in rows if q == s}
        assert abs(taken[(size[s], targets[order.index(s)])] - len(same) * targets[order.index(s)]) <= len(same) * max(lens) or size[s] == 0
    again = [tuple(r) for r in mixing.mix(df.repartition(5)).select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert Counter(got) == Counter(again)
    assert mixing.mix(frame(spark, [])).count() == 0


def test_mixed_documents_of_equal_id_and_text(spark):
    """Rows that differ in source or other columns only keep their own values."""
    rows = [(1, "a b c", "en", "x", 7), (1, "a b c", "en", "y", 8), (2, "d e", "en", "x", 1), (2, "d e", "fr", "x", 2),
            (2, "d e", "de", "x", 3), (3, None, "en", "x", 1), (3, None, "fr", "x", 2), (None, "f g h", "en", "y", 1),
            (4, "i", "en", "x", 1), (5, "j k l m", "en", "y", 4)]
    df = frame(spark, rows)
    picks = mixing.mix(df)
    out = mixing.mixed_documents(df, picks)
    assert out.columns == df.columns
    want, got = Counter(), Counter()
    for r in picks.collect():
        want[r.doc_id, r.source] += r.times if r.size else 1
    taken = Counter(tuple(r) for r in take_columns(out, ["doc_id", "text", "lang", "source", "n_chars"]).collect())
    for (d, _, _, s, _), n in taken.items():
        got[d, s] += n
    assert got == +want and set(taken) <= set(rows)
    of_two = [taken[r] for r in rows if r[0] == 2]
    assert max(of_two) - min(of_two) <= 1 and taken[rows[5]] == taken[rows[6]] == 1


def test_mixed_documents_repeat_as_taken(spark):
    df = frame(spark, extra=False).where("doc_id is not null").dropDuplicates(["doc_id"])
    often = {r.doc_id: r.taken // r["size"] for r in mixing.mix(df).collect() if r["size"]}
    got = Counter(r.doc_id for r in mixing.mixed_documents(df, mixing.mix(df)).collect())
    assert all(got.get(d, 0) == n for d, n in often.items())


@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 4)), min_size=1, max_size=8, unique_by=lambda x: x[0]),
       st.integers(0, 300))
@settings(max_examples=120, deadline=None)
def test_fit_counts_is_as_near_as_brute_force(items, budget):
    lengths = np.array([a for a, _ in items], np.int64)
    counts = np.array([c for _, c in items], np.int64)
    take = mixing.fit_counts(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    total = int((lengths * take).sum())
    sums = {0}
    for a, c in items:
        sums = {s + a * k for s in sums for k in range(c + 1)}
    best = max(s for s in sums if s <= max(budget, 0))
    assert total <= max(budget, 0) or budget >= int((lengths * counts).sum())
    # proportional shares are kept, so the fit may stop short by less than the longest length
    assert best - total <= int(lengths.max())


RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tik():
    import tiktoken
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_bpe_against_library(spark, tik):
    df = bpe.decode(bpe.encode(frame(spark), RANKS, P.PATTERN), RANKS, P.PATTERN)
    got = Counter(tuple(r) for r in bpe.digests(df).collect())
    want = Counter()
    for doc_id, text, *_ in documents():
        ids = tik.encode_ordinary(text or "")
        want[(doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
              hashlib.sha256((text or "").encode()).hexdigest())] += 1
    assert got == want
    assert bpe.encode(frame(spark, []), RANKS, P.PATTERN).count() == 0


@given(st.text(alphabet=" \t\n\r\x1c aeiounrst'LlVvEe12é日😀.!?_-", max_size=60))
@settings(max_examples=300, deadline=None)
def test_bpe_property(tik, text):
    c = bpe.codec(RANKS, P.PATTERN)
    ids = c.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(text)
    assert c.decode(ids) == text.encode()


def test_transducer_long_match_and_resets(tik, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_MOVES", 50)
    monkeypatch.setattr(bpe, "MAX_STATES", 20, raising=False)
    c = bpe.Codec(RANKS, P.PATTERN)
    text = "the" + "anderetion" * 300 + " " + "x" * 700
    assert np.frombuffer(c.encode(text), "<u4").tolist() == tik.encode_ordinary(text)


def test_utf8_stream_holds_unfinished_characters():
    data = "aé日😀z".encode()
    s = bpe.Utf8Stream()
    out = [s.feed(data[i:i + 1]) for i in range(len(data))]
    assert b"".join(out) == data and s.finish() == b""
    assert all(piece.decode() is not None for piece in out)
    s.feed(data[:2])
    assert s.finish() == data[1:2]


PIECES = P.path("piece_bpe_32k.model")


def test_unigram_counts_against_library(spark):
    from tokenizers import Tokenizer, models

    tok = Tokenizer(models.Unigram(unigram_count.load_pieces(PIECES), unk_id=0, byte_fallback=True))
    got = Counter((r.doc_id, r.n_tokens) for r in take_columns(
        unigram_count.count_tokens(frame(spark), PIECES), ["doc_id", "n_tokens"]).collect())
    want = Counter()
    for doc_id, text, *_ in documents():
        t = text or ""
        if len(t) > 20_000:
            n = unigram_count.Counter(unigram_count.load_pieces(PIECES)).viterbi("▁" + t.replace(" ", "▁"))
        else:
            n = len(tok.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0
        want[(doc_id, n)] += 1
    assert got == want


@given(st.text(alphabet=" ab▁c\n日é<0x>", max_size=30))
@settings(max_examples=200, deadline=None)
def test_unigram_ties_and_unknowns(text):
    from tokenizers import Tokenizer, models

    pieces = [("<unk>", 0.0), ("▁", -3.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁a", -5.0), ("ba", -4.0),
              ("abab", -8.0), ("c", -1.0), ("▁▁", -6.0), ("cab", -5.0)]
    tok = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    mine = unigram_count.Counter(pieces).count(text)
    assert mine == (len(tok.encode("▁" + text.replace(" ", "▁")).ids) if text else 0)


WORDPIECE = P.path("word_bpe_49k.json")


def test_id_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    idcoder.write_ids(frame(spark), str(tmp_path / "ids"), WORDPIECE, block_ids=500)
    got = sorted(((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in
                  idcoder.read_documents(spark, str(tmp_path / "ids")).collect()), key=lambda r: r[0])
    tok = Tokenizer.from_file(WORDPIECE)
    want = Counter()
    for doc_id, text, *_ in documents():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        want[(doc_id, len(ids), np.array(ids, "<u4").tobytes())] += 1
    assert Counter(r[1:] for r in got) == want
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    ids = [r[1] for r in got]
    assert [i for i in ids if i is not None] == sorted(i for i in ids if i is not None)
    assert ids[0] is None and zlib.crc32(got[0][3]) >= 0


def test_added_tokens_in_texts_are_their_own_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ["abc <|endoftext|> def", "abc<|endoftext|>def", "<|endoftext|>", "a <|ENDOFTEXT|> <|endoftext |> b",
             "x<|startoftext|><|endoftext|>'s can'<|endoftext|>t", "é<|endoftext|>\u0301b", "\x1c<|endoftext|>\u00a012",
             "|endoftext| endoftext <|endoftext <| endoftext |>", "plain", "<|endoftext|>" * 40 + "y" * 80]
    tok = Tokenizer.from_file(WORDPIECE)
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert 49_407 in want[0] and 49_406 in want[4]
    for order in (1, -1):  # whatever the caches hold already
        enc = idcoder.Encoder(WORDPIECE)
        for _ in range(2):
            got = enc.encode([t.encode() for t in texts[::order]])
            assert [np.frombuffer(g, "<u4").tolist() for g in got] == want[::order]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    idcoder.write_ids(frame(spark, rows), str(tmp_path / "ids"), WORDPIECE)
    got = sorted((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist())
                 for r in idcoder.read_documents(spark, str(tmp_path / "ids")).collect())
    assert [r[2] for r in got] == [w + [1] for w in want]
    assert [r[0] for r in got] == np.cumsum([0] + [len(w) + 1 for w in want[:-1]]).tolist()


def test_encoder_keeps_no_more_than_its_limit(monkeypatch):
    from linkwright.llm import common

    monkeypatch.setattr(idcoder, "MAX_UNITS", 100)
    enc = idcoder.Encoder(WORDPIECE)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}, Übe{chr(97 + i % 26)}{chr(97 + i // 26)}&&" for i in range(500)]
    enc.encode([w.encode() for w in words])
    kept = sum(len(c.young) + len(c.old) for c in vars(enc).values() if isinstance(c, common.TwoAges))
    assert kept <= 100


def test_id_files_are_read_by_one_python_step(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    plan = queries.QUERIES["op5_token_id_files"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_id_files_empty_table(spark, tmp_path):
    idcoder.write_ids(frame(spark, []), str(tmp_path / "none"), WORDPIECE)
    assert idcoder.read_documents(spark, str(tmp_path / "none")).count() == 0


@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 49_407)), max_size=400), max_size=5))
@settings(max_examples=40, deadline=None)
def test_blocks_round_trip_alone_and_together(docs):
    a = (list(range(len(docs))), [np.array(d, np.uint32) for d in docs])
    b = ([None], [np.arange(3000, dtype=np.uint32) % 77])
    data = idcoder.pack_blocks([a, b], 49_408)
    assert idcoder.pack_blocks([a], 49_408)[0] == data[0]  # a block doesn't depend on its batch
    for got in (idcoder.unpack_blocks(data)[0], idcoder.unpack_blocks(data[:1])[0]):
        assert got[0] == a[0] and [x.tolist() for x in got[1]] == docs


def test_damaged_block_is_noticed_and_repetition_shrinks():
    ids = np.tile(np.arange(100, dtype=np.uint32), 600)
    data = idcoder.pack_blocks([([1], [ids])], 49_408)[0]
    assert len(data) < len(ids) // 2
    with pytest.raises(ValueError):
        idcoder.unpack_blocks([data[:50] + b"x" + data[51:]])


def test_long_text_is_whole():
    assert len(LONG) > 200_000


def test_border_walk_equals_merging():
    """Two tokens stay side by side exactly where merging their bytes leaves them so."""
    import random

    import public_tokenizers

    m = bpe.Transducer(bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    rnd = random.Random(1)
    known = [i for i, t in enumerate(m.vocab) if t]
    short = [i for i in known if len(m.vocab[i]) <= 3]
    for k in range(6000):
        a, b = rnd.choice(short if k % 2 else known), rnd.choice(short if k % 2 else known)
        if k % 5 == 0:  # neighbours in a real encoding
            ids = m.merge(m.vocab[a] + m.vocab[b])
            a, b = ids[-2:] if len(ids) > 1 else (a, b)
        assert m._side_by_side(a, b) == (m.merge(m.vocab[a] + m.vocab[b]) == [a, b])


def test_round_trip_equals_encode_decode_digests(spark):
    from linkwright.llm.common import split_pattern, vocabulary

    path, pattern = vocabulary("byte_bpe_multi_50k.tiktoken"), split_pattern()
    df = frame(spark)
    steps = bpe.digests(bpe.decode(bpe.encode(take_columns(df, ["doc_id", "text"]), path, pattern), path, pattern))
    one = bpe.round_trip(df, path, pattern)
    assert Counter(map(tuple, one.collect())) == Counter(map(tuple, steps.collect())) and one.columns == steps.columns
    assert bpe.round_trip(frame(spark, []), path, pattern).count() == 0
