"""Operators 11 to 13 against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations
from math import factorial

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from linkwright.llm import alignment, fingerprints, interactions
from linkwright.llm.common import vocabulary

from .data import LONG, documents, frame, sentence

GAP = "[\\x20\\x09-\\x0D]+"
TOP = (1 << 63) - 1


# --------------------------------------------------------------- operator 11
def hashes(text):
    w = [x for x in re.split(GAP, text or "") if x]
    out = []
    for i in range(max(1, len(w) - 4) if w else 0):
        h = 42
        for x in w[i:i + 5]:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        out.append(h & TOP)
    return set(out)


def kept(found, scale=8, floor=16):
    below = sorted(h for h in found if h < (1 << 63) // scale)
    return below if len(below) >= floor else sorted(found)[:floor]


def like(a, b, scale=8, floor=16):
    if not a and not b:
        return 1.0
    t = (1 << 63) // scale
    limit = min(TOP if len(x) < floor else t if x[-1] < t else x[-1] + 1 for x in (a, b))
    x, y = {h for h in a if h < limit}, {h for h in b if h < limit}
    return len(x & y) / len(x | y)


def shown(sk):
    return "".join(f"{h:016x}" for h in sk)


def fingerprint_answer(rows):
    def key(r):
        t = r[1] or ""
        inner = hashlib.sha256(t.encode()).hexdigest()
        return hashlib.sha256(f"{'-' if r[0] is None else r[0]}:{inner}".encode()).digest()

    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), key(r)))
    out = []
    for i, (r, nxt) in enumerate(zip(order, order[1:] + order[:1])):
        t, u = r[1] or "", nxt[1] or ""
        half = len(t) // 2
        e = t[:len(t) - half] + u[:half]
        a, b, c = kept(hashes(t)), kept(hashes(e)), kept(hashes(u))
        out.append((r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), shown(a), shown(b),
                    round(like(a, b), 12), round(like(a, c), 12)))
    return sorted(out, key=repr)


def test_fingerprints_equal_plain_python(spark):
    rows = documents()
    got = fingerprints.compare_with_next(frame(spark, rows)).drop("in_edited", "in_next").collect()
    got = sorted((tuple(r)[:5] + (round(r.near_edited, 12), round(r.near_next, 12)) for r in got), key=repr)
    assert got == fingerprint_answer(rows)


def test_fingerprints_of_few_rows(spark):
    assert fingerprints.compare_with_next(frame(spark, [])).count() == 0
    for rows in ([(3, sentence(1, 40), "en", "a", 1)], [(None, None, None, None, None)] * 3):
        got = fingerprints.compare_with_next(frame(spark, rows)).collect()
        assert [r.near_next for r in got] == [1.0] * len(rows)


def test_order_links_every_range_to_the_next(spark):
    rows = [(i * 7 % 501, str(i)) for i in range(501)] + [(None, "x"), (None, "y")]
    keys = spark.createDataFrame(rows, "doc_id long, k string").withColumn("n", F.length("k"))
    got = {r.k: (r.pk, r.pn) for r in fingerprints.neighbours(keys).collect()}
    order = [k for _, k in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))]
    for a, b in zip(order, order[1:] + order[:1]):
        assert got[b] == (a, len(a))


def test_sketches_merge_and_contain(spark):
    a, b = sentence(5, 3000), sentence(6, 20)
    df = spark.createDataFrame([(a, b, a + " | " + sentence(7, 3000), a[:2000])], "a string, b string, c string, d string")
    sk = df.select(*[fingerprints.sketch(F.col(c)).alias(c) for c in "abcd"])
    r = sk.select(fingerprints.merge(F.col("a"), F.col("b")).alias("m"),
                  fingerprints.containment(F.col("a"), F.col("c")).alias("whole"),
                  fingerprints.containment(F.col("d"), F.col("a")).alias("part"),
                  fingerprints.containment(F.col("b"), F.col("a")).alias("none")).first()
    assert list(r.m) == kept(hashes(a) | hashes(b))
    assert r.whole > 0.99 and r.part > 0.95 and r.none == 0


def test_fingerprint_plan_has_no_python(spark):
    df = fingerprints.compare_with_next(frame(spark))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian", plan)


# --------------------------------------------------------------- operator 12
def encoders():
    return vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def alignment_answer(texts):
    """Per text: ids, group digest and links, by loops over bytes."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    pa_, pb = encoders()
    ta, sp = Tokenizer.from_file(pa_), sentencepiece.SentencePieceProcessor(model_file=pb)
    ta.encode_special_tokens = True
    char = {c: b for c, b in alignment._byte_of_char().items()}
    assert ByteLevel().decode(list(char)) and len(char) == 256
    out, count = [], Counter()
    for t in texts:
        t = t or ""
        a = ta.encode(" " + t, add_special_tokens=False).ids
        b = sp.encode(t)
        ba = [bytes(char[c] for c in ta.id_to_token(i)) for i in a]
        bb = [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if re.fullmatch("<0x..>", sp.id_to_piece(i))
              else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(ba) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            out.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in ba]), np.cumsum([len(x) for x in bb])
        both = sorted(set(ends_a) & set(ends_b))
        groups, at = [], 0
        for e in both:
            groups.append(",".join(str(i) for i, x in zip(a, ends_a) if at < x <= e) + "|" +
                          ",".join(str(i) for i, x in zip(b, ends_b) if at < x <= e))
            at = e
        links, j = [], 0
        for i, x in enumerate(ends_a):
            s = x - len(ba[i])
            while ends_b[j] <= s:
                j += 1
            k = j
            while k < len(b) and ends_b[k] - len(bb[k]) < x:
                links.append((a[i], b[k]))
                k += 1
        count.update(links)
        out.append((a, b, groups, links))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    rows = []
    for x in out:
        if x is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = x
        rows.append((len(a), len(b), len(groups), len(links), sum(count[p] == most[p[1]] for p in links),
                     sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return rows


def alignment_rows():
    rows = [r for r in documents() if r[1] != LONG]
    odd = ["a▁b", "<s> </s> <unk> x", "<|endoftext|> end", "\x00 nul", "日本語テキスト😀😀", "  two  spaces ", " ", "\r\n\t",
           "ﬁne ①", "x" * 3000, "éclair", "<0x41> <0x0A>"]
    return rows + [(1000 + i, t, "en", "a", 1) for i, t in enumerate(odd)]


def test_alignment_equals_loops(spark, monkeypatch):
    rows = alignment_rows()
    got = sorted((tuple(r) for r in alignment.align(frame(spark, rows), *encoders()).collect()), key=repr)
    want = sorted(((r[0], *x) for r, x in zip(rows, alignment_answer([r[1] for r in rows]))), key=repr)
    assert got == want and any(w[1] == 0 and w[0] == 1000 for w in want)


def test_alignment_does_not_depend_on_chunks(spark, monkeypatch):
    texts = [sentence(70 + i, 40) for i in range(50)] + [LONG, "", None]
    tok = alignment.Tokenizers.load(*encoders())
    whole = alignment.align_chunk(tok, [t or "" for t in texts])
    for i, t in enumerate(texts):
        one = alignment.align_chunk(tok, [t or ""])
        assert one["digest"][0] == whole["digest"][i] and one["n_links"][0] == whole["n_links"][i]
    places = whole["places"]
    assert np.array_equal(alignment._unpack(alignment._pack(places), len(places)), places)


def test_ranked_encoder_equals_the_library():
    """Every code point, alone, in words, before endings and between spaces."""
    tok = alignment.Tokenizers.load(*encoders())
    assert tok.ranked
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for k in range(0, len(points), 4000):
        part = [" a{0}b {0} {0}{0}1{0} 2 {0}'s{0}\n{0}  {0}!".replace("{0}", chr(c)) for c in points[k:k + 4000]]
        want = [e.ids for e in tok.a.encode_batch_fast(part, add_special_tokens=False)]
        assert [tok.ranked.encode_to_numpy(t, disallowed_special=()).tolist() for t in part] == want


def test_alignment_without_ranks_is_the_same(monkeypatch):
    tok = alignment.Tokenizers.load(*encoders())
    texts = [r[1] or "" for r in alignment_rows()]
    fast = alignment.align_chunk(tok, texts)
    monkeypatch.setattr(tok, "ranked", None)
    slow = alignment.align_chunk(tok, texts)
    assert fast["digest"] == slow["digest"] and fast["places"].tolist() == slow["places"].tolist()


def test_alignment_of_empty_tables(spark):
    assert alignment.align(frame(spark, []), *encoders()).count() == 0
    got = alignment.align(frame(spark, [(1, None, "", "", 1), (2, "", "", "", 1)]), *encoders()).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_pointer_jumping_on_random_cuts():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        n = int(rnd.integers(1, 60))
        ends = [np.unique(np.append(rnd.choice(np.arange(1, n + 1), int(rnd.integers(1, n + 1))), n)) for _ in "ab"]
        starts = [np.concatenate([[0], e[:-1]]) for e in ends]
        at = alignment.terminals(starts[0], ends[0], starts[1], ends[1])
        both = np.intersect1d(*ends)
        for e, label in zip(np.concatenate(ends), at):
            assert ends[1][label] == both[np.searchsorted(both, e)]


# --------------------------------------------------------------- operator 13
def audit_answer(rows, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    low = {}
    for d, t, *_ in rows:
        if d is not None:
            low[t or ""] = min(low.get(t or "", d), d)
    docs = []
    for d, t, _, source, _ in rows:
        t = t or ""
        w = [x for x in re.split(GAP, t) if x]
        fails = {f for f, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            bool(re.search("[#$%&*|]", t)), d is not None and d > low[t])) if bad}
        docs.append((source or "", fails, d in good, d in toxic))
    out, shapley = [], Counter()
    for part in {x[0] for x in docs}:
        mine = [x for x in docs if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                failing = sum(f in x[1] for x in mine)
                shapley[part, f] += len(gone)
                out.append((part, order, step, len(left), len(gone), failing - len(gone), sum(
                    x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)))
    return sorted(o + (shapley[o[0], o[1][o[2] - 1]],) for o in out)


def audit_rows():
    long_ = sentence(4, 260)
    more = [(500 + i, t, "en", s, 1) for i, (t, s) in enumerate([
        (long_, "a"), (long_, "a"), (long_.upper(), "b"), (long_ + " #", "b"), ("x y " * 150, "c"), ("X Y# " * 150, None),
        (long_, ""), (long_ + " #", "é")])]
    return documents() + more + [(None, long_, "en", "a", 1), (3, long_ + " $", "en", "zz", 1)]


LABELS = [(1, 1, 0), (2, 0, 1), (500, 1, 1), (500, 0, 0), (501, 1, None), (505, None, 1), (None, 1, 1), (14, 1, 1)]


def label_frame(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1))


@pytest.mark.parametrize("rows_per_range", [interactions.RANGE_ROWS, 5])
def test_audit_equals_every_order_in_turn(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(interactions, "RANGE_ROWS", rows_per_range)
    rows = audit_rows()
    got = interactions.audit(frame(spark, rows), label_frame(spark))
    want = audit_answer(rows, LABELS)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert len(want) == 600 * len({r[3] or "" for r in rows})


def test_audit_with_hot_texts(spark, monkeypatch):
    monkeypatch.setattr(interactions, "HOT_SHARE", 5)  # a fifth of all rows is hot
    rows = [(i, "same text" if i % 2 else f"text {i // 4}", "en", "ab"[i % 2], 1) for i in range(60)]
    got = interactions.audit(frame(spark, rows), label_frame(spark))
    assert sorted(tuple(r) for r in got.collect()) == audit_answer(rows, LABELS)


def test_audit_of_an_empty_table(spark):
    assert interactions.audit(frame(spark, []), label_frame(spark)).count() == 0
    empty = label_frame(spark).where("doc_id = 77")
    assert interactions.audit(frame(spark), empty).where("good_lost + toxic_lost > 0").count() == 0


def test_galloping_merges():
    rnd = np.random.default_rng(5)
    for _ in range(300):
        lists = [np.unique(rnd.integers(0, 80, int(rnd.integers(0, 60)))) for _ in range(4)]
        assert list(interactions.union(lists)) == sorted(set().union(*map(set, map(np.ndarray.tolist, lists))))
        a, b = lists[:2]
        assert list(interactions.minus(a, b)) == sorted(set(a.tolist()) - set(b.tolist()))
        assert list(interactions.common(a, b)) == sorted(set(a.tolist()) & set(b.tolist()))
    assert sum(factorial(s.bit_count()) * factorial(4 - s.bit_count()) for s in range(16)) == 120
