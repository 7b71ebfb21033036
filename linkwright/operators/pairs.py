"""Candidate generation, pair scoring and top-1 linkage (O-BLK1, O-JOIN1-7,
O-HSH1-2, O-FEA1-2).

Pairs are always generated by equi-joins on exploded key arrays. A pair
that shares several keys is kept once, at its smallest shared key
(``key = array_min(array_intersect(l.keys, r.keys))``), so de-duplication
costs no extra shuffle. Top-1 per left row is a ``max_by`` aggregate
(partial aggregation before the shuffle), never a window sort.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ratios
from ..functions import similarity as S
from ..functions import text


#: rows of one key on one side that a single task may pair
KEY_ROWS = 4_096


def keyed_pairs(left: DataFrame, right: DataFrame, lkeys: str = "keys",
                rkeys: str = "keys", lprefix: str = "l_", rprefix: str = "r_",
                key_rows: int = KEY_ROWS) -> DataFrame:
    """Every (left, right) pair sharing at least one key, exactly once.

    ``left`` and ``right`` carry an ``array<string>`` of keys. Output columns
    are the inputs' columns prefixed, plus ``block_key``. The join is a plain
    shuffle equi-join on the key.

    Hot keys: the rows of every key are counted on both sides (one partial
    aggregate over the keys alone). A key with more than ``key_rows`` rows on
    a side is split there into as many buckets as its count asks for, by a
    hash of the row; its pairs are dealt into the grid of left and right
    buckets, so a task pairs at most about ``key_rows`` squared rows whatever
    the key's size. Each row is repeated once per bucket of the other side and
    each pair is still produced exactly once.
    """
    lcols, rcols = list(left.columns), list(right.columns)
    l = left.select(*[F.col(c).alias(lprefix + c) for c in lcols],
                    F.explode(F.array_distinct(F.col(lkeys))).alias("block_key"))
    r = right.select(*[F.col(c).alias(rprefix + c) for c in rcols],
                     F.explode(F.array_distinct(F.col(rkeys))).alias("_rk"))
    counts = l.select(F.col("block_key").alias("_hk"), F.lit(0).alias("_side")).unionByName(
        r.select(F.col("_rk").alias("_hk"), F.lit(1).alias("_side")))
    hot = counts.groupBy("_hk").agg(F.count_if(F.col("_side") == 0).alias("_nl"),
                                    F.count_if(F.col("_side") == 1).alias("_nr")) \
        .where((F.col("_nl") > key_rows) | (F.col("_nr") > key_rows)) \
        .select("_hk", F.ceil(F.col("_nl") / key_rows).cast("int").alias("_bl"),
                F.ceil(F.col("_nr") / key_rows).cast("int").alias("_br"))

    def deal(df, key, cols, own, other, mine, theirs):
        d = df.join(hot.withColumnRenamed("_hk", key), key, "left")
        n_own, n_other = F.greatest(F.coalesce(own, F.lit(1)), F.lit(1)), F.greatest(F.coalesce(other, F.lit(1)), F.lit(1))
        return d.withColumn(mine, F.pmod(F.xxhash64(*[F.col(c) for c in cols]), n_own).cast("int")) \
            .withColumn(theirs, F.explode(F.sequence(F.lit(0), n_other - 1))).drop("_bl", "_br")

    l = deal(l, "block_key", [lprefix + c for c in lcols], F.col("_bl"), F.col("_br"), "_s1", "_s2")
    r = deal(r, "_rk", [rprefix + c for c in rcols], F.col("_br"), F.col("_bl"), "_t2", "_t1")
    j = l.join(r, (F.col("block_key") == F.col("_rk")) & (F.col("_s1") == F.col("_t1"))
               & (F.col("_s2") == F.col("_t2"))).drop("_s1", "_s2", "_t1", "_t2")
    first_shared = F.array_min(F.array_intersect(F.col(lprefix + lkeys), F.col(rprefix + rkeys)))
    return j.where(F.col("block_key") == first_shared).drop("_rk")


def _keys(*conds_and_values: tuple[Column, Column]) -> Column:
    arr = F.array(*[F.when(c, v) for c, v in conds_and_values])
    return F.filter(arr, lambda x: x.isNotNull())


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _unit_char_keys(prefix: str, unit: Column) -> Column:
    chars = F.array_distinct(F.filter(F.split(unit, ""), lambda ch: ch != ""))
    return F.transform(chars, lambda ch: F.concat(F.lit(prefix), ch))


def prepare_addresses(df: DataFrame, id_col: str = "id", address_col: str = "address",
                      order_col: str | None = None) -> DataFrame:
    """O-STD1 text + O-PRS1 components for one side (narrow, no shuffle)."""
    std = text.standardize_address(F.col(address_col))
    out = df.select(F.col(id_col).alias("id"), F.col(address_col).alias("address"),
                    F.col(order_col or id_col).alias("ord"), std.alias("std"))
    return out.withColumn("comp", text.parse_components(F.col("std")))


def best_match_candidates(L: DataFrame, R: DataFrame, threshold: float) -> DataFrame:
    """Lossless candidates for O-JOIN2. Below 0.6875 no key is lossless, so
    every pair is one; :func:`keyed_pairs` deals them into a grid of blocks.

    score = .3*overall + .5*component + .2*bigram <= .5 + .5*component, so a
    match needs component > 2t-1. With house and zip both comparable and
    the house differing, component <= .2; house comparable and different
    without zip, <= .3; zip comparable and different without house, <= .375.
    Hence a match has an equal house, or an equal zip, or neither house nor
    zip comparable (then only the unit can score, and a unit score above 0
    needs a shared character).

    For t >= .767 it is tighter: an equal zip with differing houses scores at
    most .533, so zip keys are only needed where a house is missing; and
    with both house and zip comparable, equal houses with differing zips
    give component <= 2/3, so the bigram Jaccard must exceed
    (t - .3 - .5*2/3)/.2 (0.833 at t = .8): such pairs share one of the
    first |B| - ceil(j*|B|) + 1 bigrams of each side (prefix filter; any fixed
    order is right, so bigrams that begin with the house, which these pairs
    share anyway, come last, and long ones with digits first). The hot house-only key is kept only for rows without a
    zip.
    """
    if threshold < 0.6875:  # any pair may match: all pairs, dealt in blocks
        every = F.array(F.lit("all"))
        return keyed_pairs(L.withColumn("keys", every), R.withColumn("keys", every))
    tight = threshold >= 0.767

    # which row shapes exist on each side: one small aggregate over both sides
    c = F.col("comp")
    hp, zp, u = _present(c["house_number"]), _present(c["zipcode"]), _present(c["unit"])
    nh, nz = ~hp, ~zp
    shapes = {"nh": nh, "nz": nz, "hnz": hp & nz, "nhz": nh & nz & u, "nhu": nh & u, "nzu": nz & u}
    both = L.select("comp", F.lit(0).alias("_side")).unionByName(R.select("comp", F.lit(1).alias("_side")))
    row = both.agg(*[F.max((cond & (F.col("_side") == s)).cast("int")).alias(f"{k}_{s}")
                     for k, cond in shapes.items() for s in (0, 1)]).first()
    fl = {k: bool(row[f"{k}_0"]) for k in shapes}
    fr = {k: bool(row[f"{k}_1"]) for k in shapes}
    jmin = (threshold - 0.3 - 0.5 * (2.0 / 3.0)) / 0.2 - 1e-9

    def side_keys(is_left: bool) -> Column:
        c = F.col("comp")
        h, z, u = c["house_number"], c["zipcode"], c["unit"]
        hp, zp, up = _present(h), _present(z), _present(u)
        yes = F.lit(True)
        if tight:
            parts: list[tuple[Column, Column]] = [
                (hp & zp, F.concat(F.lit("hz:"), h, F.lit("|"), z))]
            # house equal, zip missing on one side: house-only keys, one type
            # per side that can lack the zip
            if fl["hnz"]:
                parts.append(((hp & ~zp) if is_left else hp, F.concat(F.lit("hA:"), h)))
            if fr["hnz"]:
                parts.append((hp if is_left else (hp & ~zp), F.concat(F.lit("hB:"), h)))
            # zip equal, house missing on one side
            if fl["nh"]:
                parts.append(((~hp if is_left else yes) & zp, F.concat(F.lit("zA:"), z)))
            if fr["nh"]:
                parts.append(((yes if is_left else ~hp) & zp, F.concat(F.lit("zB:"), z)))
            arr = _keys(*parts)
            # house equal, both zips present and different: bigram prefix keys
            bg = F.col("_bg")
            nb = F.size(bg)
            plen = nb - F.ceil(F.lit(jmin) * nb).cast("int") + 1
            last = F.concat(h, F.lit(" "))
            bg = F.transform(F.array_sort(F.transform(bg, lambda b: F.struct(
                b.startswith(last).alias("house"), (~b.rlike("[0-9]")).alias("plain"), (-F.length(b)).alias("short"),
                b.alias("b")))), lambda x: x["b"])
            pref = F.slice(bg, 1, F.greatest(plen, F.lit(1)))
            hb = F.transform(pref, lambda b: F.concat(F.lit("hb:"), h, F.lit("|"), b))
            arr = F.concat(arr, F.when(hp & zp & (nb > 0), hb).otherwise(F.array().cast("array<string>")))
        else:
            arr = _keys((hp, F.concat(F.lit("h:"), h)), (zp, F.concat(F.lit("z:"), z)))
        # Fallback: neither house nor zip comparable and both sides have a unit:
        # (Lnh & Lnz) | (Lnh & Rnz) | (Rnh & Lnz) | (Rnh & Rnz). A key type is only
        # emitted when both of its restricted sides actually hold such rows.
        nh, nz = ~hp, ~zp
        combos = [
            ("u1:", (nh & nz) if is_left else yes, fl["nhz"]),
            ("u2:", nh if is_left else nz, fl["nhu"] and fr["nzu"]),
            ("u3:", nz if is_left else nh, fl["nzu"] and fr["nhu"]),
            ("u4:", yes if is_left else (nh & nz), fr["nhz"]),
        ]
        for prefix, cond, needed in combos:
            if needed:
                extra = F.when(cond & up, _unit_char_keys(prefix, u)).otherwise(
                    F.array().cast("array<string>"))
                arr = F.concat(arr, extra)
        return arr

    if tight:  # distinct word bigrams, staged once per row
        bigrams = F.array_distinct(text.ngrams(F.col("std"), 2))
        L, R = L.withColumn("_bg", bigrams), R.withColumn("_bg", bigrams)
    lk = L.withColumn("keys", side_keys(True))
    rk = R.withColumn("keys", side_keys(False))
    if tight:
        lk, rk = lk.drop("_bg"), rk.drop("_bg")
    return keyed_pairs(lk, rk)


def best_match(left: DataFrame, right: DataFrame, threshold: float = 0.8,
               id_col: str = "id", address_col: str = "address",
               right_order: str | None = None) -> DataFrame:
    """O-JOIN2: for each left row the right row with the highest O-SIM15
    score strictly above ``threshold``; ties go to the earliest right row
    (``right_order``, default the id). Left rows without a match are absent.

    Output: address1_id, address1, address2_id, address2, similarity.
    """
    # both sides feed flag and key counts and the join: checkpointed, so the
    # standardization runs once and nothing stays in executor storage
    L = prepare_addresses(left, id_col, address_col).checkpoint(eager=True)
    R = prepare_addresses(right, id_col, address_col, right_order).checkpoint(eager=True)
    pairs = best_match_candidates(L, R, threshold)
    scored = _scored_above(pairs, S.address_similarity_v1_std(
        F.col("l_std"), F.col("r_std"), F.col("l_comp"), F.col("r_comp")), threshold)
    return top1(scored, "l_id", ["l_address"], ["r_id", "r_address"], "similarity", "r_ord") \
        .select(F.col("l_id").alias("address1_id"), F.col("l_address").alias("address1"),
                F.col("r_id").alias("address2_id"), F.col("r_address").alias("address2"),
                F.col("similarity"))


def _scored_above(pairs: DataFrame, score: Column, threshold: float) -> DataFrame:
    """The ids, addresses and orders of ``pairs`` with ``similarity`` above
    ``threshold``. Scores are rows of a generator: the filter isn't pushed below
    it, where it would score every pair a second time."""
    kept = [side + c for side in ("l_", "r_") for c in ("id", "address", "ord")]
    scored = pairs.withColumn("_score", score).select(*kept, F.inline(F.array(F.struct(F.col("_score").alias("similarity")))))
    return scored.where(F.col("similarity") > threshold)


def top1(scored: DataFrame, group_col: str, carry_left: list[str], carry_right: list[str],
         score_col: str, order_col: str) -> DataFrame:
    """Best row per ``group_col`` by (score desc, order asc) via ``max_by``.

    ``max_by`` is a declarative aggregate, so Spark runs a partial aggregate
    per map task before the shuffle: at most one row per left id and task
    crosses the network.
    """
    best = F.max_by(F.struct(*[F.col(c) for c in carry_right + [score_col]]),
                    F.struct(F.col(score_col), -F.col(order_col) if _numeric_order(scored, order_col)
                             else F.col(order_col)))
    aggs = [best.alias("_best")] + [F.first(c).alias(c) for c in carry_left]
    out = scored.groupBy(group_col).agg(*aggs)
    return out.select(group_col, *carry_left,
                      *[F.col("_best")[c].alias(c) for c in carry_right + [score_col]])


def _numeric_order(df: DataFrame, c: str) -> bool:
    t = df.schema[c].dataType.typeName()
    if t in ("long", "integer", "short", "byte", "double", "float", "decimal"):
        return True
    raise ValueError(f"order column {c} must be numeric for earliest-wins ties")


def link_names(left: DataFrame, right: DataFrame, threshold: float = 0.8,
               left_key: str = "customer", right_key: str = "customer",
               id_col: str = "id", right_order: str | None = None) -> DataFrame:
    """O-JOIN6: for each left row the right row with the highest
    Jaro-Winkler of the lower-cased names, strictly above ``threshold``;
    ties -> earliest right row. Equal to scoring all pairs.

    Equal names collapse on both sides first and match with score 1. The rest
    is searched by upper bounds (:mod:`.search`): blocks of right names whose
    character counts cannot beat a name's best score so far are never joined.
    """
    from . import search

    L = left.select(F.col(id_col).alias("lid"), F.col(left_key).alias("lname"),
                    F.lower(F.coalesce(F.col(left_key), F.lit(""))).alias("k"))
    R = right.select(F.lower(F.coalesce(F.col(right_key), F.lit(""))).alias("k"), F.struct(
        F.col(right_order or id_col).alias("o"), F.col(id_col).alias("rid"),
        F.col(right_key).alias("rname")).alias("r"))
    # of equal right names only the earliest can win
    names = R.groupBy("k").agg(F.min("r").alias("r")).checkpoint(eager=True)
    same = L.select("k").distinct().join(names, "k").select("k", "r", F.lit(1.0).alias("score"))
    # an empty name scores 0 against any other
    todo = L.select("k").distinct().join(names, "k", "left_anti").where("k <> ''")
    best = search.best_partners(todo, names.where("k <> ''").select("k", F.col("r.o").alias("o")), threshold,
                                search.Name())
    found = best.join(names.withColumnRenamed("k", "r_k"), "r_k").select("k", "r", "score")
    found = same.unionByName(found).where(F.col("score") > threshold)
    return L.join(found, "k").select(
        F.col("lid").alias("left_id"), F.col("lname").alias("left_name"),
        F.col("r.rid").alias("right_id"), F.col("r.rname").alias("right_name"), "score")


#: components that the token parser fills
_LINKED = {c: w for c, w in S.COMPONENT_WEIGHTS_V2.items() if c not in ("street_name", "city")}


def _linked_text(norm: Column, comp: Column) -> Column:
    """The components that :func:`_similarity_above` compares, which hold no
    blanks, and the normalized text, with blanks between."""
    return F.concat_ws(" ", *[F.coalesce(comp[c], F.lit("")) for c in _LINKED], F.coalesce(norm, F.lit("")))


def _similarity_above(threshold: float):
    """O-SIM16 of two :func:`_linked_text`, a whole batch at once; null where the
    components alone keep it from exceeding ``threshold``."""
    from . import search

    @F.arrow_udf("double")
    def score(x: pa.Array, y: pa.Array) -> pa.Array:
        found = linked_scores(x, y, list(_LINKED.values()), threshold, search.EPS)
        return pa.array(found, mask=np.isnan(found))

    return score


def linked_scores(x: pa.Array, y: pa.Array, weights: list[float], threshold: float, eps: float) -> np.ndarray:
    """O-SIM16 of each pair, nan where its components rule out more than ``threshold``."""
    (at_x, of_x), (at_y, of_y) = (ratios.parts(s, len(weights) + 1, " ") for s in (x, y))
    num, den = np.zeros(len(x)), np.zeros(len(x))
    for w, u, v in zip(weights, of_x, of_y):
        (i, a), (j, b) = ratios.distinct(u), ratios.distinct(v)
        i, j = i[at_x], j[at_y]
        both = (ratios.lengths(a) > 0)[i] & (ratios.lengths(b) > 0)[j]
        at = np.flatnonzero(both)
        num[at] += ratios.of_pairs(ratios.jaro_winklers, a, b, i[at], j[at]) * w
        den += np.where(both, w, 0.0)
    part = num / np.where(den == 0, 1.0, den)
    out = np.full(len(x), np.nan)
    at = np.flatnonzero(np.where(den == 0, 1.0, 0.5 + 0.5 * part + eps) > threshold)
    (i, a), (j, b) = ratios.distinct(of_x[-1]), ratios.distinct(of_y[-1])
    whole = ratios.of_pairs(ratios.jaro_winklers, a, b, i[at_x][at], j[at_y][at])
    out[at] = np.where(den[at] == 0, whole, 0.5 * whole + 0.5 * part[at])
    return out


def link_addresses(left: DataFrame, right: DataFrame, threshold: float = 0.85,
                   id_col: str = "id", address_col: str = "address",
                   right_order: str | None = None, mode: str = "exact") -> DataFrame:
    """O-JOIN3: best right address per left address by O-SIM16 (literal
    normalization, token components, Jaro-Winkler), strictly above
    ``threshold``, ties -> earliest right row.

    ``mode='exact'`` (default) equals scoring all pairs: O-SIM16 has no
    lossless key, as all of its parts are Jaro-Winkler, so zones of blocks,
    sorted by house number, ZIP and length, bound the score a left address can
    reach there, and blocks below its best so far are never joined. ``mode='blocked'`` is a
    cheaper operator of its own: best match among rows that share the house
    number or the ZIP.
    """
    if mode not in ("exact", "blocked"):
        raise ValueError(f"unknown mode {mode!r}")
    def prep(df, order):
        s = text.normalize_address_literal(F.col(address_col))
        out = df.select(F.col(id_col).alias("id"), F.col(address_col).alias("address"),
                        F.col(order or id_col).alias("ord"), s.alias("norm")).checkpoint(eager=True)
        c = text.parse_components_tokens(F.col("norm"))
        out = out.withColumn("comp", c)
        keys = _keys((F.col("comp.house_number").isNotNull(), F.concat(F.lit("h:"), F.col("comp.house_number"))),
                     (F.col("comp.zipcode").isNotNull(), F.concat(F.lit("z:"), F.col("comp.zipcode"))))
        # key counts and the join read both sides: cut, so each text is normalized and parsed once
        return out.withColumn("keys", keys if mode == "blocked" else F.array(F.lit("all"))).checkpoint(eager=True)

    L, R = prep(left, None), prep(right, right_order)
    if mode == "exact":
        return _link_all_addresses(L, R, threshold)
    pairs = keyed_pairs(*[side.select("id", "address", "ord", "keys", _linked_text(F.col("norm"), F.col("comp")).alias("text"))
                          for side in (L, R)])
    scored = _scored_above(pairs, _similarity_above(threshold)("l_text", "r_text"), threshold)
    return top1(scored, "l_id", ["l_address"], ["r_id", "r_address"], "similarity", "r_ord") \
        .select(F.col("l_id").alias("record1_id"), F.col("l_address").alias("record1_address"),
                F.col("r_id").alias("record2_id"), F.col("r_address").alias("record2_address"),
                "similarity")


def _link_all_addresses(L: DataFrame, R: DataFrame, threshold: float) -> DataFrame:
    """``link_addresses`` over all pairs, by :mod:`.search`. Equal normalized
    addresses score alike against anything, so each is compared once; of equal
    right ones only the earliest can win."""
    from . import search

    metric = search.Blend(_LINKED)

    def collapse(df, *more):
        parts = [F.first(F.col("comp")[c]).alias(c) for c in metric.fields[1:]]
        return df.where(F.col("norm").isNotNull()).groupBy(F.col("norm").alias("k")).agg(*parts, *more) \
            .checkpoint(eager=True)

    l, r = collapse(L), collapse(R, F.min(F.struct("ord", "id", "address")).alias("r"))
    # blocks of like house numbers and ZIPs have tight zones
    sort = [F.col("house_number"), F.col("zipcode"), F.length("k"), F.col("k")]
    real = F.col("k") != ""
    best = search.best_partners(l.where(real), r.where(real).withColumn("o", F.col("r.ord")), threshold, metric, sort, sort)
    equal = l.where(~real).join(r.select("k"), "k").select("k", F.col("k").alias("r_k"), F.lit(1.0).alias("score"))
    best = best.unionByName(equal).where(F.col("score") > threshold)
    return L.join(best, L["norm"] == best["k"]).drop("k").join(r.select(F.col("k").alias("r_k"), "r"), "r_k").select(
        F.col("id").alias("record1_id"), F.col("address").alias("record1_address"),
        F.col("r.id").alias("record2_id"), F.col("r.address").alias("record2_address"),
        F.col("score").alias("similarity"))


def fuzzy_lookup(df: DataFrame, reference: DataFrame, col: str = "address",
                 ref_col: str | None = None, cutoff: int = 70) -> DataFrame:
    """O-JOIN4: best reference string per input by the weighted best-of
    score (O-SIM19); below ``cutoff`` the row is kept with no match; ties go
    to the reference that sorts first. Adds best_match, confidence, matched.

    Distinct inputs are searched against the distinct reference strings by
    upper bounds (:mod:`.search`, :mod:`.lookup`): blocks of references whose
    characters and tokens cannot beat an input's best score are never joined.
    """
    from . import lookup, search

    ref_col = ref_col or reference.columns[0]
    ref = reference.select(F.col(ref_col).alias("k")).where(F.col("k").isNotNull()).distinct().withColumn("o", F.col("k"))
    inp = df.select(F.col(col).alias("k")).where(F.col("k").isNotNull()).distinct()
    # both sides are read several times
    ref, inp = ref.checkpoint(eager=True), inp.checkpoint(eager=True)
    # references that end alike often share whole words: blocks of them have tight zones
    best = search.best_partners(inp, ref, float(cutoff), lookup.BestOf(), right_sort=[F.reverse("k"), F.col("k")]).select(
        F.col("k").alias("_input"), F.col("r_k").alias("best_match"), F.col("score").cast("int").alias("confidence"))
    out = df.join(best, df[col] == best["_input"], "left").drop("_input")
    return out.withColumn("matched", F.col("best_match").isNotNull())


PAIR_METRICS = ("levenshtein", "levenshtein_sim", "jaro", "jaro_winkler", "jaro_winkler_gated",
                "token_jaccard", "ngram_cosine", "bigram_jaccard", "seq_ratio", "ratio",
                "token_sort_ratio", "token_set_ratio", "hybrid", "address_similarity_v1",
                "address_similarity_v2", "best_of")


def score_pairs(pairs: DataFrame, a: str, b: str, metrics=PAIR_METRICS,
                standardize: bool = True) -> DataFrame:
    """Score string pairs with the chosen metrics, each distinct (a, b) once.

    The distinct pairs are scored (one shuffle; duplicated pairs are common
    in address data) and joined back. The O-STD1 text and O-PRS1 components
    are materialized as columns first, so no metric re-derives them.
    ``standardize``: string metrics see the O-STD1 text (the address
    similarities always standardize as their definitions require).
    """
    d = pairs.select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
    d = d.withColumn("_sa", text.standardize_address(F.col("_a"))) \
        .withColumn("_sb", text.standardize_address(F.col("_b")))
    need_c1 = "address_similarity_v1" in metrics
    need_c2 = "address_similarity_v2" in metrics
    if need_c1:
        d = d.withColumn("_ca", text.parse_components(F.col("_sa"))) \
            .withColumn("_cb", text.parse_components(F.col("_sb")))
    if need_c2:
        d = d.withColumn("_na", text.normalize_address_literal(F.col("_a"))) \
            .withColumn("_nb", text.normalize_address_literal(F.col("_b")))
        d = d.withColumn("_ta", text.parse_components_tokens(F.col("_na"))) \
            .withColumn("_tb", text.parse_components_tokens(F.col("_nb")))
    x, y = (F.col("_sa"), F.col("_sb")) if standardize else (F.col("_a"), F.col("_b"))
    fns = {
        "levenshtein": lambda: S.levenshtein(x, y),
        "levenshtein_sim": lambda: S.levenshtein_sim(x, y),
        "jaro": lambda: S.jaro(x, y),
        "jaro_winkler": lambda: S.jaro_winkler(x, y),
        "jaro_winkler_gated": lambda: S.jaro_winkler_gated(x, y),
        "token_jaccard": lambda: S.token_jaccard(x, y),
        "ngram_cosine": lambda: S.ngram_cosine(x, y),
        "bigram_jaccard": lambda: S.bigram_jaccard(x, y),
        "seq_ratio": lambda: S.seq_ratio(x, y),
        "ratio": lambda: S.ratio(F.col("_a"), F.col("_b")),
        "token_sort_ratio": lambda: S.token_sort_ratio(F.col("_a"), F.col("_b")),
        "token_set_ratio": lambda: S.token_set_ratio(F.col("_a"), F.col("_b")),
        "hybrid": lambda: S.hybrid(x, y),
        "address_similarity_v1": lambda: S.address_similarity_v1_std(
            F.col("_sa"), F.col("_sb"), F.col("_ca"), F.col("_cb")),
        "address_similarity_v2": lambda: S.address_similarity_v2_std(
            F.col("_na"), F.col("_nb"), F.col("_ta"), F.col("_tb")),
        "best_of": lambda: S.best_of(F.col("_a"), F.col("_b")),
    }
    scored = d.select("_a", "_b", *[fns[m]().alias(m) for m in metrics])
    return pairs.join(scored, (pairs[a].eqNullSafe(scored["_a"])) & (pairs[b].eqNullSafe(scored["_b"])),
                      "left").drop("_a", "_b")
