"""Registered queries over the driver tables, each with its DuckDB oracle.

Every query reads whole tables (or data Spark derives from them); doubles
are rounded to 6 places on both sides; every computed column is aliased to
the same name in Spark and SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import similarity as S
from ..functions import text
from ..operators import changes, fields, filters, pairs, validate
from ..session import ensure_checkpoint_dir, ensure_parallelism, ship_package
from . import fixtures as X
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            ensure_checkpoint_dir(spark)
            return _widen_ints(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


def _widen_ints(df: DataFrame) -> DataFrame:
    """Integral outputs as BIGINT (SQL engines count in 64 bits)."""
    from pyspark.sql import types as T
    small = (T.ByteType, T.ShortType, T.IntegerType)
    if not any(isinstance(f.dataType, small) for f in df.schema.fields):
        return df
    return df.select(*[F.col(f"`{f.name}`").cast("bigint").alias(f.name)
                       if isinstance(f.dataType, small) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- O-STD1/PRS1
_LEFT = f"({X.sql_left_addresses()})"
_RIGHT = f"({X.sql_right_addresses()})"
_STD = O.std_address_sql("address")
_C = O.components_sql("std")

SQL_STD = f"""
WITH a AS (SELECT id, address, {_STD} AS std FROM {_LEFT} t)
SELECT id, std, {_C['house_number']} AS house_number, {_C['unit']} AS unit,
       {_C['zipcode']} AS zipcode FROM a
"""


@register("std_address", SQL_STD)
def q_std_address(spark, sf_dir):
    """O-STD1 + O-PRS1 over every derived customer address."""
    a = X.left_addresses(spark, sf_dir)
    s = a.select("id", text.standardize_address(F.col("address")).alias("std"))
    c = text.parse_components(F.col("std"))
    return s.select("id", "std", c["house_number"].alias("house_number"),
                    c["unit"].alias("unit"), c["zipcode"].alias("zipcode"))


SQL_STD_RIGHT = f"""
WITH a AS (SELECT id, address, {_STD} AS std FROM {_RIGHT} t)
SELECT id, std, {_C['house_number']} AS house_number, {_C['unit']} AS unit,
       {_C['zipcode']} AS zipcode FROM a
"""


@register("std_address_varied", SQL_STD_RIGHT)
def q_std_address_varied(spark, sf_dir):
    """O-STD1 + O-PRS1 over the varied copy (abbreviations, '#', no zip)."""
    a = X.right_addresses(spark, sf_dir)
    s = a.select("id", text.standardize_address(F.col("address")).alias("std"))
    c = text.parse_components(F.col("std"))
    return s.select("id", "std", c["house_number"].alias("house_number"),
                    c["unit"].alias("unit"), c["zipcode"].alias("zipcode"))


# ------------------------------------------------------------ O-SIM1..4, 6..8
_PAIRS_SQL = f"""
WITH l AS (SELECT id, {_STD} AS a FROM {_LEFT} t),
     r AS (SELECT id, {_STD} AS b FROM {_RIGHT} t),
     p AS (SELECT l.id, a, b FROM l JOIN r ON l.id = r.id)
"""
_TA, _TB = O.tokens_sql("a"), O.tokens_sql("b")
_NN = f"least(len({_TA}), len({_TB}), 2)"
_GA = f"list_distinct({O.ngrams_sql(_TA, _NN)})"
_GB = f"list_distinct({O.ngrams_sql(_TB, _NN)})"
SQL_METRICS = _PAIRS_SQL + f"""
SELECT id,
  levenshtein(a, b) AS lev,
  round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0
        ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END, 6) AS lev_sim,
  round(CASE WHEN a = b THEN 1.0 WHEN length(a) = 0 OR length(b) = 0 THEN 0.0
        ELSE jaro_similarity(a, b) END, 6) AS jaro,
  round({O.jaro_winkler_sql('a', 'b')}, 6) AS jaro_winkler,
  round({O.jaccard_sql(_TA, _TB)}, 6) AS token_jaccard,
  round(CASE WHEN {_NN} < 1 OR len({_GA}) = 0 OR len({_GB}) = 0 THEN 0.0
        ELSE len(list_intersect({_GA}, {_GB})) / sqrt(len({_GA}) * len({_GB})) END, 6)
    AS ngram_cosine,
  round({O.jaccard_sql(O.ngrams_sql(_TA, '2'), O.ngrams_sql(_TB, '2'))}, 6) AS bigram_jaccard
FROM p
"""


def _std_pairs(spark, sf_dir) -> DataFrame:
    l = X.left_addresses(spark, sf_dir).select("id", text.standardize_address(F.col("address")).alias("a"))
    r = X.right_addresses(spark, sf_dir).select("id", text.standardize_address(F.col("address")).alias("b"))
    return l.join(r, "id")


@register("string_metrics", SQL_METRICS)
def q_string_metrics(spark, sf_dir):
    """O-SIM1, 2, 3, 4, 6, 7, 8 on every (left, right) pair of the same customer."""
    p = _std_pairs(spark, sf_dir)
    a, b = F.col("a"), F.col("b")
    return p.select("id", S.levenshtein(a, b).alias("lev"),
                    r6(S.levenshtein_sim(a, b)).alias("lev_sim"),
                    r6(S.jaro(a, b)).alias("jaro"),
                    r6(S.jaro_winkler(a, b)).alias("jaro_winkler"),
                    r6(S.token_jaccard(a, b)).alias("token_jaccard"),
                    r6(S.ngram_cosine(a, b)).alias("ngram_cosine"),
                    r6(S.bigram_jaccard(a, b)).alias("bigram_jaccard"))


# --------------------------------------------------------------------- O-JOIN2
@register("best_match")
def q_best_match(spark, sf_dir):
    """O-JOIN2 / O-SIM15 (difflib inside, so no SQL oracle): best varied
    address for every customer address, threshold 0.8."""
    l = X.left_addresses(spark, sf_dir)
    r = X.right_addresses(spark, sf_dir)
    out = pairs.best_match(l, r, threshold=0.8)
    return out.withColumn("similarity", r6(F.col("similarity")))


# -------------------------------------------------------------------- O-NRM1/8/9
_MESSY = f"({X.sql_messy_records()})"


def _sql_simple_alias_map() -> str:
    m = fields._first_target_alias_map(fields.SIMPLE_MAPPINGS["default"])
    return "MAP([" + ", ".join(O.q(k) for k in m) + "], [" + ", ".join(O.q(v) for v in m.values()) + "])"


_CLEAN = "lower(regexp_replace(e.key, '^\\s+|\\s+$', '', 'g'))"
SQL_NORMALIZE = f"""
WITH r AS (SELECT pos, list_transform(map_entries(record), lambda e:
             {{'key': e.key, 'value': e.value, 'tgt': {_sql_simple_alias_map()}[{_CLEAN}]}}) AS t
           FROM {_MESSY} m)
SELECT pos,
  list_filter(t, lambda e: e.tgt = 'first_name' AND e.value IS NOT NULL)[1].value AS first_name,
  list_filter(t, lambda e: e.tgt = 'last_name' AND e.value IS NOT NULL)[1].value AS last_name,
  list_filter(t, lambda e: e.tgt = 'email' AND e.value IS NOT NULL)[1].value AS email,
  len(list_filter(t, lambda e: e.tgt IS NOT NULL)) AS n_matched,
  len(list_filter(list_transform(t, lambda e, i: e.tgt IS NOT NULL AND
      len(list_filter(t[1:i - 1], lambda x: x.tgt = e.tgt AND x.value IS NOT NULL)) > 0),
      lambda x: x)) AS n_skipped,
  len(list_filter(t, lambda e: e.tgt IS NULL)) AS n_unmatched
FROM r
"""


@register("normalize_fields", SQL_NORMALIZE)
def q_normalize_fields(spark, sf_dir):
    """O-NRM1 + O-NRM8 (simple audit, counted) on records derived from customer."""
    recs = X.messy_records(spark, sf_dir)
    out = fields.normalize_fields(recs)
    m = F.col("audit.matched")
    return out.select("pos", "first_name", "last_name", "email",
                      F.size(m).alias("n_matched"),
                      F.size(F.filter(m, lambda e: e["action"] == fields.ACTION_SKIPPED)).alias("n_skipped"),
                      F.size("audit.unmatched").alias("n_unmatched"))


SQL_AUDIT_SUMMARY = f"""
WITH n AS ({SQL_NORMALIZE})
SELECT count(*) AS total_records, CAST(sum(n_matched - n_skipped) AS BIGINT) AS total_mapped,
       CAST(sum(n_skipped) AS BIGINT) AS total_skipped,
       CAST(sum(n_unmatched) AS BIGINT) AS total_unmatched
FROM n
"""


@register("audit_summary", SQL_AUDIT_SUMMARY)
def q_audit_summary(spark, sf_dir):
    """O-NRM9 totals over the O-NRM1 audit."""
    return fields.audit_summary(fields.normalize_fields(X.messy_records(spark, sf_dir)))


# ------------------------------------------------------------------- O-VAL1..3
_FAC = f"({X.sql_facilities()})"
_TERMS = "[" + ", ".join(O.q(t) for t in validate.RESTRICTED_TERMS) + "]"
SQL_VALIDATE = f"""
WITH f AS (SELECT * FROM {_FAC} t),
e AS (SELECT atom_id,
  list_filter([
    CASE WHEN facility_name IS NULL THEN 'facility_name'
         WHEN len(list_filter({_TERMS}, lambda x: contains(upper(facility_name), x))) > 0 THEN 'facility_name'
         WHEN trim(facility_name) = '' THEN 'facility_name' END,
    CASE WHEN addr1 IS NULL OR starts_with(upper(addr1), 'PATIENT DELIVERY') OR trim(addr1) = ''
         THEN 'addr1' END,
    CASE WHEN city IS NULL OR trim(city) = '' THEN 'city' END,
    CASE WHEN state IS NULL OR trim(state) = '' THEN 'state' END,
    CASE WHEN zip IS NULL OR trim(zip) = '' THEN 'zip' END,
    CASE WHEN auth_id IS NULL OR trim(auth_id) = '' THEN 'auth_id' END,
    CASE WHEN try_strptime(expire_date, '%Y-%m-%d') IS NULL THEN 'expire_date' END,
    CASE WHEN try_strptime(first_observed, '%Y-%m-%d') IS NULL THEN 'first_observed' END
  ], lambda x: x IS NOT NULL) AS errs,
  list_filter({_TERMS}, lambda x: contains(upper(facility_name), x))[1] AS restricted_term
FROM f)
SELECT atom_id, len(errs) = 0 AS is_valid, array_to_string(errs, ',') AS error_fields,
       restricted_term FROM e
"""


def _validated(spark, sf_dir) -> DataFrame:
    return validate.validate_facilities(X.facilities(spark, sf_dir))


@register("validate_facilities", SQL_VALIDATE)
def q_validate(spark, sf_dir):
    """O-VAL1 over facilities derived from customer."""
    v = _validated(spark, sf_dir)
    terms = F.array(*[F.lit(t) for t in validate.RESTRICTED_TERMS])
    term = F.get(F.filter(terms, lambda t: F.instr(F.upper(F.col("facility_name")), t) > 0), 0)
    return v.select("atom_id", (F.size("errors") == 0).alias("is_valid"),
                    F.array_join(F.transform("errors", lambda e: e["field"]), ",").alias("error_fields"),
                    term.alias("restricted_term"))


SQL_VALIDATION_SUMMARY = f"""
WITH v AS ({SQL_VALIDATE})
SELECT count(*) AS total, count(*) FILTER (WHERE is_valid) AS valid,
       count(*) FILTER (WHERE NOT is_valid) AS invalid,
       count(*) FILTER (WHERE list_contains(string_split(error_fields, ','), 'facility_name')) AS errors_facility_name,
       count(*) FILTER (WHERE list_contains(string_split(error_fields, ','), 'addr1')) AS errors_addr1,
       count(*) FILTER (WHERE list_contains(string_split(error_fields, ','), 'city')) AS errors_city,
       count(*) FILTER (WHERE list_contains(string_split(error_fields, ','), 'first_observed')) AS errors_first_observed
FROM v
"""


@register("validation_summary", SQL_VALIDATION_SUMMARY)
def q_validation_summary(spark, sf_dir):
    """O-VAL3 totals and per-rule counts."""
    s = validate.validation_summary(_validated(spark, sf_dir))
    return s.select("total", "valid", "invalid", "errors_facility_name", "errors_addr1",
                    "errors_city", "errors_first_observed")


# ------------------------------------------------------------------- O-FIL1..5
SQL_SEARCH = """
SELECT p_partkey, p_name, p_brand, p_type FROM part
WHERE contains(lower(p_name), 'ring') AND p_type = 'ECONOMY'
"""


def _part_as_facilities(spark, sf_dir) -> DataFrame:
    p = X.read(spark, sf_dir, "part")
    return p.select("p_partkey", F.col("p_name").alias("facility_name"),
                    F.col("p_brand").alias("city"), F.col("p_type").alias("state"),
                    F.lit(None).cast("string").alias("auth_type"))


@register("search", SQL_SEARCH)
def q_search(spark, sf_dir):
    """O-FIL4: name contains 'ring' and type equals ECONOMY (part as facilities)."""
    f = _part_as_facilities(spark, sf_dir)
    out = filters.search(f, facility_name="RING", city=None, state="ECONOMY", auth_type="")
    return out.select("p_partkey", F.col("facility_name").alias("p_name"),
                      F.col("city").alias("p_brand"), F.col("state").alias("p_type"))


SQL_SEARCH_BATCH = """
WITH req AS (SELECT DISTINCT p_brand AS brand, split_part(p_name, ' ', 2) AS term FROM part)
SELECT req.brand || '|' || req.term AS request_id, p_partkey
FROM req JOIN part ON part.p_brand = req.brand AND contains(lower(part.p_name), lower(req.term))
"""


@register("search_batch", SQL_SEARCH_BATCH)
def q_search_batch(spark, sf_dir):
    """O-FIL5: one request per distinct (brand, second word of name) in part."""
    p = X.read(spark, sf_dir, "part")
    req = p.select(F.col("p_brand").alias("city"),
                   F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)).alias("facility_name")) \
        .distinct().select(F.concat_ws("|", "city", "facility_name").alias("request_id"),
                           "facility_name", "city", F.lit(None).cast("string").alias("state"),
                           F.lit(None).cast("string").alias("auth_type"))
    f = _part_as_facilities(spark, sf_dir)
    return filters.search_batch(f, req).select("request_id", "p_partkey")


SQL_LOOKUP = """
WITH ids AS (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem
             UNION SELECT DISTINCT -l_suppkey - 1 FROM lineitem)
SELECT ids.o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderkey IS NOT NULL AS found
FROM ids LEFT JOIN orders o ON ids.o_orderkey = o.o_orderkey
"""


@register("lookup_by_id", SQL_LOOKUP)
def q_lookup(spark, sf_dir):
    """O-FIL1: every order key seen in lineitem plus unknown (negative) ids."""
    li = X.read(spark, sf_dir, "lineitem")
    ids = li.select(F.col("l_orderkey").alias("o_orderkey")).union(
        li.select((-F.col("l_suppkey") - 1).alias("o_orderkey"))).distinct()
    o = X.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return filters.lookup_by_id(o, ids, key="o_orderkey") \
        .select("o_orderkey", "o_custkey", "o_totalprice", "found")


SQL_BY_CITY = f"""
SELECT atom_id, city FROM {_FAC} t WHERE city = 'SPRINGFIELD'
"""


@register("by_city", SQL_BY_CITY)
def q_by_city(spark, sf_dir):
    """O-FIL2 (and O-FIL3 by the same rule) on the derived facilities."""
    return filters.by_city(X.facilities(spark, sf_dir), "SPRINGFIELD").select("atom_id", "city")


# ------------------------------------------------------------------- O-CHG2..4
SQL_PATCH = """
WITH ch AS (SELECT l_orderkey AS o_orderkey,
            arg_max(l_returnflag, {'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey,
                                   'd': l_extendedprice}) AS st
            FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey, coalesce(ch.st, o.o_orderstatus) AS o_orderstatus, o.o_totalprice
FROM orders o LEFT JOIN ch ON o.o_orderkey = ch.o_orderkey
"""


@register("patch_rows", SQL_PATCH)
def q_patch(spark, sf_dir):
    """O-CHG2: every lineitem row is a change {o_orderstatus: l_returnflag} to
    its order; several per key apply in (line number, part, supplier, price)
    order, so the last one wins."""
    li = X.read(spark, sf_dir, "lineitem")
    seq = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    ch = li.select(F.col("l_orderkey").alias("o_orderkey"), seq.alias("seq"),
                   F.create_map(F.lit("o_orderstatus"), F.col("l_returnflag")).alias("change"))
    o = X.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new, _report = changes.patch_rows(o, ch, key="o_orderkey", seq_col="seq")
    return new


SQL_DELETE = """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
"""


@register("delete_rows", SQL_DELETE)
def q_delete(spark, sf_dir):
    """O-CHG4: delete every order that has a returned line."""
    li = X.read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").select("l_orderkey")
    o = X.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    remaining, _ = changes.delete_rows(o, li, key="o_orderkey")
    return remaining


SQL_REPLACE = """
WITH ch AS (SELECT c_custkey AS o_orderkey, c_name AS o_orderpriority FROM customer)
SELECT o.o_orderkey, coalesce(ch.o_orderpriority, o.o_orderpriority) AS o_orderpriority
FROM orders o LEFT JOIN ch ON o.o_orderkey = ch.o_orderkey
"""


@register("replace_rows", SQL_REPLACE)
def q_replace(spark, sf_dir):
    """O-CHG3: customers replace the priority of the order with the same key."""
    ch = X.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_orderkey"),
                                                  F.col("c_name").alias("o_orderpriority"))
    o = X.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    new, _ = changes.replace_rows(o, ch, key="o_orderkey")
    return new


# ---------------------------------------------------------------- O-JOIN5 / geo
SQL_NEAR = f"""
SELECT l.id AS left_id, r.id AS right_id FROM {_LEFT} l JOIN {_RIGHT} r
ON abs(l.latitude - r.latitude) < 0.001 AND abs(l.longitude - r.longitude) < 0.001
"""


@register("near_join", SQL_NEAR)
def q_near(spark, sf_dir):
    """O-JOIN5: coordinate pairs within 0.001 degrees on both axes."""
    from ..operators import spatial
    l = X.left_addresses(spark, sf_dir).select("id", "latitude", "longitude")
    r = X.right_addresses(spark, sf_dir).select("id", "latitude", "longitude")
    return spatial.near_join(l, r, 0.001).select(F.col("l_id").alias("left_id"),
                                                 F.col("r_id").alias("right_id"))


SQL_HAVERSINE = f"""
SELECT l.id,
  round(2 * {geo.EARTH_RADIUS_M} * asin(sqrt(least(1.0,
    pow(sin((radians(r.latitude) - radians(l.latitude)) / 2), 2) +
    cos(radians(l.latitude)) * cos(radians(r.latitude)) *
    pow(sin((radians(r.longitude) - radians(l.longitude)) / 2), 2)))), 3) AS distance_m
FROM {_LEFT} l JOIN {_RIGHT} r ON l.id = r.id
"""


@register("geo_distance", SQL_HAVERSINE)
def q_geo(spark, sf_dir):
    """O-SIM17 (haversine method) between the two coordinates of each customer."""
    l = X.left_addresses(spark, sf_dir).select("id", F.col("latitude").alias("la"),
                                               F.col("longitude").alias("lo"))
    r = X.right_addresses(spark, sf_dir).select("id", "latitude", "longitude")
    j = l.join(r, "id")
    d = geo.geo_distance_m(F.col("la"), F.col("lo"), F.col("latitude"), F.col("longitude"),
                           method="haversine")
    return j.select("id", F.round(d, 3).alias("distance_m"))


# ----------------------------------------------- O-PRS4, O-STD3, O-BLK1, O-JOIN1
_PARENTS = f"({X.sql_parents()})"
_ATOMS = f"({X.sql_atoms()})"
_PREP_P = f"({O.prepared_sql(X.sql_parents())})"
_PREP_A = f"({O.prepared_sql(X.sql_atoms())})"

SQL_USPS = f"""
SELECT id, name, street_number, street_name, unit, city, state, zip5,
       array_to_string(keys, ',') AS block_keys
FROM {_PREP_A} t
"""


def _prepared(df: DataFrame) -> DataFrame:
    from ..operators import linkage as LK
    return LK.blocking_keys(LK.standardize_usps(df))


@register("usps_blocking", SQL_USPS)
def q_usps_blocking(spark, sf_dir):
    """O-PRS4 tagger + O-STD3 USPS components + O-STD4 name + O-BLK1 keys
    for every derived atom (the varied addresses)."""
    a = _prepared(X.atoms(spark, sf_dir))
    return a.select("id", "name", "street_number", "street_name", "unit", "city", "state", "zip5",
                    F.array_join("keys", ",").alias("block_keys"))


SQL_CANDIDATES = f"""
WITH pk AS (SELECT id, unnest(keys) AS k FROM {_PREP_P} p),
     ak AS (SELECT id, unnest(keys) AS k FROM {_PREP_A} a)
SELECT DISTINCT pk.id AS parent_id, ak.id AS atom_id FROM pk JOIN ak ON pk.k = ak.k
"""


def _candidates(spark, sf_dir) -> DataFrame:
    from ..operators import linkage as LK
    P = _prepared(X.parents(spark, sf_dir)).select("id", "keys")
    A = _prepared(X.atoms(spark, sf_dir)).select("id", "keys")
    return LK.candidate_pairs(P, A).select(F.col("p_id").alias("parent_id"),
                                           F.col("a_id").alias("atom_id"))


@register("candidate_pairs", SQL_CANDIDATES)
def q_candidate_pairs(spark, sf_dir):
    """O-JOIN1: parent/atom pairs sharing a blocking key, each once."""
    return _candidates(spark, sf_dir)


SQL_EVAL_BLOCKING = f"""
WITH c AS ({SQL_CANDIDATES}),
     t AS (SELECT id AS parent_id, id AS atom_id FROM {_ATOMS} a),
     j AS (SELECT c.parent_id IS NOT NULL AS pred, t.parent_id IS NOT NULL AS tru
           FROM c FULL OUTER JOIN t ON c.parent_id = t.parent_id AND c.atom_id = t.atom_id),
     s AS (SELECT count(*) FILTER (WHERE pred AND tru) AS tp,
                  count(*) FILTER (WHERE pred AND NOT tru) AS fp,
                  count(*) FILTER (WHERE tru AND NOT pred) AS fn,
                  count(*) FILTER (WHERE pred) AS np, count(*) FILTER (WHERE tru) AS nt FROM j)
SELECT round(tp / greatest(np, 1), 6) AS precision, round(tp / greatest(nt, 1), 6) AS recall,
       round(2 * (tp / greatest(np, 1)) * (tp / greatest(nt, 1)) /
             greatest(tp / greatest(np, 1) + tp / greatest(nt, 1), 1e-5), 6) AS f1_score,
       tp AS true_positives, fp AS false_positives, fn AS false_negatives
FROM s
"""


@register("evaluate_blocking", SQL_EVAL_BLOCKING)
def q_evaluate_blocking(spark, sf_dir):
    """O-EVA1: blocking recall/precision of O-JOIN1 against the known truth
    (each atom is the copy of the parent with the same key)."""
    from ..operators import linkage as LK
    truth = X.atoms(spark, sf_dir).select(F.col("id").alias("parent_id"), F.col("id").alias("atom_id"))
    ev = LK.evaluate_candidates(_prepared(X.parents(spark, sf_dir)), _prepared(X.atoms(spark, sf_dir)), truth)
    return ev.select(r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"),
                     r6(F.col("f1_score")).alias("f1_score"), "true_positives", "false_positives",
                     "false_negatives")


@register("linkage_features")
def q_linkage_features(spark, sf_dir):
    """O-FEA1 over every candidate pair."""
    from ..operators import linkage as LK
    from . import linkage as PL
    feats = PL.pair_features(X.parents(spark, sf_dir), X.atoms(spark, sf_dir), with_geo=False)
    # features are hundredths, for which this equals r6 without its decimals
    return feats.select(F.col("p_id").alias("parent_id"), F.col("a_id").alias("atom_id"),
                        *[(F.rint(F.col(c) * 1e6) / 1e6).alias(c) for c in LK.FEATURES_9])


@register("link_records")
def q_link_records(spark, sf_dir):
    """O-LNK1 end to end on the derived parents/atoms: O-FEA1 features of the
    candidate pairs (computed and persisted once, shared with the training
    of the forest, O-ML1: 100 trees, seed 42, label = same customer), then
    score (O-ML3), classify (O-CLS1), explain (O-LNK3) and present (O-LNK4).
    The same steps composed as ``plans.linkage.link_records`` are tested in
    pytest."""
    from ..operators import linkage as LK
    from ..operators import model as M
    model, feats, with_records = _forest_and_features(spark, sf_dir)
    scored = M.score_matches(feats, model, features=LK.FEATURES_9)
    return LK.readable(LK.explain(with_records(LK.classify(scored))))


# ------------------------------------------------------------ O-NRM4..8 (full)
def _sql_map(d: dict[str, str]) -> str:
    return "MAP([" + ", ".join(O.q(k) for k in d) + "], [" + ", ".join(O.q(v) for v in d.values()) + "])"


_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _sql_norm_value(tgt: str, v: str) -> str:
    email = f"CASE WHEN {v} IS NULL OR {v} = '' THEN NULL ELSE {_STRIP.format(x='lower(' + v + ')')} END"
    phone = f"CASE WHEN {v} IS NULL OR {v} = '' THEN NULL ELSE regexp_replace({v}, '[^0-9+]', '', 'g') END"
    return (f"CASE WHEN {v} IS NULL THEN NULL WHEN {tgt} = 'email' THEN {email} "
            f"WHEN {tgt} = 'phone' THEN {phone} ELSE {_STRIP.format(x=v)} END")


_FULL_TARGETS = ["customer_id", "loyalty_level", "first_name", "last_name", "email", "phone", "address"]
_REV_CUSTOMER = fields._reverse_map("customer", fields.FULL_MAPPINGS)
SQL_NORMALIZE_FULL = f"""
WITH r0 AS (SELECT pos, list_transform(map_entries(record), lambda e:
             {{'key': e.key, 'value': e.value,
               'tgt': {_sql_map(_REV_CUSTOMER)}[{_CLEAN}]}}) AS t0 FROM {_MESSY} m),
r AS (SELECT pos, list_transform(t0, lambda e: {{'key': e.key, 'value': e.value, 'tgt': e.tgt,
               'nv': {_sql_norm_value('e.tgt', 'e.value')}}}) AS t FROM r0),
a AS (SELECT pos, t,
  list_transform(t, lambda e, i: CASE WHEN e.tgt IS NULL THEN NULL
    WHEN len(list_filter(t[1:i - 1], lambda x: x.tgt = e.tgt)) = 0 THEN 'mapped'
    WHEN e.value IS NOT NULL AND len(list_filter(t[1:i - 1], lambda x: x.tgt = e.tgt AND x.nv IS NOT NULL)) = 0
      THEN 'overwritten' ELSE 'skipped' END) AS acts
  FROM r),
v AS (SELECT pos, t, acts,
  {", ".join(f"list_filter(t, lambda e: e.tgt = '{c}' AND e.nv IS NOT NULL)[1].nv AS v_{c}" for c in _FULL_TARGETS)},
  {", ".join(f"len(list_filter(t, lambda e: e.tgt = '{c}')) > 0 AS p_{c}" for c in _FULL_TARGETS)}
  FROM a)
SELECT pos,
  {", ".join(f"v_{c} AS {c}" for c in _FULL_TARGETS if c != "loyalty_level")},
  coalesce(v_loyalty_level, 'standard') AS loyalty_level,
  CAST({" + ".join(f"CAST(p_{c} AS INTEGER)" for c in _FULL_TARGETS if c != "loyalty_level")}
    + 1 AS BIGINT) AS n_fields,
  len(list_filter(acts, lambda x: x = 'mapped')) AS n_mapped,
  len(list_filter(acts, lambda x: x = 'overwritten')) AS n_overwritten,
  len(list_filter(acts, lambda x: x = 'skipped')) AS n_skipped,
  len(list_filter(t, lambda e: e.tgt IS NULL)) AS n_unmatched,
  CAST(CASE WHEN v_loyalty_level IS NULL THEN 1 ELSE 0 END AS BIGINT) AS n_defaults,
  CAST(CASE WHEN v_customer_id IS NULL THEN 1 ELSE 0 END + CASE WHEN v_email IS NULL THEN 1 ELSE 0 END
    AS BIGINT) AS n_errors
FROM v
"""


@register("normalize_full", SQL_NORMALIZE_FULL)
def q_normalize_full(spark, sf_dir):
    """O-NRM4..8 with mapping key 'customer': reverse alias map plus default
    aliases, value rules (email, phone, strip), defaults, required fields,
    full audit (counted per action)."""
    out = fields.normalize_full(X.messy_records(spark, sf_dir), "customer")
    n = F.col("normalized")
    m = F.col("audit.matched")
    cols = [n[c].alias(c) for c in _FULL_TARGETS]

    def count(action):
        return F.size(F.filter(m, lambda e: e["action"] == action))

    return out.select("pos", *cols, F.size(n).alias("n_fields"),
                      count(fields.ACTION_MAPPED).alias("n_mapped"),
                      count(fields.ACTION_OVERWRITTEN).alias("n_overwritten"),
                      count(fields.ACTION_SKIPPED).alias("n_skipped"),
                      F.size("audit.unmatched").alias("n_unmatched"),
                      F.size("audit.defaults_applied").alias("n_defaults"),
                      F.size("audit.validation_errors").alias("n_errors"))


# ------------------------------------------------------------ O-NRM2 / O-NRM3
_FUZZY = fields.FUZZY_MAPPINGS["default"]


def _sql_fuzzy_tgt(name: str) -> str:
    parts = []
    for tgt, aliases in _FUZZY.items():
        al = "[" + ", ".join(O.q(a.lower()) for a in aliases) + "]"
        parts.append(f"WHEN len(list_filter({al}, lambda a: contains({name}, a))) > 0 THEN '{tgt}'")
    return "CASE " + " ".join(parts) + " END"


SQL_FUZZY = f"""
WITH r AS (SELECT pos, list_transform(map_entries(record), lambda e:
             {{'value': e.value, 'tgt': {_sql_fuzzy_tgt(_CLEAN)}}}) AS t FROM {_MESSY} m)
SELECT pos,
  {", ".join(f"CASE WHEN len(list_filter(t, lambda e: e.tgt = '{c}')) > 0 THEN list_filter(t, lambda e: e.tgt = '{c}')[-1].value ELSE {O.q('n/a') if c == 'city' else 'NULL'} END AS {c}" for c in _FUZZY)}
FROM r
"""


@register("normalize_fuzzy", SQL_FUZZY)
def q_normalize_fuzzy(spark, sf_dir):
    """O-NRM2: contains-match of aliases, first target wins, last source
    wins, default for city 'n/a'."""
    return fields.normalize_fields_fuzzy(X.messy_records(spark, sf_dir), "default",
                                         default_values={"city": "n/a"})


_FUZZY_C = fields.FUZZY_MAPPINGS["customer"]


def _sql_fuzzy_tgt_c(name: str) -> str:
    parts = []
    for tgt, aliases in _FUZZY_C.items():
        al = "[" + ", ".join(O.q(a.lower()) for a in aliases) + "]"
        parts.append(f"WHEN len(list_filter({al}, lambda a: contains({name}, a))) > 0 THEN '{tgt}'")
    return "CASE " + " ".join(parts) + " END"


SQL_MODEL = f"""
WITH r AS (SELECT pos, list_transform(map_entries(record), lambda e:
             {{'value': e.value, 'tgt': {_sql_fuzzy_tgt_c(_CLEAN)}}}) AS t FROM {_MESSY} m),
v AS (SELECT pos,
  {", ".join(f"CASE WHEN len(list_filter(t, lambda e: e.tgt = '{c}')) > 0 THEN list_filter(t, lambda e: e.tgt = '{c}')[-1].value ELSE {O.q('Basic') if c == 'membership_level' else 'NULL'} END AS {c}" for c in _FUZZY_C)}
  FROM r)
SELECT *, CAST(CAST(customer_id IS NULL AS INTEGER) + CAST(email IS NULL AS INTEGER) AS BIGINT) AS n_errors
FROM v
"""


@register("to_model", SQL_MODEL)
def q_to_model(spark, sf_dir):
    """O-NRM3: customer model (membership_level defaults to 'Basic'),
    required customer_id and email."""
    out = fields.to_model(X.messy_records(spark, sf_dir), "customer",
                          required=["customer_id", "email"])
    return out.select("pos", *_FUZZY_C.keys(), F.size("errors").alias("n_errors"))


# ------------------------------------------------------ JSON records (O-SRC1)
_EVENT_MAPPING = {"default": {"kind": ["event_type", "type"], "user": ["user_id", "uid"],
                              "score": ["k", "score"]}}
SQL_EVENTS = """
WITH r AS (SELECT event_id AS pos,
  list_concat(map_entries(CAST(json(props) AS MAP(VARCHAR, VARCHAR))),
              [{'key': 'Event_Type', 'value': event_type},
               {'key': 'user_id', 'value': CAST(user_id AS VARCHAR)}]) AS t FROM events)
SELECT pos,
  list_filter(t, lambda e: lower(e.key) IN ('event_type', 'type') AND e.value IS NOT NULL)[1].value AS kind,
  list_filter(t, lambda e: lower(e.key) IN ('user_id', 'uid') AND e.value IS NOT NULL)[1].value AS "user",
  list_filter(t, lambda e: lower(e.key) IN ('k', 'score') AND e.value IS NOT NULL)[1].value AS score,
  len(list_filter(t, lambda e: lower(e.key) NOT IN ('event_type', 'type', 'user_id', 'uid', 'k', 'score')))
    AS n_unmatched
FROM r
"""


@register("normalize_event_props", SQL_EVENTS)
def q_event_props(spark, sf_dir):
    """O-SRC1 path for JSON text columns: ``events.props`` parsed into an
    ordered record map, extended with two columns, then O-NRM1."""
    from ..sources import records as R
    ev = X.read(spark, sf_dir, "events")
    recs = R.records_from_json_column(ev, "props", "event_id", keep=["event_type", "user_id"])
    recs = recs.select("pos", F.map_concat("record", F.create_map(
        F.lit("Event_Type"), F.col("event_type"), F.lit("user_id"), F.col("user_id").cast("string"))).alias("record"))
    out = fields.normalize_fields(recs, mappings=_EVENT_MAPPING)
    return out.select("pos", "kind", "user", "score", F.size("audit.unmatched").alias("n_unmatched"))


# ------------------------------------------------------------------ O-JOIN6
_JW_LN = O.jaro_winkler_sql("l.k", "r.k")
SQL_LINK_NAMES = f"""
WITH l AS (SELECT id, name, lower(name) AS k FROM {_PARENTS} p),
r AS (SELECT id, name, lower(name) AS k FROM {_ATOMS} a),
s AS (SELECT l.id AS left_id, l.name AS left_name, r.id AS right_id, r.name AS right_name,
             {_JW_LN} AS score FROM l CROSS JOIN r),
b AS (SELECT left_id, arg_max({{'right_id': right_id, 'right_name': right_name, 'score': score}},
                              {{'s': score, 'o': -CAST(right_id AS BIGINT)}}) AS m, any_value(left_name) AS left_name
      FROM s WHERE score > 0.8 GROUP BY left_id)
SELECT left_id, left_name, m.right_id AS right_id, m.right_name AS right_name, round(m.score, 6) AS score
FROM b
"""


@register("link_names", SQL_LINK_NAMES)
def q_link_names(spark, sf_dir):
    """O-JOIN6: best atom name per parent name by lower-cased Jaro-Winkler
    > 0.8 over all pairs (the oracle scores every pair)."""
    p = X.parents(spark, sf_dir)
    a = X.atoms(spark, sf_dir).withColumn("rord", F.col("id").cast("long"))
    out = pairs.link_names(p, a, 0.8, "name", "name", "id", right_order="rord")
    return out.withColumn("score", r6(F.col("score")))


# ------------------------------------------------------------------ O-JOIN3
def _sql_literal_norm(col: str) -> str:
    s = f"lower({col})"
    for full, abbr in text.LITERAL_ABBREVIATIONS:
        for a, b in ((f" {full} ", f" {abbr} "), (f" {full},", f" {abbr},"),
                     (f" {full}.", f" {abbr}."), (f" {abbr}.", f" {abbr} ")):
            s = f"replace({s}, {O.q(a)}, {O.q(b)})"
    s = f"translate({s}, ',.#-/\\', '      ')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def _sql_prs2(norm: str) -> dict[str, str]:
    toks = f"list_filter(string_split({norm}, ' '), lambda t: t <> '')"
    digits = f"list_filter({toks}, lambda t: regexp_full_match(t, '[0-9]+'))"
    zips = f"list_filter({digits}, lambda t: length(t) = 5)"
    idx = (f"list_filter(list_transform({toks}, lambda t, i: CASE WHEN t IN ('apt', 'unit', 'ste', "
           f"'suite', '#') AND i < len({toks}) THEN i END), lambda x: x IS NOT NULL)")
    return {"house": f"{digits}[1]", "zip": f"{zips}[-1]",
            "unit": f"CASE WHEN len({idx}) > 0 THEN {toks}[{idx}[-1] + 1] END"}


def _sql_v2_score() -> str:
    jw = O.jaro_winkler_sql
    parts = []
    for comp, w in (("house", 0.4), ("unit", 0.1), ("zip", 0.1)):
        a, b = f"l.{comp}", f"r.{comp}"
        both = f"({a} IS NOT NULL AND {a} <> '' AND {b} IS NOT NULL AND {b} <> '')"
        parts.append((f"CASE WHEN {both} THEN {jw(a, b)} * {w} ELSE 0 END",
                      f"CASE WHEN {both} THEN {w} ELSE 0 END"))
    num = " + ".join(p[0] for p in parts)
    den = " + ".join(p[1] for p in parts)
    overall = jw("l.norm", "r.norm")
    return f"CASE WHEN ({den}) = 0 THEN {overall} ELSE 0.5 * {overall} + 0.5 * (({num}) / ({den})) END"


def _sql_v2_side(src: str) -> str:
    n = _sql_literal_norm("address")
    pr = _sql_prs2("norm")
    return (f"SELECT id, address, norm, {pr['house']} AS house, {pr['zip']} AS zip, {pr['unit']} AS unit "
            f"FROM (SELECT id, address, {n} AS norm FROM {src} t) x")


SQL_LINK_ADDRESSES = f"""
WITH l AS ({_sql_v2_side(_LEFT)}), r AS ({_sql_v2_side(_RIGHT)}),
c AS (SELECT DISTINCT l.id AS lid, r.id AS rid FROM l JOIN r
      ON (l.house IS NOT NULL AND l.house = r.house) OR (l.zip IS NOT NULL AND l.zip = r.zip)),
s AS (SELECT l.id AS record1_id, l.address AS record1_address, r.id AS record2_id,
             r.address AS record2_address, {_sql_v2_score()} AS similarity
      FROM c JOIN l ON c.lid = l.id JOIN r ON c.rid = r.id),
b AS (SELECT record1_id, any_value(record1_address) AS record1_address,
             arg_max({{'id': record2_id, 'a': record2_address, 's': similarity}},
                     {{'s': similarity, 'o': -record2_id}}) AS m
      FROM s WHERE similarity > 0.85 GROUP BY record1_id)
SELECT record1_id, record1_address, m.id AS record2_id, m.a AS record2_address,
       round(m.s, 6) AS similarity FROM b
"""


#: the same over all pairs
SQL_LINK_ADDRESSES_ALL = f"""
WITH l AS ({_sql_v2_side(_LEFT)}), r AS ({_sql_v2_side(_RIGHT)}),
s AS (SELECT l.id AS record1_id, l.address AS record1_address, r.id AS record2_id,
             r.address AS record2_address, {_sql_v2_score()} AS similarity
      FROM l CROSS JOIN r),
b AS (SELECT record1_id, any_value(record1_address) AS record1_address,
             arg_max({{'id': record2_id, 'a': record2_address, 's': similarity}},
                     {{'s': similarity, 'o': -record2_id}}) AS m
      FROM s WHERE similarity > 0.85 GROUP BY record1_id)
SELECT record1_id, record1_address, m.id AS record2_id, m.a AS record2_address,
       round(m.s, 6) AS similarity FROM b
"""


@register("link_addresses", SQL_LINK_ADDRESSES_ALL)
def q_link_addresses(spark, sf_dir):
    """O-JOIN3 / O-STD2 / O-PRS2 / O-SIM16: best varied address per customer
    address above 0.85, over all pairs."""
    out = pairs.link_addresses(X.left_addresses(spark, sf_dir), X.right_addresses(spark, sf_dir))
    return out.withColumn("similarity", r6(F.col("similarity")))


@register("link_addresses_blocked", SQL_LINK_ADDRESSES)
def q_link_addresses_blocked(spark, sf_dir):
    """The house-or-ZIP form of O-JOIN3: best varied address per customer
    address above 0.85 among those of equal house number or ZIP."""
    out = pairs.link_addresses(X.left_addresses(spark, sf_dir), X.right_addresses(spark, sf_dir),
                               mode="blocked")
    return out.withColumn("similarity", r6(F.col("similarity")))


# ------------------------------------------------------------------ O-JOIN4
def _misspelt(c, id_col="id"):
    """``c`` with a letter dropped, two swapped or a word added, by the id."""
    n = F.length(c)
    at = F.greatest(F.lit(2), F.pmod(F.xxhash64(id_col), F.greatest(n - 1, F.lit(1))).cast("int") + 1)
    kind = F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(3))
    head, here = F.substring(c, F.lit(1), at - 1), F.substring(c, at, F.lit(1))
    return F.when(kind == 0, F.concat(head, F.substring(c, at + 1, n))) \
        .when(kind == 1, F.concat(head, F.substring(c, at + 1, F.lit(1)), here, F.substring(c, at + 2, n))) \
        .otherwise(F.concat(c, F.lit(" Area")))


@register("fuzzy_lookup")
def q_fuzzy_lookup(spark, sf_dir):
    """O-JOIN4 / O-SIM19: each atom's city, misspelt (a letter dropped, two
    swapped or a word added, by the id), against all parent cities."""
    from ..operators import linkage as LK
    # the tagger's expression is used once: cut before the misspelling repeats it
    a = LK.standardize_usps(X.atoms(spark, sf_dir)).select("id", F.initcap("city").alias("c")).checkpoint(eager=True)
    ref = X.parents(spark, sf_dir).select(
        F.split_part(F.col("address"), F.lit(", "), F.lit(3)).alias("city"))
    return pairs.fuzzy_lookup(a.select("id", _misspelt(F.col("c")).alias("city")), ref, "city", cutoff=70)


@register("fuzzy_lookup_names")
def q_fuzzy_lookup_names(spark, sf_dir):
    """O-JOIN4 / O-SIM19: each atom's name, misspelt the same way, against all
    parent names (as many references as customers)."""
    a = X.atoms(spark, sf_dir).select("id", _misspelt(F.col("name")).alias("name"))
    return pairs.fuzzy_lookup(a, X.parents(spark, sf_dir).select("name"), "name", cutoff=70)


# ---------------------------------------------------------------- O-DED1/2
def _sql_dedupe_names(t: float) -> str:
    jw = O.jaro_winkler_sql("x.k", "n.k")
    jw2 = O.jaro_winkler_sql("x.k", "lower(p.p_name)")
    return f"""
WITH RECURSIVE names AS (
  SELECT lower(p_name) AS k, min(p_partkey) AS ord,
         row_number() OVER (ORDER BY min(p_partkey)) AS rn
  FROM part GROUP BY lower(p_name)),
walk(rn, leaders) AS (
  SELECT 0, []::STRUCT(k VARCHAR, ord BIGINT)[]
  UNION ALL
  SELECT n.rn, CASE WHEN len(list_filter(w.leaders, lambda x: {jw} >= {t})) = 0
                    THEN list_append(w.leaders, {{'k': n.k, 'ord': n.ord}}) ELSE w.leaders END
  FROM walk w JOIN names n ON n.rn = w.rn + 1),
fin AS (SELECT leaders FROM walk WHERE rn = (SELECT max(rn) FROM walk))
SELECT p.p_partkey, list_filter(fin.leaders, lambda x: {jw2} >= {t})[1].ord AS leader,
       p.p_partkey = list_filter(fin.leaders, lambda x: {jw2} >= {t})[1].ord AS is_leader
FROM part p, fin
"""


@register("dedupe_names", _sql_dedupe_names(0.85))
def q_dedupe_names(spark, sf_dir):
    """O-DED1: part names (lower-cased) deduplicated in part-key order with
    Jaro-Winkler >= 0.85; leader = part key of the group's first row."""
    from ..operators import dedupe
    p = X.read(spark, sf_dir, "part").select("p_partkey", "p_name")
    out = dedupe.dedupe(p, "p_name", 0.85, order_col="p_partkey")
    return out.select("p_partkey", "leader", "is_leader")


SQL_DEDUPE_NEAR = f"""
WITH RECURSIVE pts AS (SELECT id, latitude, longitude, row_number() OVER (ORDER BY id) AS rn
                       FROM {_LEFT} t),
walk(rn, leaders) AS (
  SELECT 0, []::STRUCT(id BIGINT, la DOUBLE, lo DOUBLE)[]
  UNION ALL
  SELECT n.rn, CASE WHEN len(list_filter(w.leaders, lambda x: abs(x.la - n.latitude) < 0.05
                                         AND abs(x.lo - n.longitude) < 0.05)) = 0
                    THEN list_append(w.leaders, {{'id': n.id, 'la': n.latitude, 'lo': n.longitude}})
                    ELSE w.leaders END
  FROM walk w JOIN pts n ON n.rn = w.rn + 1),
fin AS (SELECT leaders FROM walk WHERE rn = (SELECT max(rn) FROM walk))
SELECT p.id, list_filter(fin.leaders, lambda x: abs(x.la - p.latitude) < 0.05
                          AND abs(x.lo - p.longitude) < 0.05 AND x.id <= p.id)[1].id AS leader
FROM pts p, fin
"""


@register("dedupe_near", SQL_DEDUPE_NEAR)
def q_dedupe_near(spark, sf_dir):
    """O-DED2: customer coordinates deduplicated in key order, |dlat| and
    |dlon| < 0.05 (grid-binned equi-join edges, then leader rounds)."""
    from ..operators import dedupe
    a = X.left_addresses(spark, sf_dir).select("id", "latitude", "longitude")
    return dedupe.dedupe_near(a, 0.05, order_col="id").select("id", "leader")


# ------------------------------------------------------------------ O-CHG1
SQL_INSERT = """
WITH m AS (SELECT max(o_orderkey) AS mx FROM orders)
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
UNION ALL
SELECT m.mx + row_number() OVER (ORDER BY c_custkey), c_custkey, 'N', c_acctbal, c_mktsegment
FROM customer, m
"""


@register("insert_rows", SQL_INSERT)
def q_insert(spark, sf_dir):
    """O-CHG1: one new order per customer without a key; keys continue
    after the largest order key in customer-key order."""
    o = X.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                              "o_totalprice", "o_orderpriority")
    c = X.read(spark, sf_dir, "customer")
    new = c.select(F.col("c_custkey").alias("o_custkey"), F.lit("N").alias("o_orderstatus"),
                   F.col("c_acctbal").alias("o_totalprice"),
                   F.col("c_mktsegment").alias("o_orderpriority"), F.col("c_custkey").alias("_ord"))
    return changes.insert_rows(o, new, key="o_orderkey", order_col="_ord")


# ------------------------------------------------------------- O-PRS3 / PRS5
def _sql_prs3(col: str) -> dict[str, str]:
    s = f"coalesce({col}, '')"
    zr = f"regexp_extract({s}, '(\\d{{5}})(?:-\\d{{4}})?', 0)"
    s1 = f"replace({s}, {zr}, '')"
    st = f"regexp_extract({s1}, '\\b([A-Z]{{2}})\\b', 0)"
    s2 = f"replace({s1}, {st}, '')"
    num = f"NULLIF(regexp_extract({s2}, '^\\s*(\\d+)', 1), '')"
    s3 = f"regexp_replace({s2}, '^(\\s*)\\d+', '\\1')"
    parts = f"list_filter(list_transform(string_split({s3}, ','), lambda p: {O.strip_sql('p')}), lambda p: p <> '')"
    return {"number": num, "street": f"({parts})[1]",
            "city": f"CASE WHEN len({parts}) > 1 THEN ({parts})[-1] END",
            "state": f"NULLIF({st}, '')", "zip_code": f"NULLIF({zr}, '')"}


def _sql_parsers() -> str:
    c1 = O.components_sql("address")
    p3 = _sql_prs3("address")
    tg = O.tag_sql("address")
    street4 = (f"CASE WHEN {tg['StreetName']} IS NOT NULL THEN concat_ws(' ', "
               f"{tg['StreetNamePreDirectional']}, {tg['StreetName']}, {tg['StreetNamePostType']}) END")
    cols = {
        "components": {"number": c1["house_number"], "street": "NULL", "city": "NULL",
                       "state": "NULL", "zip_code": c1["zipcode"]},
        "regex": p3,
        "tagger": {"number": tg["AddressNumber"], "street": street4, "city": tg["PlaceName"],
                   "state": tg["StateName"], "zip_code": tg["ZipCode"]},
    }
    sel = ", ".join(f"{v} AS {p}_{f}" for p, d in cols.items() for f, v in d.items())
    rows = f"SELECT {sel} FROM {_RIGHT} t"
    aggs = ["count(*) AS n"]
    for a, b in text.PARSER_PAIRS:
        for f in text.PARSER_FIELDS:
            aggs.append(f"round(avg(CASE WHEN {a}_{f} IS NOT DISTINCT FROM {b}_{f} THEN 1.0 ELSE 0.0 END), 6)"
                        f" AS agree_{a}_{b}_{f}")
    return f"SELECT {', '.join(aggs)} FROM ({rows}) r"


@register("compare_parsers", _sql_parsers())
def q_compare_parsers(spark, sf_dir):
    """O-PRS5 (with O-PRS1, O-PRS3, O-PRS4): agreement of the three parsers
    per field over every varied address."""
    a = text.with_tags(X.right_addresses(spark, sf_dir), "address", "_t")
    return text.parser_agreement(
        a.select(text.compare_parsers(F.col("address"), F.col("_t")).alias("parsers")))


# ------------------------------------------------------------------ O-JOIN7
SQL_GEOCODE = f"""
WITH p1 AS (SELECT address AS k, latitude, longitude FROM {_LEFT} t WHERE id % 2 = 0),
     p2 AS (SELECT address AS k, latitude, longitude FROM {_RIGHT} t WHERE id % 3 = 1),
     a AS (SELECT * FROM {_ATOMS} x)
SELECT a.id, coalesce(p1.latitude, p2.latitude) AS latitude,
       coalesce(p1.longitude, p2.longitude) AS longitude,
       coalesce(p1.latitude, p2.latitude) IS NOT NULL AS geocoded,
       CASE WHEN p1.latitude IS NOT NULL THEN 'provider_1'
            WHEN p2.latitude IS NOT NULL THEN 'provider_2' END AS geocoder
FROM a LEFT JOIN p1 ON a.address = p1.k LEFT JOIN p2 ON a.address = p2.k
"""


@register("geocode_lookup", SQL_GEOCODE)
def q_geocode(spark, sf_dir):
    """O-JOIN7: atoms geocoded from two provider tables in priority order
    (provider 1: even-keyed customer addresses; provider 2: a third of the
    varied addresses)."""
    from ..operators import linkage as LK
    p1 = X.left_addresses(spark, sf_dir).where(F.col("id") % 2 == 0).select("address", "latitude", "longitude")
    p2 = X.right_addresses(spark, sf_dir).where(F.col("id") % 3 == 1).select("address", "latitude", "longitude")
    out = LK.geocode_lookup(X.atoms(spark, sf_dir), [p1, p2], "address")
    return out.select("id", "latitude", "longitude", "geocoded", "geocoder")


# ---------------------------------------------------------------- O-PRJ1..3
def _sql_format() -> str:
    tg = O.tag_sql("address")
    e = lambda x: f"coalesce({x}, '')"
    std = (f"trim({e(tg['AddressNumber'])} || ' ' || {e(tg['StreetName'])} || ' ' || "
           f"{e(tg['StreetNamePostType'])} || ', ' || {e(tg['PlaceName'])} || ', ' || "
           f"{e(tg['StateName'])} || ' ' || {e(tg['ZipCode'])})")
    prep = f"({O.prepared_sql(X.sql_parents())})"
    gq = ("concat_ws(', ', CASE WHEN street_number IS NOT NULL AND street_name IS NOT NULL "
          "THEN street_number || ' ' || street_name ELSE address END, city, state, zip5, 'USA')")
    return (f"SELECT id, street_number, zip5, {std} AS standardized_address, {gq} AS geocode_query "
            f"FROM {prep} t")


@register("format_addresses", _sql_format())
def q_format(spark, sf_dir):
    """O-PRJ1 (camelCase field selection), O-PRJ2 (formatted address from
    the tags), O-PRJ3 (geocoder query text) for every parent."""
    from ..operators import linkage as LK
    p = text.with_tags(X.parents(spark, sf_dir), "address", "_t")
    t = F.col("_t")
    std = text.format_address(t["AddressNumber"], t["StreetName"], t["StreetNamePostType"],
                              t["PlaceName"], t["StateName"], t["ZipCode"])
    u = LK.standardize_usps(p.withColumn("standardized_address", std), tags_col="_t")
    u = u.withColumn("geocode_query", filters.geocode_query(
        F.col("street_number"), F.col("street_name"), F.col("address"), F.col("city"),
        F.col("state"), F.col("zip5")))
    return filters.project(u, ["id", "streetNumber", "zip5", "standardizedAddress", "geocodeQuery"])


# ------------------------------------------------------- O-SNK1 + O-SRC3 loop
SQL_ROUNDTRIP = f"""
WITH n AS ({SQL_NORMALIZE}) SELECT pos, first_name, last_name, email FROM n
"""


@register("records_roundtrip", SQL_ROUNDTRIP)
def q_roundtrip(spark, sf_dir):
    """O-SNK1 -> O-SRC3: normalized records written as JSON lines (NULLs
    kept) under the shared checkpoint folder, read back as ordered records."""
    from ..session import scratch_path
    from ..sources import records as R
    out = fields.normalize_fields(X.messy_records(spark, sf_dir), audit=False)
    path = scratch_path(spark, "records") + ".json"
    R.write_records(out, path)
    back = R.read_records(spark, path, lines=True)
    rec = F.col("record")
    return back.select(rec["pos"].cast("long").alias("pos"), rec["first_name"].alias("first_name"),
                       rec["last_name"].alias("last_name"), rec["email"].alias("email"))


# ------------------------------------------------------------------ O-STR1
def _customer_schema(spark, sf_dir):
    return X.read(spark, sf_dir, "customer").schema


@register("validate_stream", SQL_VALIDATE)
def q_validate_stream(spark, sf_dir):
    """O-STR1: the customer table read as a file stream, facilities derived,
    validated, written by two checkpointed parquet sinks (valid / invalid,
    trigger availableNow), then read back."""
    from ..session import scratch_path
    from ..streaming import streams as ST
    src = ST.read_table_stream(spark, sf_dir, "customer.parquet", _customer_schema(spark, sf_dir))
    fac = X.facilities_from(src.select("c_custkey", "c_nationkey", "c_name", "c_mktsegment"))
    base = scratch_path(spark, "validate-stream")
    qs = ST.start_split_sinks(ST.validate_stream(fac), f"{base}/valid", f"{base}/invalid",
                              f"{base}/_checkpoints")
    for q in qs:
        q.awaitTermination()
    valid = spark.read.parquet(f"{base}/valid").withColumn(
        "errors", F.array().cast("array<struct<field:string,error:string>>"))
    invalid = spark.read.parquet(f"{base}/invalid")
    v = valid.unionByName(invalid)
    terms = F.array(*[F.lit(t) for t in validate.RESTRICTED_TERMS])
    term = F.get(F.filter(terms, lambda t: F.instr(F.upper(F.col("facility_name")), t) > 0), 0)
    return v.select("atom_id", (F.size("errors") == 0).alias("is_valid"),
                    F.array_join(F.transform("errors", lambda e: e["field"]), ",").alias("error_fields"),
                    term.alias("restricted_term"))


SQL_NORMALIZE_STREAM = SQL_NORMALIZE


@register("normalize_stream", SQL_NORMALIZE_STREAM)
def q_normalize_stream(spark, sf_dir):
    """O-STR1: messy records derived from a customer file stream, O-NRM1 per
    arrival, written by a checkpointed parquet sink, read back."""
    from ..session import scratch_path
    from ..streaming import streams as ST
    src = ST.read_table_stream(spark, sf_dir, "customer.parquet", _customer_schema(spark, sf_dir))
    recs = X.messy_records_from(src)
    out = ST.normalize_stream(recs)
    m = F.col("audit.matched")
    flat = out.select("pos", "first_name", "last_name", "email",
                      F.size(m).alias("n_matched"),
                      F.size(F.filter(m, lambda e: e["action"] == fields.ACTION_SKIPPED)).alias("n_skipped"),
                      F.size("audit.unmatched").alias("n_unmatched"))
    base = scratch_path(spark, "normalize-stream")
    q = flat.writeStream.format("parquet").option("path", f"{base}/out") \
        .option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


# ------------------------------------------- O-SIM5, 9..13, 15, 19 (Arrow UDFs)
@register("fuzzy_scores")
def q_fuzzy_scores(spark, sf_dir):
    """O-SIM5, 9, 10, 11, 12, 13, 15, 16, 19 via ``score_pairs`` on every
    (customer, varied) address pair (Python string metrics: rows-only check;
    unit tests pin their values)."""
    l = X.left_addresses(spark, sf_dir).select("id", F.col("address").alias("x"))
    r = X.right_addresses(spark, sf_dir).select("id", F.col("address").alias("y"))
    metrics = ["jaro_winkler_gated", "seq_ratio", "ratio", "token_sort_ratio", "token_set_ratio",
               "hybrid", "address_similarity_v1", "address_similarity_v2", "best_of"]
    out = pairs.score_pairs(l.join(r, "id"), "x", "y", metrics)
    rounded = {"jaro_winkler_gated", "seq_ratio", "hybrid", "address_similarity_v1",
               "address_similarity_v2"}
    return out.select("id", *[(r6(F.col(m)) if m in rounded else F.col(m)).alias(m) for m in metrics])


@register("address_pair_features")
def q_pair_features(spark, sf_dir):
    """O-FEA2: the 13 address-pair features for every (customer, varied) pair."""
    from ..operators import model as M
    l = X.left_addresses(spark, sf_dir).select("id", F.col("address").alias("addr1"))
    r = X.right_addresses(spark, sf_dir).select("id", F.col("address").alias("addr2"))
    f = M.address_pair_features(l.join(r, "id"))
    return f.select("id", *[r6(F.col(c)).alias(c) for c in M.PAIR_FEATURES_13])


def _sql_pair_features() -> str:
    c1, c2 = O.components_sql("a"), O.components_sql("b")

    def both(k):
        return f"(coalesce({k}1, '') <> '' AND coalesce({k}2, '') <> '')"

    def same(k):
        return f"CASE WHEN {both(k)} THEN CAST({k}1 = {k}2 AS DOUBLE) ELSE 0.0 END"

    far = "greatest(length(a), length(b))"
    lev = "1 - levenshtein({0}1, {0}2) / greatest(length({0}1), length({0}2))"
    cols = {
        "levenshtein_sim": f"CASE WHEN {far} > 0 THEN 1 - levenshtein(a, b) / {far} ELSE 1.0 END",
        "jaro_winkler_sim": O.jaro_winkler_sql("a", "b"), "jaccard_sim": O.jaccard_sql(_TA, _TB),
        "cosine_sim": f"CASE WHEN {_NN} < 1 OR len({_GA}) = 0 OR len({_GB}) = 0 THEN 0.0 "
                      f"ELSE len(list_intersect({_GA}, {_GB})) / sqrt(len({_GA}) * len({_GB})) END",
        "house_num_match": same("h"), "house_num_sim": f"CASE WHEN {both('h')} THEN {lev.format('h')} ELSE 0.0 END",
        "unit_match": same("u"), "unit_sim": f"CASE WHEN {both('u')} THEN {O.jaro_winkler_sql('u1', 'u2')} ELSE 0.0 END",
        "zipcode_match": same("z"), "zipcode_sim": f"CASE WHEN {both('z')} THEN 1 - levenshtein(z1, z2) / 5.0 ELSE 0.0 END",
        "len_diff": f"CASE WHEN {far} > 0 THEN abs(length(a) - length(b)) / {far} ELSE 0.0 END",
        "token_count_diff": f"CASE WHEN greatest(len({_TA}), len({_TB})) > 0 THEN "
                            f"abs(len({_TA}) - len({_TB})) / greatest(len({_TA}), len({_TB})) ELSE 0.0 END",
    }
    parts = ", ".join(f"{c[k]} AS {n}{i}" for i, c in ((1, c1), (2, c2))
                      for n, k in (("h", "house_number"), ("u", "unit"), ("z", "zipcode")))
    sel = ", ".join(f"round(CAST({v} AS DOUBLE), 6) AS {k}" for k, v in cols.items())
    return _PAIRS_SQL + f" SELECT id, {sel} FROM (SELECT *, {parts} FROM p) q"


@register("address_pair_features_exact", _sql_pair_features())
def q_pair_features_exact(spark, sf_dir):
    """O-FEA2 but for its difflib column: 12 features of every pair."""
    from ..operators import model as M
    l = X.left_addresses(spark, sf_dir).select("id", F.col("address").alias("addr1"))
    r = X.right_addresses(spark, sf_dir).select("id", F.col("address").alias("addr2"))
    f = M.address_pair_features(l.join(r, "id"))
    return f.select("id", *[r6(F.col(c)).alias(c) for c in M.PAIR_FEATURES_13 if c != "seq_matcher_sim"])


#: labelled pairs of the boosted model, whatever the size of the input
TRAINING_PAIRS = 2000


def _boosted(spark, sf_dir):
    """O-ML9 -> O-FEA2 -> O-ML4 -> O-ML2: (model, test features)."""
    from ..operators import model as M
    bases = X.left_addresses(spark, sf_dir).select(F.concat(F.lit("A"), F.col("id").cast("string"))
                                                   .alias("id"), "address")
    pairs_ = M.make_training_pairs(bases, n=TRAINING_PAIRS, levels=3, seed=42)
    feats = M.address_pair_features(pairs_).checkpoint(eager=True)
    train, test = M.split(feats, ["id1", "id2"], 0.8, 42)
    return M.train_boosted(train, M.PAIR_FEATURES_13, "is_match"), test


@register("boosted_report")
def q_boosted_report(spark, sf_dir):
    """O-ML9 (a bounded sample of training pairs), O-FEA2, O-ML4 (hash
    split 80/20), O-ML2 (boosted trees), O-ML3 scoring and O-ML6 report."""
    from ..operators import model as M
    model, test = _boosted(spark, sf_dir)
    pred = model.transform(test)
    return M.classification_report(pred, "is_match")


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    """O-ML7: top-10 feature importances of the boosted model."""
    from ..operators import model as M
    model, _ = _boosted(spark, sf_dir)
    return M.feature_importance(model, M.PAIR_FEATURES_13, 10)


# ------------------------------------------------------------------ O-LNK2
def _forest_and_features(spark, sf_dir):
    """The forest (O-ML1) trained on the candidate pairs' features, these, and a
    function that looks up their records."""
    from ..operators import linkage as LK
    from ..operators import model as M
    from . import linkage as PL
    feats, with_records = PL.numbered_features(X.parents(spark, sf_dir), X.atoms(spark, sf_dir), with_geo=False)
    feats = feats.withColumn("is_match", (F.col("p_id") == F.col("a_id")).cast("int")).drop("p_id", "a_id") \
        .checkpoint(eager=True)
    return M.train_forest(feats, LK.FEATURES_9, "is_match"), feats, with_records


def _forest_for_links(spark, sf_dir):
    return _forest_and_features(spark, sf_dir)[0]


@register("link_incremental")
def q_link_incremental(spark, sf_dir):
    """O-LNK2 + O-LNK5: a first run links the even-keyed atoms; the second
    run links all atoms with the first run's scores as cache; returns the
    second run's statistics (cache hits = pairs not scored again)."""
    from . import linkage as PL
    model = _forest_for_links(spark, sf_dir)
    parents, atoms = X.parents(spark, sf_dir), X.atoms(spark, sf_dir)
    _m1, scores1, _s1 = PL.link_incremental(parents, atoms.where(F.col("id").cast("long") % 2 == 0),
                                            model, None, with_geo=False)
    _m2, _scores2, stats = PL.link_incremental(parents, atoms, model, scores1, with_geo=False)
    return stats.select("total_parents", "total_atoms", "comparison_count", "definite_match_count",
                        "possible_match_count", "cache_hits")


# ------------------------------------------------------------------ O-CHG5
SQL_INSERT_NEAR = f"""
WITH RECURSIVE base AS (SELECT id, latitude, longitude FROM {_LEFT} t),
r0 AS (SELECT * FROM {_RIGHT} t),
nw AS (SELECT id * 2 AS pos,
              CASE WHEN id % 49 = 0 THEN 0.0 WHEN id % 4 = 0 THEN latitude + 0.0105 ELSE latitude END
                AS latitude, longitude FROM r0
       UNION ALL
       SELECT id * 2 + 1, latitude + 0.0105 + 0.0003, longitude + 0.0002 FROM r0 WHERE id % 8 = 0),
rej AS (SELECT pos FROM nw WHERE latitude IS NULL OR longitude IS NULL OR latitude = 0 OR longitude = 0),
ex AS (SELECT n.pos, min(b.id) AS existing_id FROM nw n JOIN base b
       ON abs(n.latitude - b.latitude) < 0.001 AND abs(n.longitude - b.longitude) < 0.001
       WHERE n.pos NOT IN (SELECT pos FROM rej) GROUP BY n.pos),
fr AS (SELECT pos, latitude, longitude, row_number() OVER (ORDER BY pos) AS rn FROM nw
       WHERE pos NOT IN (SELECT pos FROM rej) AND pos NOT IN (SELECT pos FROM ex)),
walk(rn, leaders) AS (
  SELECT 0, []::STRUCT(pos BIGINT, la DOUBLE, lo DOUBLE)[]
  UNION ALL
  SELECT f.rn, CASE WHEN len(list_filter(w.leaders, lambda x: abs(x.la - f.latitude) < 0.001
                                         AND abs(x.lo - f.longitude) < 0.001)) = 0
                    THEN list_append(w.leaders, {{'pos': f.pos, 'la': f.latitude, 'lo': f.longitude}})
                    ELSE w.leaders END
  FROM walk w JOIN fr f ON f.rn = w.rn + 1),
fin AS (SELECT leaders FROM walk WHERE rn = (SELECT max(rn) FROM walk))
SELECT pos, 'rejected' AS outcome, CAST(NULL AS BIGINT) AS existing_id FROM rej
UNION ALL SELECT pos, 'existing', existing_id FROM ex
UNION ALL SELECT f.pos, CASE WHEN list_contains(list_transform(fin.leaders, lambda x: x.pos), f.pos)
                             THEN 'inserted' ELSE 'duplicate of new row' END, CAST(NULL AS BIGINT)
          FROM fr f, fin
"""


@register("insert_if_not_near", SQL_INSERT_NEAR)
def q_insert_if_not_near(spark, sf_dir):
    """O-CHG5 (with O-JOIN5 and O-DED2): varied-address coordinates offered as
    new outlets against the customer coordinates (tolerance 0.001): most are
    near an existing row, every 4th is moved away (inserted), every 8th comes
    twice (the second copy duplicates the first), every 49th has a zero latitude
    (rejected)."""
    from ..operators import spatial
    base = X.left_addresses(spark, sf_dir).select("id", "latitude", "longitude")
    r = X.right_addresses(spark, sf_dir)
    k, lat = F.col("id"), F.col("latitude")
    first = r.select((k * 2).alias("pos"),
                     F.when(k % 49 == 0, F.lit(0.0)).when(k % 4 == 0, lat + 0.0105).otherwise(lat)
                     .alias("latitude"), "longitude")
    second = r.where(k % 8 == 0).select((k * 2 + 1).alias("pos"), (lat + 0.0105 + 0.0003).alias("latitude"),
                                        (F.col("longitude") + 0.0002).alias("longitude"))
    return spatial.insert_if_not_near(base, first.unionByName(second), 0.001, key="id",
                                      order_col="pos")


# ------------------------------------------------------------------ O-STR2
@register("link_stream")
def q_link_stream(spark, sf_dir):
    """O-STR2: atoms derived from a customer file stream (one file per
    trigger) linked per micro-batch with foreachBatch + O-LNK2; the match
    table written per batch id is read back."""
    from ..operators import linkage as LK
    from ..session import scratch_path
    from ..streaming import streams as ST
    model = _forest_for_links(spark, sf_dir)
    src = ST.read_table_stream(spark, sf_dir, "customer.parquet", _customer_schema(spark, sf_dir),
                               max_files_per_trigger=1)
    arrivals = X.atoms_from(src.select("c_custkey", "c_nationkey", "c_mktsegment"))
    base = scratch_path(spark, "link-stream")
    q = ST.link_stream(arrivals, X.parents(spark, sf_dir), model, f"{base}/out",
                       f"{base}/_checkpoint")
    q.awaitTermination()
    m = spark.read.parquet(f"{base}/out/matches")
    return LK.readable(m)



_F = geo.WGS84_F
_A, _B = geo.WGS84_A, geo.WGS84_B
_TERMS = """sin(lam) AS sl, cos(lam) AS cl,
  sqrt(pow(cu2 * sl, 2) + pow(cu1 * su2 - su1 * cu2 * cl, 2)) AS sin_sigma,
  su1 * su2 + cu1 * cu2 * cl AS cos_sigma,
  atan2(sin_sigma, cos_sigma) AS sigma,
  CASE WHEN sin_sigma = 0 THEN 0.0 ELSE cu1 * cu2 * sl / sin_sigma END AS sin_alpha,
  1 - sin_alpha * sin_alpha AS cos2_alpha,
  CASE WHEN cos2_alpha = 0 THEN 0.0 ELSE cos_sigma - 2 * su1 * su2 / cos2_alpha END AS cos_2sm"""
SQL_GEO_SIM = f"""
WITH RECURSIVE q AS (
  SELECT l.id, radians(r.longitude) - radians(l.longitude) AS L,
         sin(atan((1 - {_F!r}) * tan(radians(l.latitude)))) AS su1,
         cos(atan((1 - {_F!r}) * tan(radians(l.latitude)))) AS cu1,
         sin(atan((1 - {_F!r}) * tan(radians(r.latitude)))) AS su2,
         cos(atan((1 - {_F!r}) * tan(radians(r.latitude)))) AS cu2
  FROM {_LEFT} l JOIN {_RIGHT} r ON l.id = r.id),
it(id, n, lam) AS (
  SELECT id, 0, L FROM q
  UNION ALL
  SELECT id, n + 1,
         L + (1 - c) * {_F!r} * sin_alpha * (sigma + c * sin_sigma * (cos_2sm + c * cos_sigma * (-1 + 2 * cos_2sm * cos_2sm)))
  FROM (SELECT it.id, it.n, it.lam, q.L, q.su1, q.cu1, q.su2, q.cu2 FROM it JOIN q ON it.id = q.id
        WHERE it.n < 20) s,
       LATERAL (SELECT {_TERMS.replace(chr(10), ' ')},
                       {_F!r} / 16 * cos2_alpha * (4 + {_F!r} * (4 - 3 * cos2_alpha)) AS c) t),
fin AS (
  SELECT id, {_TERMS.replace(chr(10), ' ')},
         cos2_alpha * ({_A!r} * {_A!r} - {_B!r} * {_B!r}) / ({_B!r} * {_B!r}) AS usq,
         1 + usq / 16384 * (4096 + usq * (-768 + usq * (320 - 175 * usq))) AS a_,
         usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq))) AS b_,
         b_ * sin_sigma * (cos_2sm + b_ / 4 * (cos_sigma * (-1 + 2 * cos_2sm * cos_2sm)
           - b_ / 6 * cos_2sm * (-3 + 4 * sin_sigma * sin_sigma) * (-3 + 4 * cos_2sm * cos_2sm))) AS d_sigma,
         CASE WHEN sin_sigma = 0 THEN 0.0 ELSE {_B!r} * a_ * (sigma - d_sigma) END AS d
  FROM it JOIN q USING (id) WHERE n = 20)
SELECT id, round(d, 3) AS distance_m, round(exp(-d / 500.0), 6) AS geo_sim FROM fin
"""


@register("geo_similarity", SQL_GEO_SIM)
def q_geo_similarity(spark, sf_dir):
    """O-SIM17 (Vincenty on WGS-84, column math, 20 iterations) and O-SIM18
    (distance decay) between the two coordinates of each customer; the
    oracle runs the same iteration as a recursive CTE."""
    l = X.left_addresses(spark, sf_dir).select("id", F.col("latitude").alias("la"),
                                               F.col("longitude").alias("lo"))
    r = X.right_addresses(spark, sf_dir).select("id", "latitude", "longitude")
    d = geo.geo_distance_m(F.col("la"), F.col("lo"), F.col("latitude"), F.col("longitude"))
    j = l.join(r, "id").withColumn("_d", d)  # one Vincenty evaluation per row
    return j.select("id", F.round("_d", 3).alias("distance_m"),
                    r6(geo.geo_decay(F.col("_d"))).alias("geo_sim"))


# ------------------------------------------- O-FEA1 oracle: LCS in SQL
def _sql_fp(x: str) -> str:
    """Ratio preprocessing: drop non-ASCII, non-alphanumerics to space, lower, trim."""
    return (f"trim(lower(regexp_replace(regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g'), "
            f"'[^A-Za-z0-9_]', ' ', 'g')))")


def _sql_toks(x: str) -> str:
    return f"list_sort(list_filter(string_split({_sql_fp(x)}, ' '), lambda t: t <> ''))"


def _sql_feature_rows() -> str:
    """Candidate pairs with the strings each ratio compares."""
    num = lambda s: f"coalesce({s}, '')"
    t1, t2 = _sql_toks("coalesce(p.name, '')"), _sql_toks("coalesce(a.name, '')")
    d1, d2 = f"list_distinct({t1})", f"list_distinct({t2})"
    sect = f"array_to_string(list_sort(list_intersect({d1}, {d2})), ' ')"
    r12 = f"array_to_string(list_sort(list_filter({d1}, lambda t: NOT list_contains({d2}, t))), ' ')"
    r21 = f"array_to_string(list_sort(list_filter({d2}, lambda t: NOT list_contains({d1}, t))), ' ')"
    return f"""
SELECT c.parent_id, c.atom_id,
  CASE WHEN p.zip5 IS NOT DISTINCT FROM a.zip5 THEN 1.0 ELSE 0.0 END AS zip_match,
  CASE WHEN p.street_number IS NOT DISTINCT FROM a.street_number THEN 1.0 ELSE 0.0 END AS number_match,
  CASE WHEN p.state IS NOT DISTINCT FROM a.state THEN 1.0 ELSE 0.0 END AS state_match,
  CASE WHEN p.auth_id IS NOT DISTINCT FROM a.auth_id THEN 1.0 ELSE 0.0 END AS auth_match,
  array_to_string({_sql_toks("coalesce(p.street_name, '')")}, ' ') AS st1,
  array_to_string({_sql_toks("coalesce(a.street_name, '')")}, ' ') AS st2,
  array_to_string({_sql_toks("coalesce(p.unit, '')")}, ' ') AS un1,
  array_to_string({_sql_toks("coalesce(a.unit, '')")}, ' ') AS un2,
  array_to_string({_sql_toks("coalesce(p.city, '')")}, ' ') AS ci1,
  array_to_string({_sql_toks("coalesce(a.city, '')")}, ' ') AS ci2,
  len({d1}) = 0 OR len({d2}) = 0 AS name_empty,
  {sect} AS ns, trim(concat_ws(' ', {sect}, {r12})) AS n12, trim(concat_ws(' ', {sect}, {r21})) AS n21,
  concat_ws(' ', {num('p.street_number')}, {num('p.street_name')}, {num('p.unit')}) AS ad1,
  concat_ws(' ', {num('a.street_number')}, {num('a.street_name')}, {num('a.unit')}) AS ad2
FROM ({SQL_CANDIDATES}) c JOIN {_PREP_P} p ON c.parent_id = p.id JOIN {_PREP_A} a ON c.atom_id = a.id
"""


_RATIO_PAIRS = [("st1", "st2"), ("un1", "un2"), ("ci1", "ci2"), ("ns", "n12"), ("ns", "n21"),
                ("n12", "n21"), ("ad1", "ad2")]


def _sql_ratio(x: str, y: str) -> str:
    lcs = f"(SELECT lcs FROM lcs WHERE lcs.x = {x} AND lcs.y = {y})"
    return (f"CASE WHEN {x} = {y} THEN 100 WHEN {x} = '' OR {y} = '' THEN 0 "
            f"ELSE round_even(100.0 * 2 * {lcs} / (length({x}) + length({y})), 0) END")


def _sql_linkage_features() -> str:
    pairs_union = " UNION ".join(f"SELECT {a} AS x, {b} AS y FROM fr" for a, b in _RATIO_PAIRS)
    mask = ("CAST(list_sum(list_transform(range(length(x)), lambda i: CASE WHEN x[i + 1] = y[k + 1] "
            "THEN (1::UBIGINT << CAST(i AS INTEGER)) ELSE 0::UBIGINT END)) AS UBIGINT)")
    full = "((1::UBIGINT << CAST(length(x) AS INTEGER)) - 1::UBIGINT)"
    feats = {
        "street_sim": _sql_ratio("st1", "st2"), "unit_sim": _sql_ratio("un1", "un2"),
        "city_sim": _sql_ratio("ci1", "ci2"),
        "name_sim": (f"CASE WHEN name_empty THEN 0 ELSE greatest({_sql_ratio('ns', 'n12')}, "
                     f"{_sql_ratio('ns', 'n21')}, {_sql_ratio('n12', 'n21')}) END"),
        "address_sim": _sql_ratio("ad1", "ad2"),
    }
    sel = ", ".join(f"round(({v}) / 100.0, 6) AS {k}" for k, v in feats.items())
    return f"""
WITH RECURSIVE fr AS ({_sql_feature_rows()}),
sp AS (SELECT DISTINCT x, y FROM ({pairs_union}) u WHERE x <> '' AND y <> '' AND x <> y),
it(x, y, k, v) AS (
  SELECT x, y, 0, {full} FROM sp
  UNION ALL
  SELECT x, y, k + 1, ((v + (v & m)) | (v - (v & m))) & {full}
  FROM (SELECT x, y, k, v, {mask} AS m FROM it WHERE k < length(y)) s),
lcs AS (SELECT x, y, length(x) - bit_count(v) AS lcs FROM it WHERE k = length(y))
SELECT parent_id, atom_id, round(zip_match, 6) AS zip_match, round(number_match, 6) AS number_match,
       round(state_match, 6) AS state_match, round(auth_match, 6) AS auth_match, {sel}
FROM fr
"""


ORACLE["linkage_features"] = _sql_linkage_features()


# ------------------------- O-CLS1, O-LNK1, 3, 4, 5 and O-ML5 without a model
def _sql_scored() -> str:
    from ..operators import linkage as LK
    total = " + ".join(f"CAST({c} AS DOUBLE)" for c in LK.FEATURES_9)
    return f"SELECT *, ({total}) / 9.0 AS score FROM ({ORACLE['linkage_features']}) f"


def _sql_explained() -> str:
    from ..operators import linkage as LK

    def pct(c):
        return f"CAST(CAST(round_even({c} * 100, 0) AS BIGINT) AS VARCHAR)"

    names, streets = LK.REASON_NAMES, LK.REASON_STREETS
    reasons = f"""list_filter([
      CASE WHEN p.zip5 = a.zip5 THEN {O.q(LK.REASON_SAME_ZIP)} || p.zip5 END,
      CASE WHEN name_sim > 0.8 THEN {O.q(names[0])} || {pct('name_sim')} || {O.q(names[1])} END,
      CASE WHEN street_sim > 0.8 THEN {O.q(streets[0])} || {pct('street_sim')} || {O.q(streets[1])} END,
      CASE WHEN p.street_number = a.street_number THEN {O.q(LK.REASON_SAME_NUMBER)} || p.street_number END,
      CASE WHEN p.auth_id = a.auth_id THEN {O.q(LK.REASON_AUTH)} || p.auth_id END], lambda x: x IS NOT NULL)"""
    return f"""
WITH s AS ({_sql_scored()}),
r AS (SELECT s.parent_id, s.atom_id, p.name AS parent_name, a.name AS atom_name, p.address AS parent_address,
        a.address AS atom_address, score, {reasons} AS reasons
      FROM s JOIN {_PREP_P} p ON s.parent_id = p.id JOIN {_PREP_A} a ON s.atom_id = a.id WHERE score > 0.4)
SELECT parent_id, coalesce(parent_name, 'unknown') AS parent_name, coalesce(parent_address, 'unknown') AS parent_address,
  atom_id, coalesce(atom_name, 'unknown') AS atom_name, coalesce(atom_address, 'unknown') AS atom_address,
  round_even(score, 4) AS match_score, CASE WHEN score > 0.85 THEN 'definite' ELSE 'possible' END AS match_class,
  CASE WHEN len(reasons) = 0 AND score > 0.7 THEN {O.q(LK.REASON_GENERIC)} ELSE array_to_string(reasons, '; ') END AS reasons
FROM r
"""


@register("link_explained", _sql_explained())
def q_link_explained(spark, sf_dir):
    """O-LNK1 scored by the mean of the features: O-CLS1 classes, O-LNK3
    reasons and the O-LNK4 presentation of every match."""
    from ..operators import linkage as LK
    from . import linkage as PL
    out = LK.readable(PL.link_records(X.parents(spark, sf_dir), X.atoms(spark, sf_dir), PL.mean_score, with_geo=False))
    return out.withColumn("reasons", F.array_join("match_reasons", "; ")).drop("match_reasons")


@register("link_counts", f"""
WITH s AS ({_sql_scored()})
SELECT (SELECT count(*) FROM {_PARENTS} p) AS total_parents, (SELECT count(*) FROM {_ATOMS} a) AS total_atoms,
  count(*) AS comparison_count, count(*) FILTER (WHERE score > 0.85) AS definite_match_count,
  count(*) FILTER (WHERE score > 0.4 AND score <= 0.85) AS possible_match_count,
  count(*) FILTER (WHERE CAST(atom_id AS BIGINT) % 2 = 0) AS cache_hits
FROM s
""")
def q_link_counts(spark, sf_dir):
    """O-LNK5 of an O-LNK2 run over all atoms after one over the even ones,
    scored by the mean of the features: counts observed as the run writes."""
    from . import linkage as PL
    parents = X.parents(spark, sf_dir)
    atoms = X.atoms(spark, sf_dir).withColumn("id", F.concat(F.lit("A"), "id"))  # ids of their own
    even = F.substring("id", 2, 20).cast("long") % 2 == 0
    _, scores, _ = PL.link_incremental(parents, atoms.where(even), PL.mean_score, None, with_geo=False)
    return PL.link_incremental(parents, atoms, PL.mean_score, scores, with_geo=False)[2]


@register("stratified_folds", f"""
SELECT parent_id, atom_id, is_match, CAST((row_number() OVER (
    PARTITION BY is_match ORDER BY md5(parent_id || '|' || atom_id || '|42'), parent_id, atom_id) - 1) % 5 AS INTEGER) AS fold
FROM (SELECT parent_id, atom_id, CAST(parent_id = atom_id AS INTEGER) AS is_match FROM ({SQL_CANDIDATES}) c) t
""")
def q_stratified_folds(spark, sf_dir):
    """O-ML5: five folds of all labelled candidate pairs, stratified by label."""
    from ..operators import model as M
    pairs_ = _candidates(spark, sf_dir).withColumn("is_match", (F.col("parent_id") == F.col("atom_id")).cast("int"))
    return M.stratified_folds(pairs_, ["parent_id", "atom_id"])


# ------------------------------------------------- O-PRS4 without commas
def _sql_tag_sequences() -> str:
    from ..operators import tagger as G
    tags, letters = O.tag_sql("address"), list(G.TAGS.values())
    name, n = list(G.TAGS), len(G.TAGS)

    def toks(c):
        return f"regexp_extract_all(coalesce({c}, ''), {O.q(G.TOKEN)})"

    def listed(words):
        return "(" + ", ".join(O.q(w.upper()) for w in words) + ")"

    def kind(t):
        u = f"upper(rtrim({t}, '.'))"
        return (f"CASE WHEN regexp_full_match({u}, '[0-9]+') THEN 0 WHEN {u} = '#' OR {u} IN {listed(text.TAG_UNITS)} THEN 1 "
                f"WHEN {u} IN {listed(text.TAG_DIRECTIONS)} THEN 2 WHEN {u} IN {listed(text.TAG_SUFFIXES)} THEN 3 "
                f"WHEN regexp_matches({u}, '[0-9]') THEN 4 ELSE 5 END")

    def bucket(t):
        return f"CAST('0x' || substring(md5(lower({t})), 1, 3) AS INTEGER)"

    seq = "list_concat(" * (n - 1) + ", ".join(
        f"list_transform({toks(f't.{c}')}, lambda w: {{'tag': {i}, 'w': w}})" + (")" if i > 1 else "")
        for i, c in enumerate(name, 1))
    sel = ", ".join(f"{tags[c]} AS {c}" for c in [*name, "StateName", "ZipCode"])
    picked = ", ".join(
        f"CASE WHEN PlaceName IS NOT NULL THEN {c} WHEN contains(path, {O.q(x)}) THEN array_to_string(list_filter(toks, "
        f"lambda t, i: path[i] = {O.q(x)}), ' ') END AS {c}" for c, x in G.TAGS.items())
    # states 1 to 8; 0 before the first token, 9 after the last
    return f"""
WITH RECURSIVE tr AS (SELECT {sel} FROM {_PARENTS} p),
s AS (SELECT {seq} AS seq FROM tr t WHERE PlaceName IS NOT NULL AND StreetName IS NOT NULL),
sx AS (SELECT list_concat(list_concat([0], list_transform(seq, lambda e: e.tag)), [9]) AS x FROM s),
mv AS (SELECT x[i] AS a, x[i + 1] AS b, count(*) AS n FROM sx, range(1, 1000) r(i) WHERE i < len(x) GROUP BY ALL),
ws AS (SELECT unnest(seq) AS e FROM s),
wk AS (SELECT e.tag AS a, e.w AS w, {kind('e.w')} AS k FROM ws),
kn AS (SELECT a, k, count(*) AS n FROM wk GROUP BY ALL),
bn AS (SELECT a, {bucket('w')} AS b, count(*) AS n FROM wk WHERE k = 5 AND a IN (3, 8) GROUP BY ALL),
m1 AS (SELECT a.a, b.b, ln((coalesce(mv.n, 0) + 1.0::DOUBLE) / (sum(coalesce(mv.n, 0)) OVER (PARTITION BY a.a) + 9)) AS v
       FROM range(0, 9) a(a) CROSS JOIN range(1, 10) b(b) LEFT JOIN mv ON mv.a = a.a AND mv.b = b.b),
step AS (SELECT list(v ORDER BY a, b) AS v FROM m1),
k1 AS (SELECT a.a, k.k, ln((coalesce(kn.n, 0) + 1.0::DOUBLE) / (sum(coalesce(kn.n, 0)) OVER (PARTITION BY a.a) + 6)) AS v
       FROM range(1, 9) a(a) CROSS JOIN range(0, 6) k(k) LEFT JOIN kn ON kn.a = a.a AND kn.k = k.k),
kinds AS (SELECT list(v ORDER BY a, k) AS v FROM k1),
b1 AS (SELECT a.a, b.b, ln((coalesce(bn.n, 0) + 1.0::DOUBLE) / (sum(coalesce(bn.n, 0)) OVER (PARTITION BY a.a) + 4096)) AS v
       FROM (VALUES (3), (8)) a(a) CROSS JOIN range(0, 4096) b(b) LEFT JOIN bn ON bn.a = a.a AND bn.b = b.b),
words AS (SELECT list(v ORDER BY a, b) AS v FROM b1),
src AS (SELECT id, address FROM (SELECT id, replace(address, ',', '') AS address FROM {_ATOMS} a
        UNION ALL SELECT 'c' || id, address FROM {_ATOMS} a) u),
g AS (SELECT id, {sel}, {toks("regexp_replace(regexp_replace(trim(coalesce(address, '')), " + O.q(text.tagger_patterns()['zip']) + ", '', 'g'), " + O.q(text.tagger_patterns()['state']) + ", '', 'g')")} AS toks FROM src),
em AS (SELECT id, toks, list_transform(list_transform(toks, lambda t: {{'k': {kind('t')}, 'b': {bucket('t')}}}), lambda e:
         list_transform(range(1, 9), lambda j: kinds.v[(j - 1) * 6 + e.k + 1] + CASE WHEN e.k < 5 THEN 0.0::DOUBLE
           WHEN j = 3 THEN words.v[e.b + 1] WHEN j = 8 THEN words.v[4096 + e.b + 1] ELSE -ln(4096.0::DOUBLE) END)) AS e
       FROM g, kinds, words),
it(id, k, st) AS (
  SELECT id, 1, list_transform(range(1, 9), lambda j: {{'s': step.v[j] + e[1][j], 'p': {letters}[j]}}) FROM em, step WHERE len(e) > 0
  UNION ALL
  SELECT it.id, it.k + 1, list_transform(list_transform(range(1, 9), lambda j: {{'j': j, 'b': list_sort(list_transform(range(1, 9),
      lambda i: {{'s': st[i].s + step.v[i * 9 + j], 'p': st[i].p}}), 'DESC')[1]}}),
      lambda y: {{'s': y.b.s + em.e[it.k + 1][y.j], 'p': y.b.p || {letters}[y.j]}})
  FROM it JOIN em ON em.id = it.id, step WHERE it.k < len(em.e)),
fin AS (SELECT it.id, list_sort(list_transform(range(1, 9), lambda i: {{'s': st[i].s + step.v[i * 9 + 9], 'p': st[i].p}}), 'DESC')[1].p AS path
        FROM it JOIN em ON em.id = it.id, step WHERE it.k = len(em.e))
SELECT id, {picked}, StateName, ZipCode FROM g LEFT JOIN fin USING (id)
"""


@register("tag_sequences", _sql_tag_sequences())
def q_tag_sequences(spark, sf_dir):
    """O-PRS4: every atom's address with and without its commas, tagged by rules
    and, where these find no city, by the chain fitted on the parents."""
    from ..operators import tagger as G
    model = G.fit(X.parents(spark, sf_dir), "address")
    a = X.atoms(spark, sf_dir).select("id", "address")
    both = a.withColumn("address", F.regexp_replace("address", ",", "")).unionByName(
        a.withColumn("id", F.concat(F.lit("c"), "id")))
    return G.tag_sequences(both, "address", model).select("id", "tags.*")


# --------------------------------------------------- sinks, reports and hashes
@register("by_state", f"SELECT atom_id, state FROM {_FAC} t WHERE state = 'CT'")
def q_by_state(spark, sf_dir):
    """O-FIL3 on the derived facilities."""
    return filters.by_state(X.facilities(spark, sf_dir), "CT").select("atom_id", "state")


@register("split_valid", f"""
WITH v AS ({SQL_VALIDATE})
SELECT atom_id, is_valid, CASE WHEN NOT is_valid THEN error_fields END AS error_fields FROM v
""")
def q_split_valid(spark, sf_dir):
    """O-VAL2: valid rows and invalid rows with their fields in error."""
    valid, invalid = validate.split_valid(validate.validate_facilities(X.facilities(spark, sf_dir)))
    return valid.select("atom_id", F.lit(True).alias("is_valid"), F.lit(None).cast("string").alias("error_fields")) \
        .unionByName(invalid.select(F.col("record_index").alias("atom_id"), F.lit(False).alias("is_valid"),
                                    F.array_join(F.transform("errors", lambda e: e["field"]), ",").alias("error_fields")))


@register("change_reports", """
WITH p AS (SELECT DISTINCT l_orderkey + CASE WHEN l_linenumber > 5 THEN 100000000 ELSE 0 END AS k FROM lineitem),
d AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R' UNION SELECT -c_custkey FROM customer)
SELECT 'patch' AS op, k, k IN (SELECT o_orderkey FROM orders) AS found FROM p
UNION ALL SELECT 'replace', c_custkey, c_custkey IN (SELECT o_orderkey FROM orders) FROM customer
UNION ALL SELECT 'delete', k, k IN (SELECT o_orderkey FROM orders) FROM d
""")
def q_change_reports(spark, sf_dir):
    """O-CHG2 to O-CHG4: which keys of a change batch the table knows."""
    o = X.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    li = X.read(spark, sf_dir, "lineitem")
    c = X.read(spark, sf_dir, "customer")
    late = F.when(F.col("l_linenumber") > 5, F.lit(100000000)).otherwise(0)
    ch = li.select((F.col("l_orderkey") + late).cast("long").alias("o_orderkey"), F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"),
        F.create_map(F.lit("o_orderstatus"), F.col("l_returnflag")).alias("change"))
    _, patch = changes.patch_rows(o, ch, key="o_orderkey", seq_col="seq")
    _, replace = changes.replace_rows(o, c.select(F.col("c_custkey").cast("long").alias("o_orderkey"),
                                                  F.col("c_name").alias("o_orderstatus")), key="o_orderkey")
    _, delete = changes.delete_rows(o, li.where(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").cast("long")).union(c.select((-F.col("c_custkey")).cast("long"))), key="o_orderkey")
    out = [r.select(F.lit(op).alias("op"), F.col("o_orderkey").alias("k"), "found")
           for op, r in (("patch", patch), ("replace", replace), ("delete", delete))]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _sql_part(c: str) -> str:
    return f"CASE WHEN coalesce({c}, '') = '' THEN '-' ELSE length({c}) || ':' || {c} END"


@register("record_hash", f"""
SELECT id, md5('i|' || {_sql_part('id')} || '|' || {_sql_part('auth_id')}) AS id_hash,
  md5('f|' || {_sql_part('address')} || '|' || {_sql_part('name')} || '|-|-|-|-|-|-') AS field_hash,
  md5({_sql_part('id')} || '|' || {_sql_part('auth_id')} || '#' || {_sql_part('address')} || '|' || {_sql_part('name')}
      || '|-|-|-|-|-|-') AS content_hash
FROM {_ATOMS} a
""")
def q_record_hash(spark, sf_dir):
    """O-HSH1: hash by id, by fields where no id is set, and of the content."""
    from ..operators import linkage as LK
    a = X.atoms(spark, sf_dir).select("id", "auth_id", "address", "name")
    with_id = LK.record_hash(a).withColumnRenamed("record_hash", "id_hash")
    no_id = LK.record_hash(a.select(F.col("id").alias("_id"), "address", "name"), by_id=True)
    return with_id.join(no_id.select(F.col("_id").alias("id"), F.col("record_hash").alias("field_hash")), "id") \
        .select("id", "id_hash", "field_hash", "content_hash")


@register("pair_hash", f"""
WITH h AS (SELECT id, md5('i|' || {_sql_part('id')} || '|' || {_sql_part('auth_id')}) AS h FROM {_PARENTS} p),
g AS (SELECT id, md5('i|' || {_sql_part('id')} || '|' || {_sql_part('auth_id')}) AS h FROM {_ATOMS} a)
SELECT parent_id, atom_id, least(h.h, g.h) || '_' || greatest(h.h, g.h) AS pair_key, true AS same_reversed
FROM ({SQL_CANDIDATES}) c JOIN h ON h.id = parent_id JOIN g ON g.id = atom_id
""")
def q_pair_hash(spark, sf_dir):
    """O-HSH2: the key of every candidate pair, whichever side comes first."""
    from ..operators import linkage as LK
    p = LK.record_hash(X.parents(spark, sf_dir), by_id=True).select(F.col("id").alias("parent_id"), F.col("record_hash").alias("h"))
    a = LK.record_hash(X.atoms(spark, sf_dir), by_id=True).select(F.col("id").alias("atom_id"), F.col("record_hash").alias("g"))
    both = _candidates(spark, sf_dir).join(p, "parent_id").join(a, "atom_id")
    key, back = LK.pair_hash(F.col("h"), F.col("g")), LK.pair_hash(F.col("g"), F.col("h"))
    return both.select("parent_id", "atom_id", key.alias("pair_key"), (key == back).alias("same_reversed"))


@register("csv_roundtrip", f"SELECT CAST(id AS VARCHAR) AS id, address FROM {_LEFT} t")
def q_csv_roundtrip(spark, sf_dir):
    """O-SNK1 -> O-SRC2: addresses written as CSV with header, read back as records."""
    from ..session import scratch_path
    from ..sources import records as R
    path = scratch_path(spark, "records") + ".csv"
    R.write_records(X.left_addresses(spark, sf_dir).select("id", "address"), path)
    rec = F.col("record")
    return R.read_records(spark, path).select(rec["id"].alias("id"), rec["address"].alias("address"))


@register("sink_roundtrips", f"""
WITH v AS ({SQL_VALIDATE})
SELECT 'matches' AS sink, CAST(l.id AS VARCHAR) AS k, r.address AS value FROM {_LEFT} l JOIN {_RIGHT} r ON l.id = r.id
UNION ALL SELECT 'valid', CAST(v.atom_id AS VARCHAR), t.facility_name FROM v JOIN {_FAC} t ON v.atom_id = t.atom_id WHERE is_valid
UNION ALL SELECT 'audit', CAST(atom_id AS VARCHAR), error_fields FROM v WHERE NOT is_valid
""")
def q_sink_roundtrips(spark, sf_dir):
    """O-SNK2 (audit log in two appends), O-SNK3 (match file), O-SNK4 (valid
    rows), each written under the shared folder and read back."""
    from ..session import scratch_path
    from ..sources import records as R
    base = scratch_path(spark, "sinks")
    l, r = X.left_addresses(spark, sf_dir), X.right_addresses(spark, sf_dir)
    R.write_matches(l.select("id", F.col("id").alias("address1_id"), F.col("address").alias("address1")).join(
        r.select("id", F.col("id").alias("address2_id"), F.col("address").alias("address2")), "id")
        .withColumn("similarity", F.lit(1.0)), f"{base}/matches")
    # read by four jobs; a filter on the errors does not reach below the written rows
    checked = validate.validate_facilities(ensure_parallelism(X.facilities(spark, sf_dir))).checkpoint(eager=True)
    R.write_valid(checked, f"{base}/valid")
    _, invalid = validate.split_valid(checked)
    audit = invalid.select(F.col("record_index").cast("string").alias("k"),
                           F.array_join(F.transform("errors", lambda e: e["field"]), ",").alias("value"))
    even = F.pmod(F.col("k").cast("long"), F.lit(2)) == 0
    R.append_audit(audit.where(even), f"{base}/audit")
    R.append_audit(audit.where(~even), f"{base}/audit")
    m = spark.read.option("header", True).csv(f"{base}/matches")
    v = spark.read.schema("atom_id long, facility_name string").json(f"{base}/valid")
    return m.select(F.lit("matches").alias("sink"), F.col("address1_id").alias("k"), F.col("address2").alias("value")) \
        .unionByName(v.select(F.lit("valid").alias("sink"), F.col("atom_id").cast("string").alias("k"),
                              F.col("facility_name").alias("value"))) \
        .unionByName(R.read_audit(spark, f"{base}/audit", "k string, value string")
                     .select(F.lit("audit").alias("sink"), "k", "value"))
