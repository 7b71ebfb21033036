"""Lookups, filters, search and projections (O-FIL1..5, O-PRJ1..3).

Single-value predicates are plain ``filter`` calls, so Catalyst pushes them
into the parquet scan (``PushedFilters``) and prunes columns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A list of ids passed from Python is bounded by the caller's memory; it is
# turned into a small DataFrame and broadcast. A DataFrame of ids is joined
# normally (AQE picks broadcast only when its runtime size allows).
MAX_LITERAL_IDS = 100_000


def lookup_by_id(df: DataFrame, ids, key: str = "atom_id",
                 spark: SparkSession | None = None) -> DataFrame:
    """O-FIL1: one id -> ``filter``; many ids -> left join from the ids with a
    ``found`` flag (unknown ids are kept and reported, NULL row otherwise)."""
    if isinstance(ids, (int, str)):
        return df.where(F.col(key) == F.lit(ids))
    if isinstance(ids, DataFrame):
        id_df = ids.select(F.col(ids.columns[0]).alias(key))
    else:
        ids = list(ids)
        if len(ids) > MAX_LITERAL_IDS:
            raise ValueError("pass large id sets as a DataFrame")
        spark = spark or df.sparkSession
        id_df = F.broadcast(spark.createDataFrame([(i,) for i in ids],
                                                  [key]).select(F.col(key).cast(df.schema[key].dataType)))
    marked = df.withColumn("_found", F.lit(True))
    return id_df.join(marked, key, "left").withColumn("found", F.coalesce("_found", F.lit(False))) \
        .drop("_found")


def by_city(df: DataFrame, city: str) -> DataFrame:
    """O-FIL2: exact, case-sensitive."""
    return df.where(F.col("city") == F.lit(city))


def by_state(df: DataFrame, state: str) -> DataFrame:
    """O-FIL3."""
    return df.where(F.col("state") == F.lit(state))


def name_contains(c: Column, term: str, like_wildcards: bool = False) -> Column:
    """Contains-match as the SQLite store evaluates it: ASCII case-insensitive.
    ``like_wildcards=True`` also lets ``%``/``_`` in the term act as wildcards
    (the ORM did not escape them)."""
    if like_wildcards:
        return F.lower(c).like("%" + term.lower() + "%")
    return F.instr(F.lower(c), F.lit(term.lower())) > 0


def search(df: DataFrame, facility_name: str | None = None, city: str | None = None,
           state: str | None = None, auth_type: str | None = None,
           like_wildcards: bool = False) -> DataFrame:
    """O-FIL4: AND of the given criteria; None and '' mean "no filter"."""
    out = df
    if facility_name:
        out = out.where(name_contains(F.col("facility_name"), facility_name, like_wildcards))
    if city:
        out = out.where(F.col("city") == F.lit(city))
    if state:
        out = out.where(F.col("state") == F.lit(state))
    if auth_type:
        out = out.where(F.col("auth_type") == F.lit(auth_type))
    return out


EXACT_CRITERIA = ("city", "state", "auth_type")


def search_batch(df: DataFrame, requests: DataFrame, name_col: str = "facility_name",
                 request_id: str = "request_id", max_gram: int = 3,
                 allow_match_all: bool = False) -> DataFrame:
    """O-FIL5: the O-FIL4 predicate for a table of requests; one output row
    per (request, hit).

    Requests are grouped by which criteria they set (at most 16 patterns,
    read back with one tiny aggregate). A group with a name criterion is joined
    over posting lists: each term is looked up by the one of its
    ``max_gram``-letter runs that fewest names hold (:func:`rarest_grams`; a
    shorter term is its own run) and joined on it and the equality criteria to
    the names that hold it; the exact ``instr`` follows. Other groups are joined
    on their equality criteria. A key that many rows share on either side is
    dealt into a grid of parts (:func:`.pairs.keyed_pairs`).
    A request with no criterion matches every row by definition; such
    requests are refused unless ``allow_match_all``.
    """
    from .pairs import keyed_pairs

    def setv(c: Column) -> Column:
        return F.when(c.isNotNull() & (c != ""), c)

    crit = (name_col,) + EXACT_CRITERIA
    # requests and rows are read once per pattern
    req = requests.select(F.col(request_id).alias("id"), *[setv(F.col(c)).alias(f"c{i}") for i, c in enumerate(crit)])
    req = req.withColumn("c0", F.lower("c0")).checkpoint(eager=True)
    flags = [F.col(f"c{i}").isNotNull().alias(f"h{i}") for i in range(len(crit))]
    patterns = req.select(*flags).distinct().collect()
    rows = df.withColumn("_row", F.struct(*[F.col(c) for c in df.columns])).select(
        "_row", F.lower(F.col(name_col)).alias("name"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(crit)])
    grams = None
    if any(p["h0"] for p in patterns):
        grams = rarest_grams(req.where("c0 is not null").select(F.col("c0").alias("term")).distinct(),
                             rows.select("name"), max_gram).checkpoint(eager=True)
        lengths = sorted(r[0] for r in grams.select(F.length("gram")).distinct().collect())
    outs = []
    for p in patterns:
        have = [i for i in range(len(crit)) if p[f"h{i}"]]
        rq, exact = req, [i for i in have if i]
        for i in range(len(crit)):
            rq = rq.where(F.col(f"c{i}").isNotNull() if i in have else F.col(f"c{i}").isNull())
        t = rows
        for i in exact:
            t = t.where(F.col(f"c{i}").isNotNull())
        # one key per request: the term's run and the equality criteria
        parts = [F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)) for c in [f"c{i}" for i in exact]]
        if 0 in have:
            wanted = grams.select("gram").distinct()
            if grams.count() <= BROADCAST_GRAMS:
                wanted = F.broadcast(wanted)
            rq = rq.join(grams, rq["c0"] == grams["term"]).drop("term")
            t = t.withColumn("gram", F.explode(substring_runs(F.col("name"), lengths))).join(wanted, "gram", "left_semi")
            parts = [F.col("gram"), *parts]
        if parts:
            key = F.array(F.concat_ws("\u0001", *parts))
            both = keyed_pairs(rq.withColumn("keys", key), t.withColumn("keys", key))
            if 0 in have:
                both = both.where(F.instr(F.col("r_name"), F.col("l_c0")) > 0)
        elif allow_match_all:
            every = F.array(F.lit("all"))
            both = keyed_pairs(rq.withColumn("keys", every), t.withColumn("keys", every))
        else:
            raise ValueError("search request without any criterion matches every row; "
                             "pass allow_match_all=True")
        outs.append(both.select(F.col("l_id").alias(request_id), "r__row.*"))
    if not outs:
        rid = F.lit(None).cast(requests.schema[request_id].dataType).alias(request_id)
        return df.limit(0).select(rid, *[F.col(c) for c in df.columns])
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


#: runs of letters that may be broadcast to thin out the names' posting lists
BROADCAST_GRAMS = 100_000


def substring_runs(c: Column, lengths: list[int]) -> Column:
    """Distinct runs of the given numbers of characters."""
    def runs(n: int) -> Column:
        return F.when(F.length(c) >= n, F.transform(
            F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(
            F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[runs(n) for n in lengths]))


def rarest_grams(terms: DataFrame, names: DataFrame, max_gram: int = 3) -> DataFrame:
    """(term, gram): of the ``max_gram``-letter runs of each distinct ``term``
    the one that fewest ``names`` (column ``name``) hold; the term itself where
    it is shorter. A run no name holds is the best of all."""
    n = F.least(F.length("term"), F.lit(max_gram))
    runs = terms.select("term", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("term") - n + 1), lambda i: F.substring("term", i, n)))).alias("gram"))
    held = names.select(F.explode(substring_runs(F.col("name"), [max_gram])).alias("gram")).groupBy("gram").agg(
        F.count("*").alias("f"))
    return runs.join(held, "gram", "left").groupBy("term").agg(
        F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "gram")).alias("m")).select("term", F.col("m.gram").alias("gram"))


def camel_to_snake(name: str) -> str:
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


def project(df: DataFrame, fields: list[str]) -> DataFrame:
    """O-PRJ1: the caller's field selection, camelCase names accepted."""
    return df.select(*[F.col(camel_to_snake(f)) for f in fields])


def geocode_query(number: Column, street: Column, address: Column, city: Column,
                  state: Column, zip5: Column) -> Column:
    """O-PRJ3: "{number} {street}" (else the raw address), then city, state,
    zip5 when present, then USA, joined by ", "."""
    first = F.when(number.isNotNull() & street.isNotNull(),
                   F.concat(number, F.lit(" "), street)).otherwise(address)
    return F.concat_ws(", ", first, city, state, zip5, F.lit("USA"))
