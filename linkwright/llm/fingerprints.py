"""Document fingerprints (operator 11): threshold-scaled sketches.

A sketch keeps every hash of a text's five-word shingles that lies below a
fixed fraction of the hash space, so its size follows the text's and the
sketches of a short and of a very long text are samples of one rate: the share
of one's hashes found in the other estimates containment without bias. Texts
with fewer than ``FLOOR`` hashes below the threshold keep their ``FLOOR``
smallest ones, so a short text is never left without a sketch. Both rules
survive union, so sketches merge: ``merge`` of two sketches is the sketch of
both texts' shingles together.

A sketch says by itself how far it is complete: up to the threshold, up to its
largest hash (a floor sketch), or wholly (fewer than ``FLOOR`` hashes). Two
sketches are compared below the smaller of both limits.

Everything here is DataFrame expressions: no Python runs in the tasks.

Defined results: a null text is empty; a text of fewer than five words has one
shingle; a text without words has an empty sketch, whose likeness is 1 to
another empty one and 0 to any other. Documents follow each other by doc_id
descending, rows without doc_id last, rows of one doc_id by a hash of their
texts; equal rows follow each other, so all but the last have their own text
as the next one's. Of an empty table nothing is returned. Extra columns are
dropped first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BREAK_PATTERN, staged, take_columns

WINDOW = 5
#: one of so many hashes is kept
SCALE = 8
#: smallest number of hashes kept of a text that has as many
FLOOR = 16
_TOP = (1 << 63) - 1
#: rows of one range when documents are put in order
RANGE_ROWS = 500_000


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def _threshold(scale: int) -> int:
    return (1 << 63) // scale


def shingle_hashes(text: Column, size: int = WINDOW) -> Column:
    """63-bit hash of every window of ``size`` words, in text order."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))

    def windows(w: Column) -> Column:
        last = F.greatest(F.size(w) - size, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(
            *[F.get(w, i + j) for j in range(size)]).bitwiseAND(F.lit(_TOP)))

    return F.when(bare == "", F.array().cast("array<bigint>")).otherwise(
        _let(F.split(bare, WORD_BREAK_PATTERN), windows))


def _keep(hashes: Column, scale: int, floor: int) -> Column:
    t = F.lit(_threshold(scale))

    def choose(all_: Column) -> Column:
        below = F.array_sort(F.array_distinct(F.filter(all_, lambda h: h < t)))
        return _let(below, lambda b: F.when(F.size(b) >= floor, b).otherwise(
            F.slice(F.array_sort(F.array_distinct(all_)), 1, floor)))

    return _let(hashes, choose)


def sketch(text: Column, scale: int = SCALE, floor: int = FLOOR, size: int = WINDOW) -> Column:
    """Sorted distinct hashes of the text's sketch, as array<bigint>."""
    return _keep(shingle_hashes(text, size), scale, floor)


def merge(a: Column, b: Column, scale: int = SCALE, floor: int = FLOOR) -> Column:
    """The sketch of both texts' shingles together."""
    return _keep(F.concat(a, b), scale, floor)


def encoded(hashes: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits per hash, ascending."""
    return F.concat_ws("", F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))))


def _limit(a: Column, scale: int, floor: int) -> Column:
    """Every hash of the text below this is in the sketch."""
    t, last = F.lit(_threshold(scale)), F.element_at(a, -1)
    return F.when(F.size(a) < floor, F.lit(_TOP)).when(last < t, t).otherwise(last + 1)


def _shared(a: Column, b: Column, scale: int, floor: int, ratio) -> Column:
    def at(limit: Column) -> Column:
        cut = F.named_struct(F.lit("a"), F.filter(a, lambda h: h < limit), F.lit("b"), F.filter(b, lambda h: h < limit))
        return _let(cut, lambda c: _let(F.size(F.array_intersect(c["a"], c["b"])).cast("double"), lambda n: ratio(
            n, F.size(c["a"]).cast("double"), F.size(c["b"]).cast("double"))))

    both_empty = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(both_empty, F.lit(1.0)).otherwise(
        _let(F.least(_limit(a, scale, floor), _limit(b, scale, floor)), at))


def likeness(a: Column, b: Column, scale: int = SCALE, floor: int = FLOOR) -> Column:
    """Estimated Jaccard similarity of two texts' shingles, from their sketches."""
    return _shared(a, b, scale, floor, lambda n, x, y: F.when(
        x + y > n, n / (x + y - n)).otherwise(0.0))


def containment(a: Column, b: Column, scale: int = SCALE, floor: int = FLOOR) -> Column:
    """Estimated share of a's shingles that b has too; 0 where none of a's
    hashes lies below the limit of both sketches."""
    return _shared(a, b, scale, floor, lambda n, x, y: F.when(x > 0, n / x).otherwise(0.0))


def fingerprint_rows(df: DataFrame, scale: int = SCALE, floor: int = FLOOR) -> DataFrame:
    """``df`` (doc_id, text) with its sketch: doc_id, text, sketch."""
    rows = take_columns(df, ["doc_id", "text"])
    return rows.withColumn("sketch", sketch(F.col("text"), scale, floor))


# ------------------------------------------------------- order of documents
def neighbours(keys: DataFrame) -> DataFrame:
    """``keys`` (distinct k, with doc_id and n) and pk, pn: k and n of the row
    before by doc_id descending, nulls last, k; the last row stands before the
    first.

    Ranges are sorted apart; only the last row of each is brought to the next.
    """
    parts = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                math.ceil(keys.count() / RANGE_ROWS))
    order = [F.col("doc_id").desc_nulls_last(), F.col("k").asc()]
    ranged = staged(keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "fp-order")
    here = Window.partitionBy("part").orderBy(*order)
    linked = ranged.select("*", F.lag(F.struct("k", "n")).over(here).alias("p"),
                           F.lead("n").over(here).isNull().alias("is_last"))
    # one row per range, in the order of ranges: their number is fixed above
    across, ends = Window.orderBy("part"), Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    last = linked.where("is_last").select("part", F.struct("k", "n").alias("tail"))
    edge = last.select("part", F.coalesce(
        F.lag("tail").over(across), F.last("tail").over(ends)).alias("before"))
    return linked.join(edge, "part").withColumn("p", F.coalesce("p", "before")).select(
        *keys.columns, F.col("p.k").alias("pk"), F.col("p.n").alias("pn"))


def compare_with_next(df: DataFrame, scale: int = SCALE, floor: int = FLOOR) -> DataFrame:
    """Sketches of every text and of its edited form, with likeness estimates.

    The edited form is the text with its last floor(n_chars / 2) code points
    replaced by as many first ones of the next document. Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next (likeness), in_edited, in_next (share of the text's shingles
    found there).

    Whole texts are shuffled once, by a key of id and text (both uses of
    ``one`` read one exchange); at most half of a text, the part its
    predecessor needs, is shuffled a second time.
    """
    text = F.coalesce("text", F.lit(""))
    docs = take_columns(df, ["doc_id", "text"]).select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.substring(F.unhex(F.sha2(F.concat_ws(
            ":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.sha2("text", 256)), 256)), 1, 16).alias("k"))
    # equal rows are one row with a count, combined before the shuffle
    keys = staged(docs.groupBy("k").agg(F.first("doc_id").alias("doc_id"), F.first(F.length("text")).alias("n"),
                                        F.count("*").alias("c")), "fp-keys")
    links = staged(neighbours(keys), "fp-links")
    one = docs.groupBy("k").agg(F.first("text").alias("text"))
    gifts = one.join(links.select("k", "pk", "pn"), "k").select(
        F.col("pk").alias("k"), F.expr("substring(text, 1, pn div 2)").alias("piece"),
        sketch(F.col("text"), scale, floor).alias("next_sk"))
    met = one.join(links.select("k", "doc_id", "n", "c"), "k").join(gifts, "k").withColumn(
        "sk", sketch(F.col("text"), scale, floor))
    half = F.expr("n div 2")
    follow = F.struct(F.col("piece"), F.col("next_sk"), F.lit(1).cast("long").alias("times"))
    itself = F.struct(F.expr("substring(text, 1, n div 2)").alias("piece"), F.col("sk").alias("next_sk"),
                      (F.col("c") - 1).alias("times"))
    cases = met.select("doc_id", "text", "n", "sk", F.explode(
        F.when(F.col("c") > 1, F.array(follow, itself)).otherwise(F.array(follow))).alias("x"))
    edited = cases.select(
        "doc_id", "n", "sk", "x.next_sk", "x.times",
        F.concat(F.substring("text", F.lit(1), F.col("n") - half), "x.piece").alias("edited"))
    done = edited.withColumn("edited_sk", sketch(F.col("edited"), scale, floor))
    a, e, x = F.col("sk"), F.col("edited_sk"), F.col("next_sk")
    return done.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        encoded(a).alias("fingerprint"), encoded(e).alias("edited_fingerprint"),
        likeness(a, e, scale, floor).alias("near_edited"), likeness(a, x, scale, floor).alias("near_next"),
        containment(a, e, scale, floor).alias("in_edited"), containment(a, x, scale, floor).alias("in_next"),
        F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("_t")).drop("_t")
