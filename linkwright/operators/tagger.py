"""Sequence tagger of addresses without commas (O-PRS4).

The rule tagger needs a comma before the city. Here the same tags are the
states of a linear chain: every token is scored by its kind (number, unit,
direction, suffix, mixed, word) and, if it is a word, by how often its hash
bucket stood in street names and in cities; tags follow each other by
transition weights. Weights are smoothed counts over rule-tagged rows, summed
by Spark and of fixed size whatever the number of rows. The best sequence is
found by Viterbi decoding, a fold over the row's tokens in column expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.similarity import _let

#: letter of each tag, in the order that a full address has them
TAGS = {"AddressNumber": "N", "StreetNamePreDirectional": "P", "StreetName": "S", "StreetNamePostType": "T",
        "StreetNamePostDirectional": "Q", "OccupancyType": "U", "OccupancyIdentifier": "I", "PlaceName": "C"}
LETTERS = "".join(TAGS.values())
#: tags whose words are told apart by hash bucket
WORDED = "SC"
KINDS = ["num", "unit", "dir", "suf", "mixed", "word"]
#: buckets of three hexadecimal digits
BUCKETS = 4096
TOKEN = r"#|[^\s,#]+"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), 0)


def kind(token: Column) -> Column:
    """Index into KINDS."""
    t = F.upper(F.rtrim(token, F.lit(".")))
    return F.when(t.rlike("^[0-9]+$"), 0).when((t == "#") | t.isin(text.TAG_UNITS), 1) \
        .when(t.isin(text.TAG_DIRECTIONS), 2).when(t.isin([s.upper() for s in text.TAG_SUFFIXES]), 3) \
        .when(t.rlike("[0-9]"), 4).otherwise(5)


def bucket(token: Column) -> Column:
    return F.conv(F.substring(F.md5(F.lower(token)), 1, 3), 16, 10).cast("int")


@dataclass(frozen=True)
class ChainModel:
    """Log weights: first tags, tag to tag, last tags, kinds per tag, and word
    buckets of the WORDED tags."""

    start: list[float]
    step: list[list[float]]
    end: list[float]
    kinds: list[list[float]]
    words: dict[str, list[float]]


def _events(df: DataFrame, col: str) -> DataFrame:
    """(what, a, b): each tag step, kind and word bucket of the rule-tagged rows."""
    tagged = text.with_tags(df, col, "_t")
    known = F.col("_t.PlaceName").isNotNull() & F.col("_t.StreetName").isNotNull()

    def labelled(name: str, letter: str) -> Column:
        return F.transform(tokens(F.col("_t")[name]), lambda w: F.named_struct(
            F.lit("tag"), F.lit(letter), F.lit("w"), w, F.lit("kind"), kind(w)))

    seq = F.concat(*[labelled(name, letter) for name, letter in TAGS.items()])
    # as rows of a generator: a filter on them is not pushed below a repartitioning of
    # the input, where the rules would run a second time in the few tasks of its scan
    rows = tagged.select(F.inline(F.array(F.struct(F.when(known, seq).alias("seq"))))).where(F.size("seq") > 0)

    def event(what: str, a: Column, b: Column) -> Column:
        return F.named_struct(F.lit("what"), F.lit(what), F.lit("a"), a, F.lit("b"), b)

    # all counts of a row in one pass, so that its tags are made once
    letters = F.concat(F.array(F.lit("<")), F.col("seq.tag"), F.array(F.lit(">")))
    moves = F.zip_with(F.slice("x", 1, F.size("x") - 1), F.slice("x", 2, F.size("x") - 1),
                       lambda a, b: event("move", a, b))
    seen = F.transform("seq", lambda s: event("kind", s["tag"], s["kind"].cast("string")))
    words = F.transform(F.filter("seq", lambda s: (s["kind"] == 5) & s["tag"].isin(list(WORDED))),
                        lambda s: event("word", s["tag"], bucket(s["w"]).cast("string")))
    return rows.withColumn("x", letters).select(F.explode(F.concat(moves, seen, words)).alias("e")).select("e.*")


def fit(df: DataFrame, col: str) -> ChainModel:
    """Weights from the rule tagger's tags of all addresses with a city and a
    street name. At most 10 * 10 + 8 * 6 + 2 * 4096 counts reach the driver."""
    n = {(r["what"], r["a"], r["b"]): r["count"]
         for r in _events(df, col).groupBy("what", "a", "b").count().collect()}

    def logs(what: str, a: str, options: list[str]) -> list[float]:
        got = [n.get((what, a, b), 0) for b in options]
        return [math.log((x + 1.0) / (sum(got) + len(options))) for x in got]

    after = {a: logs("move", a, [*LETTERS, ">"]) for a in "<" + LETTERS}
    return ChainModel(
        start=after["<"][:-1], step=[after[a][:-1] for a in LETTERS], end=[after[a][-1] for a in LETTERS],
        kinds=[logs("kind", a, [str(i) for i in range(len(KINDS))]) for a in LETTERS],
        words={a: logs("word", a, [str(i) for i in range(BUCKETS)]) for a in WORDED})


def _numbers(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def decode(df: DataFrame, model: ChainModel, toks: str, out: str) -> DataFrame:
    """``out``: one tag letter per token of the array column ``toks``, the
    sequence of highest weight (of equal ones the last in letter order)."""
    spark = df.sparkSession
    words = spark.createDataFrame([(1, *[model.words[a] for a in WORDED])], ["_one", *[f"_w{a}" for a in WORDED]])
    start, end, step = _numbers(model.start), _numbers(model.end), F.array(*[_numbers(r) for r in model.step])
    letters = F.array(*[F.lit(x) for x in LETTERS])

    def weights(t: Column) -> Column:
        def of(k: Column, b: Column) -> Column:
            unseen = F.lit(-math.log(BUCKETS))
            word = [F.get(F.col(f"_w{a}"), b) if a in WORDED else unseen for a in LETTERS]
            return F.array(*[F.get(_numbers(model.kinds[i]), k) + F.when(k == 5, word[i]).otherwise(0.0)
                             for i in range(len(LETTERS))])

        return _let(of, kind(t), bucket(t))

    every = F.sequence(F.lit(0), F.lit(len(LETTERS) - 1))

    def advance(state: Column, w: Column) -> Column:
        def to(j: Column) -> Column:
            best = F.array_max(F.transform(state, lambda x, i: F.named_struct(
                F.lit("s"), x["s"] + F.get(F.get(step, i), j), F.lit("p"), x["p"])))
            return _let(lambda b: F.named_struct(
                F.lit("s"), b["s"] + F.get(w, j), F.lit("p"), F.concat(b["p"], F.get(letters, j))), best)

        return F.transform(every, to)

    first = F.transform(every, lambda j: F.named_struct(
        F.lit("s"), F.get(start, j) + F.get(F.get(F.col("_e"), F.lit(0)), j), F.lit("p"), F.get(letters, j)))
    scored = df.withColumn("_one", F.lit(1).cast("long")).join(F.broadcast(words), "_one").withColumn(
        "_e", F.transform(F.col(toks), weights)).drop("_one", *words.columns[1:])
    path = F.aggregate(F.slice("_e", 2, F.greatest(F.size("_e") - 1, F.lit(0))), first, advance, lambda state: F.array_max(
        F.transform(state, lambda x, i: F.named_struct(F.lit("s"), x["s"] + F.get(end, i), F.lit("p"), x["p"])))["p"])
    return scored.withColumn(out, F.when(F.size("_e") > 0, path).otherwise("")).drop("_e")


def tag_sequences(df: DataFrame, col: str, model: ChainModel, out: str = "tags") -> DataFrame:
    """O-PRS4: the rule tagger's tags where it finds a city after a comma;
    elsewhere ZIP and state from the end and the chain's tags before them."""
    staged = df.withColumn("_g1", text._tag_stage1(F.col(col))).withColumn("_g2", text._tag_stage2(F.col("_g1"))) \
        .withColumn("_rule", text._tag_stage3(F.col("_g2")))
    # the chain is only asked where the rules found no city
    staged = staged.withColumn("_toks", F.when(F.col("_rule.PlaceName").isNull(), tokens(F.col("_g1.rest"))).otherwise(
        F.array().cast("array<string>")))
    done = decode(staged, model, "_toks", "_path")

    def of(letter: str) -> Column:
        mine = F.filter("_toks", lambda t, i: F.substring(F.col("_path"), i + 1, F.lit(1)) == letter)
        return F.when(F.size(mine) > 0, F.array_join(mine, " "))

    chain = F.struct(*[of(x).alias(name) for name, x in TAGS.items()],
                     F.col("_rule.StateName").alias("StateName"), F.col("_rule.ZipCode").alias("ZipCode"))
    return done.withColumn(out, F.when(F.col("_rule.PlaceName").isNotNull(), F.col("_rule")).otherwise(chain)) \
        .drop("_g1", "_g2", "_rule", "_toks", "_path")
