"""Quality rules (operator 4): a threshold table compiled into one Spark
projection, evaluated without user functions and without a shuffle.

Every measure is a column expression over the whole text. A rule compares
``numerator / denominator`` with a limit by multiplication, so a rule whose
denominator is 0 holds. ``kept`` is the conjunction of the rules, false where
the base rule fails.

Defined results: a null text has no words and no lines, so it fails the base
rule; repeated rows give repeated rows; extra columns of the input are
dropped before the measures are named. Equal five-word windows are recognised
by a 64-bit hash of their words within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAK_PATTERN, take_columns

# Frequent function words of the four languages.
STOP_WORDS = (
    "the be to of and that have with this for not you was are on in it is at by from "
    "der die das und ist nicht von zu mit den ein eine im auf sich für des dem als "
    "le la les et de des un une est que pour dans qui sur au avec "
    "el los las y en que un una es por con para no se del su al"
).split()

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """numerator / denominator must be <= (or >=) limit."""

    name: str
    numerator: str
    denominator: str
    op: str
    limit: float

    def holds(self) -> Column:
        left, right = F.col(self.numerator).cast("double"), F.col(self.denominator) * self.limit
        return left <= right if self.op == "<=" else left >= right


#: the threshold table; limits follow published web-text filters
DEFAULT_RULES = (
    Rule("mean_word_length_low", "word_chars", "n_words", ">=", 2.0),
    Rule("mean_word_length_high", "word_chars", "n_words", "<=", 14.0),
    Rule("symbols_per_word", "n_symbols", "n_words", "<=", 0.1),
    Rule("exclamations_per_word", "n_exclamations", "n_words", "<=", 0.5),
    Rule("stop_word_share", "n_stop_words", "n_words", ">=", 0.005),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", "<=", 0.3),
)


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def measures(df: DataFrame) -> DataFrame:
    """doc_id and the counts that rules refer to, one narrow projection chain.

    Arrays that several expressions read are columns of their own; Spark
    keeps such projections apart, so nothing is computed per element twice.
    """
    text = F.coalesce("text", F.lit(""))
    base = take_columns(df, ["doc_id", "text"]).select(
        "doc_id", text.alias("text"),
        F.array_remove(F.split(text, WORD_BREAK_PATTERN), "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
        .alias("lines"))
    n = F.size("w")
    counted = base.select(
        "doc_id", n.cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        _count_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        _count_of(F.col("text"), "!").alias("n_exclamations"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(list(dict.fromkeys(STOP_WORDS)))))
        .cast("long").alias("n_stop_words"),
        F.when(n >= WINDOW, F.transform(
            F.sequence(F.lit(0), n - WINDOW),
            lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(WINDOW)])))
        .otherwise(F.array().cast("array<bigint>")).alias("h"))
    # positions are only sorted where some window occurs twice
    placed = counted.withColumn(
        "s", F.when(F.size(F.array_distinct("h")) < F.size("h"),
                    F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twice = placed.withColumn("p", F.sort_array(F.filter(F.transform(
        "s", lambda x, j: F.when((F.get("s", j - 1)["h"] == x["h"]) | (F.get("s", j + 1)["h"] == x["h"]),
                                 x["i"])), lambda v: v.isNotNull())))
    covered = F.aggregate(
        "p", F.struct(F.lit(0).cast("long").alias("c"), F.lit(-WINDOW).alias("last")),
        lambda acc, x: F.struct((acc["c"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("c"),
                                x.alias("last")))["c"]
    return twice.withColumn("n_repeat_words", F.when(F.col("p").isNull(), F.lit(0).cast("long"))
                            .otherwise(covered)).drop("h", "s", "p")


def quality_rules(df: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """doc_id, the measures, base_failed, one boolean per rule, kept."""
    m = measures(df)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = ~failed
    for r in rules:
        kept = kept & r.holds()
    return m.select("*", failed.alias("base_failed"),
                    *[r.holds().alias(f"ok_{r.name}") for r in rules], kept.alias("kept"))
