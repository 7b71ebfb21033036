"""Small hostile inputs shared by the tests."""

import random

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000)) + "\n" + "é" * 5000
WORDS = "the river ran past old stone houses while children played near water and birds sang above them all day".split()


def sentence(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 99)) for _ in range(n))


def documents() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars) with nulls, empties, ties, repeats."""
    base = sentence(1, 80)
    w = base.split()
    near = " ".join(w[:40] + ["changed"] + w[41:])
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "b", 2), (3, near, "en", "a", None),
        (4, None, "en", "a", 3), (5, "", None, None, 4), (6, " \t\n ", "de", "é", 5),
        (7, LONG, "en", "a", 6), (8, "one", "en", None, 7), (9, "one", "en", None, 7),
        (None, base, "en", "a", 8), (10, "line a b\nline a b\nline a b\nother", "fr", "b", 9),
        (11, sentence(2, 60), None, "b", 10), (11, sentence(2, 60), None, "b", 10),
        (12, "a b c d e f a b c d e f x", "en", "c", 11),
        (13, "naïve ﬁ ß İ Σσς 日本語 😀 don't we'll 12 345 --- \x1c  x y", "xx", "c", 12),
        (14, "#*$%&|<> !! THE END", "en", "", 13), (None, None, None, None, None),
    ]
    rows += [(100 + i, sentence(50 + i, 3 + i), "en", "abc"[i % 3], i) for i in range(30)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None, extra: bool = True):
    """The rows, with columns whose names clash with what operators use."""
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    if not extra:
        return df
    from pyspark.sql import functions as F

    for name in ("size", "taken", "ids", "decoded", "n_tokens", "score", "kept", "words", "w", "h", "p", "k",
                 "rep", "sig", "tie", "src", "times", "_new", "_c0", "n_entities", "kinds", "Doc_Id", "TEXT"):
        df = df.withColumns({f"__{name}": F.lit("x")}) if name in ("Doc_Id", "TEXT") else df.withColumn(name, F.lit(1))
    names = [c[2:] if c in ("__Doc_Id", "__TEXT") else c for c in df.columns]
    return df.toDF(*names)
