"""Record sources and sinks (O-SRC1..4, O-SNK1..4).

Records are ``(pos LONG, record MAP<STRING,STRING>)``: a map keeps document
key order (an inferred struct would sort the keys and break "first wins").
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _last_value_per_key(entries):
    """Python's dict keeps the *last* value of a repeated key at the *first*
    key's position; Spark's map_from_entries rejects duplicates. Keep the
    first position of each key with the last value written for it."""
    def pick(e, i):
        later = F.filter(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))),
                         lambda x: x["key"] == e["key"])
        earlier = F.exists(F.slice(entries, 1, i), lambda x: x["key"] == e["key"])
        last = F.when(F.size(later) > 0, F.get(later, F.size(later) - 1)["value"]) \
            .otherwise(e["value"])
        return F.when(~earlier, F.struct(e["key"].alias("key"), last.alias("value")))
    return F.filter(F.transform(entries, pick), lambda x: x.isNotNull())


def read_records_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """O-SRC1. ``lines=False``: each file is one JSON array of objects (not
    splittable: one task per file). ``lines=True``: JSON-lines, splittable,
    the path for large inputs. ``pos`` orders records within the input."""
    if lines:
        raw = spark.read.text(path).where(F.trim(F.col("value")) != "")
        df = raw.select(F.from_json("value", "map<string,string>").alias("record"))
        return df.select(F.monotonically_increasing_id().alias("pos"),
                         F.map_from_entries(_last_value_per_key(F.map_entries("record")))
                         .alias("record"))
    raw = spark.read.text(path, wholetext=True)
    arr = raw.select(F.input_file_name().alias("_file"),
                     F.from_json("value", "array<map<string,string>>").alias("_arr"))
    ex = arr.select("_file", F.posexplode("_arr").alias("_i", "record"))
    ex = ex.withColumn("record", F.map_from_entries(
        _last_value_per_key(F.map_entries("record"))))
    # pos orders records by file name, then inside the file (one row per file is ranked)
    files = arr.select("_file").distinct().select(
        "_file", (F.row_number().over(Window.orderBy("_file")) - 1).cast("long").alias("_rank"))
    ex = ex.join(F.broadcast(files), "_file")
    cols = [(F.shiftleft("_rank", 33) + F.col("_i")).alias("pos"), "record"]
    if not isinstance(path, str) or any(ch in path for ch in "*?["):
        cols.append(F.col("_file").alias("source_file"))
    return ex.select(*cols)


def read_records_csv(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """O-SRC2: header CSV; an empty cell is '' (Spark reads it as NULL, the
    reference as ''), so NULLs are coalesced to ''. ``wide=True`` returns the
    columns as read; otherwise ``(pos, record MAP)`` in header order."""
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    cols = df.columns
    df = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in cols])
    if wide:
        return df
    rec = F.map_from_arrays(F.array(*[F.lit(c) for c in cols]),
                            F.array(*[F.col(f"`{c}`") for c in cols]))
    return df.select(F.monotonically_increasing_id().alias("pos"), rec.alias("record"))


def read_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """O-SRC3: dispatch on the extension, case-insensitive."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext in (".json", ".jsonl", ".ndjson"):
        return read_records_json(spark, path, lines=lines or ext != ".json")
    if ext == ".csv":
        return read_records_csv(spark, path)
    raise ValueError(f"Unsupported file format: {ext or path!r}; only .json and .csv")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str = "parquet") -> DataFrame:
    """O-SRC4: full scan of a typed table (filters/projections applied later
    are pushed into the scan by Catalyst)."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def records_from_json_column(df: DataFrame, json_col: str, pos_col: str,
                             keep: list[str] | None = None) -> DataFrame:
    """JSON object text per row (e.g. ``events.props``) -> (pos, record), and
    the columns ``keep``."""
    m = F.from_json(F.col(json_col), "map<string,string>")
    return df.select(F.col(pos_col).cast("long").alias("pos"), m.alias("record"), *(keep or []))


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """O-SNK1: CSV with header or JSON lines by extension; JSON keeps NULL
    fields (written as null)."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext == ".csv":
        df.write.mode(mode).option("header", True).csv(path)
    elif ext in (".json", ".jsonl"):
        df.write.mode(mode).option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"Unsupported output format: {ext}")


def append_audit(audit_df: DataFrame, path: str, fmt: str = "json") -> None:
    """O-SNK2: append-only audit log."""
    audit_df.write.mode("append").format(fmt).option("ignoreNullFields", False).save(path)


def read_audit(spark: SparkSession, path: str, schema: T.StructType | str,
               fmt: str = "json") -> DataFrame:
    """O-SNK2 read-back; empty result when nothing was written yet."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except Exception as exc:  # path does not exist yet
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return spark.createDataFrame([], schema)
        raise


def write_matches(df: DataFrame, path: str) -> None:
    """O-SNK3: ``address1_id,address1,address2_id,address2,similarity`` CSV."""
    df.select("address1_id", "address1", "address2_id", "address2", "similarity") \
        .write.mode("overwrite").option("header", True).csv(path)


def write_valid(df: DataFrame, path: str, errors_col: str = "errors") -> bool:
    """O-SNK4: valid rows as JSON (dates as ISO text); nothing written when
    no row is valid. Returns whether anything was written."""
    valid = df.where(F.size(F.col(errors_col)) == 0).drop(errors_col)
    if valid.limit(1).count() == 0:
        return False
    valid.write.mode("overwrite").option("ignoreNullFields", False) \
        .option("dateFormat", "yyyy-MM-dd").json(path)
    return True
