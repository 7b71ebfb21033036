"""WARC archives (operator 9): written by Spark's text sink, read back by
boundary-chain verification.

*Writing.* Equal payloads of at least ``MIN_REVISIT`` bytes share one response,
that of the smallest page_id; the others become revisit records that carry
the digest and length but no payload. Every record is one text value; the
sink's line separator is the blank lines that end a record. Files are
committed by Spark, so a lost executor leaves no half-written archive.

*Reading.* Files are split at every occurrence of the magic ``WARC/1.0\\r\\n``,
wherever it stands, by tasks that read byte ranges. Each piece is a candidate
record: its header names a length and so the offset of its successor. Offsets
are the running sum of the pieces of a split, then of a file's splits. Pointer
jumping (each round doubles the distance) from the file start marks the
candidates on the chain: within the byte range that one task reads, in the
task; from range to range, by self-joins. The others are magic inside a
payload, and their bytes go back to the record they belong to. No task holds
the candidates of more than one byte range, so archives may be of any size.

Defined results: a null html is an empty payload; a null page_id takes part
neither as original nor as revisit of another (its record is a response
without a page id); repeated page rows are separate records, and those equal
in page_id and payload do not revisit themselves; header fields are matched
without regard to case; a file that does not begin with the magic, or whose
chain breaks off, raises an error unless ``strict`` is off, in which case the
records up to the break count. An empty table writes no record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, staged, take_columns

MAGIC = "WARC/1.0\r\n"
BLANK = "\r\n\r\n"
MIN_REVISIT = 100
#: rows of a revisit list that may be broadcast; beyond that it is joined
BROADCAST_ROWS = 200_000


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest and refers_to of every page."""
    p = take_columns(pages, ["page_id", "url", "html"]).select(
        "page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    large = p.where((F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull())
    ids = large.select("page_id", "digest")
    first = (ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
             .where("n > 1").select("digest", "first"))
    revisits = staged(ids.join(first, "digest").where("page_id <> first")
                      .select("page_id", F.col("first").alias("refers_to"),
                              F.col("digest").alias("d")).distinct(), "warc-revisits")
    if revisits.count() <= BROADCAST_ROWS:
        revisits = F.broadcast(revisits)
    return (p.join(revisits, (p["page_id"] == revisits["page_id"]) & (p["digest"] == revisits["d"]), "left")
            .select(p["page_id"], "url", "payload", "digest", "refers_to"))


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))


def record_text(page_id: Column, url: Column, payload: Column, digest: Column,
                refers_to: Column) -> Column:
    """One record without the blank lines behind it."""
    revisit = refers_to.isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(payload.cast("string"))
    clean = F.regexp_replace(url, "[\\r\\n]+", " ")
    return F.concat(
        F.lit(MAGIC),
        F.when(revisit, "WARC-Type: revisit\r\n").otherwise("WARC-Type: response\r\n"),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))),
        _line("WARC-Target-URI", clean),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        _line("X-Payload-Length", F.octet_length(payload).cast("string")),
        _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers_to.cast("string"), F.lit(">"))),
        F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.octet_length(payload)).cast("string"),
        F.lit(BLANK), body)


def write_archives(pages: DataFrame, path: str, max_records_per_file: int = 100_000) -> None:
    """Write one WARC record per page below ``path``."""
    prepare(pages.sparkSession)
    r = plan_records(pages)
    (r.select(record_text(*[F.col(c) for c in ("page_id", "url", "payload", "digest", "refers_to")])
              .alias("value"))
     .write.option("lineSep", BLANK).option("maxRecordsPerFile", max_records_per_file).text(path))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, seq, body): bytes between two magics, numbered within
    the byte range [start, ...) of a file that one task reads."""
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("value").cast("binary").alias("body"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = None, 0
        for b in batches:
            seq = np.empty(b.num_rows, np.int64)
            files, starts = b.column(1).to_pylist(), b.column(2).to_pylist()
            for i in range(b.num_rows):
                if (files[i], starts[i]) != at:
                    at, n = (files[i], starts[i]), 0
                seq[i] = n
                n += 1
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(seq), b.column(0)],
                                             names=["file", "start", "seq", "body"])

    return raw.mapInArrow(number, "file string, start long, seq long, body binary")


def _field(head: Column, name: str) -> Column:
    got = F.regexp_extract(head, f"(?im)^{name}:[ \\t]*([^\\r\\n]*)", 1)
    return F.when(got != "", got)


def _candidates(pieces: DataFrame) -> DataFrame:
    """Header fields, payload bounds and, where the whole payload lies in the
    piece, its digest."""
    text = F.col("body").cast("string")
    head = F.substring_index(text, BLANK, 1)
    p = pieces.withColumn("head", head).withColumn("size", F.octet_length("body").cast("long"))
    p = p.withColumn("skip", (F.octet_length("head") + 4).cast("long")).withColumn(
        "length", F.when(F.col("skip") <= F.col("size"),
                         _field(F.col("head"), "Content-Length").try_cast("long")))
    body = F.substring("body", F.col("skip").cast("int") + 1, F.col("length").cast("int"))
    exact = F.col("skip") + F.col("length") + 4 == F.col("size")
    return p.select("file", "start", "seq", "size", "skip", "length",
                    F.when(F.col("length").isNotNull(), F.col("head")).alias("head"),
                    F.when(exact, F.sha2(body, 256)).alias("digest"))


def _pointers(offset: np.ndarray, succ: np.ndarray, after: int) -> np.ndarray:
    """Index of each candidate's successor among the sorted candidates of one
    split; itself where the successor lies behind the split or nowhere."""
    n = len(offset)
    at = np.minimum(np.searchsorted(offset, succ), max(n - 1, 0))
    inside = (succ >= 0) & (succ < after) & (offset[at] == succ if n else np.zeros(0, bool))
    return np.where(inside, at, np.arange(n))


def last_stops(offset: np.ndarray, succ: np.ndarray, after: int) -> np.ndarray:
    """Where the chain from each candidate of a split leaves it: an offset at
    or behind ``after``, or -1 if it breaks off, by pointer jumping."""
    to = _pointers(offset, succ, after)
    while True:
        on = to[to]
        if np.array_equal(on, to):
            return np.where(succ[to] >= after, succ[to], -1)
        to = on


def reachable(offset: np.ndarray, succ: np.ndarray, after: int, entry: np.ndarray) -> np.ndarray:
    """Mask of a split's candidates on the chains from its entries: in each
    round pointers double their distance and marks spread by one such hop."""
    mark, jump = entry.copy(), _pointers(offset, succ, after)
    while True:
        more = mark.copy()
        more[jump[mark]] = True
        on = jump[jump]
        if np.array_equal(more, mark) and np.array_equal(on, jump):
            return mark
        mark, jump = more, on


def _places(cand: DataFrame) -> DataFrame:
    """file, start, seq, offset in the file, successor's offset (-1: none),
    offset at which the next split begins and of the file's end; the piece
    before any magic has a negative offset. Sums run within a split, then over
    the splits of a file."""
    width = F.lit(len(MAGIC)).cast("long")
    took = F.col("size") + width
    splits = cand.groupBy("file", "start").agg(F.sum(took).alias("total"))
    of_file = Window.partitionBy("file")
    before = of_file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"),
                           "total", (F.sum("total").over(of_file) - width).alias("end"))
    inner = F.coalesce(F.sum(took).over(Window.partitionBy("file", "start").orderBy("seq").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    placed = cand.select("file", "start", "seq", "size", "skip", "length").withColumn("inner", inner).join(
        splits, ["file", "start"])
    offset = F.col("base") + F.col("inner") - width
    return placed.select(
        "file", "start", "seq", offset.alias("offset"),
        F.when(F.col("length") >= 0, offset + width + F.col("skip") + F.col("length") + 4).otherwise(
            F.lit(-1)).cast("long").alias("succ"),
        (F.col("base") + F.col("total") - width).alias("after"), "end", "size")


def _entries(places: DataFrame) -> DataFrame:
    """(file, offset) at which the chain from the file's start enters a split,
    and the file's end if the chain gets there: pointer jumping by self-joins
    over the splits, each round doubling the distance."""
    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["offset"] >= 0].sort_values("offset")
        stops = last_stops(pdf["offset"].to_numpy(), pdf["succ"].to_numpy(), int(pdf["after"].iloc[0]) if len(pdf) else 0)
        return pd.DataFrame({"file": pdf["file"], "offset": pdf["offset"], "to": stops})

    exits = staged(places.select("file", "start", "offset", "succ", "after").groupBy("file", "start").applyInPandas(
        leave, "file string, offset long, to long"), "warc-exits")
    # only candidates that another split's chain may enter, and the first ones
    aims = exits.select("file", F.col("to").alias("offset")).where("offset >= 0").distinct()
    jump = staged(exits.where("offset = 0").unionByName(
        exits.where("offset > 0").join(aims, ["file", "offset"], "left_semi")), "warc-jumps")
    marks, n = jump.where("offset = 0").select("file", "offset"), -1
    while True:
        marks = staged(marks.unionByName(marks.join(jump, ["file", "offset"]).select(
            "file", F.col("to").alias("offset"))).distinct(), "warc-marks")
        was, n = n, marks.count()
        if n == was:
            return marks
        far = jump.select("file", F.col("offset").alias("to"), F.col("to").alias("further"))
        jump = staged(jump.join(far, ["file", "to"], "left").select(
            "file", "offset", F.coalesce("further", "to").alias("to")), "warc-jumps")


def _owners(places: DataFrame, marks: DataFrame) -> DataFrame:
    """file, start, seq, offset, on (a record begins here), owner (offset of the
    record the piece belongs to), part and parts of the owner's pieces."""
    entry = marks.withColumn("entry", F.lit(True))
    flagged = places.join(entry, ["file", "offset"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["offset"] >= 0].sort_values("offset").reset_index(drop=True)
        offset, succ = pdf["offset"].to_numpy(), pdf["succ"].to_numpy()
        if len(pdf):
            on = reachable(offset, succ, int(pdf["after"].iloc[0]), pdf["entry"].to_numpy())
            on &= (succ >= 0) & (succ <= pdf["end"].to_numpy())
        else:
            on = np.zeros(0, bool)
        own = np.maximum.accumulate(np.where(on, np.arange(len(on)), -1)) if len(on) else np.zeros(0, np.int64)
        pdf["on"] = on
        pdf["owner"] = np.where(own >= 0, offset[own] if len(on) else offset, -1)
        pdf["until"] = np.where(own >= 0, succ[own] if len(on) else succ, -1)
        return pdf[["file", "start", "seq", "offset", "on", "owner", "until"]]

    fields = "file string, start long, seq long, offset long, on boolean, owner long, until long"
    walked = staged(flagged.select("file", "start", "seq", "offset", "succ", "after", "end", "entry").groupBy(
        "file", "start").applyInPandas(walk, fields), "warc-walked")
    # the first pieces of a split may belong to a record of an earlier one
    last = walked.where("owner >= 0").groupBy("file", "start").agg(F.max(F.struct("owner", "until")).alias("o"))
    every = walked.select("file", "start").distinct().join(last, ["file", "start"], "left")
    past = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("file", "start", F.max("o").over(past).alias("c"))
    owned = walked.join(carried, ["file", "start"]).select(
        "file", "start", "seq", "offset", "on",
        F.when(F.col("owner") >= 0, F.col("owner")).otherwise(F.col("c.owner")).alias("owner"),
        F.when(F.col("owner") >= 0, F.col("until")).otherwise(F.col("c.until")).alias("until"))
    # pieces behind the end of their owner's payload belong to nobody
    mine = Window.partitionBy("file", "owner")
    return owned.where("offset < until").select(
        "file", "start", "seq", "offset", "on", "owner",
        (F.row_number().over(mine.orderBy("offset")) - 1).alias("part"), F.count("*").over(mine).alias("parts"))


def read_archives(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Every record of the archives below ``path``: file, page_id, url,
    record_type, refers_to, payload_bytes, payload_digest (of the full payload)."""
    prepare(spark)
    pieces = _pieces(spark, path)
    cand = staged(_candidates(pieces), "warc-candidates")
    places = staged(_places(cand), "warc-places")
    marks = _entries(places)
    if strict:
        whole = places.groupBy("file").agg(
            F.max("end").alias("offset"), F.max(F.when(F.col("offset") < 0, F.col("size"))).alias("lead"),
            F.count_if(F.col("offset") >= 0).alias("n"))
        broken = whole.where("lead > 0").select("file").unionByName(
            whole.where("n > 0").join(marks, ["file", "offset"], "left_anti").select("file")).first()
        if broken:
            raise ValueError(f"broken record chain in {broken['file']}")
    found = staged(_owners(places, marks), "warc-chain")
    key = ["file", "start", "seq"]
    heads = cand.join(found.where("on").select(*key, "offset", "parts"), key)
    single = heads.where("parts = 1").select(*key, "head", "length", F.col("digest").alias("own"))
    # payloads that hold the magic are put together from their pieces
    many = found.where("parts > 1")
    if many.isEmpty():
        records = single
    else:
        joined = pieces.join(many, key).select("file", "owner", "part", "body")
        full = (joined.groupBy("file", "owner")
                .agg(F.sort_array(F.collect_list(F.struct("part", "body"))).alias("p"))
                .select("file", F.col("owner").alias("offset"),
                        F.aggregate("p", F.lit(b"").cast("binary"),
                                    lambda a, x: F.when(x["part"] == 0, x["body"]).otherwise(
                                        F.concat(a, F.lit(MAGIC.encode()).cast("binary"), x["body"])))
                        .alias("body")))
        records = single.unionByName(
            heads.where("parts > 1").join(full, ["file", "offset"]).select(
                *key, "head", "length",
                F.sha2(F.substring("body", F.col("skip").cast("int") + 1, F.col("length").cast("int")), 256)
                .alias("own")))
    h = F.col("head")
    page = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1)
    kind = _field(h, "WARC-Type")
    stated = F.regexp_replace(_field(h, "WARC-Payload-Digest"), "^sha256:", "")
    rec = records.select(
        "file", page(_field(h, "WARC-Record-ID")).try_cast("long").alias("page_id"),
        _field(h, "WARC-Target-URI").alias("url"), kind.alias("record_type"),
        F.when(kind == "revisit", page(_field(h, "WARC-Refers-To")).try_cast("long")).alias("refers_to"),
        F.when(kind == "revisit", _field(h, "X-Payload-Length").try_cast("long")).otherwise(F.col("length"))
        .alias("payload_bytes"),
        F.when(kind == "revisit", stated).otherwise(F.col("own")).alias("payload_digest"),
        stated.alias("stated"))
    bad = (F.col("record_type") == "response") & (F.col("stated") != F.col("payload_digest"))
    if strict:
        rec = rec.withColumn("payload_digest", F.when(
            bad, F.raise_error(F.lit("payload digest differs from its header")).cast("string"))
            .otherwise(F.col("payload_digest")))
    return rec.drop("stated")
