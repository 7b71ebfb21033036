"""Change batches applied to a table (O-CHG1..5).

A batch of inserts / updates / deletes produces the new table plus a
per-change outcome; nothing is modified in place (write the result to a new
path, or MERGE it with a table format that supports it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _cast_like(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DateType):
        return F.try_to_date(c.cast("string"), "yyyy-MM-dd")
    return c.try_cast(dtype)


def insert_rows(base: DataFrame, new: DataFrame, key: str = "atom_id",
                order_col: str | None = None) -> DataFrame:
    """O-CHG1: append ``new`` to ``base``; rows without a key get
    ``max(key) + 1, + 2, ...`` in batch order (autoincrement); ISO date
    strings are cast to the base's date columns.

    Dense numbering without a global sort: per-partition row counts (one
    small table, one row per partition, joined back) give each partition an offset;
    the row's index inside its partition comes from
    ``monotonically_increasing_id``. With ``order_col`` the batch is range-
    partitioned and sorted on it first (a distributed sort, no single-task
    window), so keys follow that order. The batch is checkpointed first so
    the ids are computed over a fixed partitioning.
    """
    schema = base.schema
    cols = []
    for f in schema.fields:
        if f.name in new.columns:
            cols.append(_cast_like(F.col(f.name), f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    extra = [F.col(order_col).alias("_order")] if order_col else []
    batch = new.select(*cols, *extra)
    needs = batch.where(F.col(key).isNull())
    has = batch.where(F.col(key).isNotNull())
    start = base.agg(F.max(key)).first()[0]
    start_has = has.agg(F.max(key)).first()[0]
    start = max([v for v in (start, start_has) if v is not None], default=0)
    if order_col:
        # as many ranges as Spark's shuffles have, which adaptive execution sizes by bytes
        needs = needs.repartitionByRange("_order").sortWithinPartitions("_order")
    needs = needs.checkpoint(eager=True)
    mid = F.monotonically_increasing_id()
    tagged = needs.withColumn("_mid", mid).withColumn("_part", F.shiftright("_mid", 33))
    # one row per partition: rows of all partitions before it
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tagged.groupBy("_part").agg(F.count("*").alias("n")).select(
        "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_off"))
    idx = F.col("_mid") - F.shiftleft(F.col("_part"), 33)
    new_key = (F.lit(start) + F.col("_off") + idx + 1).cast(schema[key].dataType)
    numbered = tagged.join(offsets, "_part").withColumn(key, new_key).drop("_mid", "_part", "_off")
    names = schema.fieldNames()
    return base.unionByName(has.select(*names)).unionByName(numbered.select(*names))


def patch_rows(base: DataFrame, changes: DataFrame, key: str = "atom_id",
               change_col: str = "change", seq_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """O-CHG2: partial update. ``changes`` holds (key, change MAP<STRING,STRING>
    [, seq]): only fields *present* in the map are set, a present NULL sets
    NULL. Several changes per key apply in ``seq`` order, per field the last
    present value wins; without ``seq_col`` they are rejected. Changing the key
    itself is rejected.

    Returns (new table, report with ``found`` per changed key).
    """
    seq = F.col(seq_col) if seq_col else F.lit(0)
    e = changes.select(F.col(key), seq.alias("_seq"), F.explode(F.map_entries(change_col)).alias("e"))
    bad = e.where(F.col("e.key") == F.lit(key)).limit(1).count()
    if bad:
        raise ValueError(f"a change may not set the key column {key!r}")
    per_field = e.groupBy(key, F.col("e.key").alias("field")).agg(
        F.max_by(F.struct(F.col("e.value").alias("v")), F.col("_seq")).alias("_v"),
        F.count("*").alias("n")).select(key, "field", "n", F.col("_v.v").alias("value"))
    if seq_col is None and not per_field.where("n > 1").isEmpty():
        raise ValueError("several changes set one field of a key: name a seq_col that orders them")
    merged = per_field.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_m"))
    j = base.join(merged, key, "left")
    out = []
    for f in base.schema.fields:
        if f.name == key:
            out.append(F.col(key))
            continue
        hit = F.coalesce(F.map_contains_key(F.col("_m"), F.lit(f.name)), F.lit(False))
        out.append(F.when(hit, _cast_like(F.col("_m")[f.name], f.dataType))
                   .otherwise(F.col(f.name)).alias(f.name))
    report = merged.select(key).join(base.select(key).withColumn("found", F.lit(True)), key, "left") \
        .withColumn("found", F.coalesce("found", F.lit(False)))
    return j.select(*out), report


def replace_rows(base: DataFrame, changes: DataFrame, key: str = "id",
                 seq_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """O-CHG3: full replacement of the non-key fields of existing keys
    (unknown keys are reported, not inserted). Of several changes for one key
    the last by ``seq_col`` counts; without it, the largest by its values, so
    that a rerun gives the same rows."""
    names = [c for c in changes.columns if c != seq_col]
    whole = F.struct(*[F.col(c) for c in names])
    order = F.struct(F.col(seq_col), whole) if seq_col else whole
    changes = changes.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, order).alias("_r")).select(
        *[F.col("_r")[c].alias(c) for c in names])
    r = changes.select(*[F.col(c).alias(f"_n_{c}") for c in changes.columns])
    j = base.join(r, base[key] == r[f"_n_{key}"], "left")
    matched = F.col(f"_n_{key}").isNotNull()
    out = [F.col(key) if c == key else
           (F.when(matched, F.col(f"_n_{c}").cast(base.schema[c].dataType)).otherwise(F.col(c))
            if c in changes.columns else F.col(c)).alias(c) for c in base.columns]
    report = changes.select(key).join(base.select(key).withColumn("found", F.lit(True)), key, "left") \
        .withColumn("found", F.coalesce("found", F.lit(False)))
    return j.select(*out), report


def delete_rows(base: DataFrame, keys: DataFrame, key: str = "atom_id") -> tuple[DataFrame, DataFrame]:
    """O-CHG4: delete by key (anti-join); report unknown keys."""
    k = keys.select(F.col(keys.columns[0]).alias(key)).distinct()
    remaining = base.join(k, key, "left_anti")
    report = k.join(base.select(key).withColumn("found", F.lit(True)), key, "left") \
        .withColumn("found", F.coalesce("found", F.lit(False)))
    return remaining, report
