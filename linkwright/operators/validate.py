"""Facility validation (O-VAL1..3): rules become one ``errors`` array column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: restricted facility-name terms, in the reference's order --
RESTRICTED_TERMS = [
    "BLIND", "BLINDED", "BLOCKED", "BLOCKED PER CUSTOMER",
    "RGH ENTERPRISE, INC.", "RGH ENTERPRISES", "BYRAM HEALTHCARE",
    "PHARMACY CONFIDENTIAL LTC", "PHARMACY CONFIDENTIAL ACUTE",
    "PATIENT DATA", "ZIPPED CUSTOMER NAME", "MPCS BLINDED",
    "WOUND CARE", "PATIENT SALE", "HOME PATIENT", "MASKED ACUTE",
    "CONFIDENTIAL", "SHIP TO", "CONFIDENTIAL PATIENT INFO", "XX",
]
FACILITY_FIELDS = ["atom_id", "source", "facility_name", "addr1", "addr2", "city", "state",
                   "zip", "auth_type", "auth_id", "expire_date", "first_observed",
                   "data_type", "class_of_trade"]
OPTIONAL_FIELDS = {"addr2"}
NOT_BLANK_FIELDS = ["facility_name", "addr1", "city", "state", "zip", "auth_id"]
DATE_FIELDS = ["expire_date", "first_observed"]
BLOCKED_ADDRESS_PREFIX = "PATIENT DELIVERY"
MSG_RESTRICTED = "Facility name contains restricted term: "
MSG_ADDRESS = "Address cannot start with 'PATIENT DELIVERY'"
MSG_EMPTY = "Field {field} cannot be empty"
MSG_DATE = ("Invalid date format: ", ". Use YYYY-MM-DD format.")
MSG_REQUIRED = "Field required"
MSG_INTEGER = "Input should be a valid integer"
# ---------------------------------------------------------------------------


def _err(field: str, cond: Column, message: Column | str) -> Column:
    msg = F.lit(message) if isinstance(message, str) else message
    return F.when(cond, F.struct(F.lit(field).alias("field"), msg.alias("error")))


def _blank(c: Column) -> Column:
    return c.isNull() | (F.regexp_replace(c, r"(?U)^\s+|\s+$", "") == "")


def _as_date(c: Column, dtype: str) -> Column:
    if dtype == "date":
        return c
    if dtype == "timestamp":
        return F.to_date(c)
    return F.try_to_date(c.cast("string"), "yyyy-MM-dd")


def validate_facilities(df: DataFrame) -> DataFrame:
    """O-VAL1: adds ``errors ARRAY<STRUCT<field, error>>`` (one per failing
    field, first failing rule of the field) and casts the dates to DATE.

    facility_name: first restricted term contained in the upper-cased name;
    addr1: must not start with PATIENT DELIVERY; the six key text fields
    must not be blank; both dates required ISO dates; atom_id integer; every
    other text field required (addr2 optional).
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    terms = F.array(*[F.lit(t) for t in RESTRICTED_TERMS])
    errs: list[Column] = []
    for f in FACILITY_FIELDS:
        c = F.col(f) if f in types else F.lit(None)
        if f == "atom_id":
            if f in types and types[f] in ("bigint", "int", "smallint", "tinyint"):
                bad = c.isNull()
            else:
                bad = F.try_cast(c.cast("string"), "bigint").isNull()
            errs.append(_err(f, bad, MSG_INTEGER))
        elif f in DATE_FIELDS:
            d = _as_date(c, types.get(f, "string"))
            msg = F.when(c.isNull(), F.lit(MSG_REQUIRED)).otherwise(
                F.concat(F.lit(MSG_DATE[0]), c.cast("string"), F.lit(MSG_DATE[1])))
            errs.append(_err(f, d.isNull(), msg))
        elif f == "facility_name":
            hit = F.get(F.filter(terms, lambda t: F.instr(F.upper(c), t) > 0), 0)
            errs.append(_err(f, c.isNull(), MSG_REQUIRED))
            errs.append(_err(f, c.isNotNull() & hit.isNotNull(),
                             F.concat(F.lit(MSG_RESTRICTED), hit)))
            errs.append(_err(f, c.isNotNull() & hit.isNull() & _blank(c),
                             MSG_EMPTY.format(field=f)))
        elif f == "addr1":
            starts = F.upper(c).startswith(BLOCKED_ADDRESS_PREFIX)
            errs.append(_err(f, c.isNull(), MSG_REQUIRED))
            errs.append(_err(f, c.isNotNull() & starts, MSG_ADDRESS))
            errs.append(_err(f, c.isNotNull() & ~starts & _blank(c), MSG_EMPTY.format(field=f)))
        elif f in NOT_BLANK_FIELDS:
            errs.append(_err(f, c.isNull(), MSG_REQUIRED))
            errs.append(_err(f, c.isNotNull() & _blank(c), MSG_EMPTY.format(field=f)))
        elif f not in OPTIONAL_FIELDS:
            errs.append(_err(f, c.isNull(), MSG_REQUIRED))
    out = df
    for f in DATE_FIELDS:
        if f in types:
            out = out.withColumn(f, _as_date(F.col(f), types[f]))
    return out.withColumn("errors", F.filter(F.array(*errs), lambda x: x.isNotNull()))


def split_valid(validated: DataFrame, index_col: str = "atom_id") -> tuple[DataFrame, DataFrame]:
    """O-VAL2: (valid rows, invalid rows with index, first error and data).

    Callers that use both outputs should persist ``validated`` first so the
    rules run once."""
    valid = validated.where(F.size("errors") == 0).drop("errors")
    data_cols = [c for c in validated.columns if c != "errors"]
    invalid = validated.where(F.size("errors") > 0).select(
        F.col(index_col).alias("record_index"),
        F.array_join(F.transform("errors", lambda e: F.concat(e["field"], F.lit(": "), e["error"])),
                     "; ").alias("error"),
        F.col("errors"),
        F.struct(*[F.col(c) for c in data_cols]).alias("data"))
    return valid, invalid


def validation_summary(validated: DataFrame) -> DataFrame:
    """O-VAL3: one row: total, valid, invalid and one error count per field,
    all in a single aggregate pass (partial aggregation, one tiny shuffle)."""
    per_field = [F.count_if(F.exists("errors", _field_is(f))).alias(f"errors_{f}")
                 for f in FACILITY_FIELDS]
    return validated.agg(F.count(F.lit(1)).alias("total"),
                         F.count_if(F.size("errors") == 0).alias("valid"),
                         F.count_if(F.size("errors") > 0).alias("invalid"), *per_field)


def _field_is(field: str):
    def pred(e: Column) -> Column:
        return e["field"] == F.lit(field)
    return pred


def validation_rule_counts(validated: DataFrame) -> DataFrame:
    """O-VAL3 long form: (field, n) for every field with at least one error."""
    return validated.select(F.explode("errors").alias("e")) \
        .groupBy(F.col("e.field").alias("field")).agg(F.count(F.lit(1)).alias("n"))
