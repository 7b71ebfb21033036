"""Field-name normalization with audit trail (O-NRM1..9).

Input rows carry ``record MAP<STRING,STRING>`` (key order = document order)
and usually ``pos``. Every rule is a native higher-order-function expression
over ``map_entries(record)``: no shuffle, no UDF, one pass per record. The
audit is an array-of-struct column next to the result, so the normalized
table and its audit come out of the same scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the mapping tables the reference ships ------------------
SIMPLE_MAPPINGS = {
    "default": {
        "first_name": ["first", "first_name", "fname"],
        "last_name": ["last", "last_name", "surname"],
        "email": ["email", "email_address", "e-mail"],
    },
}
FULL_MAPPINGS = {
    "default": {
        "first_name": ["first", "first_name", "fname", "firstname", "given_name"],
        "last_name": ["last", "last_name", "surname", "lastname", "family_name"],
        "email": ["email", "email_address", "e-mail", "emailaddress", "mail"],
        "phone": ["phone", "phone_number", "telephone", "cell", "mobile"],
        "address": ["address", "street_address", "mailing_address", "residence"],
    },
    "customer": {
        "customer_id": ["cust_id", "customer_id", "customerid", "id", "customer_number"],
        "loyalty_level": ["loyalty", "status", "membership_level", "tier"],
    },
}
FULL_DEFAULT_VALUES = {"loyalty_level": "standard"}
FULL_REQUIRED_FIELDS = {"default": ["email"], "customer": ["customer_id", "email"]}
FUZZY_MAPPINGS = {
    "default": {
        "first_name": ["first name", "firstname", "fname", "given name"],
        "last_name": ["last name", "lastname", "lname", "surname", "family name"],
        "email": ["email", "email address", "e-mail", "mail"],
        "phone": ["phone", "telephone", "phone number", "cell", "mobile"],
        "address": ["address", "street address", "location"],
        "city": ["city", "town"],
        "state": ["state", "province", "region"],
        "zip_code": ["zip", "zip code", "postal code", "postcode"],
    },
    "customer": {
        "customer_id": ["id", "customer id", "cust id", "client id"],
        "first_name": ["first name", "firstname", "fname", "customer first name"],
        "last_name": ["last name", "lastname", "lname", "customer last name"],
        "email": ["email", "customer email", "contact email"],
        "phone": ["phone", "customer phone", "contact phone"],
        "membership_level": ["level", "tier", "membership", "status"],
        "joined_date": ["joined", "date joined", "member since", "start date"],
    },
}
MODEL_DEFAULTS = {"customer": {"membership_level": "Basic"}}
ACTION_MAPPED = "mapped"
ACTION_SKIPPED = "skipped (already set)"
ACTION_OVERWRITTEN = "overwritten"
# ---------------------------------------------------------------------------

def clean_name(c: Column) -> Column:
    """``name.strip().lower()`` (Unicode whitespace, like Python)."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def _lit_map(d: dict[str, str]) -> Column:
    if not d:
        return F.create_map().cast("map<string,string>")
    args = []
    for k, v in d.items():
        args += [F.lit(k), F.lit(v)]
    return F.create_map(*args)


def _key_is(field: str, non_null: bool = False):
    """Predicate factory for HOFs (a lambda with default arguments would be
    taken for an (element, index) lambda)."""
    def pred(e: Column) -> Column:
        c = e["key"] == F.lit(field)
        return c & e["value"].isNotNull() if non_null else c
    return pred


def _tgt_is(target: str, non_null: bool = False):
    def pred(e: Column) -> Column:
        c = e["tgt"] == F.lit(target)
        return c & e["value"].isNotNull() if non_null else c
    return pred


def _entries(record_col: str) -> Column:
    return F.map_entries(F.col(record_col))


def _first_target_alias_map(mapping: dict[str, list[str]]) -> dict[str, str]:
    """alias -> first target (in mapping order) listing it."""
    out: dict[str, str] = {}
    for target, aliases in mapping.items():
        for a in aliases:
            out.setdefault(a.strip().lower(), target)
    return out


def _tagged(record_col: str, alias_map: dict[str, str]) -> Column:
    """entries with their target: array<struct<key, value, tgt>>."""
    m = _lit_map(alias_map)
    return F.transform(_entries(record_col), lambda e: F.struct(
        e["key"].alias("key"), e["value"].alias("value"),
        F.try_element_at(m, clean_name(e["key"])).alias("tgt")))


def normalize_fields(df: DataFrame, mapping_key: str = "default",
                     mappings: dict | None = None, record_col: str = "record",
                     audit: bool = True, keep: tuple[str, ...] = ("pos",)) -> DataFrame:
    """O-NRM1 (+O-NRM8 simple audit).

    Exact alias match on the trimmed, lower-cased source name; the first
    target in mapping order owns an alias; the first non-null value wins;
    output is dense (one column per target, NULL if unmatched). An unknown
    mapping key falls back to ``default``.
    """
    mappings = mappings or SIMPLE_MAPPINGS
    mapping = mappings.get(mapping_key, mappings["default"])
    alias_map = _first_target_alias_map(mapping)
    tagged = F.col("_tagged")
    out_cols = [F.col(c) for c in keep if c in df.columns]
    for target in mapping:
        hit = F.filter(tagged, _tgt_is(target, non_null=True))
        out_cols.append(F.get(hit, 0)["value"].alias(target))
    if audit:
        out_cols.append(_simple_audit(tagged, mapping_key).alias("audit"))
    return df.withColumn("_tagged", _tagged(record_col, alias_map)).select(*out_cols)


def _simple_audit(tagged: Column, mapping_key: str) -> Column:
    def entry(e: Column, i: Column) -> Column:
        earlier = F.slice(tagged, 1, i)
        already = F.exists(earlier, lambda x: (x["tgt"] == e["tgt"]) & x["value"].isNotNull())
        return F.when(e["tgt"].isNotNull(), F.struct(
            e["key"].alias("source_field"), e["tgt"].alias("target_field"),
            e["value"].alias("value"),
            F.when(already, F.lit(ACTION_SKIPPED)).otherwise(F.lit(ACTION_MAPPED)).alias("action")))

    matched = F.filter(F.transform(tagged, entry), lambda x: x.isNotNull())
    unmatched = F.transform(F.filter(tagged, lambda e: e["tgt"].isNull()), lambda e: F.struct(
        e["key"].alias("source_field"), e["value"].alias("value")))
    return F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
                    .alias("timestamp"), F.lit(mapping_key).alias("mapping_key"),
                    matched.alias("matched"), unmatched.alias("unmatched"))


# --- O-NRM5: value normalizers ---------------------------------------------

def _email_norm(v: Column) -> Column:
    return F.when(v.isNull() | (v == ""), F.lit(None).cast("string")).otherwise(
        F.regexp_replace(F.lower(v), r"(?U)^\s+|\s+$", ""))


def _phone_norm(v: Column) -> Column:
    return F.when(v.isNull() | (v == ""), F.lit(None).cast("string")).otherwise(
        F.regexp_replace(v, r"[^0-9+]", ""))


def _strip(v: Column) -> Column:
    return F.regexp_replace(v, r"(?U)^\s+|\s+$", "")


DEFAULT_VALUE_RULES = {"email": _email_norm, "phone": _phone_norm}


def normalize_value(target: Column, v: Column, rules: dict | None = None) -> Column:
    """O-NRM5: per-target rule (email, phone, or caller's), else strip."""
    rules = DEFAULT_VALUE_RULES if rules is None else rules
    expr = _strip(v)
    for name, fn in rules.items():
        expr = F.when(target == name, fn(v)).otherwise(expr)
    return F.when(v.isNull(), F.lit(None).cast("string")).otherwise(expr)


def normalize_values(df: DataFrame, columns: dict[str, str] | None = None,
                     rules: dict | None = None) -> DataFrame:
    """O-NRM5 on flat columns: ``columns`` maps column -> rule name."""
    rules = DEFAULT_VALUE_RULES if rules is None else rules
    columns = columns or {c: c for c in df.columns if c in rules}
    out = df
    for c, rule in columns.items():
        out = out.withColumn(c, rules[rule](F.col(c)) if rule in rules else _strip(F.col(c)))
    return out


def _reverse_map(mapping_key: str, mappings: dict) -> dict[str, str]:
    """Later alias wins inside one mapping; a non-default key also gets the
    default aliases that do not clash."""
    mapping = mappings.get(mapping_key, mappings["default"])
    rev: dict[str, str] = {}
    for target, aliases in mapping.items():
        for a in aliases:
            rev[a.lower().strip()] = target
    if mapping_key != "default":
        for target, aliases in mappings["default"].items():
            for a in aliases:
                rev.setdefault(a.lower().strip(), target)
    return rev


def _fill_default(field: str, value: str):
    def fn(e: Column) -> Column:
        v = F.when((e["key"] == F.lit(field)) & e["value"].isNull(), F.lit(value)) \
            .otherwise(e["value"])
        return F.struct(e["key"].alias("key"), v.alias("value"))
    return fn


def normalize_full(df: DataFrame, mapping_key: str = "default", mappings: dict | None = None,
                   apply_defaults: bool = True, validate_required: bool = True,
                   record_col: str = "record", defaults: dict | None = None,
                   required: dict | None = None, rules: dict | None = None,
                   keep: tuple[str, ...] = ("pos",)) -> DataFrame:
    """O-NRM4 + O-NRM5/6/7 + full audit (O-NRM8).

    Output ``normalized MAP<STRING,STRING>`` is sparse (only matched or
    defaulted targets, in first-match order) and ``audit`` is a struct with
    matched / unmatched / defaults_applied / validation_errors arrays.
    """
    mappings = mappings or FULL_MAPPINGS
    defaults = FULL_DEFAULT_VALUES if defaults is None else defaults
    required = FULL_REQUIRED_FIELDS if required is None else required
    rev = _reverse_map(mapping_key, mappings)
    tg = F.col("_tagged")

    # per entry: normalized value
    def with_norm(e: Column) -> Column:
        return F.struct(e["key"].alias("key"), e["value"].alias("value"), e["tgt"].alias("tgt"),
                        normalize_value(e["tgt"], e["value"], rules).alias("nv"))

    base = df.withColumn("_tagged", F.transform(_tagged(record_col, rev), with_norm))

    # targets in order of their first matching entry
    targets = list(dict.fromkeys(rev.values()))
    tgt_arr = F.array(*[F.lit(t) for t in targets])

    def first_idx(t: Column) -> Column:
        return F.array_position(F.transform(tg, lambda e: e["tgt"]), t)

    def final_value(t: Column) -> Column:
        return F.get(F.filter(tg, lambda e: (e["tgt"] == t) & e["nv"].isNotNull()), 0)["nv"]

    present = F.filter(
        F.transform(tgt_arr, lambda t: F.struct(first_idx(t).alias("i"), t.alias("k"),
                                                final_value(t).alias("v"))),
        lambda s: s["i"] > 0)
    present = F.array_sort(present)
    # staged columns: each array below is referenced several times, and a
    # higher-order function inside one projection would be re-evaluated per use
    base = base.withColumn("_norm", F.transform(present, lambda s: F.struct(
        s["k"].alias("key"), s["v"].alias("value"))))
    norm_entries = F.col("_norm")
    applied_defaults = {}
    if apply_defaults and mapping_key != "default":
        applied_defaults = dict(defaults)
    def_entries = []
    for f, v in applied_defaults.items():
        missing = ~F.exists(norm_entries, _key_is(f, non_null=True))
        def_entries.append(F.when(missing, F.struct(F.lit(f).alias("field"), F.lit(v).alias("value"))))
    defaults_applied = F.filter(F.array(*def_entries), lambda x: x.isNotNull()) if def_entries \
        else F.array().cast("array<struct<field:string,value:string>>")
    # merge defaults: replace a present-null entry in place, else append
    merged = norm_entries
    for f, v in applied_defaults.items():
        has = F.exists(merged, _key_is(f))
        merged = F.when(has, F.transform(merged, _fill_default(f, v))).otherwise(
            F.concat(merged, F.array(F.struct(F.lit(f).alias("key"), F.lit(v).alias("value")))))

    base = base.withColumn("_merged", merged)
    merged = F.col("_merged")
    req: list[str] = []
    if validate_required:
        req = list(required.get(mapping_key, []))
        if mapping_key != "default":
            req = sorted(set(req) | set(required.get("default", [])))
    errs = [F.when(~F.exists(merged, _key_is(f, non_null=True)),
                   F.struct(F.lit(f).alias("field"), F.lit("required field missing").alias("error")))
            for f in req]
    validation_errors = F.filter(F.array(*errs), lambda x: x.isNotNull()) if errs \
        else F.array().cast("array<struct<field:string,error:string>>")

    def audit_entry(e: Column, i: Column) -> Column:
        earlier = F.filter(F.slice(tg, 1, i), lambda x: x["tgt"] == e["tgt"])
        first = F.size(earlier) == 0
        current = F.get(F.filter(earlier, lambda x: x["nv"].isNotNull()), 0)["nv"]
        overwrite = ~first & e["value"].isNotNull() & current.isNull()
        action = (F.when(first, F.lit(ACTION_MAPPED))
                  .when(overwrite, F.lit(ACTION_OVERWRITTEN)).otherwise(F.lit(ACTION_SKIPPED)))
        skipped = ~first & ~overwrite
        return F.when(e["tgt"].isNotNull(), F.struct(
            e["key"].alias("source_field"), e["tgt"].alias("target_field"),
            F.when(skipped, e["value"]).otherwise(e["nv"]).alias("value"),
            action.alias("action"),
            F.when(skipped, current).alias("current_value")))

    matched = F.filter(F.transform(tg, audit_entry), lambda x: x.isNotNull())
    unmatched = F.transform(F.filter(tg, lambda e: e["tgt"].isNull()), lambda e: F.struct(
        e["key"].alias("source_field"), e["value"].alias("value")))
    audit = F.struct(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        F.lit(mapping_key).alias("mapping_key"),
        F.try_element_at(F.col(record_col), F.lit("id")).alias("record_id"),
        matched.alias("matched"), unmatched.alias("unmatched"),
        defaults_applied.alias("defaults_applied"),
        validation_errors.alias("validation_errors"))
    out = [F.col(c) for c in keep if c in df.columns]
    return base.select(*out, F.map_from_entries(merged).alias("normalized"), audit.alias("audit"))


def normalize_fields_fuzzy(df: DataFrame, mapping_key: str = "default",
                           default_values: dict | None = None, mappings: dict | None = None,
                           record_col: str = "record",
                           keep: tuple[str, ...] = ("pos",)) -> DataFrame:
    """O-NRM2: a source matches a target when its cleaned name *contains* any
    alias; first target in mapping order; the last matching source wins
    (a NULL value included); unmatched targets keep the given default."""
    mappings = mappings or FUZZY_MAPPINGS
    mapping = mappings.get(mapping_key, mappings["default"])
    defaults = default_values or {}
    order = list(mapping.items())

    def tgt_of(name: Column) -> Column:
        expr = F.lit(None).cast("string")
        for target, aliases in reversed(order):
            al = F.array(*[F.lit(a.lower()) for a in aliases])
            expr = F.when(F.exists(al, lambda a: F.instr(name, a) > 0), F.lit(target)).otherwise(expr)
        return expr

    tagged = F.transform(_entries(record_col), lambda e: F.struct(
        e["value"].alias("value"), tgt_of(clean_name(e["key"])).alias("tgt")))
    out = [F.col(c) for c in keep if c in df.columns]
    for target, _ in order:
        hits = F.filter(F.col("_t"), _tgt_is(target))
        last = F.get(hits, F.size(hits) - 1)
        dv = F.lit(defaults.get(target)).cast("string")
        out.append(F.when(F.size(hits) > 0, last["value"]).otherwise(dv).alias(target))
    return df.withColumn("_t", tagged).select(*out)


def to_model(df: DataFrame, mapping_key: str = "default", default_values: dict | None = None,
             required: list[str] | None = None, mappings: dict | None = None,
             model_defaults: dict | None = None, record_col: str = "record",
             keep: tuple[str, ...] = ("pos",)) -> DataFrame:
    """O-NRM3: fuzzy matching into a declared model. Precedence: value from
    the record (NULL included) > caller default > model default. Required
    fields that end up NULL produce an entry in ``errors``."""
    mappings = mappings or FUZZY_MAPPINGS
    md = (MODEL_DEFAULTS if model_defaults is None else model_defaults).get(mapping_key, {})
    merged = dict(md)
    merged.update(default_values or {})
    out = normalize_fields_fuzzy(df, mapping_key, merged, mappings, record_col, keep)
    req = required or []
    errs = [F.when(F.col(f).isNull(), F.struct(F.lit(f).alias("field"),
                                               F.lit("field required").alias("error")))
            for f in req]
    errors = F.filter(F.array(*errs), lambda x: x.isNotNull()) if errs \
        else F.array().cast("array<struct<field:string,error:string>>")
    return out.withColumn("errors", errors)


def apply_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """O-NRM6 on flat columns: fill NULL and record which fields were filled."""
    applied = [F.when(F.col(f).isNull(), F.struct(F.lit(f).alias("field"),
                                                  F.lit(v).alias("value")))
               for f, v in defaults.items()]
    out = df.withColumn("defaults_applied", F.filter(F.array(*applied), lambda x: x.isNotNull()))
    for f, v in defaults.items():
        out = out.withColumn(f, F.coalesce(F.col(f), F.lit(v)))
    return out


def check_required(df: DataFrame, required: list[str]) -> DataFrame:
    """O-NRM7 on flat columns: one error per NULL required field."""
    errs = [F.when(F.col(f).isNull(), F.struct(F.lit(f).alias("field"),
                                               F.lit("required field missing").alias("error")))
            for f in required]
    return df.withColumn("validation_errors", F.filter(F.array(*errs), lambda x: x.isNotNull()))


def audit_long(df: DataFrame, audit_col: str = "audit", id_col: str = "pos") -> DataFrame:
    """O-NRM8 long form: one row per source field with its action."""
    a = F.col(audit_col)
    matched = df.select(F.col(id_col), F.explode(a["matched"]).alias("m")).select(
        id_col, F.col("m.source_field").alias("source_field"),
        F.col("m.target_field").alias("target_field"), F.col("m.value").alias("value"),
        F.col("m.action").alias("action"))
    unmatched = df.select(F.col(id_col), F.explode(a["unmatched"]).alias("m")).select(
        id_col, F.col("m.source_field").alias("source_field"),
        F.lit(None).cast("string").alias("target_field"), F.col("m.value").alias("value"),
        F.lit("unmatched").alias("action"))
    return matched.unionByName(unmatched)


def audit_summary(df: DataFrame, audit_col: str = "audit") -> DataFrame:
    """O-NRM9: one-row totals. ``mapped`` counts mapped + overwritten."""
    a = F.col(audit_col)
    m = a["matched"]

    def n_action(cond) -> Column:
        return F.sum(F.size(F.filter(m, cond))).cast("long")

    cols = [F.count(F.lit(1)).alias("total_records"),
            n_action(lambda e: e["action"] != ACTION_SKIPPED).alias("total_mapped"),
            n_action(lambda e: e["action"] == ACTION_SKIPPED).alias("total_skipped"),
            F.sum(F.size(a["unmatched"])).cast("long").alias("total_unmatched")]
    fields = df.schema[audit_col].dataType.fieldNames()
    if "defaults_applied" in fields:
        cols.append(F.sum(F.size(a["defaults_applied"])).cast("long").alias("total_defaults"))
        cols.append(F.sum(F.size(a["validation_errors"])).cast("long")
                    .alias("total_validation_errors"))
    return df.agg(*cols)
