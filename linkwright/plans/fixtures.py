"""Linkage inputs derived from the driver's tables.

The driver tables hold no addresses, so the queries derive them from
``customer`` with integer arithmetic (``k`` = ``c_custkey``). Each derivation
exists twice: as a Spark DataFrame (narrow projection, no shuffle; the
25-row nation lookup is a literal array indexed by key, not a join) and as a
DuckDB SQL fragment used by ``oracle_sql``. Both must produce identical rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_parallelism

# --- fixed fixture values (ours; ASCII only so the RE2 oracle agrees) -------
STREETS = ["Main", "Oak", "Pine", "Maple", "Cedar", "Elm", "Washington", "Lake",
           "Hill", "Park", "River", "Sunset"]
TYPES_FULL = ["Street", "Avenue", "Road", "Boulevard", "Lane", "Drive", "Court"]
TYPES_ABBR = ["St", "Ave", "Rd", "Blvd", "Ln", "Dr", "Ct"]
CITIES = ["Springfield", "Riverside", "Franklin", "Greenville", "Bristol", "Clinton",
          "Fairview", "Salem", "Madison", "Georgetown", "Arlington", "Ashland",
          "Burlington", "Manchester", "New York", "Jackson", "Milton", "Newport",
          "Auburn", "Dayton", "Lexington", "Kingston", "North Haven", "Hudson", "Marion"]
STATES = ["IL", "CA", "TN", "SC", "CT", "NY", "TX", "OR", "WI", "KY", "VA", "MA",
          "VT", "NH", "NY", "GA", "WA", "NJ", "RI", "AL", "OH", "MO", "CT", "FL", "PA"]
RESTRICTED_PICK = ["BLIND", "CONFIDENTIAL", "WOUND CARE", "SHIP TO", "XX",
                   "PATIENT DATA", "HOME PATIENT"]
# ---------------------------------------------------------------------------


def _pick(values: list[str], idx: Column) -> Column:
    """values[idx] for a 0-based integer column (literal array, no join)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx.cast("int") + 1)


def _sql_pick(values: list[str], idx_sql: str) -> str:
    lst = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{lst}])[CAST({idx_sql} AS INTEGER) + 1]"


def _s(c: Column) -> Column:
    return c.cast("string")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (O-SRC4 typed parquet scan)."""
    from ..sources.records import read_table
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def _left_cols(k: Column, nation: Column) -> dict[str, Column]:
    house = _s(F.lit(100) + (k * 37) % 9000)
    street = _pick(STREETS, k % 12)
    typ = _pick(TYPES_FULL, k % 7)
    suite = _s(F.lit(1) + k % 40)
    city = _pick(CITIES, nation)
    state = _pick(STATES, nation)
    zipc = _s(F.lit(10000) + (k * 53) % 89999)
    return dict(house=house, street=street, typ=typ, suite=suite, city=city, state=state,
                zipc=zipc)


def left_addresses_from(c: DataFrame) -> DataFrame:
    """(id LONG, address, latitude, longitude) from customer rows."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    p = _left_cols(k, n)
    addr = F.concat(p["house"], F.lit(" "), p["street"], F.lit(" "), p["typ"], F.lit(", Suite "),
                    p["suite"], F.lit(", "), p["city"], F.lit(", "), p["state"], F.lit(" "),
                    p["zipc"])
    lat = F.lit(30.0) + ((k * 7919) % 100000) / F.lit(10000.0)
    lon = F.lit(-120.0) + ((k * 104729) % 100000) / F.lit(10000.0)
    extra = [x for x in c.columns if x.startswith("_")]
    return c.select(k.alias("id"), addr.alias("address"), lat.alias("latitude"),
                    lon.alias("longitude"), *extra)


def left_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id LONG, address STRING, latitude, longitude) for every customer."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return ensure_parallelism(left_addresses_from(c))


def right_addresses_from(c: DataFrame) -> DataFrame:
    """Varied copy for k % 5 <> 0: type abbreviated when k even, 'Suite' -> '#'
    when k % 3 = 0, zip dropped when k % 7 = 0; coordinates nudged."""
    c = c.where((F.col("c_custkey") % 5) != 0)
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    p = _left_cols(k, n)
    typ = F.when(k % 2 == 0, _pick(TYPES_ABBR, k % 7)).otherwise(p["typ"])
    unit = F.when(k % 3 == 0, F.concat(F.lit("#"), p["suite"])).otherwise(
        F.concat(F.lit("Suite "), p["suite"]))
    tail = F.when(k % 7 == 0, p["state"]).otherwise(F.concat(p["state"], F.lit(" "), p["zipc"]))
    addr = F.concat(p["house"], F.lit(" "), p["street"], F.lit(" "), typ, F.lit(", "), unit,
                    F.lit(", "), p["city"], F.lit(", "), tail)
    lat = F.lit(30.0) + ((k * 7919) % 100000) / F.lit(10000.0) + ((k % 3) - 1) * F.lit(0.0004)
    lon = F.lit(-120.0) + ((k * 104729) % 100000) / F.lit(10000.0) + ((k % 4) - 1) * F.lit(0.0003)
    extra = [x for x in c.columns if x.startswith("_")]
    return c.select(k.alias("id"), addr.alias("address"), lat.alias("latitude"),
                    lon.alias("longitude"), *extra)


def right_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return ensure_parallelism(right_addresses_from(c))


def _sql_left_parts(k: str = "c_custkey", n: str = "c_nationkey") -> dict[str, str]:
    return dict(
        house=f"CAST(100 + ({k} * 37) % 9000 AS VARCHAR)",
        street=_sql_pick(STREETS, f"{k} % 12"),
        typ=_sql_pick(TYPES_FULL, f"{k} % 7"),
        typ_abbr=_sql_pick(TYPES_ABBR, f"{k} % 7"),
        suite=f"CAST(1 + {k} % 40 AS VARCHAR)",
        city=_sql_pick(CITIES, n),
        state=_sql_pick(STATES, n),
        zipc=f"CAST(10000 + ({k} * 53) % 89999 AS VARCHAR)",
    )


def sql_left_addresses() -> str:
    p = _sql_left_parts()
    return (
        "SELECT c_custkey AS id, "
        f"{p['house']} || ' ' || {p['street']} || ' ' || {p['typ']} || ', Suite ' || {p['suite']}"
        f" || ', ' || {p['city']} || ', ' || {p['state']} || ' ' || {p['zipc']} AS address, "
        "30.0 + ((c_custkey * 7919) % 100000) / 10000.0 AS latitude, "
        "-120.0 + ((c_custkey * 104729) % 100000) / 10000.0 AS longitude "
        "FROM customer"
    )


def sql_right_addresses() -> str:
    p = _sql_left_parts()
    return (
        "SELECT c_custkey AS id, "
        f"{p['house']} || ' ' || {p['street']} || ' ' || "
        f"CASE WHEN c_custkey % 2 = 0 THEN {p['typ_abbr']} ELSE {p['typ']} END || ', ' || "
        f"CASE WHEN c_custkey % 3 = 0 THEN '#' || {p['suite']} ELSE 'Suite ' || {p['suite']} END"
        f" || ', ' || {p['city']} || ', ' || "
        f"CASE WHEN c_custkey % 7 = 0 THEN {p['state']} ELSE {p['state']} || ' ' || {p['zipc']} END"
        " AS address, "
        "30.0 + ((c_custkey * 7919) % 100000) / 10000.0 + ((c_custkey % 3) - 1) * 0.0004 AS latitude, "
        "-120.0 + ((c_custkey * 104729) % 100000) / 10000.0 + ((c_custkey % 4) - 1) * 0.0003"
        " AS longitude FROM customer WHERE c_custkey % 5 <> 0"
    )


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facility rows (validation input) derived from customer.

    name = segment + customer name, with a restricted term appended when
    k % 11 = 0; city blank when k % 13 = 0; addr1 prefixed with
    'PATIENT DELIVERY ' when k % 17 = 0; first_observed not a date when
    k % 19 = 0. Dates stay ISO strings (validation parses them).
    """
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name",
                                               "c_mktsegment")
    return facilities_from(c)


def facilities_from(c: DataFrame) -> DataFrame:
    """Facility rows from customer rows (batch or stream)."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    p = _left_cols(k, n)
    name = F.concat_ws(" ", F.col("c_mktsegment"), F.col("c_name"))
    name = F.when(k % 11 == 0, F.concat(name, F.lit(" "), _pick(RESTRICTED_PICK, k % 7))) \
        .otherwise(name)
    addr1 = F.upper(F.concat_ws(" ", p["house"], p["street"], p["typ"]))
    addr1 = F.when(k % 17 == 0, F.concat(F.lit("PATIENT DELIVERY "), addr1)).otherwise(addr1)
    city = F.when(k % 13 == 0, F.lit("")).otherwise(F.upper(p["city"]))
    first_obs = F.when(k % 19 == 0, F.lit("2023-02-30")).otherwise(
        F.concat(F.lit("2023-"), F.lpad(_s(F.lit(1) + k % 12), 2, "0"), F.lit("-15")))
    return c.select(
        k.alias("atom_id"),
        F.concat(F.lit("SYSTEM_"), _s(k % 3)).alias("source"),
        name.alias("facility_name"),
        addr1.alias("addr1"),
        F.concat(F.lit("SUITE "), p["suite"]).alias("addr2"),
        city.alias("city"),
        p["state"].alias("state"),
        p["zipc"].alias("zip"),
        F.lit("LICENSE").alias("auth_type"),
        F.concat(F.lit("PHY"), _s(k)).alias("auth_id"),
        F.lit("2025-12-31").alias("expire_date"),
        first_obs.alias("first_observed"),
        F.lit("RETAIL").alias("data_type"),
        F.col("c_mktsegment").alias("class_of_trade"),
    )


def sql_facilities() -> str:
    p = _sql_left_parts()
    terms = _sql_pick(RESTRICTED_PICK, "c_custkey % 7")
    name = "c_mktsegment || ' ' || c_name"
    return (
        "SELECT c_custkey AS atom_id, 'SYSTEM_' || CAST(c_custkey % 3 AS VARCHAR) AS source, "
        f"CASE WHEN c_custkey % 11 = 0 THEN {name} || ' ' || {terms} ELSE {name} END"
        " AS facility_name, "
        f"CASE WHEN c_custkey % 17 = 0 THEN 'PATIENT DELIVERY ' ELSE '' END || "
        f"upper({p['house']} || ' ' || {p['street']} || ' ' || {p['typ']}) AS addr1, "
        f"'SUITE ' || {p['suite']} AS addr2, "
        f"CASE WHEN c_custkey % 13 = 0 THEN '' ELSE upper({p['city']}) END AS city, "
        f"{p['state']} AS state, {p['zipc']} AS zip, 'LICENSE' AS auth_type, "
        "'PHY' || CAST(c_custkey AS VARCHAR) AS auth_id, '2025-12-31' AS expire_date, "
        "CASE WHEN c_custkey % 19 = 0 THEN '2023-02-30' ELSE "
        "'2023-' || lpad(CAST(1 + c_custkey % 12 AS VARCHAR), 2, '0') || '-15' END"
        " AS first_observed, 'RETAIL' AS data_type, c_mktsegment AS class_of_trade "
        "FROM customer"
    )


# Messy records: alias layout chosen by k % 4 (source field names are ours,
# shaped like the reference's sample records).
def messy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos LONG, record MAP<STRING,STRING>) with key order preserved."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment",
                                               "c_nationkey")
    return messy_records_from(c)


def messy_records_from(c: DataFrame) -> DataFrame:
    """Messy records from customer rows (batch or stream)."""
    k = F.col("c_custkey")
    first = F.concat(F.lit("Cust"), _s(k))
    last = F.initcap(F.col("c_mktsegment"))
    email = F.concat(F.lit(" C"), _s(k), F.lit("@Example.com "))
    phone = F.concat(F.lit("+1 (555) "), F.lpad(_s(k % 10000), 4, "0"))
    city = _pick(CITIES, F.col("c_nationkey"))
    kid = _s(k)
    m0 = F.create_map(F.lit("id"), kid, F.lit("FName"), first, F.lit("Surname"), last,
                      F.lit("Email_Address"), email)
    m1 = F.create_map(F.lit("first"), first, F.lit("Last_Name"), last, F.lit("e-mail"), email,
                      F.lit("Extra_Field"), F.col("c_name"), F.lit("Cust_ID"), kid)
    m2 = F.create_map(F.lit("fname"), first, F.lit("first"), F.lit("ShouldNotOverride"),
                      F.lit("surname"), last, F.lit("email"), F.lit(""),
                      F.lit("mail"), email, F.lit("tier"), F.lit("gold"))
    m3 = F.create_map(F.lit("username"), first, F.lit("phone_number"), phone,
                      F.lit(" City "), city, F.lit("Telephone"), F.lit(None).cast("string"),
                      F.lit("mobile"), phone)
    rec = (F.when(k % 4 == 0, m0).when(k % 4 == 1, m1).when(k % 4 == 2, m2).otherwise(m3))
    return c.select(k.alias("pos"), rec.alias("record"))


def sql_messy_records() -> str:
    """DuckDB: the same maps built with MAP([keys], [values])."""
    k = "CAST(c_custkey AS VARCHAR)"
    first = f"'Cust' || {k}"
    last = ("upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2))")
    email = f"' C' || {k} || '@Example.com '"
    phone = f"'+1 (555) ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')"
    city = _sql_pick(CITIES, "c_nationkey")
    m0 = f"MAP(['id', 'FName', 'Surname', 'Email_Address'], [{k}, {first}, {last}, {email}])"
    m1 = (f"MAP(['first', 'Last_Name', 'e-mail', 'Extra_Field', 'Cust_ID'], "
          f"[{first}, {last}, {email}, c_name, {k}])")
    m2 = (f"MAP(['fname', 'first', 'surname', 'email', 'mail', 'tier'], "
          f"[{first}, 'ShouldNotOverride', {last}, '', {email}, 'gold'])")
    m3 = (f"MAP(['username', 'phone_number', ' City ', 'Telephone', 'mobile'], "
          f"[{first}, {phone}, {city}, NULL, {phone}])")
    return (f"SELECT c_custkey AS pos, CASE c_custkey % 4 WHEN 0 THEN {m0} WHEN 1 THEN {m1} "
            f"WHEN 2 THEN {m2} ELSE {m3} END AS record FROM customer")


# --- facility-style parents / atoms for the linkage queries -----------------
# name = three letters from k + a facility kind from the market segment; the
# atom copy varies the kind. The letters keep name-prefix blocks small.
KINDS = {"AUTOMOBILE": "Hospital", "BUILDING": "Medical Center", "FURNITURE": "Clinic",
         "HOUSEHOLD": "Health Care", "MACHINERY": "Saint Mary Hospital"}


def _letters(k: Column) -> Column:
    def ch(x: Column) -> Column:
        return F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (x % 26 + 1).cast("int"), 1)
    return F.concat(ch(k), F.lower(ch(F.floor(k / F.lit(26)))), F.lower(ch(F.floor(k / F.lit(676)))))


def _kind(seg: Column) -> Column:
    out = F.lit("Clinic")
    for s, kd in KINDS.items():
        out = F.when(seg == s, F.lit(kd)).otherwise(out)
    return out


def parents_from(c: DataFrame) -> DataFrame:
    """(id, name, address, auth_id) from customer rows: one projection."""
    k = F.col("c_custkey")
    name = F.concat(_letters(k.cast("long")), F.lit("ton "), _kind(F.col("c_mktsegment")))
    a = left_addresses_from(c.select("c_custkey", "c_nationkey", name.alias("_name")))
    return a.select(_s(F.col("id")).alias("id"), F.col("_name").alias("name"), "address",
                    F.concat(F.lit("PHY"), _s(F.col("id"))).alias("auth_id"))


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return ensure_parallelism(parents_from(c))


def atoms_from(c: DataFrame) -> DataFrame:
    """Atom copy: the varied address, 'The ' before the name when k % 3 = 0,
    ' Lab' after it when k % 2 = 0, auth id missing when k % 4 = 0."""
    k = F.col("c_custkey")
    base = F.concat(_letters(k.cast("long")), F.lit("ton "), _kind(F.col("c_mktsegment")))
    name = F.concat(F.when(k % 3 == 0, F.lit("The ")).otherwise(F.lit("")), base,
                    F.when(k % 2 == 0, F.lit(" Lab")).otherwise(F.lit("")))
    a = right_addresses_from(c.select("c_custkey", "c_nationkey", name.alias("_name")))
    kk = F.col("id")
    return a.select(_s(kk).alias("id"), F.col("_name").alias("name"), "address",
                    F.when(kk % 4 != 0, F.concat(F.lit("PHY"), _s(kk))).alias("auth_id"))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return ensure_parallelism(atoms_from(c))


def _sql_letters(k: str) -> str:
    al = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
    return (f"substr({al}, CAST({k} % 26 + 1 AS INTEGER), 1) || "
            f"lower(substr({al}, CAST(({k} // 26) % 26 + 1 AS INTEGER), 1)) || "
            f"lower(substr({al}, CAST(({k} // 676) % 26 + 1 AS INTEGER), 1))")


def _sql_kind() -> str:
    return "CASE c_mktsegment " + " ".join(f"WHEN '{s}' THEN '{kd}'" for s, kd in KINDS.items()) \
        + " ELSE 'Clinic' END"


def sql_parents() -> str:
    return (f"SELECT CAST(c.c_custkey AS VARCHAR) AS id, {_sql_letters('c.c_custkey')} || 'ton ' || "
            f"{_sql_kind()} AS name, l.address, 'PHY' || CAST(c.c_custkey AS VARCHAR) AS auth_id "
            f"FROM customer c JOIN ({sql_left_addresses()}) l ON l.id = c.c_custkey")


def sql_atoms() -> str:
    base = f"{_sql_letters('c.c_custkey')} || 'ton ' || {_sql_kind()}"
    return (f"SELECT CAST(c.c_custkey AS VARCHAR) AS id, "
            f"CASE WHEN c.c_custkey % 3 = 0 THEN 'The ' ELSE '' END || {base} || "
            f"CASE WHEN c.c_custkey % 2 = 0 THEN ' Lab' ELSE '' END AS name, r.address, "
            f"CASE WHEN c.c_custkey % 4 <> 0 THEN 'PHY' || CAST(c.c_custkey AS VARCHAR) END AS auth_id "
            f"FROM customer c JOIN ({sql_right_addresses()}) r ON r.id = c.c_custkey")
