"""DuckDB SQL fragments for the oracle side of the query registry.

These re-state the reference's rules in SQL, sequentially and literally
(e.g. O-STD1 as the chain of word-boundary substitutions in rule order),
so they check the Spark formulations rather than repeat them.
"""

from __future__ import annotations

from ..functions import text as T


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def std_address_sql(col: str) -> str:
    """O-STD1 as the literal rule sequence."""
    s = f"lower({col})"
    s = f"replace(replace({s}, '.', ' '), ',', ' ')"
    s = f"regexp_replace({s}, '#\\s*', 'unit ', 'g')"
    for table in (T.STREET_TYPES, T.UNIT_TYPES, T.DIRECTIONALS, T.US_STATES):
        for full, abbr in table.items():
            s = f"regexp_replace({s}, {q(chr(92) + 'b' + full + chr(92) + 'b')}, {q(abbr)}, 'g')"
    s = f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN {col} IS NULL OR {col} = '' THEN '' ELSE {s} END"


def nonempty(expr: str) -> str:
    return f"NULLIF({expr}, '')"


def components_sql(std: str) -> dict[str, str]:
    """O-PRS1 in SQL, given the name of a standardized text column."""
    zip_ = nonempty(f"regexp_extract({std}, '\\b\\d{{5}}(?:-\\d{{4}})?\\b')")
    s1 = f"CASE WHEN {zip_} IS NULL THEN {std} ELSE replace({std}, {zip_}, '') END"
    unit = nonempty(f"regexp_extract({s1}, "
                    "'(?i)\\b(?:apt|suite|ste|unit|bldg|floor|fl|#)\\s*(?:[a-zA-Z0-9-]+)\\b')")
    s2 = f"CASE WHEN {unit} IS NULL THEN {s1} ELSE replace({s1}, {unit}, '') END"
    house = nonempty(f"regexp_extract({s2}, '^\\d+')")
    return {"zipcode": zip_, "unit": unit, "house_number": house}


def tokens_sql(col: str) -> str:
    return f"regexp_extract_all(lower({col}), '\\w+')"


def ngrams_sql(toks: str, n: str) -> str:
    return (f"CASE WHEN len({toks}) >= {n} AND {n} >= 1 THEN list_transform(range(0, len({toks}) - {n} + 1), "
            f"lambda i: array_to_string({toks}[i + 1:i + {n}], ' ')) ELSE [] END")


def jaccard_sql(a: str, b: str) -> str:
    u = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {u} = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / {u} END"


def prefix_len_sql(a: str, b: str) -> str:
    parts = []
    for k in (4, 3, 2, 1):
        parts.append(f"WHEN length({a}) >= {k} AND length({b}) >= {k} AND "
                     f"left({a}, {k}) = left({b}, {k}) THEN {k}")
    return "CASE " + " ".join(parts) + " ELSE 0 END"


def jaro_winkler_sql(a: str, b: str, p: float = 0.1) -> str:
    """Always-boosted Jaro-Winkler built from DuckDB's Jaro (DuckDB's own
    jaro_winkler_similarity only boosts above 0.7)."""
    j = f"jaro_similarity({a}, {b})"
    return (f"CASE WHEN {a} = {b} THEN 1.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 "
            f"ELSE {j} + {prefix_len_sql(a, b)} * {p} * (1 - {j}) END")


def case_map(expr: str, mapping: dict[str, str]) -> str:
    """``coalesce(mapping[upper(x)], upper(x))`` as a CASE."""
    u = f"upper({expr})"
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"CASE {u} {whens} ELSE {u} END"


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def tag_sql(col: str) -> dict[str, str]:
    """O-PRS4 in SQL with the tagger's own patterns (RE2-compatible)."""
    pt = T.tagger_patterns()
    s = f"trim(coalesce({col}, ''))"
    zipc = f"regexp_extract({s}, {q(pt['zip'])}, 1)"
    s1 = f"regexp_replace({s}, {q(pt['zip'])}, '', 'g')"
    state = f"regexp_extract({s1}, {q(pt['state'])}, 1)"
    s2 = f"regexp_replace({s1}, {q(pt['state'])}, '', 'g')"
    parts = (f"list_filter(list_transform(string_split({s2}, ','), lambda p: {strip_sql('p')}), "
             f"lambda p: p <> '')")
    street_line = f"coalesce(({parts})[1], '')"
    n = f"len({parts})"
    city = f"CASE WHEN {n} >= 2 THEN ({parts})[{n}] END"
    middle = f"coalesce(CASE WHEN {n} >= 3 THEN ({parts})[2] END, '')"
    g = {i: nonempty(f"regexp_extract({street_line}, {q(pt['street'])}, {i})") for i in range(1, 9)}
    mu = {i: nonempty(f"regexp_extract({middle}, {q(pt['unit'])}, {i})") for i in (1, 2, 3)}
    return {
        "AddressNumber": g[1], "StreetNamePreDirectional": g[2], "StreetName": g[3],
        "StreetNamePostType": g[4], "StreetNamePostDirectional": g[5],
        "OccupancyType": f"coalesce({g[6]}, {g[7]}, {mu[1]}, {mu[2]})",
        "OccupancyIdentifier": f"coalesce({g[8]}, {mu[3]})",
        "PlaceName": city, "StateName": nonempty(state), "ZipCode": nonempty(zipc),
    }


def usps_sql(tag_table: str) -> str:
    """O-STD3 columns from a relation that has the tag columns."""
    street = ("concat_ws(' ', " + case_map("StreetNamePreDirectional", T.USPS_DIRECTIONAL) + ", "
              "upper(StreetName), " + case_map("StreetNamePostType", T.USPS_SUFFIX) + ", "
              + case_map("StreetNamePostDirectional", T.USPS_DIRECTIONAL) + ")")
    utype = f"coalesce({case_map('OccupancyType', T.USPS_UNIT)}, '')"
    unum = "coalesce(upper(OccupancyIdentifier), '')"
    unit = f"CASE WHEN {utype} <> '' OR {unum} <> '' THEN trim(concat_ws(' ', {utype}, {unum})) END"
    has = "(address IS NOT NULL AND address <> '')"
    cols = {
        "street_number": "AddressNumber", "street_name": street, "unit": unit,
        "city": "upper(PlaceName)", "state": "upper(StateName)", "zip": "ZipCode",
        "zip5": "split_part(ZipCode, '-', 1)", "parsed": "true",
    }
    sel = ", ".join(f"CASE WHEN {has} THEN {v} END AS {k}" for k, v in cols.items())
    return f"SELECT *, {sel} FROM {tag_table}"


def facility_name_sql(col: str) -> str:
    s = f"upper({col})"
    for term, repl in T.HEALTHCARE_TERMS:
        s = f"regexp_replace({s}, {q(chr(92) + 'b' + term + chr(92) + 'b')}, {q(repl)}, 'g')"
    for w in T.NAME_STOP_WORDS:
        s = f"regexp_replace({s}, {q(chr(92) + 'b' + w + chr(92) + 'b')}, '', 'g')"
    s = f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN {col} IS NULL OR {col} = '' THEN '' ELSE {s} END"


def prepared_sql(src: str) -> str:
    """tag -> USPS -> name -> blocking keys, over a relation (id, name, address, auth_id)."""
    tags = ", ".join(f"{v} AS {k}" for k, v in tag_sql("address").items())
    tagged = f"(SELECT *, {tags} FROM ({src}) s0)"
    usps = f"({usps_sql(tagged)})"
    named = (f"(SELECT * REPLACE (CASE WHEN address IS NOT NULL AND address <> '' THEN "
             f"{facility_name_sql('name')} ELSE name END AS name) FROM {usps} s1)")
    keys = ("list_filter([CASE WHEN zip5 IS NOT NULL THEN 'zip:' || zip5 END, "
            "CASE WHEN length(name) >= 3 THEN 'name:' || substr(name, 1, 3) END, "
            "CASE WHEN coalesce(street_name, '') <> '' AND coalesce(street_number, '') <> '' "
            "THEN 'addr:' || substr(street_name, 1, 1) || substr(street_number, 1, 3) END], "
            "lambda x: x IS NOT NULL)")
    return f"SELECT *, CASE WHEN coalesce(parsed, false) THEN {keys} ELSE [] END AS keys FROM {named} s2"
