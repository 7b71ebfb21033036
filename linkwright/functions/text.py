"""Address / name standardization, parsing and tokenization as Column expressions.

Everything here is a native Spark expression (regex, higher-order array
functions, literal maps): it runs inside whole-stage codegen with no Python
on the executors. Regexes carry ``(?U)`` so ``\\w``/``\\b``/``\\d`` are Unicode
aware like Python's ``re``.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's rules (O-STD1). Order matters
# only where noted; they are applied as one dictionary pass (see below).
# ---------------------------------------------------------------------------
STREET_TYPES = {
    "avenue": "ave", "boulevard": "blvd", "circle": "cir", "court": "ct",
    "drive": "dr", "expressway": "expy", "freeway": "fwy", "highway": "hwy",
    "lane": "ln", "parkway": "pkwy", "place": "pl", "plaza": "plz",
    "road": "rd", "square": "sq", "street": "st", "terrace": "ter",
    "trail": "trl", "turnpike": "tpke", "way": "way",
}
UNIT_TYPES = {
    "apartment": "apt", "building": "bldg", "department": "dept", "floor": "fl",
    "room": "rm", "suite": "ste", "unit": "unit",
}
DIRECTIONALS = {
    "north": "n", "south": "s", "east": "e", "west": "w",
    "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw",
}
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar",
    "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de",
    "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id",
    "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks",
    "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md",
    "massachusetts": "ma", "michigan": "mi", "minnesota": "mn",
    "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne",
    "nevada": "nv", "new hampshire": "nh", "new jersey": "nj",
    "new mexico": "nm", "new york": "ny", "north carolina": "nc",
    "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or",
    "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc",
    "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut",
    "vermont": "vt", "virginia": "va", "washington": "wa",
    "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
}

# O-STD2 (literal replacement list, applied in this order)
LITERAL_ABBREVIATIONS = [
    ("avenue", "ave"), ("boulevard", "blvd"), ("circle", "cir"), ("court", "ct"),
    ("drive", "dr"), ("lane", "ln"), ("place", "pl"), ("road", "rd"),
    ("square", "sq"), ("street", "st"), ("terrace", "ter"), ("apartment", "apt"),
    ("building", "bldg"), ("floor", "fl"), ("suite", "ste"), ("unit", "unit"),
    ("north", "n"), ("south", "s"), ("east", "e"), ("west", "w"),
    ("northeast", "ne"), ("northwest", "nw"), ("southeast", "se"), ("southwest", "sw"),
]

# O-STD3 (USPS-style upper-case maps) and O-STD4 (facility names)
USPS_SUFFIX = {
    "AVENUE": "AVE", "BOULEVARD": "BLVD", "CIRCLE": "CIR", "COURT": "CT",
    "DRIVE": "DR", "EXPRESSWAY": "EXPY", "HIGHWAY": "HWY", "LANE": "LN",
    "PARKWAY": "PKWY", "PLACE": "PL", "ROAD": "RD", "SQUARE": "SQ",
    "STREET": "ST", "TERRACE": "TER",
}
USPS_DIRECTIONAL = {
    "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W",
    "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW",
}
USPS_UNIT = {
    "APARTMENT": "APT", "BUILDING": "BLDG", "DEPARTMENT": "DEPT", "FLOOR": "FL",
    "ROOM": "RM", "SUITE": "STE", "UNIT": "UNIT",
}
HEALTHCARE_TERMS = [
    ("HOSPITAL", "HOSP"), ("MEDICAL CENTER", "MED CTR"), ("CLINIC", "CLIN"),
    ("HEALTHCARE", "HLTHCARE"), ("HEALTH CARE", "HLTHCARE"), ("SAINT", "ST"),
    ("MOUNT", "MT"), ("CENTER", "CTR"),
]
NAME_STOP_WORDS = ["THE", "OF", "AND", "FOR"]

# Component patterns (O-PRS1, O-PRS2, O-PRS3). Java regexes carry (?U) so
# \w, \d and \b are Unicode-aware like Python's.
ZIP_RE = r"(?U)\b\d{5}(?:-\d{4})?\b"
UNIT_RE = r"(?iU)\b(?:apt|suite|ste|unit|bldg|floor|fl|#)\s*(?:[a-zA-Z0-9-]+)\b"
HOUSE_RE = r"(?U)^\d+"
TOKEN_UNIT_MARKERS = ["apt", "unit", "ste", "suite", "#"]
REGEX_PARSER_ZIP = r"(?U)(\d{5})(?:-\d{4})?"
REGEX_PARSER_STATE = r"(?U)\b([A-Z]{2})\b"
REGEX_PARSER_NUMBER = r"(?U)^\s*(\d+)"
# ---------------------------------------------------------------------------


def _lit_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def collapse_spaces(c: Column) -> Column:
    """Python's ``' '.join(s.split())``."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _one_word_dict() -> dict[str, str]:
    d: dict[str, str] = {}
    for table in (STREET_TYPES, UNIT_TYPES, DIRECTIONALS):
        d.update(table)
    d.update({k: v for k, v in US_STATES.items() if " " not in k})
    return d


def _reachable_two_word_states() -> list[tuple[str, str]]:
    """Two-word state names whose first word is not rewritten earlier.

    Directionals run before states, so "north carolina" etc. can never match.
    """
    return [(k, v) for k, v in US_STATES.items()
            if " " in k and k.split(" ")[0] not in DIRECTIONALS]


def map_words(c: Column, mapping: dict[str, str]) -> Column:
    """Replace every whole word found in ``mapping`` in one pass.

    The string is split into alternating word / non-word runs; each word run
    is looked up in a literal map. Equivalent to a chain of ``\\bword\\b``
    substitutions when no replacement is itself a key of a later rule.
    """
    parts = F.regexp_extract_all(c, F.lit(r"(?U)(\w+|\W+)"), 1)
    m = _lit_map(mapping)
    return F.array_join(F.transform(parts, lambda w: F.coalesce(F.try_element_at(m, w), w)), "")


def standardize_address(c: Column) -> Column:
    """O-STD1: lower, punctuation to spaces, ``#`` to ``unit``, abbreviations."""
    s = F.lower(c)
    s = F.translate(s, ".,", "  ")
    s = F.regexp_replace(s, r"#\s*", "unit ")
    s = map_words(s, _one_word_dict())
    for full, abbr in _reachable_two_word_states():
        s = F.regexp_replace(s, r"(?U)\b" + full + r"\b", abbr)
    s = collapse_spaces(s)
    return F.when(c.isNull() | (c == ""), F.lit("")).otherwise(s)


def normalize_address_literal(c: Column) -> Column:
    """O-STD2: literal word replacement (needs surrounding space), then strip punctuation."""
    s = F.lower(c)
    for full, abbr in LITERAL_ABBREVIATIONS:
        s = F.replace(s, F.lit(f" {full} "), F.lit(f" {abbr} "))
        s = F.replace(s, F.lit(f" {full},"), F.lit(f" {abbr},"))
        s = F.replace(s, F.lit(f" {full}."), F.lit(f" {abbr}."))
        s = F.replace(s, F.lit(f" {abbr}."), F.lit(f" {abbr} "))
    s = F.translate(s, ",.#-/\\", "      ")
    return collapse_spaces(s)


def standardize_facility_name(c: Column) -> Column:
    """O-STD4: upper, healthcare abbreviations, drop stop words, collapse."""
    s = F.upper(c)
    for term, repl in HEALTHCARE_TERMS:
        s = F.regexp_replace(s, r"(?U)\b" + term + r"\b", repl)
    for w in NAME_STOP_WORDS:
        s = F.regexp_replace(s, r"(?U)\b" + w + r"\b", "")
    s = F.trim(F.regexp_replace(s, r"(?U)\s+", " "))
    return F.when(c.isNull() | (c == ""), F.lit("")).otherwise(s)


def _nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parse_components(c: Column) -> Column:
    """O-PRS1: struct(house_number, street_name, unit, city, state, zipcode).

    zip = first ZIP match, every copy removed; unit = first unit match in
    what is left, every copy removed; house = leading digits of the rest.
    street/city/state are never filled (as in the rule being reproduced).
    Written without conditionals (``replace`` with an empty search string is
    the identity) so the expression stays small and CSE can share parts.
    """
    s = F.coalesce(c, F.lit(""))
    z = F.regexp_extract(s, ZIP_RE, 0)
    s1 = F.replace(s, z, F.lit(""))
    u = F.regexp_extract(s1, UNIT_RE, 0)
    s2 = F.replace(s1, u, F.lit(""))
    house = F.regexp_extract(s2, HOUSE_RE, 0)
    null = F.lit(None).cast("string")
    return F.struct(_nonempty(house).alias("house_number"), null.alias("street_name"),
                    _nonempty(u).alias("unit"), null.alias("city"), null.alias("state"),
                    _nonempty(z).alias("zipcode"))


def parse_components_tokens(c: Column) -> Column:
    """O-PRS2: whitespace tokens; first all-digit token = house, last 5-digit
    token = zip, token after the last unit marker that has a next token = unit.
    No lambda refers to the outer token array (``zip_with`` over a shifted
    copy instead), so the split runs a bounded number of times per row."""
    toks = F.filter(F.split(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")), " "),
                    lambda t: t != "")
    digits = F.filter(toks, lambda t: t.rlike(r"(?U)^\d+$"))
    house = F.get(digits, 0)
    zipcode = F.try_element_at(F.filter(digits, lambda t: F.length(t) == 5), F.lit(-1))
    after_marker = F.zip_with(toks, F.slice(toks, 2, 1 << 30), lambda t, nxt: F.when(
        t.isin(*TOKEN_UNIT_MARKERS) & nxt.isNotNull(), nxt))
    unit = F.try_element_at(F.filter(after_marker, lambda x: x.isNotNull()), F.lit(-1))
    null = F.lit(None).cast("string")
    return F.struct(house.alias("house_number"), null.alias("street_name"),
                    unit.alias("unit"), null.alias("city"), zipcode.alias("zipcode"))


def pystrip(c: Column) -> Column:
    """Python's ``str.strip()`` (all Unicode whitespace, not only spaces)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def parse_address_regex(c: Column) -> Column:
    """O-PRS3: zip (removed everywhere), state = first 2-capital word (removed
    everywhere), leading number (removed once), then split on commas:
    street = first part, city = last part when there are several."""
    s = F.coalesce(c, F.lit(""))
    zip_raw = F.regexp_extract(s, REGEX_PARSER_ZIP, 0)
    s1 = F.replace(s, zip_raw, F.lit(""))
    state_raw = F.regexp_extract(s1, REGEX_PARSER_STATE, 0)
    s2 = F.replace(s1, state_raw, F.lit(""))
    number = _nonempty(F.regexp_extract(s2, REGEX_PARSER_NUMBER, 1))
    s3 = F.regexp_replace(s2, r"(?U)^(\s*)\d+", "$1")
    zip_full, state = _nonempty(zip_raw), _nonempty(state_raw)
    parts = F.filter(F.transform(F.split(s3, ","), pystrip), lambda p: p != "")
    street = F.get(parts, 0)
    city = F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 1))
    return F.struct(street.alias("street"), number.alias("number"), city.alias("city"),
                    state.alias("state"), zip_full.alias("zip_code"))


def tokens(c: Column) -> Column:
    """O-TOK1: lower-cased ``\\w+`` runs."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\w+"), 0)


def ngrams_fixed(toks: Column, n: int) -> Column:
    """Word n-grams (fixed n >= 1) joined by one space; empty when fewer than
    n tokens. Built from shifted slices with ``zip_with`` so no lambda
    refers to the outer array (which would re-evaluate it per element)."""
    if n == 1:
        return toks
    big = 1 << 30
    acc = toks
    for i in range(1, n):
        acc = F.zip_with(acc, F.slice(toks, i + 1, big), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.filter(acc, lambda x: x.isNotNull())


def ngrams_of(toks: Column, n: int | Column, max_n: int = 3) -> Column:
    """Word n-grams for a fixed or per-row ``n`` (per-row n <= max_n)."""
    if isinstance(n, int):
        return ngrams_fixed(toks, n) if n >= 1 else F.array().cast("array<string>")
    out = F.array().cast("array<string>")
    for k in range(max_n, 0, -1):
        out = F.when(n == k, ngrams_fixed(toks, k)).otherwise(out)
    return out


def ngrams(c: Column, n: int = 2) -> Column:
    return ngrams_of(tokens(c), n)


def format_address(num: Column, street: Column, typ: Column, city: Column,
                   state: Column, zipc: Column) -> Column:
    """O-PRJ2: ``"{num} {street} {type}, {city}, {state} {zip}"``, missing -> ''."""
    e = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    return F.trim(F.concat(e(num), F.lit(" "), e(street), F.lit(" "), e(typ), F.lit(", "),
                           e(city), F.lit(", "), e(state), F.lit(" "), e(zipc)))


# ---------------------------------------------------------------------------
# O-PRS4: rule-based address tagger (re-aim of a trained sequence tagger).
# Only regex features shared by Java and RE2 are used (no look-around), so
# the same patterns run in the DuckDB oracle.
# ---------------------------------------------------------------------------
TAG_DIRECTIONS = ["NORTHEAST", "NORTHWEST", "SOUTHEAST", "SOUTHWEST", "NORTH", "SOUTH", "EAST",
                  "WEST", "NE", "NW", "SE", "SW", "N", "S", "E", "W"]
TAG_SUFFIXES = sorted({*STREET_TYPES.keys(), *STREET_TYPES.values(), *USPS_SUFFIX.keys(),
                       *USPS_SUFFIX.values(), "wy", "str", "blv"}, key=lambda x: (-len(x), x))
TAG_UNITS = ["APARTMENT", "BUILDING", "DEPARTMENT", "FLOOR", "ROOM", "SUITE", "UNIT",
             "APT", "BLDG", "DEPT", "FL", "RM", "STE"]


def _alt(words) -> str:
    return "|".join(w.upper() for w in words)


def tagger_patterns() -> dict[str, str]:
    """Regexes of the tagger (shared with the SQL oracle)."""
    zip_tail = r"(\d{5}(?:-\d{4})?)\s*$"
    state_names = sorted({*US_STATES.keys()}, key=lambda x: (-len(x), x))
    state_tail = (r"(?i)(?:^|[\s,])(" + "|".join(sorted({v.upper() for v in US_STATES.values()}))
                  + "|" + "|".join(state_names) + r")\s*,?\s*$")
    unit_part = r"(?i)^(?:(" + _alt(TAG_UNITS) + r")\.?\s*|(#)\s*)([A-Za-z0-9-]+)$"
    d = _alt(TAG_DIRECTIONS)
    street = (r"(?i)^\s*(\d+[A-Za-z]?(?:-\d+)?)?\s*"
              r"(?:(" + d + r")\.?\s+)?"
              r"(.+?)"
              r"(?:\s+(" + _alt(TAG_SUFFIXES) + r")\.?)?"
              r"(?:\s+(" + d + r")\.?)?"
              r"(?:\s*,?\s*(?:(" + _alt(TAG_UNITS) + r")\.?\s*|(#)\s*)([A-Za-z0-9-]+))?"
              r"\s*$")
    return {"zip": zip_tail, "state": state_tail, "unit": unit_part, "street": street}


_SEP = "\u0001"


def regex_groups(c: Column, pattern: str, n: int) -> Column:
    """All ``n`` groups of an anchored pattern in one regex pass: the match
    is replaced by ``$1<SEP>$2...`` (Java leaves groups that did not take
    part empty) and split. NULL when the pattern does not match."""
    rep = _SEP.join(f"${i}" for i in range(1, n + 1))
    return F.when(c.rlike(pattern), F.split(F.regexp_replace(c, pattern, rep), _SEP))


def _tag_stage1(c: Column) -> Column:
    """ZIP and state removed from the end: struct(rest, state, zip)."""
    pt = tagger_patterns()
    s = F.trim(F.coalesce(c, F.lit("")))
    zipc = F.regexp_extract(s, pt["zip"], 1)
    s1 = F.regexp_replace(s, pt["zip"], "")
    state = F.regexp_extract(s1, pt["state"], 1)
    s2 = F.regexp_replace(s1, pt["state"], "")
    return F.struct(s2.alias("rest"), state.alias("state"), zipc.alias("zip"))


def _tag_stage2(stage1: Column) -> Column:
    """Comma parts of the rest: struct(street_line, city, middle, state, zip)."""
    parts = F.filter(F.transform(F.split(stage1["rest"], ","), pystrip), lambda p: p != "")
    n = F.size(parts)
    return F.struct(F.coalesce(F.get(parts, 0), F.lit("")).alias("street_line"),
                    F.when(n >= 2, F.get(parts, n - 1)).alias("city"),
                    F.coalesce(F.when(n >= 3, F.get(parts, 1)), F.lit("")).alias("middle"),
                    stage1["state"].alias("state"), stage1["zip"].alias("zip"))


def _tag_stage3(stage2: Column) -> Column:
    pt = tagger_patterns()
    g = regex_groups(stage2["street_line"], pt["street"], 8)
    mu = regex_groups(stage2["middle"], pt["unit"], 3)

    def gi(arr, i):
        return _nonempty(F.get(arr, i - 1))

    occ_type = F.coalesce(gi(g, 6), gi(g, 7), gi(mu, 1), gi(mu, 2))
    occ_id = F.coalesce(gi(g, 8), gi(mu, 3))
    return F.struct(
        gi(g, 1).alias("AddressNumber"), gi(g, 2).alias("StreetNamePreDirectional"),
        gi(g, 3).alias("StreetName"), gi(g, 4).alias("StreetNamePostType"),
        gi(g, 5).alias("StreetNamePostDirectional"), occ_type.alias("OccupancyType"),
        occ_id.alias("OccupancyIdentifier"), stage2["city"].alias("PlaceName"),
        _nonempty(stage2["state"]).alias("StateName"), _nonempty(stage2["zip"]).alias("ZipCode"))


def tag_address(c: Column) -> Column:
    """O-PRS4: struct of AddressNumber, StreetNamePreDirectional, StreetName,
    StreetNamePostType, StreetNamePostDirectional, OccupancyType,
    OccupancyIdentifier, PlaceName, StateName, ZipCode (NULL when absent).

    Right to left: ZIP at the end, then a state code or name, then comma
    parts: the last of several is the city, the first is the street line,
    a middle part shaped like a unit is the unit. The street line is one
    regex (number, pre-direction, shortest name, suffix, post-direction,
    unit), all groups read in one pass. On a DataFrame prefer
    ``with_tags``, which materializes the stages once.
    """
    return _tag_stage3(_tag_stage2(_tag_stage1(c)))


def with_tags(df, col: str, out: str = "tags"):
    """``tag_address`` as staged columns, so each stage runs once per row."""
    staged = df.withColumn("_tg1", _tag_stage1(F.col(col))) \
        .withColumn("_tg2", _tag_stage2(F.col("_tg1"))) \
        .withColumn(out, _tag_stage3(F.col("_tg2")))
    return staged.drop("_tg1", "_tg2")


def compare_parsers(c: Column, tags: Column | None = None) -> Column:
    """O-PRS5: the three parsers side by side as one struct of structs with
    common field names (number, street, city, state, zip_code). Pass the
    column made by ``with_tags`` as ``tags`` to avoid re-running the tagger."""
    p1 = parse_components(c)
    p3 = parse_address_regex(c)
    t = tag_address(c) if tags is None else tags
    null = F.lit(None).cast("string")
    s1 = F.struct(p1["house_number"].alias("number"), null.alias("street"), null.alias("city"),
                  null.alias("state"), p1["zipcode"].alias("zip_code"))
    s3 = F.struct(p3["number"].alias("number"), p3["street"].alias("street"),
                  p3["city"].alias("city"), p3["state"].alias("state"),
                  p3["zip_code"].alias("zip_code"))
    street4 = F.when(t["StreetName"].isNotNull(), F.concat_ws(
        " ", t["StreetNamePreDirectional"], t["StreetName"], t["StreetNamePostType"]))
    s4 = F.struct(t["AddressNumber"].alias("number"), street4.alias("street"),
                  t["PlaceName"].alias("city"), t["StateName"].alias("state"),
                  t["ZipCode"].alias("zip_code"))
    return F.struct(s1.alias("components"), s3.alias("regex"), s4.alias("tagger"))


PARSER_FIELDS = ["number", "street", "city", "state", "zip_code"]
PARSER_PAIRS = [("components", "regex"), ("components", "tagger"), ("regex", "tagger")]


def parser_agreement(df, col: str = "parsers"):
    """O-PRS5 summary: share of rows on which two parsers agree, per field
    (null-safe equality), in one aggregate."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for a, b in PARSER_PAIRS:
        for f in PARSER_FIELDS:
            eq = F.col(col)[a][f].eqNullSafe(F.col(col)[b][f]).cast("double")
            aggs.append(F.round(F.avg(eq), 6).alias(f"agree_{a}_{b}_{f}"))
    return df.agg(*aggs)
