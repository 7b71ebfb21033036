"""PII surrogates (operator 2): detected entities get keyed, type-consistent
replacements that keep gender, script and format.

1. Every whole text is searched; an entity has a kind and a canonical value
   (case, separators and titles removed), so mentions of one entity agree.
2. A surrogate is a function of key, kind, canonical value and an attempt
   number: digits stay digits, letters keep case and script, card numbers keep
   a valid check digit, addresses their number of parts, names their gender
   and script, phone numbers their trunk zeros and first digits. The same
   entity gets the same surrogate in every document. A surname is an entity of
   its own: all who bear it, with or without a given name, share its surrogate,
   and nobody else does.
3. Collision check over the distinct entities of the whole input: where two
   entities share a surrogate, or a surrogate is an entity that occurs, all
   but one try again, round by round, until every surrogate is distinct. A
   kind whose values are fewer than its entities is lengthened by digits,
   syllables or further given names after ``WIDEN`` rounds, so rounds end
   (addresses of networks and IBANs keep their length and draw again).
4. Texts are rewritten where they are read. Only attempts above 0 have to be
   known for that: up to ``BROADCAST_ROWS`` of them travel to the tasks; if
   there are more, they are joined to the documents they occur in.

Defined results: null texts stay null and have no entities; texts without
entities stay as they are; a repeated row gives a repeated row; overlapping
finds count once, names last, else the one that begins first, then the longer,
then the kind named first in ``KINDS``; other columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import secrets
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_column, claim, prepare, staged, take_columns

#: setting that names the key of the registered query and the pipeline
KEY_SETTING = "spark.linkwright.surrogates.key"
BROADCAST_ROWS = 100_000
WIDEN = 6

KINDS = ("email", "secret", "iban", "ipv6", "ipv4", "ssn", "phone", "card", "person")

# Titles with their gender, and given names by gender and script.
TITLES = {"mr": "m", "mister": "m", "herr": "m", "monsieur": "m", "señor": "m", "sr": "m", "don": "m",
          "господин": "m", "κύριος": "m",
          "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "madame": "f", "mme": "f", "mlle": "f",
          "señora": "f", "sra": "f", "srta": "f", "doña": "f", "госпожа": "f", "κυρία": "f",
          "dr": "", "doctor": "", "doktor": "", "prof": "", "professor": "", "mx": "", "sir": "m", "lady": "f"}
NAMES = {
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles Peter Hans Karl "
                    "Pierre Jean Louis Carlos José Juan Luis Miguel Antonio Paul Daniel Mark".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Ursula "
                    "Marie Claire Sophie Carmen María Isabel Lucía Elena Laura Julia Emma Alice Ruth".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Сергей Дмитрий Николай Андрей Михаил Павел Олег".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Γιάννης Παναγιώτης Σπύρος Ανδρέας".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ιωάννα Δήμητρα Βασιλική".split(),
}
#: found like NAMES, but no surrogate takes them; names that are common words or places are left out
MORE_NAMES = {
    "m": "Kevin Brian Steven Edward Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott "
         "Brandon Benjamin Samuel Gregory Patrick Frank Alexander Raymond Jack Dennis Jerry Aaron Adam Henry Nathan "
         "Douglas Zachary Kyle Walter Ethan Jeremy Harold Roger Keith Christian Anthony Matthew Andrew Joshua "
         "Kenneth George Timothy Ronald Donald Christopher Bob Tom Mike Jim Steve Dave Stefan Andreas Klaus Jürgen "
         "Wolfgang François Jacques Philippe Javier Diego Pablo Giovanni Marco Luca Mohammed Ahmed Omar Ali Wei Raj".split(),
    "f": "Jane Nancy Lisa Betty Margaret Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah "
         "Stephanie Rebecca Sharon Cynthia Kathleen Amy Angela Shirley Brenda Pamela Nicole Samantha Katherine "
         "Christine Debra Rachel Carolyn Janet Catherine Maria Heather Diane Olivia Julie Joyce Kelly Christina Joan "
         "Evelyn Judith Megan Andrea Hannah Jacqueline Martha Gloria Teresa Sara Monika Petra Sabine Ingrid Isabelle "
         "Camille Nathalie Ana Sofía Marta Giulia Chiara Francesca Fatima Aisha Priya Mei".split(),
}
_GENDER = {n.lower(): ("latin", g) for g, ns in MORE_NAMES.items() for n in ns} | {n.lower(): (script, g) for (script, g), ns in NAMES.items() for n in ns}
_SYLLABLES = {"latin": ("bar del fen gor hal kin lam mor nes pol ric sal tan ver wil".split(),
                        "ton ley man ner son den berg ford er mann".split()),
              "cyrillic": ("бор вар гор дом кир лав мел ник пав сав".split(), "ов ев ин ский енко".split()),
              "greek": ("βαρ γερ δημ καλ λαμ μαρ νικ παπ σταθ τριγ".split(), "ίδης όπουλος άκης ίου".split())}

_CAP = r"[^\W\d_a-zà-öø-ÿа-яα-ω][^\W\d_]*(?:[-'’][^\W\d_]+)*"
_TITLE = "|".join(sorted({re.escape(f) for t in TITLES for f in (t.capitalize(), t.upper())},
                         key=len, reverse=True))
_FIRST = "|".join(sorted({re.escape(f) for ns in [*NAMES.values(), *MORE_NAMES.values()] for n in ns for f in (n, n.upper())},
                         key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_PATTERNS = {
    # what follows the local part; _emails walks back over that
    "email": re.compile(r"@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}"),
    "secret": re.compile(
        r"(?i:(?<![^\W_])(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)(?!\w)[\"']?)"
        r"\s*+(?P<op>[=:]{1,3}>?)(?:\s*+(?P<q>[\"'])(?P<v>[^\"'\s]{6,}+)(?P=q)"
        r"|[^\S\r\n]*+(?!(?<=[^\S\r\n])\w[\w.]*+\()(?P<u>(?:[^\s\"'`<>&]|&(?![\w.-]++=)){6,}+))"
        r"|(?<![0-9A-Za-z])(?P<h>[0-9a-fA-F]{32,}+)(?![0-9A-Za-z])"
        r"|(?<![0-9A-Za-z])(?P<k>(?:AKIA|ASIA)[0-9A-Z]{16}|sk-[0-9A-Za-z_-]{16,}+|gh[pousr]_[0-9A-Za-z]{20,}+)"
        r"(?![0-9A-Za-z])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    "ipv6": re.compile(r"(?<![\w:.])(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}(?![\w:.])"),
    "ipv4": re.compile(rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "phone": re.compile(
        r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}"
        r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}|(?:\(0\d{1,4}\) ?|0\d{1,4}[ /-])\d{3,8}(?:[ -]\d{2,5}){0,2})(?!\w)"),
    "card": re.compile(r"(?<![\w.-])(?:\d{4}([ -]))(?:\d{4}\1){2}\d{1,7}(?![\w-])|(?<![\w.-])\d{4}([ -])\d{6}\2\d{5}(?![\w-])|(?<![\w.])\d{13,19}(?!\w)"),
    "person": re.compile(
        rf"(?<!\w)(?:(?P<t>{_TITLE})\.?[ ]+(?:(?:{_TITLE})\.?[ ]+)*+(?P<n1>{_CAP}(?:[ ]{_CAP}){{0,1}})"
        rf"|(?P<n2>(?:{_FIRST})[ ]{_CAP}))(?!\w)"),
}
_DIGIT = re.compile(r"\d")
#: one of these, a digit or a hex run of letters alone is in every text with a secret
_SECRET_SIGNS = ("=", ":", "sk-", "_", "AKIA", "ASIA")
_LETTERS_HEX = re.compile(r"[a-fA-F]{32}")
#: after "password:" a lone word in usual case is prose
_PROSE = re.compile(r"(?:[^\W\d_][^\W\d_A-ZÀ-Þ]*|[A-ZÀ-Þ]+)(?:[-’][^\W\d_]+)*")
_LOCAL = "_.+%-"
_HEX = re.compile(r"[0-9a-fA-F]*\Z")
_names = None


def _maybe_name(text: str) -> bool:
    """Does a title or a given name occur, followed by a dot or a space?"""
    global _names
    if _names is None:
        _names = ahocorasick.Automaton()
        for w in [*TITLES, *_GENDER]:
            for form in (w.capitalize(), w.upper()):
                _names.add_word(form + " ", 1)
                _names.add_word(form + ".", 1)
        _names.make_automaton()
    return next(_names.iter(text), None) is not None


def _script(s: str) -> str:
    for ch in s:
        if "Ѐ" <= ch <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= ch <= "Ͽ":
            return "greek"
    return "latin"


def _canonical(kind: str, value: str) -> str:
    if kind in ("ssn", "phone", "card"):
        return re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ipv6":
        return ipaddress.ip_address(value).exploded
    if kind == "secret":
        return value.lower() if _HEX.match(value) else value
    return value.lower()


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the addresses, local parts of any length."""
    end = 0
    for m in _PATTERNS["email"].finditer(text):
        a = m.start()
        while a > end and (text[a - 1].isalnum() or text[a - 1] in _LOCAL):
            a -= 1
        while not text[a].isalnum() and a < m.start():
            a += 1
        if a < m.start():
            end = m.end()
            yield a, end


def _secret(m: re.Match) -> tuple[int, int] | None:
    """Span of the value; an unquoted one ends before closing punctuation."""
    a, b = next(m.span(g) for g in ("v", "u", "h", "k") if m.group(g) is not None)
    if m.group("u") is not None:
        value = m.group("u").rstrip(".,;:!?)]}")
        if len(value) < 6 or (m.group("op") == ":" and _PROSE.fullmatch(value)):
            return None
        b = a + len(value)
    return a, b


def find(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, canonical, gender) of every entity of a text."""
    got = []
    digits = _DIGIT.search(text) is not None
    for rank, kind in enumerate(KINDS):
        if kind == "email":
            if "@" not in text:
                continue
            got += [(a, -b, rank, kind, "") for a, b in _emails(text)]
            continue
        elif kind == "ipv6":
            if ":" not in text:
                continue
        elif kind == "person":
            if not _maybe_name(text):
                continue
        elif kind == "secret":
            if not digits and not any(x in text for x in _SECRET_SIGNS) and not _LETTERS_HEX.search(text):
                continue
        elif not digits:
            continue
        for m in _PATTERNS[kind].finditer(text):
            a, b, gender = m.start(), m.end(), ""
            if kind == "secret":
                if (span := _secret(m)) is None:
                    continue
                a, b = span
            elif kind == "ipv6":
                try:
                    ipaddress.IPv6Address(m.group())
                except ValueError:
                    continue
                if len(m.group()) < 6:
                    continue
            elif kind == "person":
                a, b = m.span("n1") if m.group("n1") else m.span("n2")
                first = text[a:b].split()[0].lower()
                gender = (TITLES[m.group("t").lower()] if m.group("t") else "") or _GENDER.get(first, ("", ""))[1]
            elif kind == "phone" and len(re.sub(r"\D", "", m.group())) < 7:
                continue
            if kind == "person" and any(x[0] < b and a < -x[1] for x in got):
                continue
            got.append((a, -b, rank, kind, gender))
    got.sort()
    out, end = [], 0
    surnames: dict[str, tuple[str, str]] = {}
    for a, b, _, kind, gender in got:
        if a < end:
            continue
        end = -b
        out.append((a, end, kind, _canonical(kind, text[a:end]), gender))
    if any(x[2] == "person" for x in out):
        # a bare surname after a title refers to the full name before it
        for i, (a, b, kind, canon, gender) in enumerate(out):
            if kind != "person":
                continue
            words = canon.split()
            if len(words) > 1:
                surnames.setdefault(words[-1], (canon, gender))
            elif canon in surnames:
                out[i] = (a, b, kind, surnames[canon][0], surnames[canon][1] or gender)
    return out


class _Stream:
    """Keyed digits: HMAC-SHA256 in counter mode."""

    def __init__(self, key: str, *what: str):
        self.key, self.what, self.n, self.pool = key.encode(), "\x1f".join(what), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, f"{self.what}\x1f{self.n}".encode(), hashlib.sha256).digest()
            self.n += 1
        v, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return v * n >> 32


def _luhn_ok(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _letters(src: str, s: _Stream) -> str:
    """Characters of the same class, case and script."""
    out = []
    for ch in src:
        if ch.isdigit():
            out.append(str(s.below(10)))
        elif "a" <= ch <= "z" or "à" <= ch <= "ÿ":
            out.append(chr(97 + s.below(26)))
        elif "A" <= ch <= "Z" or "À" <= ch <= "Þ":
            out.append(chr(65 + s.below(26)))
        elif "а" <= ch <= "я":
            out.append(chr(ord("а") + s.below(32)))
        elif "α" <= ch <= "ω" and ch != "ς":
            out.append(chr(ord("α") + s.below(17)))
        else:
            out.append(ch)
    return "".join(out)


_session_keys: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The key in the session's settings; where there is none, one drawn for
    this application, which nobody can use to recompute surrogates later."""
    app = spark.sparkContext.applicationId
    return spark.conf.get(KEY_SETTING, None) or _session_keys.setdefault(app, secrets.token_hex(32))


def family_words(canon: str) -> list[str]:
    """The surnames in a person's canonical name."""
    words = canon.split()
    return words[1:] or words


def _given(s: _Stream, script: str, gender: str, attempt: int) -> str:
    """A given name, or several joined ones where single ones are used up."""
    names = NAMES[(script, gender or "mf"[s.below(2)])]
    return "-".join(names[s.below(len(names))].lower() for _ in range(1 + max(0, attempt - WIDEN + 1)))


def surrogate(key: str, kind: str, canon: str, gender: str, attempt: int, family: str | None = None) -> str:
    """Canonical form of the replacement of a canonical value; ``family``:
    what stands for a person's surnames (default: their first attempts)."""
    s = _Stream(key, kind, canon, gender if kind == "person" else "", str(attempt))
    extra = "".join(str(s.below(10)) for _ in range(max(0, attempt - WIDEN + 1)))
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        parts = domain.split(".")
        d = _Stream(key, "domain", domain)
        name = [_letters(p, d) for p in parts[:-1]]
        return f"{_letters(local, s)}{extra}@{'.'.join(name + ['example'])}"
    if kind == "ipv4":
        out = ".".join(str(1 + s.below(254)) for _ in range(4))
        return out
    if kind == "ipv6":
        return ":".join(f"{s.below(65536):04x}" for _ in range(8))
    if kind == "secret":
        if _HEX.match(canon):
            return "".join("0123456789abcdef"[s.below(16)] for _ in canon) + extra
        return _letters(canon, s) + extra
    if kind == "iban":
        return canon[:2] + _letters(canon[2:], s)
    if kind == "phone":
        keep = len(canon) - len(canon.lstrip("0"))
        if not keep and len(canon) > 10:  # country code
            keep = 1 if canon[0] in "17" else 2
        return canon[:keep] + str(1 + s.below(9)) + "".join(str(s.below(10)) for _ in canon[keep + 1:]) + extra
    if kind == "ssn":
        return f"{1 + s.below(665):03d}{1 + s.below(99):02d}{1 + s.below(9999):04d}" + extra
    if kind == "card":
        body = "".join(str(s.below(10)) for _ in canon) + extra
        if _luhn_ok(canon):
            body = next(body[:-1] + str(d) for d in range(10) if _luhn_ok(body[:-1] + str(d)))
        return body
    if kind == "surname":
        head, tail = _SYLLABLES[_script(canon)]
        more = "".join(head[s.below(len(head))] for _ in range(1 + max(0, attempt - WIDEN + 1)))
        return more + head[s.below(len(head))] + tail[s.below(len(tail))]
    if family is None:
        family = " ".join(surrogate(key, "surname", w, "", 0) for w in family_words(canon))
    if len(canon.split()) == 1:
        return family
    return f"{_given(s, _script(canon), gender, attempt)} {family}"


def _dress(kind: str, value: str, canon: str) -> str:
    """``canon`` in the format of the text it replaces."""
    if kind in ("ssn", "phone", "card", "iban"):
        out, i = [], 0
        for ch in value:
            if ch.isalnum() and i < len(canon):
                out.append(canon[i])
                i += 1
            elif not ch.isalnum():
                out.append(ch)
        return "".join(out) + canon[i:]
    if kind == "person":
        given, words = value.split(), canon.split()[-len(value.split()):]
        return " ".join(w.upper() if g.isupper() and len(g) > 1 else "-".join(p.capitalize() for p in w.split("-"))
                        for g, w in zip(given, words))
    if kind == "ipv4":
        return canon
    if value.isupper():
        return canon.upper()
    if kind == "email" and len(value) == len(canon):
        return "".join(c.upper() if v.isupper() else c for v, c in zip(value, canon))
    return canon


def _gender_of(kind: str, gender: str) -> str:
    return gender if kind == "person" else ""


def replace(text: str, key: str, table: dict, detect=find) -> tuple[str, int, str]:
    """(text with surrogates, number of entities, kinds); ``table`` has gender and
    attempt of the entities for which they aren't the text's own and 0."""
    spans = detect(text)
    if not spans:
        return text, 0, ""
    out, at = [], 0
    for a, b, kind, canon, gender in spans:
        gender, attempt = table.get((kind, canon), (_gender_of(kind, gender), 0))
        family = " ".join(surrogate(key, "surname", w, "", table.get(("surname", w), ("", 0))[1])
                          for w in family_words(canon)) if kind == "person" else None
        out += [text[at:a], _dress(kind, text[a:b], surrogate(key, kind, canon, gender, attempt, family))]
        at = b
    return "".join(out) + text[at:], len(spans), ",".join(sorted({s[2] for s in spans}))


def entities(df: DataFrame, text_col: str = "text", detect=find) -> DataFrame:
    """(doc_id, kind, canonical, gender) of every entity of every document."""
    prepare(df.sparkSession)
    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("canonical", T.StringType()),
                         T.StructField("gender", T.StringType())])

    def make(col: pa.Array) -> list:
        claim("pii")
        return [[{"kind": k, "canonical": c, "gender": _gender_of(k, g)}
                 for k, c, g in sorted({x[2:] for x in detect(t)})] if t else [] for t in col.to_pylist()]

    found = add_column(take_columns(df, ["doc_id", text_col]).toDF("doc_id", "text"), "e", T.ArrayType(item), "text", make)
    return found.select("doc_id", F.explode("e").alias("e")).select("doc_id", "e.*")


def _surnames(found: DataFrame) -> DataFrame:
    """The surnames in persons' names, as rows of kind surname."""
    words = F.split("canonical", "\\s+")
    own = F.when(F.size(words) > 1, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1)))).otherwise(words)
    return found.where("kind = 'person'").withColumn("canonical", F.explode(own)).withColumn(
        "kind", F.lit("surname")).withColumn("gender", F.lit(""))


def attempts(found: DataFrame, key: str, max_rounds: int = 60) -> DataFrame:
    """(kind, canonical, gender, attempt, surrogate) with distinct surrogates,
    surnames first, then persons with the surnames' surrogates."""
    # an entity met with and without a title has one gender
    m = found.groupBy("kind", "canonical").agg(F.max("gender").alias("gender"))
    none = F.lit(None).cast("string").alias("family")
    family = _surnames(m).select("kind", "canonical", "gender").distinct()
    rest = _distinct(m.where("kind <> 'person'").unionByName(family).select("*", none), key, max_rounds)
    known = rest.where("kind = 'surname'").select(F.col("canonical").alias("word"), F.col("surrogate").alias("s"))
    persons = m.where("kind = 'person'")
    words = F.split("canonical", "\\s+")
    named = persons.select("canonical", F.posexplode(words).alias("p", "word")).where(
        (F.col("p") > 0) | (F.size(words) == 1)).join(known, "word").groupBy("canonical").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "s"))), lambda x: x["s"]), " ").alias("family"))
    people = _distinct(persons.join(named, "canonical").select("kind", "canonical", "gender", "family"), key, max_rounds)
    return rest.unionByName(people).select("kind", "canonical", "gender", "attempt", "surrogate")


def _distinct(m: DataFrame, key: str, max_rounds: int) -> DataFrame:
    """``m`` (kind, canonical, gender, family) with attempt and surrogate, no
    surrogate shared and none an entity of its kind."""
    pick = F.udf(lambda k, c, g, a, f: surrogate(key, k, c, g, a, f), "string", useArrow=True)
    made = pick("kind", "canonical", "gender", "attempt", "family")
    m = staged(m.withColumn("attempt", F.lit(0)).withColumn("surrogate", made), "pii-attempts")
    real = m.select("kind", F.col("canonical").alias("surrogate"))
    # a bare surname as a person follows its surname, which is checked already
    free = (F.col("kind") != "person") | (F.size(F.split("canonical", "\\s+")) > 1)
    for _ in range(max_rounds):
        owner = (m.groupBy("kind", "surrogate").agg(F.min("canonical").alias("owner"), F.count("*").alias("n"))
                 .where("n > 1").select("kind", "surrogate", "owner"))
        shared = m.join(owner, ["kind", "surrogate"]).where("canonical <> owner").select("kind", "canonical")
        taken = m.join(real, ["kind", "surrogate"]).select("kind", "canonical")
        again = staged(shared.unionByName(taken).where(free).distinct().withColumn("again", F.lit(True)), "pii-again")
        if again.isEmpty():
            return m
        nxt = m.join(again, ["kind", "canonical"], "left").withColumn(
            "attempt", F.col("attempt") + F.coalesce(F.col("again").cast("int"), F.lit(0)))
        m = staged(nxt.withColumn("surrogate", F.when(F.col("again"), made).otherwise(F.col("surrogate")))
                   .drop("again"), "pii-attempts")
    raise RuntimeError("surrogates did not become distinct")


def pseudonymize(df: DataFrame, key: str, text_col: str = "text", detect=find) -> DataFrame:
    """``df`` with surrogates in ``text_col``, and n_entities and kinds; ``key``
    is secret: whoever has it can recompute surrogates; ``detect`` stands in for
    :func:`find`, with kinds of ``KINDS``."""
    if not key:
        raise ValueError("surrogates need a secret key")
    spark = df.sparkSession
    prepare(spark)
    found = staged(entities(df, text_col, detect), "pii-entities")
    table = attempts(found, key)
    # a gender that one document knows holds for the entity everywhere
    later = staged(table.where("attempt > 0 or gender <> ''").select(
        "kind", "canonical", "gender", F.col("attempt").cast("int").alias("attempt")), "pii-later")
    names = list(df.columns)
    pos = names.index(text_col)
    flat = df.toDF(*[f"_c{i}" for i in range(len(names))])
    if later.count() <= BROADCAST_ROWS:
        known = spark.sparkContext.broadcast(
            {(r["kind"], r["canonical"]): (r["gender"], r["attempt"]) for r in later.collect()})
        flat = flat.withColumn("_e", F.lit(None).cast("array<struct<kind:string,canonical:string,gender:string,attempt:int>>"))
    else:
        known = spark.sparkContext.broadcast({})
        both = found.unionByName(_surnames(found)).select("doc_id", "kind", "canonical").distinct()
        by_doc = (both.join(later, ["kind", "canonical"])
                  .groupBy("doc_id").agg(F.collect_set(F.struct("kind", "canonical", "gender", "attempt")).alias("_e")))
        doc = flat[f"_c{names.index('doc_id')}"]
        flat = flat.join(by_doc, doc.eqNullSafe(by_doc["doc_id"]), "left").drop("doc_id")
    schema = T.StructType([f for f in flat.schema.fields if f.name != "_e"]
                          + [T.StructField("_n", T.LongType()), T.StructField("_k", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pii")
        base = known.value
        for b in batches:
            texts, own = b.column(pos).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            new, n, kinds = [], [], []
            for t, e in zip(texts, own):
                table = {(x["kind"], x["canonical"]): (x["gender"], x["attempt"]) for x in e} if e else base
                r = (None, 0, "") if t is None else replace(t, key, table, detect)
                new.append(r[0])
                n.append(r[1])
                kinds.append(r[2])
            cols = [b.column(i) for i in range(len(names))]
            cols[pos] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(cols + [pa.array(n, pa.int64()), pa.array(kinds, pa.string())],
                                             names=schema.names)

    out = flat.mapInArrow(run, schema)
    keep = [i for i, c in enumerate(names) if c.lower() not in ("n_entities", "kinds")]
    return out.select(*[F.col(f"_c{i}").alias(names[i]) for i in keep],
                      F.col("_n").alias("n_entities"), F.col("_k").alias("kinds"))
