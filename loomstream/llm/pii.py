"""Format-preserving pseudonyms for personal data by keyed Feistel permutations, in DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 4
KINDS = ["email", "ip", "date", "ssn", "phone", "card"]
_IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9_]|\.[0-9])"
_DATE = r"(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![A-Za-z0-9_-])"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_-])"
_PHONE = r"(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9_])"
#: What may be a value of a kind.  For cards that is a run of groups of digits with 13 of them or more, up to where a
#: value of another kind begins; which of its groups are a card is looked for in the run.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": rf"(?<![A-Za-z0-9_.]){_IP}",
    "date": rf"(?<![A-Za-z0-9_-]){_DATE}",
    "ssn": rf"(?<![A-Za-z0-9_-]){_SSN}",
    "phone": rf"(?<![A-Za-z0-9_+])(?:\+[1-9][0-9]{{0,2}}[ .-]?)?{_PHONE}",
    "card": rf"(?<![A-Za-z0-9_])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?:[ -](?!{_IP}|{_DATE}|{_SSN}|{_PHONE})[0-9]++)*(?![A-Za-z0-9_])",
}
ANY = "|".join(PATTERNS.values())
LEAST_DIGITS, MOST_DIGITS = 13, 19
#: The days from FIRST_DAY to 2099-12-31 are 17 * 4297.
FIRST_DAY, DAYS_HIGH, DAYS_LOW = "1900-01-01", 17, 4297
NAME = "abcdefghijklmnopqrstuvwxyz0123456789"


def _draw(key: str, kind: str, turn: Column, value: Column) -> Column:
    """60 keyed pseudo-random bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: str, left: Column, right: Column, n_left: Column, n_right: Column) -> Column:
    """A keyed permutation of pairs (left, right) with left < n_left and right < n_right: struct(l, r).

    Each turn adds a keyed function of one half to the other, modulo its size, so every turn can be undone.
    """

    def turn(acc: Column, i: Column) -> Column:
        l_ = F.pmod(acc["l"] + F.pmod(_draw(key, kind, i * 2, acc["r"]), n_left), n_left)
        # The new left half is carried in a one-element array, so that it is computed once.
        return F.element_at(F.transform(F.array(l_), lambda l: F.struct(l.alias("l"), F.pmod(acc["r"] + F.pmod(_draw(key, kind, i * 2 + 1, l), n_right), n_right).alias("r"))), 1)

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), start, turn)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _zeros(value: Column, n: Column | int) -> Column:
    return F.lpad(value.cast("string"), n if isinstance(n, Column) else F.lit(n), F.lit("0"))


def _like(m: Column, chars: Column, of: str = "[0-9]") -> Column:
    """m with its characters of a class replaced, in order, by those given."""
    own = f"[^{of[1:]}"
    return F.array_join(
        F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(F.substr(m, i, F.lit(1)).rlike(of), F.substr(chars, F.length(F.regexp_replace(F.substr(m, F.lit(1), i), own, "")), F.lit(1))).otherwise(F.substr(m, i, F.lit(1)))), ""
    )


def _shifted(chars: Column, digest: Column) -> Column:
    """Each character moved on in NAME by two hexadecimal digits of the digest."""

    def move(i: Column) -> Column:
        by = F.conv(F.substr(digest, F.pmod(i - 1, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.substr(F.lit(NAME), F.pmod(F.instr(F.lit(NAME), F.substr(chars, i, F.lit(1))) - 1 + by, F.lit(len(NAME))) + 1, F.lit(1))

    return F.when(F.length(chars) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(chars)), move), ""))


def _name(key: str, tweak: Column, chars: Column) -> Column:
    """A keyed permutation of the strings of a length over NAME: a Feistel network that moves the characters of one
    half by a digest of the other."""
    n_left = F.floor(F.length(chars) / 2).cast("int")
    digest = lambda turn, half: F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), turn.cast("string"), tweak, half), 256)

    def turn(acc: Column, i: Column) -> Column:
        left = _shifted(acc["l"], digest(i * 2, acc["r"]))
        return _let(left, lambda l: F.struct(l.alias("l"), _shifted(acc["r"], digest(i * 2 + 1, l)).alias("r")))

    start = F.struct(F.substr(chars, F.lit(1), n_left).alias("l"), F.substr(chars, n_left + 1, F.length(chars)).alias("r"))
    return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), start, turn, lambda acc: F.concat(acc["l"], acc["r"]))


def _luhn(digits: Column, odd: int) -> Column:
    """Luhn sum; odd is 1 where the last digit counts twice (a number without its check digit), else 0."""
    places = F.sequence(F.lit(0), F.length(digits) - 1)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return acc + F.when((i + odd) % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(places, F.lit(0), add)


def _part(m: Column, mark: str, i: int) -> Column:
    return F.element_at(F.split(m, mark), i).cast("long")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255)
    if kind == "date":
        return F.try_to_timestamp(m, F.lit("yyyy-MM-dd")).isNotNull()
    if kind == "ssn":
        area = _part(m, "-", 1)
        return (area > 0) & (area != 666) & (area < 900) & (_part(m, "-", 2) > 0) & (_part(m, "-", 3) > 0)
    return F.lit(True)


def _pseudonym(kind: str, m: Column, key: str) -> Column:
    """The pseudonym of a valid value: of the kind and the format that the value has."""
    if kind == "email":
        local, domain = F.substring_index(F.lower(m), "@", 1), F.substr(m, F.locate("@", m), F.length(m))
        name = _let(F.regexp_replace(local, "[^a-z0-9]", ""), lambda chars: _name(key, F.lower(domain), chars))
        return F.concat(_let(name, lambda chars: _like(local, chars, "[a-z0-9]")), domain)
    if kind == "ip":
        pair = feistel(key, kind, _part(m, r"\.", 1) * 256 + _part(m, r"\.", 2), _part(m, r"\.", 3) * 256 + _part(m, r"\.", 4), F.lit(65536), F.lit(65536))
        return _let(pair, lambda p: F.concat_ws(".", *(x.cast("string") for h in ("l", "r") for x in (F.floor(p[h] / 256), p[h] % 256))))
    if kind == "date":
        day = F.datediff(F.to_date(F.try_to_timestamp(m, F.lit("yyyy-MM-dd"))), F.lit(FIRST_DAY).cast("date")).cast("long")
        pair = feistel(key, kind, F.floor(day / DAYS_LOW), day % DAYS_LOW, F.lit(DAYS_HIGH), F.lit(DAYS_LOW))
        return _let(pair, lambda p: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * DAYS_LOW + p["r"]).cast("int")), "yyyy-MM-dd"))
    if kind == "ssn":
        area = _part(m, "-", 1)
        left = F.when(area > 666, area - 2).otherwise(area - 1)
        pair = feistel(key, kind, left, (_part(m, "-", 2) - 1) * 9999 + _part(m, "-", 3) - 1, F.lit(898), F.lit(99 * 9999))
        return _let(pair, lambda p: F.concat_ws("-", _zeros(F.when(p["l"] >= 665, p["l"] + 2).otherwise(p["l"] + 1), 3), _zeros(F.floor(p["r"] / 9999) + 1, 2), _zeros(p["r"] % 9999 + 1, 4)))
    if kind == "phone":

        def dial(d: Column) -> Column:
            n = F.length(d)
            pair = feistel(key, kind, F.substr(d, n - 9, F.lit(5)), F.substr(d, n - 4, F.lit(5)), F.lit(100_000), F.lit(100_000))
            return _like(m, F.concat(F.substr(d, F.lit(1), n - 10), _let(pair, lambda p: F.concat(_zeros(p["l"], 5), _zeros(p["r"], 5)))))

        return _let(_digits(m), dial)

    raise ValueError(kind)


def _card(m: Column, key: str) -> Column:
    """The pseudonym of a card number: its format, another number before the check digit, and that made anew."""

    def number(d: Column) -> Column:
        n = F.length(d) - 1
        n_left = F.floor(n / 2).cast("int")
        size = lambda k: F.pow(F.lit(10.0), k).cast("long")
        pair = feistel(key, "card", F.substr(d, F.lit(1), n_left), F.substr(d, n_left + 1, n - n_left), size(n_left), size(n - n_left))
        payload = _let(pair, lambda p: F.concat(_zeros(p["l"], n_left), _zeros(p["r"], n - n_left)))
        return _like(m, _let(payload, lambda x: F.concat(x, F.pmod(-_luhn(x, 1), F.lit(10)).cast("string"))))

    return _let(_digits(m), number)


def _cards(run: Column, key: str) -> Column:
    """struct(value, n) of a run of groups of digits: from left to right the longest of consecutive groups that are a
    card number together has its pseudonym, other groups stay."""

    def of(groups: Column) -> Column:
        n = F.size(groups)
        # Where a group begins: separators are of one character.
        begin = lambda i: F.aggregate(F.slice(groups, 1, i - 1), F.lit(1), lambda at, g: at + F.length(g) + 1)
        joined = lambda i, j: F.array_join(F.slice(groups, i, j - i + 1), "")
        sound = lambda i: lambda j: _let(joined(i, j), lambda d: F.when(F.length(d).between(LEAST_DIGITS, MOST_DIGITS), _luhn(d, 0) % 10 == 0).otherwise(False))

        def step(acc: Column, i: Column) -> Column:
            last = F.try_element_at(F.filter(F.sequence(F.least(n, i + MOST_DIGITS - 1), i, F.lit(-1)), sound(i)), F.lit(1))
            before = F.when(i > 1, F.substr(run, begin(i) - 1, F.lit(1))).otherwise("")
            found = lambda x: F.substr(run, begin(i), begin(x + 1) - 1 - begin(i))
            whole = _let(last, lambda j: F.struct(F.concat(acc["value"], before, _let(found(j), lambda m: _card(m, key))).alias("value"), (acc["n"] + 1).alias("n"), (j + 1).alias("next")))
            plain = F.struct(F.concat(acc["value"], before, F.element_at(groups, i)).alias("value"), acc["n"].alias("n"), (i + 1).alias("next"))
            return F.when(i < acc["next"], acc).when(last.isNull(), plain).otherwise(whole)

        start = F.struct(F.lit("").alias("value"), F.lit(0).alias("n"), F.lit(1).alias("next"))
        return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda acc: F.struct(acc["value"].alias("value"), acc["n"].alias("n")))

    return _let(F.split(run, "[ -]"), of)


def _replace(m: Column, key: str) -> Column:
    """struct(kind, n, value): a match's kind, how many valid values of it, and what stands in its place."""
    nothing = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0).alias("n"), m.alias("value"))
    is_a = lambda kind: m.rlike(f"^(?:{PATTERNS[kind]})$")
    out = F.when(is_a("card"), _let(_cards(m, key), lambda c: F.struct(F.when(c["n"] > 0, "card").alias("kind"), c["n"].alias("n"), c["value"].alias("value")))).otherwise(nothing)
    for kind in reversed(KINDS[:-1]):
        out = F.when(is_a(kind) & _valid(kind, m), F.struct(F.lit(kind).alias("kind"), F.lit(1).alias("n"), _pseudonym(kind, m, key).alias("value"))).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, *, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: doc_id, text with pseudonyms, n_replaced, and n_<kind> for each kind.

    Found are e-mail addresses, IPv4 addresses with octets up to 255, calendar dates from 1900 to 2099 (yyyy-MM-dd),
    US social security numbers with valid groups, telephone numbers of ten digits in groups of three, three and four
    with or without a country code (its first digit is not 0; no numbering plan is asked for), and card numbers: whole
    groups of digits, 13 to 19 together, whose Luhn sum holds, wherever they begin in a run of groups.  All are
    permuted by Feistel networks keyed with `key` among the valid values of their format: a card's check digit is made
    anew; a country code and all separators stay; a mail address keeps its domain and the places of its marks, and
    letters and digits of its name are permuted (capitals count as small letters).  So equal values have equal
    pseudonyms in all documents and other values of the format others.  Digits that are no valid value stay.  Null text stays null with counts of 0; empty
    texts, repeated rows and empty tables need no rule of their own; further columns of docs are ignored.

    A narrow projection over the scan without Python: nothing is shuffled or gathered.  Plans hold a digest of the key,
    which serves in its place: treat them as secret, or let spark.sql.redaction.string.regex hide it.
    """
    if not key:
        raise ValueError("key must not be empty")
    key = hashlib.sha256(key.encode()).hexdigest()
    text = F.col("text")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    some = text.rlike("[0-9]|@")
    empty = F.array().cast("array<struct<kind:string,n:int,value:string>>")
    rows = rows.withColumn("found", F.when(some, F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: _replace(m, key))).otherwise(empty))
    between = F.split(text, ANY, -1)
    rebuilt = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.size("found")), lambda i: F.concat(F.element_at(between, i), F.element_at(F.col("found"), i)["value"])), ""), F.element_at(between, -1))
    count = lambda test: F.coalesce(F.aggregate(F.filter("found", test), F.lit(0), lambda n, x: n + x["n"]), F.lit(0)).cast("long")
    is_kind = lambda kind: lambda x: x["kind"] == kind
    return rows.select(
        "doc_id",
        F.when(F.exists(F.coalesce(F.col("found"), empty), lambda x: x["kind"].isNotNull()), rebuilt).otherwise(text).alias("text"),
        F.when(text.isNull(), 0).otherwise(count(lambda x: x["kind"].isNotNull())).cast("long").alias("n_replaced"),
        *(F.when(text.isNull(), 0).otherwise(count(is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS),
    )
