"""Format-preserving pseudonyms of personal data, in DataFrame functions alone.

Numbers and dates that pass their check are permuted within their format by a keyed Feistel network
over Z_a x Z_b with modular addition, which is a permutation of exactly a * b values, so nothing has
to be walked or stored. The tweak is the kind of value and its length, never its place: equal values
keep being equal in all documents, and different ones stay different. What is kept: separators,
country prefixes, a card's check digit (made anew), a date's pattern. Names of mailboxes and secret
tokens have no such format and become keyed digests, which link in the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: ASCII that ends the name of a mailbox is left out; everything beyond ASCII may stand in one.
_NAME = r"[^\x00-\x24\x26-\x2A\x2C\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]"
#: A host in ASCII is one run of a class, so that no length of it deepens the matcher's stack; where there is none, one with other letters (from U+00C0 on, without
#: the signs of U+2000 to U+2BFF and U+3000 to U+303F and full-width punctuation) may stand.
_LETTER = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u1FFF\u2C00-\u2FFF\u3040-\uFDFF"
_EMAIL = rf"(?<!{_NAME}){_NAME}++@(?!\.)(?:[A-Za-z0-9.\-]*(?<!\.)\.[A-Za-z]{{2,}}|[{_LETTER}0-9.\-]*(?<!\.)\.[{_LETTER}]{{2,}})"
_SECRET = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])"
_IP = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])"
_DATE = r"(?<![0-9])(?:[0-9]{4}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{1,2}|(?:[0-9]{1,2}-[0-9]{1,2}-|[0-9]{1,2}/[0-9]{1,2}/|[0-9]{1,2}\.[0-9]{1,2}\.)[0-9]{4})(?![0-9])"
_IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
_PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)[ .\-]?|[0-9]{3}[ .\-])[0-9]{3,4}[ .\-][0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])"
_TAX = r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"
#: What begins here is no further group of a run: a value of its own, or a telephone number with dots.
_STOP = rf"(?!{_EMAIL}|{_SECRET}|{_IP}|{_DATE}|[0-9]{{3}}(?:\.[0-9]{{3,4}}[ .\-]|[ \-][0-9]{{3,4}}\.)[0-9]{{4}}(?![0-9]))"
#: Runs of groups of any length, searched by :func:`_within`: 13 digits or more, or from the head of an IBAN on.
_LONG = rf"(?:\+|(?<![0-9A-Za-z]))(?=(?:[0-9][ \-]?){{12}}[0-9])[0-9]++(?![A-Za-z])(?:[ \-]{_STOP}[0-9]++(?![A-Za-z]))*+"
_CODED = rf"(?<![0-9A-Za-z])(?=[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{8}})[A-Z0-9]++(?![a-z])(?:[ \-]{_STOP}[A-Z0-9]++(?![a-z]))*+"
#: Every value has a digit, a sign of a mailbox or 32 letters in a row; texts without any of them are passed on unread.
_ANY = r"[0-9@]|[A-Fa-f]{32}"
#: Calling codes of one and two digits (fixed values); all others have three.
_CALLING = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
PATTERN = "|".join((_EMAIL, _SECRET, _IP, _DATE, _TAX, _LONG, _CODED, _PHONE))
#: Groupings that cards are printed in.
_PRINTED = r"^(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,4}(?: [0-9]{1,3})?|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,4}(?:-[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\1[0-9]{4,5})$"
#: Length of an IBAN by country.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL", 19: "MK SI", 20: "AT BA EE KZ XK LT LU", 21: "CH HR LV LI", 22: "BH BG CR GE DE IE ME RS GB VA",
    23: "AE GI IL IQ TL", 24: "AD CZ MD PK RO SA SK ES SE TN VG", 25: "PT ST", 26: "IS TR", 27: "FR GR IT MR MC SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}

KINDS = ("email", "secret", "ip", "date", "tax", "card", "iban", "phone")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _drawn(key: str, tweak: Column, i: Column, x: Column) -> Column:
    """A keyed function of a round and a half, below 2 ** 60."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), x.cast("string")), 256), 1, 15), 16, 10).cast("bigint")


def feistel(key: str, tweak: Column, left: Column, right: Column, a: Column, b: Column) -> Column:
    """(l, r) of the keyed permutation of Z_a x Z_b; a and b are at most 10 ** 18."""

    def step(acc: Column, i: Column) -> Column:
        first = F.struct(((acc["l"] + _drawn(key, tweak, i, acc["r"])) % a).alias("l"), acc["r"].alias("r"))
        second = F.struct(acc["l"].alias("l"), ((acc["r"] + _drawn(key, tweak, i, acc["l"])) % b).alias("r"))
        return F.when(i % 2 == 0, first).otherwise(second)

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """A digit string of 2 to 36 digits, permuted among those of its length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("bigint")
    halves = feistel(key, F.concat(F.lit(f"{kind}|"), n.cast("string")), F.substr(digits, F.lit(1), u), F.substr(digits, u + 1), power(u), power(n - u))
    return _let(halves, lambda x: F.concat(F.lpad(x["l"].cast("string"), u, "0"), F.lpad(x["r"].cast("string"), n - u, "0")))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refilled(m: Column, digits: Column, skip: Column | int = 0) -> Column:
    """``m`` with its digits, after the first ``skip``, taken from ``digits`` in order."""
    skip = F.lit(skip) if isinstance(skip, int) else skip

    def one(c: Column, i: Column) -> Column:
        at = F.length(_digits(F.substr(m, F.lit(1), i + 1))) - skip
        return F.when((c >= "0") & (c <= "9") & (at > 0), F.substr(digits, at, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(m, ""), lambda c: c != ""), one), "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the card check over the digits, the last one counted once."""
    n = F.length(digits)

    def weight(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), weight), F.lit(0), lambda s, x: s + x)


def _card(key: str, m: Column, digits: Column) -> Column:
    body = permuted_digits(key, "card", F.substr(digits, F.lit(1), F.length(digits) - 1))
    return _let(body, lambda b: _refilled(m, F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string"))))


def _mod97(text: Column) -> Column:
    """Remainder of the number that a string of digits and capitals (A: 10 to Z: 35) spells."""
    return F.aggregate(
        F.filter(F.split(text, ""), lambda c: c != ""),
        F.lit(0),
        lambda s, c: F.when((c >= "0") & (c <= "9"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97),
    )


def _iban(key: str, m: Column) -> Column:
    """Digits of the account permuted, letters and country kept, check digits made anew."""
    rest = F.substr(m, F.lit(5))
    new = F.when(F.length(_digits(rest)) >= 2, _refilled(rest, permuted_digits(key, "iban", _digits(rest)))).otherwise(rest)
    country = F.substr(m, F.lit(1), F.lit(2))
    return _let(new, lambda x: F.concat(country, F.lpad((98 - _mod97(F.concat(F.replace(x, F.lit(" "), F.lit("")), country, F.lit("00")))).cast("string"), 2, "0"), x))


def _ip(key: str, m: Column) -> Column:
    part = lambda i: F.get(F.split(m, "\\."), F.lit(i)).cast("bigint")
    size = F.lit(65536).cast("bigint")
    out = feistel(key, F.lit("ip"), part(0) * 256 + part(1), part(2) * 256 + part(3), size, size)
    byte = lambda x: (F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    return _let(out, lambda x: F.concat_ws(".", *byte(x["l"]), *byte(x["r"])))


#: 400 years from 1800-01-01 have 146097 = 189 * 773 days.
_FIRST, _A, _B = "1800-01-01", 189, 773


def _date_order(m: Column) -> tuple[Column, Column, Column, Column]:
    """(parts, separator, year first, day first). Of two leading numbers the first is the day if it is over 12 or dots part them."""
    parts, sep = F.split(m, "[-/.]"), F.regexp_extract(m, "([-/.])", 1)
    year_first = m.rlike("^[0-9]{4}")
    return parts, sep, year_first, ~year_first & ((F.get(parts, F.lit(0)).cast("int") > 12) | (sep == "."))


def _date_value(m: Column) -> Column:
    """The date, or null."""
    parts, _, year_first, day_first = _date_order(m)
    one, two, three = (F.get(parts, F.lit(i)) for i in range(3))
    y = F.when(year_first, one).otherwise(three)
    mo = F.lpad(F.when(year_first | day_first, two).otherwise(one), 2, "0")
    d = F.lpad(F.when(year_first, three).when(day_first, one).otherwise(two), 2, "0")
    return F.when(y.between("1800", "2199"), F.try_to_date(F.concat_ws("-", y, mo, d), "yyyy-MM-dd"))


def _date(key: str, m: Column) -> Column:
    day = F.datediff(_date_value(m), F.lit(_FIRST).cast("date"))
    a, b = F.lit(_A).cast("bigint"), F.lit(_B).cast("bigint")
    out = feistel(key, F.lit("date"), F.floor(day / _B), day % _B, a, b)
    parts, sep, year_first, day_first = _date_order(m)
    short = F.exists(parts, lambda x: F.length(x) == 1)  # written without leading zeros

    def shown(x: Column) -> Column:
        new = F.date_add(F.lit(_FIRST).cast("date"), (x["l"] * _B + x["r"]).cast("int"))
        y, mo, d = F.date_format(new, "yyyy"), *(F.when(short, F.date_format(new, p)).otherwise(F.date_format(new, 2 * p)) for p in ("M", "d"))
        return F.when(year_first, F.concat(y, sep, mo, sep, d)).when(day_first, F.concat(d, sep, mo, sep, y)).otherwise(F.concat(mo, sep, d, sep, y))

    return _let(out, shown)


#: Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999: what :func:`kind_of` lets pass.
_AREAS, _GROUPS, _SERIALS = 898, 99, 9999


def _tax(key: str, m: Column) -> Column:
    """A tax number permuted among the valid ones: areas and groups are one half, serials the other."""
    long = lambda c: c.cast("bigint")
    area = long(F.substring(m, 1, 3))
    place = (area - F.when(area > 666, 2).otherwise(1)) * _GROUPS + long(F.substring(m, 5, 2)) - 1
    out = feistel(key, F.lit("tax"), place, long(F.substring(m, 8, 4)) - 1, F.lit(_AREAS * _GROUPS).cast("bigint"), F.lit(_SERIALS).cast("bigint"))
    shown = lambda c, n: F.lpad(c.cast("string"), n, "0")
    number = lambda i: i + F.when(i >= 665, 2).otherwise(1)
    return _let(out, lambda x: F.concat_ws("-", shown(number(F.floor(x["l"] / _GROUPS)), 3), shown(x["l"] % _GROUPS + 1, 2), shown(x["r"] + 1, 4)))


def _phone(key: str, m: Column) -> Column:
    """The national number permuted whatever its groups, so that all spellings of it stay linked; the calling code stays."""
    kept = F.length(F.regexp_extract(m, _CALLING, 1))
    return _refilled(m, permuted_digits(key, "phone", F.substr(_digits(m), kept + 1)), kept)


def _digest(key: str, what: str, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(what), value), 256)


def kind_of(m: Column) -> Column:
    """What a match that is no run of groups is, with its check; null for one that fails it, which stays as it is."""
    octets = F.forall(F.split(m, "\\."), lambda x: F.try_to_number(x, F.lit("999")) <= 255)
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(m.rlike("^[0-9A-Fa-f]{32,64}$"), "secret")
        .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.when(octets, F.lit("ip")))
        .when(m.rlike(f"^{_DATE}$"), F.when(_date_value(m).isNotNull(), F.lit("date")))
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(~m.rlike("^(000|666|9..)|^...-00|0000$"), F.lit("tax")))
        .otherwise(F.when(F.length(_digits(m)).between(9, 18), F.lit("phone")))
    )


def _grouped(m: Column) -> Column:
    """Whether a match is a run of groups, to be searched for values on the borders of its groups."""
    return m.rlike(r"^\+?[0-9A-Z]++(?:[ \-][0-9A-Z]++)*+$") & ~m.rlike(rf"^(?:[0-9A-Fa-f]{{32,64}}|{_DATE}|{_TAX})$")


def _checked(s: Column, printed: bool) -> Column:
    """``card`` or ``iban`` if ``s`` is one (if ``printed``, in the usual groups and its country's length), else null."""
    digits, compact = _digits(s), F.replace(s, F.lit(" "), F.lit(""))
    card, iban = s.rlike("^[0-9](?:[ \\-]?[0-9]){12,18}$"), s.rlike(f"^{_IBAN}$")
    if printed:
        card = s.rlike(_PRINTED)
        sizes = F.lit(" ".join(f"{c}{n}" for n, names in _IBAN_LENGTHS.items() for c in names.split()))
        iban = iban & F.contains(sizes, F.concat(F.substring(s, 1, 2), F.length(compact).cast("string")))
    sum97 = _mod97(F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4))))
    return F.when(card, F.when(luhn_sum(digits) % 10 == 0, F.lit("card"))).when(iban, F.when(sum97 == 1, F.lit("iban")))


_PARTS = "array<struct<kind:string,text:string>>"


def _part(kind: Column | None, text: Column) -> Column:
    return F.struct((F.lit(None) if kind is None else kind).cast("string").alias("kind"), text.alias("text"))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, "[ \\-]$", "")


def _valued(kind: Column, text: Column) -> Column:
    """Two parts: a value, and the separator after it."""
    return _let(_bare(text), lambda s: F.array(_part(kind, s), _part(None, F.substr(text, F.length(s) + 1))))


def _loose(m: Column) -> Column:
    """Parts of a run without values in their usual groups: the whole if it passes, else tax and phone numbers, and what :func:`_within` finds between them."""
    pattern = f"{_TAX}|{_PHONE}"
    none = F.array().cast(_PARTS)

    def piece(f: Column) -> Callable[[Column, Column], Column]:
        value = lambda i: _let(F.get(f, i), lambda x: F.array(_part(kind_of(x), x)))
        return lambda p, i: F.concat(F.when(p != "", _within(p, False)).otherwise(none), F.when(i < F.size(f), value(i)).otherwise(none))

    parts = _let(F.regexp_extract_all(m, F.lit(pattern), F.lit(0)), lambda f: F.flatten(F.transform(F.split(m, pattern, -1), piece(f))))
    return _let(F.when(F.length(m) <= 48, _checked(_bare(m), False)), lambda k: F.when(k.isNotNull(), _valued(k, m)).otherwise(parts))


def _within(m: Column, printed: bool = True) -> Column:
    """Parts (kind or null, text) of a run of groups, in order.

    Cards and IBANs in their usual groups are taken first, from the left, the longest first; then, between
    them, numbers of other kinds; then cards and IBANs in any other groups. So no neighbour hides a value.
    """
    none = F.array().cast("array<struct<kind:string,i:int,j:int>>")

    def searched(words: Column) -> Column:
        n = F.size(words)
        text = lambda i, j: F.array_join(F.transform(F.sequence(i, j), lambda k: F.get(words, k)), "")

        def longest(i: Column) -> Column:
            ends = F.reverse(F.sequence(i, F.least(i + 18, n - 1)))
            made = F.transform(ends, lambda j: F.struct(_let(_bare(text(i, j)), lambda s: F.when(F.length(s).between(12, 48), _checked(s, printed))).alias("kind"), i.alias("i"), j.alias("j")))
            return F.when(F.get(words, i).rlike("^[0-9A-Z]"), F.get(F.filter(made, lambda h: h["kind"].isNotNull()), F.lit(0)))

        def step(acc: Column, i: Column) -> Column:
            free = F.coalesce(F.get(acc, F.size(acc) - 1)["j"] < i, F.lit(True))
            return _let(F.when(free, longest(i)), lambda h: F.when(h.isNotNull(), F.concat(acc, F.array(h))).otherwise(acc))

        def cut(hits: Column) -> Column:
            def piece(x: Column, t: Column) -> Column:
                start = F.when(t > 0, F.get(hits, t - 1)["j"] + 1).otherwise(F.lit(0))
                gap = F.when(start < x["i"], _let(text(start, x["i"] - 1), lambda g: _loose(g) if printed else F.array(_part(None, g))))
                own = F.when(x["kind"].isNotNull(), _let(text(x["i"], x["j"]), lambda w: _valued(x["kind"], w)))
                return F.concat(*(F.coalesce(y, F.array().cast(_PARTS)) for y in (gap, own)))

            end = F.struct(F.lit(None).cast("string").alias("kind"), n.alias("i"), n.alias("j"))
            return F.flatten(F.transform(F.concat(hits, F.array(end)), piece))

        return _let(F.aggregate(F.sequence(F.lit(0), n - 1), none, step), cut)

    return _let(F.regexp_extract_all(m, F.lit("[ \\-]?\\+?[0-9A-Z]*+[ \\-]?(?<=.)"), F.lit(0)), searched)


def pseudonym(key: str, kind: Column, m: Column) -> Column:
    """What stands for a match of a kind."""
    letters = lambda what, x, n: F.translate(F.substring(_digest(key, what, F.lower(x)), 1, n), "0123456789", "ghijklmnop")  # noqa: E731  (digits might look like a number)
    secret = F.substr(_digest(key, "secret", F.lower(m)), F.lit(1), F.length(m))
    return (
        F.when(kind == "email", F.concat(F.lit("u"), letters("email", m, 24), F.lit("@d"), letters("host", F.substring_index(m, "@", -1), 16), F.lit(".invalid")))
        .when(kind == "secret", F.when(m.rlike("[a-f]"), secret).otherwise(F.upper(secret)))
        .when(kind == "ip", _ip(key, m))
        .when(kind == "date", _date(key, m))
        .when(kind == "tax", _tax(key, m))
        .when(kind == "card", _card(key, m, _digits(m)))
        .when(kind == "iban", _iban(key, m))
        .when(kind == "phone", _phone(key, m))
        .otherwise(m)
    )


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", into: str | None = None, found_col: str = "__p_found") -> DataFrame:
    """``docs`` with the text's values replaced (in ``into``, or in place) and ``found_col``: array of (kind, place in the text).

    Null text stays null with no values, and an empty or very long text is treated like any other. Each
    row is worked on alone, so no key is hot, repeated rows get equal results, and an empty table gives an
    empty one. Columns whose names begin with ``__p_`` are the operator's own.
    """
    t = F.col(text_col)
    asked = F.coalesce(t.rlike(_ANY), F.lit(False))
    matches = F.when(asked, F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)))
    changed = docs.withColumn("__p_m", F.coalesce(matches, F.array().cast("array<string>")))
    parts = lambda m: F.when(_grouped(m), _within(m)).otherwise(F.array(_part(kind_of(m), m)))
    new = lambda p: F.struct(p["kind"].alias("kind"), pseudonym(key, p["kind"], p["text"]).alias("new"))
    made = F.transform("__p_m", lambda m: F.transform(parts(m), new))
    changed = changed.withColumn("__p_new", F.when(F.size("__p_m") > 0, made))
    pieces = F.split(t, PATTERN, -1)
    zipped = _let(pieces, lambda s: F.array_join(F.transform(s, lambda p, i: F.concat(p, F.coalesce(F.array_join(F.get(F.col("__p_new"), i)["new"], ""), F.lit("")))), ""))
    text = F.when(F.size("__p_m") > 0, zipped).otherwise(t)
    kinds = F.filter(F.coalesce(F.flatten(F.transform("__p_new", lambda x: x["kind"])), F.array().cast("array<string>")), lambda k: k.isNotNull())
    return changed.withColumn(found_col, kinds).withColumn(into or text_col, text).drop("__p_m", "__p_new")


def report(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the number of values of each kind (``n_email`` ...), their sum, and the new ``text``."""
    done = pseudonymised(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), key)
    counts = [(F.size("__p_found") - F.size(F.array_remove("__p_found", k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return done.select("doc_id", F.size("__p_found").cast("long").alias("n_values"), *counts, "text")


def replaced(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The documents with pseudonyms in their text; other columns as they were, but for the length in ``count_col``."""
    inner = docs.select(*[F.col(c).alias(f"__d_{i}") for i, c in enumerate(docs.columns)])
    at = f"__d_{docs.columns.index(text_col)}"
    done = pseudonymised(inner, key, at)
    return done.select(*[(F.length(at) if c == count_col else F.col(f"__d_{i}")).cast(docs.schema[c].dataType).alias(c) for i, c in enumerate(docs.columns)])
