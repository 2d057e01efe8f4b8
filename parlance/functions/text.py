"""Text functions as columns."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that do not count in matching.
STOPWORDS = ("de", "la", "el", "y", "que", "en", "a", "un", "una", "los", "las", "por", "para", "con", "no", "si", "se", "lo", "le", "me", "es", "su")


@cache
def _folding() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose into one ASCII letter and marks."""
    pairs = []
    for cp in range(0xC0, 0x250):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
        if len(bare) == 1 and bare != chr(cp):
            pairs.append((chr(cp), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Combining marks: what is without a counterpart in a translation goes.
_MARKS = "".join(map(chr, range(0x300, 0x370)))


def fold_accents(c: Column) -> Column:
    accented, bare = _folding()
    return F.translate(c, accented + _MARKS, bare)


def normalize_text(c: Column) -> Column:
    """Lower case without accents or punctuation, single blanks; null as empty."""
    bare = F.regexp_replace(fold_accents(F.lower(F.coalesce(c, F.lit("")))), "(?U)[^\\w\\s]", " ")
    return F.trim(F.regexp_replace(bare, "(?U)\\s+", " "))


def normalize_for_match(c: Column) -> Column:
    """As :func:`normalize_text`, with letters a to z and digits only."""
    bare = F.regexp_replace(fold_accents(F.lower(F.coalesce(c, F.lit("")))), "[^a-z0-9\\s]", " ")
    return F.trim(F.regexp_replace(bare, "\\s+", " "))


def match_tokens(c: Column) -> Column:
    """Tokens of the text, normalised for matching, but for the stop words."""
    words = F.split(fold_accents(F.lower(F.coalesce(c, F.lit("")))), "[^a-z0-9]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOPWORDS))


def count_words(c: Column) -> Column:
    """Runs between white space."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def count_word_runs(c: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit("(?U)\\w+"))


def containment(a: Column, b: Column) -> Column:
    """Shared distinct tokens over the smaller set; 0 if either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared distinct tokens over all; 0 if either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def char_grams(c: Column, shortest: int = 3, longest: int = 5) -> Column:
    """Character n-grams within words padded by a blank on either side.

    A padded word no longer than n gives itself once, at the first such n. One pass of a regular expression for each n, over
    words that stand two blanks apart: a gram begins anywhere and holds a blank at its ends alone.
    """
    words = F.regexp_replace(F.concat(F.lit(" "), fold_accents(F.lower(F.coalesce(c, F.lit("")))), F.lit(" ")), "[^a-z0-9]+", "  ")

    def pattern(n: int) -> str:
        whole = f" [^ ]{{{1 if n == shortest else n - 2},{n - 2}}} "
        return f"(?=([^ ]{{{n}}}| [^ ]{{{n - 1}}}|[^ ]{{{n - 1}}} |{whole}))"

    return F.concat(*[F.regexp_extract_all(words, F.lit(pattern(n)), 1) for n in range(shortest, longest + 1)])


def joined_words(words: Column) -> Column:
    """Words with their own blanks put together, without blanks before punctuation."""
    t = F.regexp_replace(F.array_join(words, ""), "\\s+", " ")
    return F.trim(F.regexp_replace(t, " ([,.;:!?])", "$1"))


def salted_hash(c: Column, salt: str, size: int = 16) -> Column:
    """First hex digits of sha256 of ``salt_value``; null stays null."""
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}_"), F.trim(c.cast("string"))), 256), 1, size)


def text_hash(c: Column) -> Column:
    """Unsalted 16 hex digits; blank as null."""
    return F.when(F.trim(c) != "", F.substring(F.sha2(c, 256), 1, 16))


def clock(c: Column) -> Column:
    """Seconds as MM:SS. Seconds are rounded after the minutes are taken, so 59.6 shows as 00:60."""
    s = F.bround(c % 60, 0).cast("int")
    return F.when(c.isNotNull(), F.format_string("%02d:%02d", F.floor(c / 60).cast("int"), s))


def clock_hundredths(c: Column) -> Column:
    """Seconds as MM:SS.ss."""
    return F.when(c.isNotNull(), F.format_string("%02d:%05.2f", F.floor(c / 60).cast("int"), (c % 60).cast("double")))
