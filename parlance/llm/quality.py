"""Weak supervision of document quality, in DataFrame functions alone.

Rules vote good (+1), bad (-1) or abstain (0) on each document. Votes are counted by pattern, at
most 3 ** rules patterns whatever the corpus; expectation-maximisation over those counts estimates
how often each rule is right on good and on bad documents; the posterior probability that a document
is good decides, instead of all rules having to pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.scratch import materialise

SPACE = " \t\n\x0b\f\r"
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Places of words fit in this many bits of a packed window; longer texts take the plain path.
_PLACE_BITS = 22


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(bare) > 0, F.split(bare, WORD_SPLIT)).otherwise(F.array().cast("array<string>"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _window_hashes(words: Column) -> Column:
    """xxhash64 of the three words from each place."""
    n = F.size(words)
    return F.when(n >= 3, F.transform(F.slice(words, 1, n - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def _repeated_places(words: Column, hashes: Column) -> Column:
    """Ascending places whose three words stand at another place too, compared as words.

    Places whose hashes meet are found by sorting packed longs; only those are compared as text.
    """
    low = (1 << _PLACE_BITS) - 1
    packed = F.sort_array(F.transform(hashes, lambda h, i: F.shiftright(h, 0).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
    same = lambda a, b: F.coalesce(F.shiftright(a, _PLACE_BITS) == F.shiftright(b, _PLACE_BITS), F.lit(False))
    met = _let(packed, lambda s: F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))))
    some = F.when(F.size(hashes) <= low, F.transform(met, lambda x: x.bitwiseAND(F.lit(low)).cast("int"))).otherwise(F.transform(hashes, lambda h, i: i))
    texts = F.sort_array(F.transform(some, lambda p: F.struct(F.concat_ws("\n", F.slice(words, p + 1, 3)).alias("t"), p.alias("p"))))
    twice = _let(texts, lambda s: F.filter(s, lambda x, i: F.coalesce(x["t"] == F.get(s, i - 1)["t"], F.lit(False)) | F.coalesce(x["t"] == F.get(s, i + 1)["t"], F.lit(False))))
    return F.sort_array(F.transform(twice, lambda x: x["p"]))


def _covered(places: Column) -> Column:
    """Words under the three-word windows at ascending places."""
    return _let(places, lambda s: F.aggregate(F.transform(s, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x))


@dataclass(frozen=True)
class Rule:
    """Votes good where ``good`` holds, bad where ``bad`` holds, else abstains."""

    name: str
    good: str
    bad: str


#: Over the columns of :func:`features`. Ratios are products, so that an empty text divides nothing.
RULES = (
    Rule("length", "n_words >= 80", "n_words < 50"),
    Rule("word_length", "word_chars >= 3 * n_words AND word_chars <= 9 * n_words", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    Rule("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("lines", "n_dup_lines = 0", "2 * n_dup_lines > n_lines"),
    Rule("windows", "10 * n_repeat_words <= n_words", "5 * n_repeat_words > 2 * n_words"),
    Rule("variety", "n_words > 0 AND 10 * n_distinct >= 3 * least(n_words, 400)", "5 * n_distinct < least(n_words, 400)"),
    Rule("case", "10 * n_upper <= word_chars", "10 * n_upper > 3 * word_chars"),
    Rule("letters", "100 * n_letters >= 93 * word_chars", "10 * n_letters < 9 * word_chars"),
    Rule("shouts", "50 * n_shouts <= n_words", "4 * n_shouts > n_words"),
)


def features(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` and the counts the rules look at, each name prefixed with ``__q_``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = lambda t, chars: F.length(t) - sum((F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))) for c in chars), F.lit(0))
    first = docs.withColumn("__q_text", text).withColumn("__q_words", words_of(F.col("__q_text")))
    second = first.withColumn("__q_hashes", _window_hashes(F.col("__q_words")))
    t, words = F.col("__q_text"), F.col("__q_words")
    n = F.size(words)
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    out = {
        "n_words": n,
        "word_chars": bare(t, SPACE),
        "n_symbols": F.length(t) - bare(t, SYMBOLS),
        "n_lines": F.size(lines),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": F.when(F.size(F.array_distinct(F.col("__q_hashes"))) < F.size("__q_hashes"), _covered(_repeated_places(words, F.col("__q_hashes")))).otherwise(0),
        "n_distinct": F.size(F.array_distinct(words)),
        "n_upper": F.length(t) - F.length(F.regexp_replace(t, "\\p{Lu}", "")),
        "n_letters": F.length(t) - F.length(F.regexp_replace(t, "[\\p{L}\\p{M}]+", "")),
        "n_shouts": F.length(t) - bare(t, "!?"),
    }
    return second.select(*[F.col(c) for c in docs.columns], *[v.cast("long").alias(f"__q_{k}") for k, v in out.items()])


def votes() -> list[Column]:
    """Each rule's vote over the prefixed features."""

    def prefixed(sql: str) -> Column:
        for name in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_letters", "n_shouts"):
            sql = sql.replace(name, f"__q_{name}")
        return F.expr(sql)

    return [F.when(prefixed(r.bad), F.lit("b")).when(prefixed(r.good), F.lit("g")).otherwise(F.lit("-")) for r in RULES]


#: How a rule votes on good and on bad documents before any is seen.
_GOOD = {"g": 0.8, "b": 0.02, "-": 0.18}
_BAD = {"g": 0.5, "b": 0.3, "-": 0.2}


def expectation_maximisation(counts: dict[str, int], prior: float = 0.8, rounds: int = 200) -> dict[str, float]:
    """Posterior that a document is good, for each vote pattern.

    Each rule has a probability to vote good, bad or not at all in either class. They start from
    votes that lean the right way, the bad ones more than the good, and stay smoothed towards it.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}
    rate = [{"good": dict(_GOOD), "bad": dict(_BAD)} for _ in patterns[0]]
    share = prior
    post: dict[str, float] = {}
    for _ in range(rounds):
        new = {}
        for p in patterns:
            odds = log(share) - log(1 - share) + sum(log(r["good"][v]) - log(r["bad"][v]) for r, v in zip(rate, p))
            new[p] = 1 / (1 + exp(-max(-700.0, min(700.0, odds))))
        moved = max((abs(new[p] - post.get(p, 2.0)) for p in patterns), default=0)
        post = new
        if moved < 1e-9:
            break
        total = sum(counts.values())
        good = sum(counts[p] * post[p] for p in patterns)
        share = (good + 8) / (total + 10)
        for k, r in enumerate(rate):
            for v in "gb-":
                mine = [(counts[p], post[p]) for p in patterns if p[k] == v]
                r["good"][v] = (sum(c * q for c, q in mine) + 4 * _GOOD[v]) / (good + 4)
                r["bad"][v] = (sum(c * (1 - q) for c, q in mine) + 4 * _BAD[v]) / (total - good + 4)
    return post


#: The columns of :func:`judged` beside the carried ones.
OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_good", "kept")


def judged(docs: DataFrame, text_col: str = "text", least: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """The documents with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, p_good, kept``.

    A document fails the base rules under 50 words, or when more than half of its words stand in
    repeated three-word windows; those are not asked in the estimation. Otherwise the posterior decides. Null text counts as empty, which
    fails; marks of vowels and tones count as letters. Repeated rows get equal verdicts; a posterior of exactly
    ``least`` keeps. Features are written once with the columns of ``carry`` (all, if not given), so texts are
    read once. A carried column that is named like one of these gives way to it.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in OUTPUTS]
    found = features(docs, text_col).withColumn("__q_votes", F.concat(*votes()))
    table = materialise(found.select(*carry, *[c for c in found.columns if c.startswith("__q_")]), "votes")
    failed = (F.col("__q_n_words") < 50) | (100 * F.col("__q_n_repeat_words") > 50 * F.col("__q_n_words"))
    counts = {r["__q_votes"]: r["count"] for r in table.filter(~failed).groupBy("__q_votes").count().collect()}  # at most 3 ** rules rows
    post = expectation_maximisation(counts)
    spark = docs.sparkSession
    known = spark.createDataFrame(sorted(post.items()) or [("", 0.0)], "__q_pattern string, p_good double")
    base = [F.col(f"__q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    joined = table.join(F.broadcast(known), table["__q_votes"] == known["__q_pattern"], "left")
    return joined.select(*carry, *base, failed.alias("base_failed"), "p_good", (~failed & (F.coalesce("p_good", F.lit(0.0)) >= least)).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that :func:`judged` keeps, with their columns under any names not beginning with ``__q_``."""
    inner = docs.select(*[F.col(c).alias(f"__d_{i}") for i, c in enumerate(docs.columns)])
    found = judged(inner, f"__d_{docs.columns.index(text_col)}", least).filter("kept")
    return found.select(*[F.col(f"__d_{i}").alias(c) for i, c in enumerate(docs.columns)])
