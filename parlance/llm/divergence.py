"""Source divergence audit: how the words of each source differ from those of the other sources of its language.

For a group (a language's source) each kept term has p = 1 + floor(10^9 (count + 1) / (N + V)), and the divergence
from another distribution q is the sum of f = floor((p - q)^2 / q) over all V kept terms. Of these most are in neither
source, so a pair starts at the *baseline* V f(p0, q0) of zero counts and an inverted index gives only corrections:

* terms of one source, the other's count taken as zero: they depend on the count alone, so each source's terms are
  counted by their count first, and a pair meets one row for each count that occurs;
* terms of both: the postings of a term are joined with each other, and each pair of sources gets what
  the two corrections above have wrong.

Texts are counted per Arrow batch (a term array is cut out of the lower-cased bytes and dictionary-encoded, so equal means
equal bytes) and added up by Spark. The numbers are integers throughout: products that can pass 64 bits are decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.scratch import materialise, ship, tidied
from parlance.llm.textbytes import flat, runs, word_spans

UNIT = 1_000_000_000
#: Bytes of text counted at once.
SLICE = 4 << 20

_TERM_BYTE = np.zeros(256, bool)
_TERM_BYTE[128:] = True
for _lo in (65, 97):
    _TERM_BYTE[_lo : _lo + 26] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def counted(lang: pa.Array, source: pa.Array, text: pa.Array) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of rows, and one row without a term for each (lang, source).

    ``n`` counts a term's places in the group's texts, ``docs`` the texts that have it.
    """
    langs, sources = (pc.fill_null(c, "").dictionary_encode() for c in (lang, source))
    both, group = np.unique(langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(), return_inverse=True)
    names = [langs.dictionary.take(pa.array(both // len(sources.dictionary))), sources.dictionary.take(pa.array(both % len(sources.dictionary)))]
    zeros = pa.array(np.zeros(len(both), np.int64))
    header = ["lang", "source", "term", "n", "docs"]
    yield pa.RecordBatch.from_arrays([*names, pa.nulls(len(both), pa.string()), zeros, zeros], header)
    data, offsets = flat(text)
    for i, j in runs(offsets, SLICE):
        lo = offsets[i]
        part = _LOWER[data[lo : offsets[j]]]
        start, end, row = word_spans(part, offsets[i : j + 1] - lo, _TERM_BYTE)
        if not len(start):
            continue
        at = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=at[1:])
        terms = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(part[_TERM_BYTE[part]])).dictionary_encode()
        words, codes = terms.dictionary.cast(pa.string()), terms.indices.to_numpy().astype(np.int64)
        seen = row * len(words) + codes
        seen.sort()
        seen, times = np.unique(seen, return_counts=True)
        key = group[i + seen // len(words)] * len(words) + seen % len(words)
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        g, w = pa.array(key[first] // len(words)), pa.array(key[first] % len(words))
        n, docs = np.add.reduceat(times, first), np.diff(np.append(first, len(key)))
        for a in range(0, len(first), 65_536):
            cut = slice(a, a + 65_536)
            yield pa.RecordBatch.from_arrays([*[x.take(g[cut]) for x in names], words.take(w[cut]), pa.array(n[cut].astype(np.int64)), pa.array(docs[cut].astype(np.int64))], header)


@tidied
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield from counted(batch.column("lang"), batch.column("source"), batch.column("text"))


def _share(count: Column | str, total: Column | str) -> Column:
    """p of a count among ``total`` = N + V."""
    wide = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")
    one = F.lit(1).cast("decimal(20,0)")
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (wide(count) + one), wide(total)) + 1


def _f(p: str, q: str) -> Column:
    d = F.col(p) - F.col(q)
    return F.call_function("div", d * d, F.col(q))


def audited(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has the divergence of a group from each other source of its language, part ``term`` its over-used terms.

    A language keeps the terms in at least ``least_docs`` of its texts. Part ``term`` has terms whose share in the group is over that in the language,
    by f against the language's share, the first ``most_terms``. Ranks are per group and part, from 1, by falling value and then
    by the item's bytes. Null text, lang and source count as ''; a text without terms makes its group occur; a language with one source has no pairs, one without
    kept terms has pairs of value 0; repeated rows count each; an empty table gives no rows. Only the three named columns are read, whatever others there are.
    A very long text is counted whole in its task, at some 40 bytes for each byte. Sums stay in 64 bits while a language has under 2 * 10^9 kept terms.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counts = materialise(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs")
    postings = materialise(counts.filter("term IS NOT NULL").drop("docs").join(kept, ["lang", "term"]), "postings")
    groups = counts.filter("term IS NULL").select("lang", "source").join(postings.groupBy("lang", "source").agg(F.sum("n").alias("own")), ["lang", "source"], "left")
    terms = postings.select("lang", "term", "all_n").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all"))
    groups = groups.join(terms, "lang", "left").select("lang", "source", (F.coalesce("own", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), (F.col("all") + F.col("v")).alias("lang_total"))
    groups = materialise(groups.withColumn("p0", F.when(F.col("total") > 0, _share(F.lit(0), "total")).otherwise(1)), "groups")

    shares = postings.join(groups.drop("v"), ["lang", "source"]).withColumn("p", _share("n", "total"))
    over = shares.withColumn("q", _share("all_n", "lang_total")).filter(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value"))

    side = lambda k: groups.select("lang", F.col("source").alias(f"source{k}"), F.col("p0").alias(f"p0{k}"), "v" if k == "a" else F.lit(0).alias("v2"))
    pairs = side("a").join(side("b"), "lang").filter("sourcea <> sourceb")
    base = pairs.select("lang", "sourcea", "sourceb", (F.col("v") * _f("p0a", "p0b")).alias("x"))
    levels = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("m"))
    level = levels.select("lang", F.col("source").alias("s"), "p", "p0", "m").join(groups.select("lang", F.col("source").alias("o"), F.col("p0").alias("q0")), "lang").filter("s <> o")
    one = F.array(F.struct(F.col("s").alias("sourcea"), F.col("o").alias("sourceb"), (_f("p", "q0") - _f("p0", "q0")).alias("d")), F.struct(F.col("o").alias("sourcea"), F.col("s").alias("sourceb"), (_f("q0", "p") - _f("q0", "p0")).alias("d")))
    single = level.select("lang", "m", F.explode(one).alias("e")).select("lang", "e.sourcea", "e.sourceb", (F.col("m") * F.col("e.d")).alias("x"))
    end = lambda k: shares.select("lang", "term", F.col("source").alias(f"s{k}"), F.col("p").alias(f"p{k}"), F.col("p0").alias(f"z{k}"))
    fix = lambda a, b: _f(f"p{a}", f"p{b}") - _f(f"p{a}", f"z{b}") - _f(f"z{a}", f"p{b}") + _f(f"z{a}", f"z{b}")
    both = end("a").join(end("b"), ["lang", "term"]).filter("sa < sb").groupBy("lang", "sa", "sb").agg(F.sum(fix("a", "b")).alias("ab"), F.sum(fix("b", "a")).alias("ba"))
    twice = F.array(F.struct(F.col("sa").alias("sourcea"), F.col("sb").alias("sourceb"), F.col("ab").alias("x")), F.struct(F.col("sb").alias("sourcea"), F.col("sa").alias("sourceb"), F.col("ba").alias("x")))
    shared = both.select("lang", F.explode(twice).alias("e")).select("lang", "e.sourcea", "e.sourceb", "e.x")
    apart = base.unionByName(single).unionByName(shared).groupBy("lang", F.col("sourcea").alias("source"), F.col("sourceb").alias("item")).agg(F.sum("x").alias("value"))
    apart = apart.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(apart).unionByName(ranked(over).filter(F.col("rank") <= most_terms))


def oracle_sql() -> str:
    """DuckDB SQL that gives every group every kept term, without baselines or corrections."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    p = lambda n, total: f"1 + CAST({UNIT} AS HUGEINT) * ({n} + 1) // ({total})"
    f = "(p - q) * (p - q) // q"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{alphabet}', '{alphabet.lower()}') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
full_ AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS all_n FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
total AS (SELECT lang, source, sum(n) AS n FROM full_ GROUP BY ALL),
shares AS (SELECT x.lang, x.source, x.term, x.n, {p('x.n', 't.n + l.v')} AS p, {p('x.all_n', 'l.n + l.v')} AS all_p FROM full_ x JOIN total t USING (lang, source) JOIN l ON l.lang = x.lang),
apart AS (SELECT lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
over_ AS (SELECT lang, source, 'term' AS part, term AS item, {f.replace('q', 'all_p')} AS value FROM shares WHERE n > 0 AND p > all_p),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM over_))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""
