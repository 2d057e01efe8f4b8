"""License notices by an exact containment join of text blocks with notice templates, in SQL functions alone.

A block is a window of words, wherever lines end: a template of up to ``unit`` words is held against
the windows of ``2 * unit`` words that begin at every multiple of ``unit``, so that a notice of the
template's length is in one of them as a whole, however it is wrapped. A block holds a template if at
least ``THRESHOLD`` of the template's different words are in it, and all of those that name the
license. Words of the templates are ordered by how often they are in the whole corpus, rarest first,
and a block is reduced to its words of that vocabulary in that order, which changes no overlap. Then

* length filter: the reduced block has at least ``need`` words,
* prefix filter: overlap of at least ``need`` out of ``n`` words means that one of the template's
  ``n - need + 1`` rarest words is in the block,
* positional filter: with the first common word at places i and j, no more than
  ``1 + min(n - i - 1, m - j - 1)`` can be common,

and what is left is counted exactly. Templates are few and fixed, so the join runs inside the row:
nothing is shuffled but the word counts, which are summed before they are sent.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD = 0.8
#: Units of the blocks; a template goes with the smallest one that is not shorter than it.
UNITS = (16, 64, 256)
#: Phrases that always count, as consecutive words, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    """A notice as lower-case words; ``names`` must all be in a block, whatever else is missing."""

    label: str
    text: str
    names: str = ""

    @property
    def words(self) -> list[str]:
        return sorted(set(self.text.split()))

    @property
    def unit(self) -> int:
        return next(u for u in UNITS if len(self.text.split()) <= u)


#: Fixed texts: public licenses, and the usual notices that name them.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache 2"),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    Template("mit", "released under the mit license", "mit"),
    Template("mit", "licensed under the mit license", "mit"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "associated files"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied "
        "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
        "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution"),
    Template(
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice "
        "this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "fee"),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone "
        "to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "alter",
    ),
    Template("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "accompanying organization"),
    Template("gpl", "licensed under the gnu general public license version 3", "gnu general"),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license "
        "or at your option any later version",
        "gnu general",
    ),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser"),
    Template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license "
        "or at your option any later version",
        "lesser",
    ),
    Template("agpl", "licensed under the gnu affero general public license version 3", "affero"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "mozilla"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative attribution"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative sharealike"),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative noncommercial"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc nc"),
    Template("public-domain", "this is free and unencumbered software released into the public domain", "unencumbered"),
    Template("reserved", "copyright all rights reserved", "copyright reserved"),
)


def _normal(text: Column) -> Column:
    """Words between single spaces, one at either end as well; a space alone if there is none. A to Z are lower-cased, nothing else."""
    bare = F.btrim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), SEPARATOR, " "), F.lit(" "))
    return F.when(F.length(bare) > 0, F.concat(F.lit(" "), bare, F.lit(" "))).otherwise(F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _words(normal: Column) -> Column:
    return F.split(F.btrim(normal, F.lit(" ")), " ")


def word_order(docs: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, int]:
    """Rank of each word of the vocabulary by its count in the corpus, rarest first, ties by name."""
    words = docs.select(F.explode(_words(_normal(F.coalesce(F.col(text_col), F.lit(""))))).alias("w")).filter(F.col("w").isin(vocabulary))
    counts = {r["w"]: r["count"] for r in words.groupBy("w").count().collect()}  # no more rows than the vocabulary
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _need(template: Template, threshold: float) -> int:
    return ceil(threshold * len(template.words) - 1e-9)


def rare_words(template: Template, rank: dict[str, int], threshold: float) -> list[str]:
    """Words of which a block must have one: the rarest of the names, else the template's prefix."""
    by_rank = sorted(template.names.split() or template.words, key=rank.__getitem__)
    return by_rank[:1] if template.names else by_rank[: len(by_rank) - _need(template, threshold) + 1]


def filtered(own: Column, t: Column) -> tuple[Column, Column, Column, Column]:
    """Whether template ``t`` passes the length, prefix and positional filter and the exact count against the ordered words ``own``."""
    n, m, need = F.size(t["ids"]), F.size(own), t["need"]
    first = F.get(F.array_intersect(t["prefix"], own), F.lit(0))
    room = 1 + F.least(n - F.array_position(t["ids"], first), m - F.array_position(own, first))
    return m >= need, first.isNotNull(), room >= need, F.size(F.array_intersect(own, t["ids"])) >= need


def template_rows(templates: tuple[Template, ...], rank: dict[str, int], threshold: float) -> Column:
    """The templates as an array of (label, ids, prefix, names, need)."""
    rows = []
    for t in templates:
        ids = sorted(rank[w] for w in t.words)
        need = _need(t, threshold)
        names = F.array(*[F.lit(rank[w]) for w in t.names.split()]).cast("array<int>")
        rows.append(F.struct(F.lit(t.label).alias("label"), F.array(*map(F.lit, ids)).alias("ids"), F.array(*map(F.lit, ids[: len(ids) - need + 1])).alias("prefix"), names.alias("names"), F.lit(need).alias("need")))
    return F.array(*rows)


def _block_hits(words: Column, unit: int, templates: tuple[Template, ...], rank: dict[str, int], threshold: float) -> Column:
    """(label, share, first word, words) of each template in each block of 2 * ``unit`` of the words."""
    table = template_rows(templates, rank, threshold)
    ordered = sorted({w for t in templates for w in t.words}, key=rank.__getitem__)
    names = F.array(*map(F.lit, ordered))
    ranks = F.create_map(*[F.lit(x) for w in ordered for x in (w, rank[w])])
    rare = F.array(*map(F.lit, sorted({w for t in templates for w in rare_words(t, rank, threshold)})))
    block = lambda k: F.slice(words, k * unit + 1, F.lit(2 * unit))

    def one(k: Column) -> Column:
        own = F.sort_array(F.transform(F.array_intersect(block(k), names), lambda w: ranks[w]))

        def holds(b: Column, t: Column) -> Column:
            length, prefix, place, count = filtered(b, t)
            return length & prefix & place & (F.size(F.array_except(t["names"], b)) == 0) & count

        def hit(b: Column, t: Column) -> Column:
            share = F.size(F.array_intersect(b, t["ids"])) / F.size(t["ids"])
            return F.struct(t["label"].alias("label"), share.alias("share"), (k * unit).cast("int").alias("first_word"), F.size(block(k)).alias("words"))

        return _let(own, lambda b: F.transform(F.filter(table, lambda t: holds(b, t)), lambda t: hit(b, t)))

    last = F.greatest(F.ceil(F.size(words) / unit).cast("int") - 2, F.lit(0))
    return F.flatten(F.transform(F.filter(F.sequence(F.lit(0), last), lambda k: F.arrays_overlap(block(k), rare)), one))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row for each document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, hits``.

    ``hits`` is an array of (label, share, first_word, words) over the blocks that hold a template; ``score`` is
    1 where a phrase stands, else the largest share, else 0. Null text counts as empty; a text of any length is
    read whole. Repeated rows give repeated results, an empty table an empty one; other columns play no part.
    """
    rank = word_order(docs, text_col, sorted({w for t in templates for w in t.words}))
    rare = F.array(*map(F.lit, sorted({w for t in templates for w in rare_words(t, rank, threshold)})))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t")).withColumn("__n", _normal(F.col("__t")))
    norm = F.col("__n")
    there = {p: F.contains(norm, F.lit(f" {p} ")) for p in PHRASES}
    found = F.array_compact(F.array(*[F.when(there[p], F.lit(label)) for p, label in PHRASES.items()]))
    by_unit = {u: tuple(t for t in templates if t.unit == u) for u in UNITS}
    joined = _let(_words(norm), lambda w: F.when(F.arrays_overlap(w, rare), F.concat(*[_block_hits(w, u, ts, rank, threshold) for u, ts in by_unit.items() if ts])))
    empty = F.array().cast("array<struct<label:string,share:double,first_word:int,words:int>>")
    marked = base.withColumn("__found", found).withColumn("hits", F.coalesce(joined, empty))
    any_base = F.size("__found") > 0
    alternation = f"(?<= )(?:{'|'.join(PHRASES)})(?= )"
    start = F.array_min(F.array_compact(F.array(*[F.when(there[p], F.instr(norm, f" {p} ")) for p in PHRASES])))
    mirror = F.reverse(norm)
    end = F.array_min(F.array_compact(F.array(*[F.when(there[p], F.instr(mirror, f" {p[::-1]} ") + len(p)) for p in PHRASES])))
    labels = F.array_sort(F.array_distinct(F.concat("__found", F.transform("hits", lambda h: h["label"]))))
    return marked.select(
        "doc_id",
        F.greatest(_spaces(norm) - 1, F.lit(0)).cast("long").alias("n_words"),
        F.when(any_base, F.regexp_count(norm, F.lit(alternation))).otherwise(0).cast("long").alias("n_base"),
        F.when(any_base, _spaces(F.substr(norm, F.lit(1), start)) - 1).cast("long").alias("first_word"),
        F.when(any_base, _spaces(F.substr(norm, F.lit(1), F.length(norm) - end)) - 1).cast("long").alias("last_word"),
        F.array_join(F.array_sort("__found"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(any_base, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0))).alias("score"),
        "hits",
    )


def oracle_sql(table: str = "documents", threshold: float = THRESHOLD) -> str:
    """The same by brute force: every block against every template of its size."""
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    rows = ", ".join(f"('{t.label}', {t.words!r}, {t.names.split()!r}::VARCHAR[], {t.unit}, {_need(t, threshold)})" for t in TEMPLATES)
    spots = " UNION ALL ".join(
        f"SELECT n, '{label}' AS label, i FROM (SELECT n, w, unnest(range(1, len(w) + 1)) AS i FROM t) WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) for p, label in PHRASES.items()
    )
    blocks = " UNION ALL ".join(f"SELECT n, {u} AS u, list_distinct(w[k * {u} + 1 : (k + 2) * {u}]) AS b FROM (SELECT n, w, unnest(range(0, greatest(ceil(len(w) / {u})::BIGINT - 1, 1))) AS k FROM t)" for u in UNITS)
    return f"""
    WITH t AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{word}') AS w FROM {table}),
    spot AS ({spots}),
    base AS (SELECT n, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM spot GROUP BY n),
    template(label, ids, names, u, need) AS (VALUES {rows}),
    block AS ({blocks}),
    hit AS (SELECT n, label, len(list_intersect(b, ids)) / len(ids)::DOUBLE AS share FROM block JOIN template USING (u) WHERE list_has_all(b, names) AND len(list_intersect(b, ids)) >= need),
    every AS (SELECT DISTINCT n, label FROM (SELECT n, label FROM spot UNION ALL SELECT n, label FROM hit)),
    labels AS (SELECT n, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY n),
    best AS (SELECT n, max(share) AS share FROM hit GROUP BY n)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
      CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
    FROM t LEFT JOIN base USING (n) LEFT JOIN labels USING (n) LEFT JOIN best USING (n)"""
