"""Fill-in-the-middle: documents cut into prefix, middle and suffix, and put together in another order.

The work is DuckDB SQL over Arrow batches inside ``mapInArrow``: a slice of a batch is registered, one
statement tokenises (``regexp_extract_all``), cuts (``list_slice``, ``array_to_string``), rebuilds each text
from its output and digests both (``sha256``); the result goes back as Arrow. No row is touched by Python, and
nothing is shuffled: cuts depend on the row's key and text alone, so a lost task gives the same rows again.

A *unit* is a run of ASCII letters or one other code point. The sha256 of ``seed:doc_id`` gives four numbers:
the first two, modulo units + 1, are the cuts; the third decides whether a text stays plain, the fourth
whether the suffix goes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.scratch import tidied
from parlance.llm.textbytes import flat, runs

#: Fixed format: what marks the parts of an output.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of text in one statement; a longer text stands alone. Units take 16 bytes each while a slice is worked on.
SLICE = 4 << 20

_DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def statement(plain: int, spm: int, source: str = "docs", key: str = "key", text: str = "text", output: str = "") -> str:
    """The DuckDB statement over ``source`` (doc_id, ``key`` of the digest, ``text``)."""
    p, s, m = MARKS
    between = lambda a, b: f"substr(output, strpos(output, '{a}') + {len(a)}, strpos(output, '{b}') - strpos(output, '{a}') - {len(a)})"
    after = f"substr(output, strpos(output, '{m}') + {len(m)})"
    number = lambda k: f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)"
    return f"""
WITH units AS (SELECT doc_id, t, sha256({key}) AS h, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u FROM (SELECT *, coalesce({text}, '') AS t FROM {source})),
drawn AS (SELECT doc_id, t, u, len(u) AS n, {number(0)} % (len(u) + 1) AS a, {number(1)} % (len(u) + 1) AS b,
  CASE WHEN t = '' OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR {number(2)} % 100 >= {plain} THEN 'plain' WHEN {number(3)} % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM units),
cut AS (SELECT doc_id, t, n, form, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, 1, least(a, b)), '') END AS prefix,
  CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, least(a, b) + 1, greatest(a, b)), '') END AS middle,
  CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, greatest(a, b) + 1, n), '') END AS suffix FROM drawn),
made AS (SELECT doc_id, n, form, length(prefix) AS prefix_chars, length(middle) AS middle_chars,
  CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END AS output FROM cut),
back AS (SELECT *, CASE form WHEN 'plain' THEN output WHEN 'psm' THEN {between(p, s)} || {after} || {between(s, m)} ELSE {between(p, m)} || {after} || {between(s, p)} END AS restored FROM made)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(n AS BIGINT) AS n, form, CAST(prefix_chars AS BIGINT) AS prefix_chars, CAST(middle_chars AS BIGINT) AS middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256{output} FROM back"""


def _transform(sql: str, names: list[str]):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""}) as con:
            for batch in batches:
                for i, j in runs(flat(batch.column("text"))[1], SLICE):
                    con.register("docs", pa.Table.from_batches([batch.slice(i, j - i)]))
                    out = con.sql(sql).to_arrow_table()
                    con.unregister("docs")
                    yield from out.select(names).to_batches()

    return run


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20, carry_output: bool = True) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` and, if asked for, ``output``; one row for each row.

    ``form`` is ``plain`` (the text as it is: empty, holding a mark, or drawn), ``psm`` (``<P>prefix<S>suffix<M>middle``) or
    ``spm`` (``<S>suffix<P>prefix<M>middle``). ``n`` counts units; characters are code points, null for plain
    texts. ``restored_sha256`` is that of the text rebuilt from the output and the form alone. A null text
    counts as empty; a null id draws by ``seed:`` alone and stays null; rows with one id and different texts share
    their draws; repeated rows give equal rows; an empty table gives none. Other columns are left out. A very long text is
    one statement's work, at some 20 bytes for each of its units.
    """
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.col(text_col).alias("text"))
    kept = _DIGESTS + (", output string" if carry_output else "")
    return rows.mapInArrow(_transform(statement(plain_from, spm_below, output=", output" if carry_output else ""), [c.split()[0] for c in kept.split(", ")]), kept)


def oracle_sql() -> str:
    """DuckDB SQL of the query: lengths of parts by code point places found with a regular expression, not by lists of units."""
    p, s, m = MARKS
    number = lambda k: f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
c AS (SELECT *, length(regexp_replace(t, '[A-Za-z]+', 'a', 'g')) AS n FROM d),
k AS (SELECT *, least({number(0)} % (n + 1), {number(1)} % (n + 1)) AS a, greatest({number(0)} % (n + 1), {number(1)} % (n + 1)) AS b, t = '' OR t LIKE '%{p}%' OR t LIKE '%{s}%' OR t LIKE '%{m}%' OR {number(2)} % 100 >= 90 AS plain, {number(3)} % 100 < 20 AS turned FROM c),
u AS (SELECT doc_id, unnest(regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]')) AS w, generate_subscripts(regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]'), 1) AS i FROM d),
l AS (SELECT u.doc_id, coalesce(sum(length(w)) FILTER (i <= a), 0) AS x, coalesce(sum(length(w)) FILTER (i <= b), 0) AS y FROM u JOIN k USING (doc_id) GROUP BY u.doc_id),
r AS (SELECT k.*, CAST(coalesce(x, 0) AS BIGINT) AS x, CAST(coalesce(y, 0) AS BIGINT) AS y FROM k LEFT JOIN l USING (doc_id)),
o AS (SELECT *, CASE WHEN plain THEN t WHEN turned THEN '{s}' || substr(t, y + 1) || '{p}' || substr(t, 1, x) || '{m}' || substr(t, x + 1, y - x) ELSE '{p}' || substr(t, 1, x) || '{s}' || substr(t, y + 1) || '{m}' || substr(t, x + 1, y - x) END AS output FROM r)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN turned THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN CAST(x AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(y - x AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""
