"""Language identification by prediction by partial matching over bytes.

For each language a tree of byte contexts up to ``DEPTH`` long is learned with the counts frozen.
The code length of a text is exact: a byte unseen in its context escapes to the next shorter one
(escape method C, with the bytes of longer contexts excluded), down to equal odds for all bytes. The
language with the shortest code wins.

Statistics come from a bounded sample: whole texts, chosen by a hash of their content so that a language
gives about ``SAMPLE`` texts whatever its share, and no more than about ``SAMPLE_BYTES`` bytes where they are long. The contexts kept are, for each language, the ``NODES`` most
frequent of its sample; others are coded from the longest kept suffix. Every text is scored whole, under
every label there is. Tables hold ``GROUP`` languages each, and a task has one table in memory at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.scratch import materialise, ship
from parlance.llm.textbytes import flat, runs

DEPTH = 3
SAMPLE, SAMPLE_BYTES = 1500, 16 << 20
NODES = 12_000
GROUP = 4
#: Contexts under this count in the sample have no node of their own.
LEAST = 8


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, four bytes) of a task; three zero bytes stand before each text."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(lang: int, values: np.ndarray, counts: np.ndarray) -> None:
        if lang in held:
            values, at = np.unique(np.concatenate((held[lang][0], values)), return_inverse=True)
            counts = np.bincount(at, np.concatenate((held[lang][1], counts))).astype(np.int64)
        held[lang] = (values, counts)

    for batch in batches:
        lang = np.asarray(batch.column("lang_no"))
        _, offsets = flat(batch.column("text"))
        for i, j in runs(offsets, 2 << 20):
            code, row, _ = _codes(batch.column("text").slice(i, j - i))
            for k in np.unique(lang[i:j]):
                values, counts = np.unique(code[lang[i:j][row] == k], return_counts=True)
                if len(values):
                    add(int(k), values, counts)
    for k, (values, counts) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array(values.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang_no", "gram", "n"])


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last four bytes at each place as one number, row, offsets)."""
    data, offsets = flat(column)
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    inner = np.arange(len(data)) - offsets[row]
    code = data.astype(np.uint32)
    for k in range(1, DEPTH + 1):
        before = np.zeros(len(data), np.uint32)
        before[k:] = data[:-k]
        code |= np.where(inner >= k, before, 0).astype(np.uint32) << np.uint32(8 * k)
    return code, row, offsets


class ByteTrees:
    """Frozen context trees of all languages, as one table of code lengths."""

    def __init__(self, lang: np.ndarray, gram: np.ndarray, n: np.ndarray, names: list[str], nodes: int = NODES):
        self.names = names
        count = len(names)
        used = np.unique(np.concatenate((gram & 255, (gram >> 8) & 255, [0]))) if len(gram) else np.array([0])
        self.symbol = np.full(256, len(used), np.int32)  # bytes never seen share one symbol
        self.symbol[used] = np.arange(len(used))
        s = self.size = len(used) + 1
        sym = lambda k: self.symbol[(gram >> (8 * k)) & 255].astype(np.int64)
        last = sym(0)
        contexts = [np.zeros(len(gram), np.int64)]  # by length, the nearest byte lowest
        for k in range(1, DEPTH + 1):
            contexts.append(contexts[-1] + sym(k) * s ** (k - 1))
        self.node = np.zeros(s**DEPTH, np.int32)  # of the three bytes before: the longest kept context
        keep: list[tuple[int, int]] = [(0, 0)]
        chosen: set[tuple[int, int]] = set()
        for c in range(count):
            ranked, own = [], lang == c
            for k in range(1, DEPTH + 1):
                values, at = np.unique(contexts[k][own], return_inverse=True)
                total = np.bincount(at, n[own]) if len(values) else np.zeros(0)
                ranked += [(-int(t), k, int(v)) for v, t in zip(values, total) if t >= LEAST]
            ranked.sort()
            chosen |= {(k, v) for _, k, v in ranked[: nodes - 1]}
        keep += sorted(x for x in chosen if x[0] == 1 or (x[0] - 1, x[1] % s ** (x[0] - 1)) in chosen)
        number = {x: i for i, x in enumerate(keep)}
        parent = np.zeros(len(keep), np.int64)
        for k in range(1, DEPTH + 1):
            mine = [(v, i) for (d, v), i in number.items() if d == k]
            for v, i in mine:
                parent[i] = number.get((k - 1, v % s ** (k - 1)), 0)
            if mine:
                grid = self.node.reshape(-1, s**k)
                grid[:, [v for v, _ in mine]] = [i for _, i in mine]
        depth = np.array([d for d, _ in keep])
        places: list[tuple[np.ndarray, np.ndarray]] = []  # by context length: grams whose context is kept, and its node
        for k in range(DEPTH + 1):
            values = np.array([v for d, v in keep if d == k], np.int64)
            ids = np.array([number[k, v] for v in values.tolist()], np.int64)
            if not len(values):
                continue
            order = np.argsort(values)
            at = np.minimum(np.searchsorted(values[order], contexts[k]), len(values) - 1)
            hit = np.flatnonzero(values[order][at] == contexts[k])
            places.append((hit, ids[order][at[hit]]))
        bits = np.zeros((len(keep), s, count), np.float32)
        for c in range(count):  # one language's counts at a time
            counts = np.zeros((len(keep), s), np.float32)
            for hit, node in places:
                own = lang[hit] == c
                np.add.at(counts, (node[own], last[hit[own]]), n[hit[own]])
            for lo in range(0, len(keep), 2048):
                rows = np.arange(lo, min(lo + 2048, len(keep)))
                bits[rows, :, c] = self._lengths(counts, parent, depth, rows)
        self.bits = bits

    def _lengths(self, counts: np.ndarray, parent: np.ndarray, depth: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """-log2 of each symbol's probability in the contexts ``rows``."""
        out = np.zeros((len(rows), self.size))
        gone = np.zeros((len(rows), self.size), bool)
        left = np.zeros(len(rows))  # bits spent on escapes
        at = rows.copy()
        for _ in range(DEPTH + 1):
            own = np.where(gone, 0, counts[at])
            total, kinds = own.sum(1), (own > 0).sum(1)
            here = (own > 0) & (total > 0)[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                cost = left[:, None] - np.log2(own / (total + kinds)[:, None])
                out = np.where(here & ~gone, cost, out)
                left = np.where(total > 0, left - np.log2(kinds / (total + kinds)), left)
            gone |= here
            top = depth[at] == 0
            at = np.where(top, at, parent[at])
            if top.all():
                break
        rest = 256 - gone.sum(1, keepdims=True)  # bytes without a symbol of their own are among them
        return np.where(gone, out, left[:, None] + np.log2(np.maximum(rest, 1)))

    def lengths(self, column: pa.Array) -> np.ndarray:
        """Code length in bits of each text under each language."""
        out = np.zeros((len(column), len(self.names)))
        _, offsets = flat(column)
        s = self.size
        for i, j in runs(offsets, 1 << 18):
            data, off = flat(column.slice(i, j - i))
            if not len(data):
                continue
            sym = self.symbol[data]
            row = np.repeat(np.arange(j - i), np.diff(off))
            inner = np.arange(len(data)) - off[row]
            start = self.symbol[0]
            ctx = np.zeros(len(data), np.int64)
            for k in range(1, DEPTH + 1):
                before = np.full(len(data), start, np.int64)
                before[k:] = sym[:-k]
                before[inner < k] = start
                ctx += before * s ** (k - 1)
            cost = self.bits[self.node[ctx], sym]
            full = np.flatnonzero(np.diff(off))
            out[i + full] = np.add.reduceat(cost, off[:-1][full], axis=0, dtype=np.float64)
        return out


def _label(groups):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.asarray(batch.column("letters"))
            names = np.full(batch.num_rows, "und", object)
            least, mass = np.full(batch.num_rows, np.inf), np.zeros(batch.num_rows)
            for trees in groups:
                model = trees.value
                if model.names and batch.num_rows:
                    bits = model.lengths(batch.column("text"))
                    now = np.minimum(least, bits.min(1))
                    mass = mass * np.exp2(now - least) + np.exp2(now[:, None] - bits).sum(1)
                    names = np.where(now < least, np.array(model.names, object)[bits.argmin(1)], names)
                    least = now
                if len(groups) > 1:  # the next use reads it from disk again
                    del model
                    trees.__dict__.pop("_value", None)
            scores = np.where(known & (mass > 0), 1 / np.maximum(mass, 1), 0.0)
            names = np.where(known, names, "und")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def learned(labelled: DataFrame, sample: int = SAMPLE, nodes: int = NODES, group: int | None = GROUP) -> Iterator[ByteTrees]:
    """Trees of all languages in ``labelled`` (text, lang; lang not null), ``group`` languages a table, in the order of names."""
    spark = labelled.sparkSession
    found = labelled.filter(F.length("text") > 0).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()  # one row for each label
    sizes = {r["lang"]: max(r["n"] / sample, r["b"] / SAMPLE_BYTES, 1.0) for r in found}
    names = sorted(sizes)
    if not names:
        none = np.zeros(0, np.int64)
        yield ByteTrees(none, none, none, [])
        return
    share = spark.createDataFrame([(name, i, 1 / sizes[name]) for i, name in enumerate(names)], "lang string, lang_no int, share double")
    drawn = labelled.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    grams = drawn.select("text", "lang_no").mapInArrow(_grams, "lang_no int, gram long, n long").groupBy("lang_no", "gram").agg(F.sum("n").alias("n"))
    group = group or len(names)
    if len(names) > group:
        grams = materialise(grams, "grams")
    for lo in range(0, len(names), group):
        got = grams.filter(F.col("lang_no").between(lo, lo + group - 1)).toPandas()  # of the bounded sample
        yield ByteTrees(got["lang_no"].to_numpy() - lo, got["gram"].to_numpy(), got["n"].to_numpy(), names[lo : lo + group], nodes)


def learn(labelled: DataFrame, sample: int = SAMPLE, nodes: int = NODES) -> ByteTrees:
    """Trees of all languages in ``labelled`` as one table."""
    return next(learned(labelled, sample, nodes, None))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each document: ``doc_id, held_out, lang_pred, score``.

    Documents whose crc32 of the id as text leaves 2 modulo 4 are held out: nothing is learned of
    them. A null id is not held out. ``und`` with score 0 means no letters (or nothing to learn
    from); ``score`` is the posterior of the winner at equal priors. Ties go to the first name.
    """
    spark = docs.sparkSession
    ship(spark)
    out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"), out.alias("held_out"))
    trees = [spark.sparkContext.broadcast(t) for t in learned(base.filter("NOT held_out AND lang IS NOT NULL").select("text", "lang"))]
    asked = base.select("doc_id", "held_out", "text", F.col("text").rlike("\\p{L}").alias("letters"))
    return asked.mapInArrow(_label(trees), f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
