"""URL verdicts: rules by host and path, then a ratio of two character language models.

The rules' own verdicts are the training labels: one smoothed variable-order Markov model is learned
of allowed and one of blocked URLs. A URL without a rule is judged by the difference of the models'
log-likelihoods per character against a cut that was calibrated on hosts kept out of the training.

Characters are folded into 41 classes and contexts hold up to three, so a model has at most
41 ** 4 cells however many URLs there are; counts are summed in the cluster before they are sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.scratch import ship
from parlance.llm.textbytes import flat, runs

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLASSES = 41
DEPTH = 3
#: Bins of the calibration histogram, over scores of -16 to 16 nats a character; scores beyond are in the outer ones.
BINS, SPAN = 16_000, 16.0

_CLASS = np.full(256, 40, np.uint8)  # 0: before the beginning
for _i, _c in enumerate(_LOWER):
    _CLASS[ord(_c)] = _CLASS[ord(_c.upper())] = 1 + _i
_CLASS[48:58] = 27
for _i, _c in enumerate("-./?=&_%#:+~"):
    _CLASS[ord(_c)] = 28 + _i


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-case host after the first ``://`` and the path up to ``?`` or ``#``; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; nulls if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = [((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)) for r in ordered]
    name = F.coalesce(*[F.when(f, F.lit(r.name)) for f, r in zip(fits, ordered)])
    return name, F.coalesce(*[F.when(f, F.lit(r.verdict)) for f, r in zip(fits, ordered)])


def _codes(column: pa.Array, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context and character codes, row of each, lengths) of rows i to j: base-41 numbers of 4 classes."""
    data, offsets = flat(column.slice(i, j - i))
    size = np.diff(offsets)
    row = np.repeat(np.arange(j - i), size)
    inner = np.arange(len(data)) - offsets[row]
    sym = _CLASS[data].astype(np.int64)
    code = sym.copy()
    for k in range(1, DEPTH + 1):
        before = np.zeros(len(sym), np.int64)
        before[k:] = sym[:-k] if len(sym) > k else 0
        code += np.where(inner >= k, before, 0) * CLASSES**k
    return code, row, size


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (label, code), summed over the task; at most 2 * 41 ** 4 cells."""
    total: dict[bool, np.ndarray] = {}
    for batch in batches:
        label = np.asarray(batch.column("allowed"))
        _, offsets = flat(batch.column("url"))
        for i, j in runs(offsets, 1 << 20):
            code, row, _ = _codes(batch.column("url"), i, j)
            for side in (False, True):
                mine = code[label[i:j][row] == side]
                if len(mine):
                    if side not in total:
                        total[side] = np.zeros(CLASSES ** (DEPTH + 1), np.int64)
                    values, counts = np.unique(mine, return_counts=True)
                    total[side][values] += counts
    for side, cells in total.items():
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), side)), pa.array(at.astype(np.int32)), pa.array(cells[at])], ["allowed", "code", "n"])


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """ln P(character | up to 3 before it), interpolated by Witten and Bell from the longest context seen."""
    full = counts.reshape((CLASSES,) * (DEPTH + 1)).astype(np.float64)
    p = np.full(CLASSES, 1 / CLASSES)
    for depth in range(DEPTH + 1):
        own = full.sum(axis=tuple(range(DEPTH - depth)))
        n, kinds = own.sum(-1, keepdims=True), (own > 0).sum(-1, keepdims=True)
        lower = np.broadcast_to(p, own.shape)
        p = np.where(n > 0, (own + kinds * lower) / np.maximum(n + kinds, 1), lower)
    return np.log(p).ravel()


def _score(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = flat(batch.column("url"))
            parts = []
            for i, j in runs(offsets, 1 << 20):
                code, row, size = _codes(batch.column("url"), i, j)
                parts.append(np.bincount(row, ratio[code], j - i) / np.maximum(size, 1))
            score = np.concatenate(parts) if parts else np.zeros(0)
            names = [n for n in batch.schema.names if n != "url"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(score)], [*names, "score"])

    return run


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each page: ``page_id, host, path, rule, verdict, score, cut``.

    ``score`` is the difference of log-likelihoods per byte, accepted less rejected; from ``cut`` up
    it means allow. Where the rules give no example of one of the sides, scores and the cut are 0
    and the method allows. Null and malformed URLs have empty host and path and are judged by the
    text there is; a URL of any length is read whole. Repeated rows give repeated results, an empty
    table an empty one, and other columns play no part. Of equal cuts the nearest to 0 is taken.
    """
    spark = pages.sparkSession
    ship(spark)
    host, path = host_and_path(F.col(url_col))
    base = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", name).withColumn("ruled", verdict)
    known = base.filter("ruled IS NOT NULL").select("url", (F.col("ruled") == "allow").alias("allowed"), (F.pmod(F.crc32(F.col("host").cast("binary")), F.lit(4)) == 3).alias("aside"))
    learned = known.filter(~F.col("aside")).select("url", "allowed").mapInArrow(_count, "allowed boolean, code int, n long").groupBy("allowed", "code").agg(F.sum("n").alias("n"))
    cells = np.zeros((2, CLASSES ** (DEPTH + 1)), np.int64)
    got = learned.toPandas()  # at most 2 * 41 ** 4 rows
    cells[got["allowed"].astype(int), got["code"]] = got["n"]
    ratio = np.zeros(CLASSES ** (DEPTH + 1), np.float32)
    if cells.sum(1).all():
        ratio = (log_probabilities(cells[1]) - log_probabilities(cells[0])).astype(np.float32)
    aside = known.filter("aside").select("url", "allowed").mapInArrow(_score(ratio), "allowed boolean, score double")
    bins = aside.groupBy("allowed", F.least(F.greatest(F.floor((F.col("score") + SPAN) / (2 * SPAN) * BINS), F.lit(0)), F.lit(BINS)).cast("int").alias("bin")).count().collect()  # at most 2 * (BINS + 1) rows
    hist = np.zeros((2, BINS + 2))
    for r in bins:
        hist[int(r["allowed"]), r["bin"]] += r["count"]
    cut = 0.0
    if hist.sum(1).all():
        below = np.cumsum(np.concatenate((np.zeros((2, 1)), hist), 1), 1)
        gain = below[0] / hist[0].sum() - below[1] / hist[1].sum()  # blocked below the edge less allowed below it
        best = np.flatnonzero(gain == gain.max())
        edge = best[np.argmin(np.abs(best - BINS / 2))]  # of equal cuts, the nearest to 0
        cut = float(edge / BINS * 2 * SPAN - SPAN)
    scored = base.mapInArrow(_score(ratio), f"page_id {pages.schema[id_col].dataType.simpleString()}, host string, path string, rule string, ruled string, score double")
    method = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "score", F.lit(cut).alias("cut"))
