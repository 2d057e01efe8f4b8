"""Approximate nearest neighbours by balanced posting lists.

* Centroids come of a sample that is halved at the median along the line between two means
  until parts hold ``PART`` vectors, so lists are balanced. The sample, and with it the number of centroids, grows
  with the table from ``SAMPLE`` to ``MOST`` vectors (a ``GROWTH``-th of it), which bounds what the driver holds.
* Every vector is in the list of its nearest centroid and, near a boundary, in up to ``COPIES`` lists
  whose centroids are within ``CLOSURE`` times that distance.
* Centroids are searched through a neighbour graph held in memory. A query reads the lists whose
  centroid is within a ratio of the nearest one's distance. The ratio is the one that finds
  ``AIM`` of the sample's own neighbours.
* Equal vectors are one entry with their k + 1 least ids, which is all an answer can use; lists
  longer than ``LIST`` are dealt in parts, and so are the queries of a list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.scratch import materialise, ship

SAMPLE, MOST, GROWTH = 16_384, 65_536, 64
PART = 64
COPIES = 8
CLOSURE = 1.08
AIM = 0.985
DEGREE = 24
LIST = 4096
QUERIES = 4096


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0))


def halved(sample: np.ndarray, part: int) -> np.ndarray:
    """Means of balanced parts of at most ``part`` vectors."""
    todo, out = [np.arange(len(sample))], []
    while todo:
        at = todo.pop()
        x = sample[at]
        if len(at) <= part:
            out.append(x.mean(0))
            continue
        one, other = x[0], x[len(x) // 2]
        for _ in range(6):
            side = ((x - one) ** 2).sum(1) <= ((x - other) ** 2).sum(1)
            if side.all() or not side.any():
                break
            one, other = x[side].mean(0), x[~side].mean(0)
        order = np.argsort(x @ (other - one), kind="stable")
        todo += [at[order[: len(order) // 2]], at[order[len(order) // 2 :]]]
    return np.array(out)


@dataclass
class Index:
    centroids: np.ndarray
    near: np.ndarray
    entries: np.ndarray
    ratio: float = 1.0

    @classmethod
    def build(cls, sample: np.ndarray, part: int = PART, neighbours: int = 10) -> Index:
        """Centroids, their graph and the query ratio, of a sample."""
        centroids = halved(sample, part)
        n = len(centroids)
        degree = min(DEGREE, max(n - 1, 0))
        near = np.zeros((n, degree + 2), np.int32)
        for a in range(0, n, 512):
            d = _distances(centroids[a : a + 512], centroids)
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            near[a : a + 512, :degree] = np.argsort(d, axis=1, kind="stable")[:, :degree]
        near[:, degree], near[:, degree + 1] = (np.arange(n) + 1) % n, (np.arange(n) - 1) % n  # a ring keeps it connected
        index = cls(centroids, near, np.unique(np.linspace(0, n - 1, min(n, 64)).astype(int)))
        sample = sample[:SAMPLE]
        asked = sample[:: max(1, len(sample) // 256)][:256]
        lists = index.search(sample, CLOSURE, COPIES)
        d = _distances(asked, sample)
        to = _distances(asked, centroids)
        k = min(neighbours + 1, len(sample))
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        need = [min(to[i, c] for c in lists[j]) / max(to[i].min(), 1e-12) for i in range(len(asked)) for j in best[i] if d[i, j] > 0]
        index.ratio = float(np.quantile(need, AIM)) * 1.001 if need else 1.0
        return index

    def search(self, vectors: np.ndarray, ratio: float, most: int | None = None, beam: int = 16, wide: int = 4) -> list[np.ndarray]:
        """Lists within ``ratio`` times the distance of the nearest found centroid, nearest first.

        All vectors walk the graph together: each expands its best open nodes until none is within
        the ratio or among its ``beam`` nearest.
        """
        out: list[np.ndarray] = []
        n = len(self.centroids)
        beam = min(beam, n)
        for a in range(0, len(vectors), 256):
            x = vectors[a : a + 256]
            d = np.full((len(x), n), np.inf)
            d[:, self.entries] = _distances(x, self.centroids[self.entries])
            closed = np.zeros((len(x), n), bool)
            rows = np.arange(len(x))
            while len(rows):
                mine = d[rows]
                limit = np.maximum(mine.min(1) * ratio, np.partition(mine, beam - 1, axis=1)[:, beam - 1])
                open_ = np.where(closed[rows] | (mine > limit[:, None]), np.inf, mine)
                pick = np.argpartition(open_, min(wide, n - 1), axis=1)[:, :wide] if n > wide else np.tile(np.arange(n), (len(rows), 1))
                live = np.isfinite(np.take_along_axis(open_, pick, 1))
                r, c = rows[np.nonzero(live)[0]], pick[live]
                closed[r, c] = True
                rr, cc = np.repeat(r, self.near.shape[1]), self.near[c].ravel()
                fresh = np.isinf(d[rr, cc])
                rr, cc = rr[fresh], cc[fresh]
                d[rr, cc] = np.sqrt(((x[rr] - self.centroids[cc]) ** 2).sum(1))
                rows = rows[live.any(1)]
            for row in d:
                at = np.flatnonzero(row <= row.min() * ratio + 1e-12)
                at = at[np.argsort(row[at], kind="stable")]
                out.append(at[:most] if most else at)
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def _deal(index, queries: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                lists = found.search(_matrix(part.column("v")), found.ratio if queries else CLOSURE, None if queries else COPIES)
                at = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists).astype(np.int32)), *[c.take(at) for c in part.columns]], ["list", *part.schema.names])

    return run


def _best(k: int):
    def run(key: tuple, entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(entries) or not len(asked):
            return pd.DataFrame({"qid": [], "qh": [], "vh": [], "d": [], "ids": []}).astype({"qid": "int64", "qh": "int64", "vh": "int64", "d": "float64"})
        x = np.stack(entries["v"].to_numpy()).astype(np.float64)
        q = np.stack(asked["v"].to_numpy()).astype(np.float64)
        norms = (q * q).sum(1)[:, None] + (x * x).sum(1)[None]
        rough = norms - 2 * (q @ x.T)
        m = min(len(x), k + 8)
        top = np.argpartition(rough, m - 1, axis=1)
        limit = np.take_along_axis(rough, top[:, m - 1 : m], 1) + 1e-12 * norms.max(1, keepdims=True)  # what ties with the last one within rounding stays
        out = []
        for i in range(len(q)):
            at = np.flatnonzero(rough[i] <= limit[i])
            d = np.sqrt(((x[at] - q[i]) ** 2).sum(1))
            order = sorted(range(len(at)), key=lambda j: (d[j], entries["ids"].iat[at[j]][0]))[: k + 1]
            out += [(asked["qid"].iat[i], asked["qh"].iat[i], entries["vh"].iat[at[j]], d[j], entries["ids"].iat[at[j]]) for j in order]
        return pd.DataFrame(out, columns=["qid", "qh", "vh", "d", "ids"])

    return run


def neighbours(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """The ``k`` nearest rows to each row whose id is divisible by ``every``: ``query_id, rank, vec_id, score``.

    ``score`` is the Euclidean distance in double precision; ties go to the smaller id. A query's own
    row is no candidate, its copies are. Rows with a null id or vector, a null or non-finite
    component, only zeros, or another length than most take no part. Fewer candidates than ``k`` give fewer
    rows; an empty table gives none.
    """
    spark = table.sparkSession
    ship(spark)
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col(id_col).alias("vec_id"), v.cast("array<double>").alias("v")).filter(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return empty
    rows = rows.filter(F.size("v") == sizes["n"])
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    entries = rows.withColumn("r", rank).filter(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = materialise(entries.withColumn("vh", F.xxhash64("v")), "entries")
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    asked = queries.groupBy("v").agg(F.min("vec_id").alias("qid")).withColumn("qh", F.xxhash64("v"))
    most = min(max(SAMPLE, sizes["count"] // GROWTH), MOST)
    sample = entries.select("v", F.xxhash64("v", F.lit(7)).alias("o")).orderBy("o").limit(most).select("v").toPandas()
    index = spark.sparkContext.broadcast(Index.build(np.stack(sample["v"].to_numpy()), neighbours=k))
    held = materialise(entries.mapInArrow(_deal(index, False), "list int, v array<double>, ids array<long>, vh long"), "lists")
    probes = materialise(asked.mapInArrow(_deal(index, True), "list int, v array<double>, qid long, qh long"), "probes")
    dealt = held.groupBy("list").agg(F.ceil(F.count("*") / LIST).cast("int").alias("ns")).join(probes.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("nq")), "list")
    dealt = F.broadcast(dealt)  # one row for each list, at most 2 * MOST / PART
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = held.join(dealt, "list").withColumn("s", F.pmod("vh", F.col("ns")).cast("int")).withColumn("q", upto("nq"))
    right = probes.join(dealt, "list").withColumn("q", F.pmod("qh", F.col("nq")).cast("int")).withColumn("s", upto("ns"))
    keys = ["list", "s", "q"]
    met = left.select(*keys, "v", "ids", "vh").groupBy(*keys).cogroup(right.select(*keys, "v", "qid", "qh").groupBy(*keys))
    best = met.applyInPandas(_best(k), "qid long, qh long, vh long, d double, ids array<long>").dropDuplicates(["qid", "qh", "vh"])
    per = Window.partitionBy("qid", "qh")
    few = best.withColumn("r", F.row_number().over(per.orderBy("d", F.element_at("ids", 1)))).filter(F.col("r") <= k + 1)
    flat_ = few.select("qid", "qh", "d", F.explode("ids").alias("id")).withColumn("r", F.row_number().over(per.orderBy("d", "id"))).filter(F.col("r") <= k + 1)
    answers = flat_.groupBy("qid", "qh").agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("top"))
    named = queries.join(asked, "v").select("vec_id", "qid", "qh").join(answers, ["qid", "qh"])
    own = F.array_position(F.transform("top", lambda x: (x["id"] == F.col("vec_id")) & (x["d"] == 0)), True)
    others = F.filter("top", lambda x, i: (F.col("own") == 0) | (i + 1 != F.col("own")))
    out = named.withColumn("own", own).select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.d").alias("score"))
