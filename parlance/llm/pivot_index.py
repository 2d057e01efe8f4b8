"""Near-duplicate vectors by a pivot-permutation index.

1. Equal vectors are one *entry*, named by its least id. Reference points (*pivots*) are entries of a sample chosen by digest,
   no two within the threshold of each other; there are ``GROWTH`` for each root of the entries.
2. An entry is described by the ``m`` pivots nearest to it, in order. ``m`` is the least one at which vectors of the sample
   and made neighbours exactly at the threshold share two of them with a probability of ``AIM``.
3. Two entries of one length are candidates if they share two pivots at least: each pair of an entry's pivots names an inverted list. A list that is
   longer than ``LIST`` is dealt in parts, and its parts meet pair by pair.
4. In a list entries that may reach the threshold are linked, as a forest: entries of one tree are not
   compared again, so a list of copies costs its length. Entries are held there in 8 bits a number, with a bound of what that changes.
5. Within the components of the forests every pair is verified in double precision, block against block, which counts each
   entry's links whatever lists it was in. Components of the verified links are the classes.

A pair is lost only if no chain of lists joins its two ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.components import components
from parlance.llm.scratch import materialise, ship, tidied

THRESHOLD = 0.9
#: Pivots for each root of the number of entries, and the fewest.
GROWTH, FEWEST = 2.0, 256
AIM = 0.985
#: Shortest and longest description.
SHORTEST, LONGEST = 4, 16
LIST = 4096
UNIT = 2048


def units(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by their largest number first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors of a list column as rows of doubles, filled up or cut to ``width`` numbers."""
    at = np.asarray(column.offsets)
    flat, size = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(at)
    width = width or int(size.max(initial=1))
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    for i, (a, n) in enumerate(zip(at - at[0] if len(at) else at, size)):
        out[i, : min(n, width)] = flat[a : a + min(n, width)]
    return out


def chosen(sample: np.ndarray, most: int, threshold: float) -> np.ndarray:
    """The first ``most`` vectors of a sample of which no two reach the threshold."""
    out = sample[:0]
    for a in range(0, len(sample), 256):
        block = sample[a : a + 256]
        block = block[(block @ out.T < threshold).all(1)] if len(out) else block
        near = np.tril(block @ block.T >= threshold, -1)
        take = np.ones(len(block), bool)
        for i in range(1, len(block)):
            take[i] = not (near[i, :i] & take[:i]).any()
        out = np.concatenate((out, block[take]))[:most]
        if len(out) == most:
            break
    return out


def nearest(x: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """Places of the ``m`` nearest pivots of each row, nearest first."""
    s = -(x @ pivots.T)
    top = np.argpartition(s, m - 1, axis=1)[:, :m] if m < len(pivots) else np.tile(np.arange(len(pivots)), (len(x), 1))
    return np.take_along_axis(top, np.argsort(np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)


def length_of_description(sample: np.ndarray, pivots: np.ndarray, threshold: float) -> int:
    """Fewest nearest pivots at which vectors at the threshold share two with the probability aimed at."""
    x = sample[:512]
    rng = np.random.default_rng(7)
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    y = units(threshold * x + np.sqrt(1 - threshold**2) * away / np.maximum(np.sqrt((away * away).sum(1, keepdims=True)), 1e-300))
    longest = min(LONGEST, len(pivots))
    a, b = nearest(x, pivots, longest), nearest(y, pivots, longest)
    for m in range(min(SHORTEST, longest), longest):
        if ((a[:, :m, None] == b[:, None, :m]).sum((1, 2)) >= 2).mean() >= AIM:
            return m
    return longest


def _described(pivots, m: int):
    """(node, width, keys, q, scale, slack): the lists of each entry, and its direction in 8 bits with the length of what that leaves out."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = pivots.value
        pairs = np.array(list(combinations(range(m), 2))).T
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                v = part.column("v")
                size = np.diff(np.asarray(v.offsets))
                found = np.sort(nearest(units(matrix(v, points.shape[1])), points, m), axis=1).astype(np.int64)
                keys = found[:, pairs[0]] * len(points) + found[:, pairs[1]]
                x = units(matrix(v))
                scale = np.abs(x).max(1) / 127
                q = np.rint(x / scale[:, None])
                slack = np.sqrt(((x - q * scale[:, None]) ** 2).sum(1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel()))
                q = q.astype(np.int8)
                bytes_ = pa.array([q[i, : size[i]].tobytes() for i in range(len(q))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(size.astype(np.int32)), lists, bytes_, pa.array(scale.astype(np.float32)), pa.array(slack.astype(np.float32) * np.float32(1.001) + np.float32(1e-6))], ["node", "width", "keys", "q", "scale", "slack"])

    return run


def forest(n: int, close) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges (from, to) of a spanning forest of ``n`` rows, where ``close(step, rest)`` says which rows are linked.

    Rows that are found leave the rest, so each row is compared with those still apart when its turn comes.
    """
    rest = np.arange(n)
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            step, front = front[:256], front[256:]
            linked_ = close(step, rest)
            hit = linked_.any(0)
            if hit.any():
                yield step[linked_[:, hit].argmax(0)], rest[hit]
                front, rest = np.concatenate((front, rest[hit])), rest[~hit]


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of equal keys in batches sorted by them; a run goes on over the end of a batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(k).to_numpy() for k in keys], 1)
        cut = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]
        if last is not None and not (at[0] == last).all():
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cut[:-1], cut[1:]):
            held.append(batch.slice(a, b - a))
            if b < len(at):
                yield pa.Table.from_batches(held)
                held = []
        last = at[-1]
    if held:
        yield pa.Table.from_batches(held)


def _edges(threshold: float):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ("key", "width", "a", "b")):
            if t.num_rows < 2:
                continue
            node = t.column("node").to_numpy()
            x = np.frombuffer(b"".join(t.column("q").to_pylist()), np.int8).reshape(len(node), -1).astype(np.float32) * t.column("scale").to_numpy()[:, None]
            slack = t.column("slack").to_numpy()
            for u, v in forest(len(node), lambda i, j: x[i] @ x[j].T + slack[i][:, None] + slack[j][None] * (1 + slack[i][:, None]) >= threshold):  # noqa: B023
                yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v])], ["u", "v"])

    return run


def _verified(threshold: float):
    """(u, v, n) of a unit: the weight of a node's links there with v null, and a forest of the links with n = 0."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ("root", "a", "b")):
            side, node, copies = t.column("s").to_numpy(), t.column("node").to_numpy(), t.column("copies").to_numpy()
            raw = matrix(t.column("v").combine_chunks())
            x = units(raw)
            one, two = t.column("a")[0].as_py(), t.column("b")[0].as_py()
            i, j = np.flatnonzero(side == one), np.flatnonzero(side == two)
            s = x[i] @ x[j].T
            for a, b in np.argwhere(np.abs(s - threshold) < 1e-12):  # scaling and the order of a sum must not decide
                s[a, b] = cosine(raw[i[a]], raw[j[b]], s[a, b])
            link = s >= threshold
            if one == two:
                np.fill_diagonal(link, False)
            n = np.zeros(len(node), np.int64)
            n[i] += link @ copies[j]
            if one != two:
                n[j] += copies[i] @ link
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(n)], ["u", "v", "n"])
            whole = np.zeros((len(node), len(node)), bool)
            whole[np.ix_(i, j)] = link
            whole |= whole.T
            for u, v in forest(len(node), lambda i, j: whole[np.ix_(i, j)]):  # noqa: B023
                yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v]), pa.array(np.zeros(len(u), np.int64))], ["u", "v", "n"])

    return run


def cosine(a: np.ndarray, b: np.ndarray, scaled: float) -> float:
    """Cosine of two rows as they are, summed in order; ``scaled`` where their squares overflow or vanish."""
    ab = aa = bb = 0.0
    for x, y in zip(a.tolist(), b.tolist()):
        ab, aa, bb = ab + x * y, aa + x * x, bb + y * y
    norms = aa**0.5 * bb**0.5
    return ab / norms if 1e-280 < norms < 1e280 else scaled


def _dealt(n: Column, mine: Column) -> Column:
    """The units (a <= b) of part ``mine`` among ``n`` parts."""
    return F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.struct(F.least(mine, o).alias("a"), F.greatest(mine, o).alias("b"))))


def linked(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row: rows linked with it, the least id of its class, and whether that is its own.

    Vectors of which one is null, zero or holds a null or non-finite number link with nothing, nor do rows without an id, whose
    ``component_id`` is null and which are kept; vectors of different lengths link with nothing of each other. Equal vectors are links of each other, also under one id, then
    all rows of the id are kept. Ties at the threshold are links. An empty table gives no rows. Other columns are left out.
    """
    spark = table.sparkSession
    ship(spark)
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)) & F.col(id_col).isNotNull(), v).alias("v"))
    entries = materialise(rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "vectors")
    nothing = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    n = entries.count()
    if not n:
        return nothing
    pivots = max(FEWEST, int(np.ceil(GROWTH * np.sqrt(n))))
    few = entries.filter(F.pmod(F.xxhash64("v", F.lit(12)), F.lit(n)) < 4 * pivots).select("v").orderBy(F.xxhash64("v", F.lit(13)), "v").toArrow()  # some 4 * pivots rows
    if not few.num_rows:
        few = entries.select("v").limit(1).toArrow()
    sample = units(matrix(few.column("v").combine_chunks()))
    points = chosen(sample, pivots, threshold)
    m = length_of_description(sample, points, threshold)
    if len(points) == 1:  # one direction: all entries of a length are one list
        points, m = np.concatenate((points, -points)), 2
    seen = entries.mapInArrow(_described(spark.sparkContext.broadcast(points), m), "node long, width int, keys array<long>, q binary, scale float, slack float")
    seen = materialise(seen, "described")
    lists = seen.select("width", F.explode("keys").alias("key")).groupBy("key", "width").count().filter(F.col("count") > 1).select("key", "width", F.ceil(F.col("count") / LIST).cast("int").alias("ns"))
    dealt = seen.select("node", "width", F.explode("keys").alias("key"), "q", "scale", "slack").join(lists, ["key", "width"]).withColumn("s", F.pmod(F.xxhash64("node"), F.col("ns")).cast("int"))
    dealt = dealt.withColumn("unit", _dealt(F.col("ns"), F.col("s"))).select("key", "width", "unit.a", "unit.b", "node", "q", "scale", "slack")
    near = dealt.repartition("key", "width", "a", "b").sortWithinPartitions("key", "width", "a", "b").mapInArrow(_edges(threshold), "u long, v long")
    near = components(near)
    sizes = near.groupBy("root").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("ns"))
    members = entries.join(near, "node").join(sizes, "root").withColumn("s", F.pmod(F.xxhash64("node"), F.col("ns")).cast("int"))
    members = members.withColumn("unit", _dealt(F.col("ns"), F.col("s"))).select("root", "unit.a", "unit.b", "s", "node", "copies", "v")
    found = members.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b").mapInArrow(_verified(threshold), "u long, v long, n long")
    found = materialise(found, "links")
    links = found.filter("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    classes = components(found.filter("v IS NOT NULL").select("u", "v"))
    facts = entries.select("node", "copies", F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(5)).alias("h2")).join(links, "node", "left").join(classes, "node", "left")
    facts = facts.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    marked = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("h1"), F.when(F.col("v").isNotNull(), F.xxhash64("v", F.lit(5))).alias("h2"))
    out = marked.join(facts, ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def oracle_sql() -> str:
    """DuckDB SQL that compares all pairs."""
    fine = "len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
    return f"""
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id IS NOT NULL AND {fine} THEN CAST(embedding AS DOUBLE[]) END AS v FROM embeddings),
p AS (SELECT a.r AS x, b.r AS y FROM e a JOIN e b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
reach(r, y) AS (SELECT r, r FROM e UNION SELECT reach.r, p.y FROM reach JOIN p ON reach.y = p.x),
c AS (SELECT reach.r, min(m.vec_id) AS component_id FROM reach JOIN e m ON m.r = reach.y GROUP BY reach.r),
n AS (SELECT x AS r, count(*) AS n_links FROM p GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept FROM e JOIN c USING (r) LEFT JOIN n USING (r)"""
