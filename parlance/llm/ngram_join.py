"""Near-duplicate documents: Jaccard join of word five-grams with Bayesian candidate pruning.

1. Each text gives a digest of its words, MinHash bands and one byte of each MinHash value.
   Texts with the same words are one *class of copies* from here on.
2. Texts that share a band meet in a bucket. There their MinHash bytes are compared a part at a
   time; a pair goes when the posterior probability of reaching the threshold falls below the
   tolerance. In a bucket over ``SMALL`` texts each text is held against leaders only, at a threshold
   lowered by the triangle inequality of the Jaccard distance, so the work is linear in copies and
   no pair that reaches the threshold is parted. Buckets over ``PART`` texts are dealt in parts to
   several tasks, and the parts' leaders meet in a second round.
3. Survivors give components of candidates. In each component every pair that the sizes and the
   posterior allow is verified on the exact sets, which counts each text's links; components too
   large for a task are verified block against block in many.
4. Components of the verified links are the classes of near copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.components import components
from parlance.llm.scratch import held, materialise, ship, tidied
from parlance.llm.textbytes import flat, mix, runs, table, word_hashes, word_spans

BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
STEP = 32
SMALL = 256
LEADER = 0.9
UNIT = 2048
#: Buckets over this many texts are dealt in parts, whose leaders meet afterwards.
PART = 20_000

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[128:] = True
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _WORD_BYTE[_lo:_hi] = True


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, row of each, words of each row, two digests of each row's words).

    Words are runs of ASCII letters and digits and of bytes from 128. A row of 1 to n - 1 words has
    one shingle, all its words; an empty one has none.
    """
    start, end, row = word_spans(data, offsets, _WORD_BYTE)
    words = word_hashes(data, start, end)
    many = np.bincount(row, minlength=len(offsets) - 1)
    base = np.cumsum(many) - many
    place = np.arange(len(words)) - base[row]
    digests = np.zeros((len(many), 2), np.uint64)
    for k, odd in enumerate((0x9FB21C651E98DF25, 0xA0761D6478BD642F)):
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words ^ mix(place.astype(np.uint64) * np.uint64(odd) + np.uint64(odd))), out=sums[1:])
        digests[:, k] = mix(sums[base + many] - sums[base] + many.astype(np.uint64) * np.uint64(odd))
    left = many[row] - place
    short = many < n
    first = np.flatnonzero((left >= n) | (short[row] & (place == 0)))
    padded = np.concatenate((words, np.zeros(n, np.uint64)))
    out = np.zeros(len(first), np.uint64)
    for k in range(n):
        inside = left[first] > k
        out = mix(out * np.uint64(0xE7037ED1A0B428DB) + np.where(inside, padded[first + k], np.uint64(k + 1)))
    return out, row[first], many, digests


def signatures(shingles: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """HASHES MinHash values (uint32) for each row; rows without shingles get the largest value."""
    out = np.full((HASHES, rows), 0xFFFFFFFF, np.uint32)
    turn, odd = table(11, HASHES)[:, None], table(13, HASHES)[:, None]
    for a in range(0, len(shingles), 4096):
        part, at = shingles[a : a + 4096], row[a : a + 4096]
        head = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        values = (((part[None, :] ^ turn) * odd) >> np.uint64(32)).astype(np.uint32)
        out[:, at[head]] = np.minimum(out[:, at[head]], np.minimum.reduceat(values, head, axis=1))
    return out.T


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("ngram_join")
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for i, j in runs(offsets, 1 << 20):
                lo = offsets[i]
                shingles, row, many, digests = shingle_sets(data[lo : offsets[j]], offsets[i : j + 1] - lo, n)
                sig = signatures(shingles, row, j - i)
                bands = np.zeros((j - i, BANDS), np.uint64)
                for k in range(ROWS):
                    bands = mix(bands * np.uint64(0x8EBC6AF09C88C6E3) + sig[:, k::ROWS].astype(np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x100000001B3))
                order = np.lexsort((shingles, row))
                s, r = shingles[order], row[order]
                new = np.concatenate(([True], (s[1:] != s[:-1]) | (r[1:] != r[:-1]))) if len(s) else np.zeros(0, bool)
                sizes = np.bincount(r[new], minlength=j - i)
                low = ((sig * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i), batch.column("th").slice(i, j - i), pa.array(digests[:, 0].view(np.int64)), pa.array(digests[:, 1].view(np.int64)),
                        pa.array(many.astype(np.int64)), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(bands.ravel().view(np.int64))),
                        pa.array([x.tobytes() for x in low], pa.binary()),
                    ],
                    ["doc_id", "th", "d1", "d2", "n_words", "size", "bands", "sig"],
                )

    return run


# --- pruning -------------------------------------------------------------------------------------


@cache
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest of ``n`` equal MinHash bytes at which P(Jaccard >= threshold) reaches ``tolerance``.

    The prior of the match probability is uniform; two different values share a byte 1 time in 256.
    """
    p = threshold + (1 - threshold) / 256
    for m in range(n + 1):  # posterior Beta(m + 1, n - m + 1), its tail as a binomial sum
        if sum(comb(n + 1, k) * p**k * (1 - p) ** (n + 1 - k) for k in range(m + 1)) >= tolerance:
            return m
    return n


def survivors(sig: np.ndarray, one: np.ndarray, other: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which pairs of rows of ``sig`` stay, with the bytes compared STEP at a time."""
    alive = np.arange(len(one))
    matches = np.zeros(len(one), np.int32)
    for k in range(0, HASHES, STEP):
        matches[alive] += (sig[one[alive], k : k + STEP] == sig[other[alive], k : k + STEP]).sum(1, dtype=np.int32)
        alive = alive[matches[alive] >= least_matches(k + STEP, threshold, tolerance)]
    return alive


def _pairs_in(sig: np.ndarray, size: np.ndarray, threshold: float, low: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """All surviving pairs (row, row) of rows sorted by size, in blocks; ``low`` is the bound of sizes too."""
    got: list[tuple[np.ndarray, np.ndarray]] = []
    n = len(sig)
    for a in range(0, n, 512):
        one, other = np.meshgrid(np.arange(a, min(a + 512, n)), np.arange(a, n), indexing="ij")
        one, other = one.ravel(), other.ravel()
        fits = (one < other) & (size[one] >= low * size[other] - 1e-9)
        one, other = one[fits], other[fits]
        stay = survivors(sig, one, other, threshold, tolerance)
        got.append((one[stay], other[stay]))
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def _by_leaders(sig: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate links (leader, row) and the leaders.

    A row is held against leaders only and leads itself unless it is close to one. If a and b reach
    the threshold and a is close to its leader, b is within the threshold lowered by the distance of
    a: such links are kept, so a and b stay in one component.
    """
    rest, leaders = np.arange(len(sig)), []
    low = max(2 * threshold - 1, 0.05)
    got: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while len(rest):
        lead, rest = rest[0], rest[1:]
        leaders.append(lead)
        same = np.full(len(rest), lead)
        stay = survivors(sig, same, rest, low, tolerance)
        got.append((same[stay], rest[stay]))
        close = (sig[rest[stay]] == sig[lead]).sum(1) >= LEADER * HASHES
        rest = np.delete(rest, stay[close])
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]), np.array(leaders)


def _candidates(threshold: float, tolerance: float, final: bool):
    """Rows (b, part, d1, size, sig, split) sorted by bucket part, to links (u, v).

    Parts of split buckets also give their leaders, as (d1, d1, bucket). ``final`` is the round in
    which those meet: all pairs of a bucket's leaders, two blocks of them at a time, at a threshold lowered
    by both their distances.
    """

    def out(wait: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(wait).combine_chunks()
        if not t.num_rows:
            return
        b, part, d, size, split = (t[c].to_numpy() for c in ("b", "part", "d1", "size", "split"))
        data, _ = flat(t["sig"].chunk(0))
        sig = data.reshape(-1, HASHES)
        cut = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (part[1:] != part[:-1]), [True])))
        u: list[np.ndarray] = []
        v: list[np.ndarray] = []
        lead_d: list[np.ndarray] = []
        lead_b: list[np.ndarray] = []
        whole = cut[:-1][(np.diff(cut) == 2) & ~split[cut[:-1]]]  # most buckets: all at once
        if not final:
            fits = whole[np.minimum(size[whole], size[whole + 1]) >= threshold * np.maximum(size[whole], size[whole + 1]) - 1e-9]
            stay = fits[survivors(sig, fits, fits + 1, threshold, tolerance)]
            u.append(d[stay])
            v.append(d[stay + 1])
        far = max(3 * threshold - 2, 0.05)
        for i, j in zip(cut[:-1], cut[1:]):
            if final:
                one, other = _pairs_in(sig[i:j], size[i:j], far, far, tolerance)
            elif split[i]:
                one, other, leaders = _by_leaders(sig[i:j], threshold, tolerance)
                lead_d.append(d[i:j][leaders])
                lead_b.append(np.full(len(leaders), b[i]))
            elif j - i <= 2:
                continue
            elif j - i <= SMALL:
                one, other = _pairs_in(sig[i:j], size[i:j], threshold, threshold, tolerance)
            else:
                one, other, _ = _by_leaders(sig[i:j], threshold, tolerance)
            u.append(d[i:j][one])
            v.append(d[i:j][other])
        pairs = np.unique(np.stack((np.concatenate(u), np.concatenate(v))), axis=1) if u else np.zeros((2, 0), np.int64)
        # a forest of the links is enough
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        keep = []
        for x, y in zip(*pairs.tolist()):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                keep.append((x, y, None))
        for ds, bs in zip(lead_d, lead_b):
            keep += [(x, x, y) for x, y in zip(ds.tolist(), bs.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([k[c] for k in keep], pa.int64()) for c in range(3)], ["u", "v", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("ngram_join")
        wait: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:  # a bucket's part is held as a whole: some 150 bytes a text
            if not batch.num_rows:
                continue
            if wait and rows > 50_000:
                last = wait[-1].slice(wait[-1].num_rows - 1)
                same = (batch.column("b").to_numpy() == last.column("b")[0].as_py()) & (batch.column("part").to_numpy() == last.column("part")[0].as_py())
                edge = len(same) if same.all() else int(np.argmin(same))
                wait.append(batch.slice(0, edge))
                batch, rows = batch.slice(edge), rows + edge
                if not batch.num_rows:
                    continue
                yield from out(wait)
                wait, rows = [], 0
            wait.append(batch)
            rows += batch.num_rows
        if wait:
            yield from out(wait)

    return run


# --- verification --------------------------------------------------------------------------------


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("ngram_join")
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for i, j in runs(offsets, 1 << 20):
                lo = offsets[i]
                shingles, row, _, _ = shingle_sets(data[lo : offsets[j]], offsets[i : j + 1] - lo, n)
                cut = np.searchsorted(row, np.arange(j - i + 1))
                body = [np.unique(shingles[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in ("root", "d1", "d2", "sig")] + [pa.array(body, pa.binary())], ["root", "d1", "d2", "sig", "body"])

    return run


def _links(sets: list[np.ndarray], sig: np.ndarray, threshold: float, tolerance: float, left: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of sets with Jaccard >= threshold; with ``left``, only i < left <= j."""
    size = np.array([len(s) for s in sets])
    n = len(sets)
    got_a: list[np.ndarray] = []
    got_b: list[np.ndarray] = []
    every = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(every, kind="stable")
    fresh = np.concatenate(([True], every[order][1:] != every[order][:-1])) if len(every) else np.zeros(0, bool)
    token = np.empty(len(every), np.int64)
    token[order] = np.cumsum(fresh) - 1
    count = np.bincount(token)
    shared = count[token] > 1  # a shingle of one text only is in no overlap
    own, tok = owner[shared], token[shared]
    at = np.searchsorted(own, np.arange(n + 1))
    for a in range(0, n if left is None else left, 128):
        top = min(a + 128, n if left is None else left)
        one, other = np.meshgrid(np.arange(a, top), np.arange(a + 1 if left is None else left, n), indexing="ij")
        one, other = one.ravel(), other.ravel()
        fits = (one < other) & (np.minimum(size[one], size[other]) >= threshold * np.maximum(size[one], size[other]) - 1e-9)
        one, other = one[fits], other[fits]
        stay = survivors(sig, one, other, threshold, tolerance)
        one, other = one[stay], other[stay]
        if not len(one):
            continue
        names, inverse = np.unique(tok[at[a] : at[top]], return_inverse=True)
        have = np.zeros((top - a, len(names) + 1), np.float32)
        have[own[at[a] : at[top]] - a, inverse] = 1
        partners = np.unique(other)
        for p in range(0, len(partners), 128):
            some = partners[p : p + 128]
            theirs = np.zeros((len(some), len(names) + 1), np.float32)
            for k, x in enumerate(some.tolist()):
                mine = tok[at[x] : at[x + 1]]
                where = np.minimum(np.searchsorted(names, mine), max(len(names) - 1, 0))
                if len(names):
                    theirs[k, where[names[where] == mine]] = 1
            both = have @ theirs.T
            mask = (other >= some[0]) & (other <= some[-1])
            i, j = one[mask], other[mask]
            common = both[i - a, np.searchsorted(some, j)].astype(np.int64)
            good = common >= threshold * (size[i] + size[j] - common) - 1e-9
            got_a.append(i[good])
            got_b.append(j[good])
    return (np.concatenate(got_a), np.concatenate(got_b)) if got_a else (np.zeros(0, np.int64),) * 2


def _verify(threshold: float, tolerance: float):
    """Units of sorted rows (unit, side) to each text's links in the unit and its smallest partner by component."""

    def solve(rows: list[dict]) -> list[tuple[int, int, int, int]]:
        seen: dict[tuple, dict] = {}
        for r in rows:
            seen.setdefault((r["side"], r["d1"], r["d2"]), r)
        rows = sorted(seen.values(), key=lambda r: r["side"])
        left = sum(r["side"] == 0 for r in rows) if rows[-1]["side"] else None
        sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint8).reshape(-1, HASHES)
        i, j = _links([np.frombuffer(r["body"], np.uint64) for r in rows], sig, threshold, tolerance, left)
        n = len(rows)
        links = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
        root = np.arange(n)
        while True:  # least label over links, with pointer jumping
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            low = low[low]
            if (low == root).all():
                break
            root = low
        return [(r["d1"], r["d2"], int(links[k]), rows[root[k]]["d1"]) for k, r in enumerate(rows) if links[k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("ngram_join")
        wait: list[dict] = []

        def out() -> pa.RecordBatch:
            found = solve(wait)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(4)], ["d1", "d2", "n_links", "v"])

        for batch in batches:
            for r in batch.to_pylist():
                if wait and wait[-1]["unit"] != r["unit"]:
                    if len(wait) > 1:
                        yield out()
                    wait.clear()
                wait.append(r)
        if len(wait) > 1:
            yield out()

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-4) -> DataFrame:
    """One row for each document: ``doc_id, th, class_id, class_th, n_links, n_copies, n_words, text_id``.

    ``class_id`` is the least id of the documents that links join (its own, if none), ``n_links`` the
    number of different texts it is linked to at ``threshold``, ``n_copies`` the rows with the same
    words (itself included; case of letters and what stands between words don't count), ``text_id`` the least
    id of those. ``th`` is xxhash64 of the text, ``class_th`` that of the class's least document. Documents without words (null, empty) are alone.
    Documents under ``n`` words count as one shingle. Null ids stand after all others.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    raw = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(raw).alias("th"), F.lower(raw).alias("text"))
    sketch = materialise(keyed.mapInArrow(tidied(_sketch(n)), f"doc_id {kind}, th long, d1 long, d2 long, n_words long, size int, bands array<long>, sig binary"), "sketches")
    texts = sketch.filter("n_words > 0").groupBy("d1", "d2").agg(
        F.count("*").alias("n_copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sig").alias("sig")
    )
    texts = materialise(texts.select("d1", "d2", "n_copies", F.col("rep.doc_id").alias("text_id"), F.col("rep.th").alias("text_th"), "size", "bands", "sig"), "texts")
    buckets = texts.select(F.explode("bands").alias("b")).groupBy("b").agg(F.count("*").alias("n")).filter("n > 1")
    met = texts.select(F.explode("bands").alias("b"), "d1", "d2").join(materialise(buckets, "buckets"), "b")  # plain tables, so that Spark can split a hot bucket
    parts = F.ceil(F.col("n") / PART).cast("int")
    met = met.select("b", "d1", "d2", F.pmod(F.xxhash64("d1"), parts).cast("int").alias("part"), (parts > 1).alias("split"))
    asked = texts.select("d1", "d2", "size", "sig")

    def linked(rows: DataFrame, final: bool) -> DataFrame:
        dealt = rows.repartition("b", "part").sortWithinPartitions("b", "part", "size", "d1")
        return dealt.mapInArrow(tidied(_candidates(threshold, tolerance, final)), "u long, v long, b long")

    met = met.join(asked, ["d1", "d2"]).select("b", "part", "d1", "size", "sig", "split")
    found = materialise(linked(met, False), "candidates")
    edges = found.filter("b IS NULL").select("u", "v")
    leaders = found.filter("b IS NOT NULL")
    if leaders.limit(1).count():
        blocks = leaders.groupBy("b").agg(F.ceil(F.count("*") / PART).cast("int").alias("nb"))
        dealt = leaders.select("b", F.col("u").alias("d1")).join(blocks, "b").withColumn("blk", F.pmod(F.xxhash64("d1"), F.col("nb")).cast("int"))
        dealt = dealt.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))  # each two blocks meet in a task
        dealt = dealt.select("b", "d1", (F.least("blk", "to") * F.col("nb") + F.greatest("blk", "to")).alias("part"))
        again = dealt.join(asked.dropDuplicates(["d1"]), "d1").select("b", "part", "d1", "size", "sig", F.lit(False).alias("split"))
        edges = edges.unionByName(linked(again, True).select("u", "v"))
    group = components(edges)
    member = texts.join(group, texts["d1"] == group["node"]).select("root", "d1", "d2", "sig", "size", "text_id", "text_th")
    bodies = keyed.join(member, keyed["doc_id"].eqNullSafe(member["text_id"]) & (keyed["th"] == member["text_th"])).select("root", "d1", "d2", "sig", "text")
    sets = materialise(bodies.mapInArrow(tidied(_sets(n)), "root long, d1 long, d2 long, sig binary, body binary").dropDuplicates(["d1", "d2"]), "sets")
    blocks = sets.groupBy("root").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("nb"))
    dealt = sets.join(blocks, "root").withColumn("blk", F.pmod(F.xxhash64("d1"), F.col("nb")).cast("int"))
    one = dealt.filter("nb = 1").select(F.struct("root", F.lit(0).alias("x"), F.lit(0).alias("y")).alias("unit"), F.lit(0).alias("side"), "d1", "d2", "sig", "body")
    wide = dealt.filter("nb > 1").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    wide = wide.select(
        F.struct("root", F.least("blk", "to").alias("x"), F.greatest("blk", "to").alias("y")).alias("unit"), F.when(F.col("blk") > F.col("to"), 1).otherwise(0).alias("side"), "d1", "d2", "sig", "body"
    )
    units = one.unionByName(wide).withColumn("unit", F.concat_ws("/", F.col("unit.root").cast("string"), F.col("unit.x").cast("string"), F.col("unit.y").cast("string")))
    found = units.repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(tidied(_verify(threshold, tolerance)), "d1 long, d2 long, n_links long, v long")
    found = materialise(found, "links")
    total = found.groupBy("d1", "d2").agg(F.sum("n_links").alias("n_links"))
    root = components(found.select(F.col("d1").alias("u"), "v"))
    linked = texts.join(total, ["d1", "d2"]).join(root, F.col("d1") == F.col("node"))
    first = F.min(F.struct(F.col("text_id").isNull().alias("none"), "text_id", "text_th"))
    least = linked.groupBy("root").agg(first.alias("first")).select("root", F.col("first.text_id").alias("class_id"), F.col("first.text_th").alias("class_th"))
    per_text = texts.join(linked.join(least, "root").select("d1", "d2", "n_links", "class_id", "class_th"), ["d1", "d2"], "left")
    per_text = per_text.select("d1", "d2", F.coalesce("class_id", "text_id").alias("class_id"), F.coalesce("class_th", "text_th").alias("class_th"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies", "text_id")
    per_text = materialise(per_text, "classes")  # so that the copies of one text can be split among tasks in the join
    return (
        sketch.select("doc_id", "th", "d1", "d2", "n_words")
        .join(per_text, ["d1", "d2"], "left")
        .select("doc_id", "th", F.when(F.col("n_words") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("class_th", "th").alias("class_th"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), "n_words", F.coalesce("text_id", "doc_id").alias("text_id"))
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """One document of each class: the one with the class's least id, of several under it the one with the least hash of its text.

    Of repeated rows (same id, same text) the one whose columns have the least hash stays. All columns
    stay, under any names but ``__pl_th``, ``__pl_id``, ``__pl_th2``, ``__pl_gone`` and ``__pl_row``.
    """
    found = near_duplicates(docs, id_col, text_col, n, threshold)
    here = (F.col("doc_id").alias("__pl_id"), F.col("th").alias("__pl_th2"))
    gone = found.filter(~(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("th") == F.col("class_th")))).select(*here).distinct()
    again = found.groupBy("doc_id", "th").count().filter("count > 1").select(*here)
    marks = gone.withColumn("__pl_gone", F.lit(True)).unionByName(again.withColumn("__pl_gone", F.lit(False))).groupBy("__pl_id", "__pl_th2").agg(F.max("__pl_gone").alias("__pl_gone"))
    marks = materialise(marks, "marks")
    mine = docs.withColumn("__pl_th", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    joined = mine.join(marks, mine[id_col].eqNullSafe(marks["__pl_id"]) & (mine["__pl_th"] == marks["__pl_th2"]), "left").filter("__pl_gone IS NULL OR NOT __pl_gone")
    once = joined.filter("__pl_gone IS NULL").select(docs.columns)
    if not marks.filter("NOT __pl_gone").limit(1).count():
        return once
    hashed = F.xxhash64(*[c for c, t in docs.dtypes if "map<" not in t])  # maps have no hash
    least = F.min_by(F.struct(*docs.columns), hashed).alias("__pl_row")  # a partial aggregate, however often the row is there
    twice = joined.filter("NOT __pl_gone").groupBy(id_col, "__pl_th").agg(least).select("__pl_row.*")
    return once.unionByName(twice)


def oracle_sql(table: str = "documents", n: int = 5, threshold: float = 0.8) -> str:
    """The columns of the query by brute force in DuckDB: all texts that share a shingle, counted exactly; classes by walking the links."""
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    return f"""
    WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{word}') AS w FROM {table}),
    txt AS (SELECT w, min(doc_id) AS text_id, count(*) AS n_copies FROM t WHERE len(w) > 0 GROUP BY w),
    sh AS (SELECT DISTINCT text_id, unnest(CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i : i + {n - 1}], ' ')) END) AS s FROM txt),
    sz AS (SELECT text_id, count(*) AS n FROM sh GROUP BY text_id),
    common AS (SELECT a.text_id AS a, b.text_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.text_id < b.text_id GROUP BY ALL),
    link AS (SELECT a, b FROM common JOIN sz x ON x.text_id = a JOIN sz y ON y.text_id = b WHERE c >= {threshold} * (x.n + y.n - c) - 1e-9),
    pair AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    walk(a, r) AS (SELECT text_id, text_id FROM txt UNION SELECT pair.a, walk.r FROM walk JOIN pair ON pair.b = walk.a),
    root AS (SELECT a AS text_id, min(r) AS class_id FROM walk GROUP BY a),
    links AS (SELECT a AS text_id, count(*) AS n_links FROM pair GROUP BY a)
    SELECT doc_id, coalesce(class_id, doc_id)::BIGINT AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_copies, 1)::BIGINT AS n_copies, len(t.w)::BIGINT AS n_words, coalesce(text_id, doc_id)::BIGINT AS text_id
    FROM t LEFT JOIN txt ON t.w = txt.w AND len(t.w) > 0 LEFT JOIN root USING (text_id) LEFT JOIN links USING (text_id)"""
