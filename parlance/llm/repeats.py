"""Repeated byte strings across documents, by enhanced suffix arrays over synchronised blocks.

Every ``min_len``-byte window picks an anchor: the leftmost smallest hash of the ``K``-byte grams
in it. Equal windows pick equal anchors at equal places, so windows that repeat always meet under
one anchor hash. Consecutive windows of one anchor form a *span*. The steps:

1. Each document gives one small row for each span (key, place, anchor hash, content hash). Those whose
   anchor is nowhere else repeat nowhere and go.
2. Spans are counted by anchor and content, the copies of one content summed before they are sent. A
   content that is there twice repeats as a whole. An anchor with several contents, some there once, is
   contested.
3. One text of each contested content goes to a block; the block builds a suffix array with LCP values
   and a stack scan finds the common-prefix intervals of at least ``min_len`` bytes. Intervals whose
   occurrences have different bytes to the left (or reach a span's border) are maximal repeat
   groups; each covers all of its occurrences, not only neighbours.
4. A document's covered ranges are joined back to it. :func:`groups` instead joins the intervals of
   neighbouring spans with the same occurrences into groups of any length, with all their occurrences.

No step brings the copies of a text together as text: copies meet as hashes, and one of them is
compared. No key has to fit in a task: counts are partial sums, joins on anchors and contents are
between tables that Spark can split at a hot key, and a task's suffix array holds at most ``WIDE``
contents of an anchor. Spans of anchors with more are cut into parts by where the anchor stands in the
window, and a part is dealt by the hash of the bytes that all its windows share, which parts the unlike
ones; parts that more than ``WIDE`` still share are compared place by place in the same memory. The windows of
anchors with over ``HUGE`` contents are counted by digest in a grouped aggregate. All find the same repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.components import components
from parlance.llm.scratch import held, materialise, release, ship, tidied, written
from parlance.llm.textbytes import flat, mix, runs, table

K = 32
CHUNK = 1 << 19
BLOCK = 1 << 20
#: A row over LARGE bytes is cut into parts of STEP.
LARGE = 8 << 20
STEP = 4 << 20
#: Contents of one anchor that a suffix array may hold.
WIDE = 1_000
#: Contents of one anchor up to which its spans are cut in PARTS parts; beyond, windows are counted.
HUGE = 200_000
PARTS = 8
_B = 0x9E3779B97F4A7C15
_INV = pow(_B, -1, 1 << 64)


# --- step 1: spans -------------------------------------------------------------------------------


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each place (the last K - 1 places are missing)."""
    h = table(3)[data]
    for step in (1, 2, 4, 8, 16):
        h = h[:-step] * np.uint64(0xD6E8FEB86659FD93 + 2 * step) + h[step:]
    return mix(h)


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` values from each place."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n, modulo 2 ** 64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def spans_of(data: np.ndarray, offsets: np.ndarray, min_len: int) -> tuple[np.ndarray, ...]:
    """(row, start in row, windows, anchor hash, content hash) of all spans of the rows.

    ``data`` is at most 16 MB here; places are kept in 24 bits beside 40 bits of the gram's hash.
    """
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    long = np.flatnonzero(np.diff(offsets) >= min_len)
    if not len(long):
        return none
    grams = _gram_hashes(data)
    key = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_window_min(key, min_len - K + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    many = offsets[long + 1] - offsets[long] - min_len + 1
    ends = np.cumsum(many)
    place = np.arange(ends[-1]) + np.repeat(offsets[long] - (ends - many), many)
    chosen = anchor[place]
    first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    count = np.diff(np.concatenate((first, [len(chosen)])))
    start, at = place[first], chosen[first]
    row = np.searchsorted(offsets, start, "right") - 1
    power = _powers(_B, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table(5)[data] * power[:-1], out=sums[1:])
    back = _powers(_INV, len(data))
    end = start + count + min_len - 1
    content = mix((sums[end] - sums[start]) * back[start] + mix(count.astype(np.uint64) * np.uint64(4096) + (at - start).astype(np.uint64)))
    return row, start - offsets[row], count, grams[at], content


def _pieces(data: np.ndarray, offsets: np.ndarray, min_len: int) -> Iterator[tuple[np.ndarray, ...]]:
    """spans_of over chunks; a row over LARGE is cut where spans of the parts agree with the whole.

    Parts overlap by min_len - 1 bytes, so each window is in one part, and a window's anchor depends
    on its own bytes only. A span may be cut in two there, which step 2 treats as two spans.
    """
    for i, j in runs(offsets, CHUNK):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= LARGE:
            row, *rest = spans_of(data[lo:hi], offsets[i : j + 1] - lo, min_len)
            yield row + i, *rest
            continue
        for a in range(lo, hi, STEP):
            b = min(hi, a + STEP + min_len - 1)
            if b - a >= min_len:
                row, start, *rest = spans_of(data[a:b], np.array([0, b - a]), min_len)
                yield row + i, start + (a - lo), *rest


_SPAN_SCHEMA = "doc_id {id}, th long, s int, n int, m int, ahash long, shash long"


def _folded(row: np.ndarray, start: np.ndarray, count: np.ndarray, anchor: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal spans that follow each other in a row as one, with all their windows as a further column.

    Periodic text gives a span for each period; folded, it is as few rows as other text.
    """
    if not len(row):
        return row, start, count, count, anchor, content
    again = (row[1:] == row[:-1]) & (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1]) & (start[1:] == start[:-1] + count[:-1])
    head = np.flatnonzero(np.concatenate(([True], ~again)))
    return row[head], start[head], count[head], np.add.reduceat(count, head), anchor[head], content[head]


def _emit_spans(min_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("repeats")
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for piece in _pieces(data, offsets, min_len):
                row, start, count, windows, anchor, content = _folded(*piece)
                keys = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(keys), batch.column("th").take(keys), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))],
                    ["doc_id", "th", "s", "n", "m", "ahash", "shash"],
                )

    return run


# --- step 3: suffix arrays -----------------------------------------------------------------------


def _ranks(symbols: np.ndarray, top: int) -> dict[int, np.ndarray]:
    """Ranks of the 4, 8, ... ``top`` symbols (uint16) from each place."""
    n = len(symbols)
    w = np.concatenate((symbols, np.zeros(3, np.uint16))).astype(np.uint64)
    for step in (1, 2):
        w = (w[:-step] << np.uint64(16 * step)) | w[step:]
    out = {4: np.unique(w, return_inverse=True)[1].astype(np.int32)}
    size = 4
    while size < top:
        r = np.concatenate((out[size], np.zeros(size, np.int32))).astype(np.int64)
        out[2 * size] = np.unique((r[:n] << 32) | r[size : size + n], return_inverse=True)[1].astype(np.int32)
        size *= 2
    return out


def suffix_array(symbols: np.ndarray, starts: np.ndarray, room: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` and the common prefix of each with its predecessor.

    Symbols are bytes plus 1, spans are followed by a 0, so a suffix that ends sorts before those
    that go on. ``depth`` symbols are compared, as many as the longest span has. A common prefix
    is capped by the ``room`` of either (bytes to the end of its span); lcp[0] is 0.
    """
    top = 4
    while 2 * top <= depth:
        top *= 2
    ranks = _ranks(symbols, top)
    n, rest = len(symbols), max(depth - top, 0)
    last = np.concatenate((ranks[top], np.zeros(rest, np.int32))).astype(np.int64)
    order = np.argsort((last[starts] << 32) | last[starts + rest], kind="stable")
    p, q = starts[order[:-1]], starts[order[1:]]
    lcp = np.zeros(len(p), np.int64)
    for size in sorted(ranks, reverse=True):
        a, b = p + lcp, q + lcp
        fits = (a < n) & (b < n)
        r = ranks[size]
        lcp += np.where(fits & (r[np.minimum(a, n - 1)] == r[np.minimum(b, n - 1)]), size, 0)
    for _ in range(3):
        lcp += symbols[np.minimum(p + lcp, n - 1)] == symbols[np.minimum(q + lcp, n - 1)]
    lcp = np.minimum(lcp, np.minimum(room[order[:-1]], room[order[1:]]))
    return order, np.concatenate(([0], lcp))


def interval_tree(lcp: list[int], left: list[int], min_len: int) -> list[tuple[int, int, int]]:
    """Maximal repeat groups (first rank, last rank, length) of an enhanced suffix array.

    A stack scan over the common prefixes yields each interval of at least ``min_len``. ``left`` is
    the byte before each suffix in rank order, or -1 where a block begins. An interval whose bytes
    to the left are all one real byte can be extended and is not maximal.
    """
    out: list[tuple[int, int, int]] = []
    stack: list[list[int]] = []  # length, first rank, byte to the left or -1
    n = len(lcp)
    for i in range(1, n + 1):
        now = lcp[i] if i < n else 0
        begin, byte = i - 1, left[i - 1]
        if stack:  # the suffix i - 1 belongs to the open interval on top
            top = stack[-1]
            if top[2] != byte:
                top[2] = -1
        while stack and stack[-1][0] > now:
            length, begin, byte = stack.pop()
            if byte < 0:
                out.append((begin, i - 1, length))
            if stack and stack[-1][0] >= max(now, min_len):
                if stack[-1][2] != byte:
                    stack[-1][2] = -1
        if now >= min_len and (not stack or stack[-1][0] < now):
            stack.append([now, begin, byte])
    return out


def repeat_groups(blobs: list[bytes], counts: list[int], min_len: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]], np.ndarray]:
    """Suffixes in rank order as (blob, place), the maximal repeat groups as rank ranges with their
    length, and the longest group's length at each rank (0: none).

    Only the first ``counts[i]`` places of a blob start a suffix.
    """
    size = np.array([len(b) for b in blobs], np.int64)
    many = np.array(counts, np.int64)
    base = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    symbols = np.frombuffer(b"\0".join(blobs) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    symbols[base + size] = 0
    blob = np.repeat(np.arange(len(blobs)), many)
    inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    starts = base[blob] + inner
    order, lcp = suffix_array(symbols, starts, size[blob] - inner, int(size.max()))
    best = np.zeros(len(order), np.int64)
    groups: list[tuple[int, int, int]] = []
    near = lcp >= min_len
    some = near.copy()
    some[:-1] |= near[1:]
    picked = np.flatnonzero(some)  # suffixes in some interval; between its members none is left out
    if len(picked):
        at = starts[order[picked]]
        byte = np.where(inner[order[picked]] > 0, symbols[np.maximum(at - 1, 0)].astype(np.int64), -1)
        groups = [(int(picked[a]), int(picked[b]), c) for a, b, c in interval_tree(np.where(near[picked], lcp[picked], 0).tolist(), byte.tolist(), min_len)]
        for a, b, length in sorted(groups, key=lambda g: g[2]):
            best[a : b + 1] = length
    return blob[order], inner[order], groups, best


def promising(blobs: list[bytes], counts: list[int], min_len: int) -> np.ndarray:
    """Which blobs have a window whose hash is there twice; the others have no repeat and need no suffixes."""
    size, many = np.array([len(b) for b in blobs], np.int64), np.array(counts, np.int64)
    data = np.frombuffer(b"".join(blobs), np.uint8)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table(7)[data] * _powers(_B, len(data))[:-1], out=sums[1:])
    owner = np.repeat(np.arange(len(blobs)), many)
    at = np.repeat(np.cumsum(size) - size - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    h = mix((sums[at + min_len] - sums[at]) * _powers(_INV, len(data))[at])
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(blobs), bool)
    out[owner[order[1:][same]]] = True
    out[owner[order[:-1][same]]] = True
    return out


def _anchor_place(body: bytes, min_len: int) -> int:
    """Where the anchor stands in a span: the leftmost smallest gram of its first window."""
    head = _gram_hashes(np.frombuffer(body[:min_len], np.uint8))
    return int(np.argmin((head & ~np.uint64((1 << 24) - 1)) | np.arange(len(head), dtype=np.uint64)))


def parts_of(ahash: int, body: bytes, windows: int, min_len: int) -> list[tuple[int, int, int, int]]:
    """(key, first window, windows, anchor's place) of the parts of a span; equal windows are in parts of one key."""
    anchor = _anchor_place(body, min_len)
    width = -(-(min_len - K + 1) // PARTS)
    out = []
    for c in range(PARTS):
        lo, hi = c * width, (c + 1) * width - 1  # the anchor stands lo to hi bytes into these windows
        first, last = max(anchor - hi, 0), min(anchor - lo, windows - 1)
        if first <= last:
            shared = body[anchor - lo : anchor - hi + min_len]
            key = hashlib.blake2b(shared, digest_size=8, salt=ahash.to_bytes(8, "little", signed=True), person=c.to_bytes(4, "little")).digest()
            out.append((int.from_bytes(key, "little", signed=True), first, last - first + 1, anchor - first))
    return out


def place_by_place(blobs: list[bytes], counts: list[int], anchors: list[int], min_len: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(blob, place) of the members of each group of equal windows, for spans that share an anchor."""
    base = np.concatenate(([0], np.cumsum([len(b) for b in blobs])[:-1]))
    data = np.frombuffer(b"".join(blobs), np.uint8)
    off, many = np.array(anchors), np.array(counts)
    for o in range(int(off.max()) + 1):  # the anchor stands o bytes into the window
        place = off - o
        rows = np.flatnonzero((place >= 0) & (place < many))
        if len(rows) < 2:
            continue
        at = base[rows] + place[rows]
        windows = np.ascontiguousarray(data[at[:, None] + np.arange(min_len)]).view(f"V{min_len}").ravel()
        order = np.argsort(windows)
        same = windows[order[1:]] == windows[order[:-1]]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], same.astype(np.int8), [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            mine = rows[order[a : b + 1]]
            yield mine, place[mine]


def _ranges(place: np.ndarray, length: np.ndarray) -> list[tuple[int, int]]:
    """Union of [place, place + length)."""
    order = np.argsort(place, kind="stable")
    a = place[order]
    b = np.maximum.accumulate(a + length[order])
    cut = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
    return list(zip(a[cut].tolist(), b[np.concatenate((cut[1:] - 1, [len(b) - 1]))].tolist()))


_MEMBERS = "ahash long, shash long, place int, length int, gid long"


def _digest_of(raw: bytes) -> int:
    """64-bit name of a string."""
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _scan_blocks(min_len: int, members: bool):
    """Spans or parts sorted by key, to the covered ranges of those that stand alone, or to the groups with their members."""

    def crowded(rows: list[dict]) -> bool:
        return len(rows) > WIDE and rows[0]["key"] == rows[-1]["key"]

    def solve(rows: list[dict]) -> Iterator[tuple[dict, int, int]]:
        """(span, first byte, end) in the document."""
        keep = promising([r["body"] for r in rows], [r["n"] for r in rows], min_len)
        rows = [r for r, k in zip(rows, keep.tolist()) if k]
        if not rows:
            return
        if crowded(rows):
            hits = list(place_by_place([r["body"] for r in rows], [r["n"] for r in rows], [r["anchor"] for r in rows], min_len))
            if not hits:
                return
            blob, place = (np.concatenate([h[i] for h in hits]) for i in (0, 1))
            length = np.full(len(blob), min_len)
        else:
            blob, place, _, best = repeat_groups([r["body"] for r in rows], [r["n"] for r in rows], min_len)
            blob, place, length = blob[best > 0], place[best > 0], best[best > 0]
        order = np.argsort(blob, kind="stable")
        blob, place, length = blob[order], place[order], length[order]
        cut = np.searchsorted(blob, np.arange(len(rows) + 1))
        for i, r in enumerate(rows):
            if r["single"] and cut[i] < cut[i + 1]:
                for a, b in _ranges(place[cut[i] : cut[i + 1]], length[cut[i] : cut[i + 1]]):
                    yield r, r["s"] + r["first"] + a, r["s"] + r["first"] + b

    def grouped(rows: list[dict]) -> Iterator[tuple[int, int, int, int, int]]:
        """(anchor, content, place in the span, length, group); a content that repeats as a whole is a group too."""
        bodies = [r["body"] for r in rows]
        whole = {i for i, r in enumerate(rows) if not r["single"]}
        if crowded(rows):
            found = ((blob, place, min_len) for blob, place in place_by_place(bodies, [r["n"] for r in rows], [r["anchor"] for r in rows], min_len))
        else:
            every, at_, ranges, _ = repeat_groups(bodies, [r["n"] for r in rows], min_len)
            found = ((every[a : b + 1], at_[a : b + 1], length) for a, b, length in ranges)
        for blob, place, length in found:
            name = _digest_of(bodies[blob[0]][place[0] : place[0] + length])
            for i, at in zip(blob.tolist(), place.tolist()):
                if length == len(bodies[i]):
                    whole.discard(i)
                yield rows[i]["ahash"], rows[i]["shash"], rows[i]["first"] + at, length, name
        for i in whole:
            yield rows[i]["ahash"], rows[i]["shash"], rows[i]["first"], len(bodies[i]), _digest_of(bodies[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("repeats")
        wait: list[dict] = []
        size, closed = 0, 0  # rows of wait before ``closed`` are of complete groups
        kind = None

        def out(rows: list[dict]) -> pa.RecordBatch:
            if members:
                found = list(grouped(rows))
                return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int32() if i in (2, 3) else pa.int64()) for i in range(5)], ["ahash", "shash", "place", "length", "gid"])
            found = list(solve(rows)) if rows else []
            return pa.RecordBatch.from_arrays(
                [pa.array([r["doc_id"] for r, _, _ in found], kind), pa.array([r["th"] for r, _, _ in found], pa.int64()), pa.array([a for _, a, _ in found], pa.int32()), pa.array([b for _, _, b in found], pa.int32())],
                ["doc_id", "th", "a", "b"],
            )

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for r in batch.to_pylist():
                if wait and wait[-1]["key"] != r["key"]:
                    closed = len(wait)
                    if size >= BLOCK:
                        yield out(wait)
                        wait, size, closed = [], 0, 0
                wait.append(r)
                size += len(r["body"])
                if size >= BLOCK and closed:
                    yield out(wait[:closed])
                    wait, closed = wait[closed:], 0
                    size = sum(len(x["body"]) for x in wait)
        if wait:
            yield out(wait)

    return run


def _cut_spans(min_len: int, windows: bool):
    """Texts with their requests, to one row for each requested span or (of crowded anchors) part, or for each of a span's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("repeats")
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            raw = data.tobytes()
            ask = batch.column("ask")
            inner = ask.flatten()
            at = np.diff(np.concatenate(([0], np.asarray(ask.value_lengths().fill_null(0)).cumsum())))
            row = np.repeat(np.arange(batch.num_rows), at)
            s, n = (np.asarray(inner.field(f)).astype(np.int64) for f in ("s", "n"))
            for i in range(0, len(row), 20_000):
                part = slice(i, i + 20_000)
                lo, many = offsets[row[part]] + s[part], n[part]
                keys = pa.array(row[part])
                ids, th = batch.column("doc_id").take(keys), batch.column("th").take(keys)
                piece = inner.slice(i, len(keys))
                if not windows:
                    rows, owner = [], []
                    asked = zip(piece.field("ahash").to_pylist(), piece.field("crowd").to_pylist(), lo.tolist(), many.tolist())
                    for k, (h, crowd, a, c) in enumerate(asked):
                        body = raw[a : a + c + min_len - 1]
                        own = [(key, f, w, at, body[f : f + w + min_len - 1]) for key, f, w, at in parts_of(h, body, c, min_len)] if crowd else [(h, 0, c, 0, body)]
                        rows += own
                        owner += [k] * len(own)
                    same = pa.array(owner, pa.int64())
                    kept = [piece.field(f).take(same) for f in ("ahash", "shash", "single", "s")]
                    made = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([*made, *kept, ids.take(same), th.take(same)], ["key", "first", "n", "anchor", "body", "ahash", "shash", "single", "s", "doc_id", "th"])
                    continue
                for k, (a, c) in enumerate(zip(lo.tolist(), many.tolist())):
                    digest = pa.array([hashlib.blake2b(raw[a + t : a + t + min_len], digest_size=16).digest() for t in range(c)], pa.binary())
                    same = pa.array(np.full(c, k))
                    kept = [piece.field(f).take(same) for f in ("ahash", "shash", "single")]
                    yield pa.RecordBatch.from_arrays([digest, *kept, ids.take(same), th.take(same), pa.array(np.arange(c, dtype=np.int32)), pa.array(np.full(c, s[i + k], np.int32))], ["window", "ahash", "shash", "single", "doc_id", "th", "place", "s"])

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def _spans(docs: DataFrame, id_col: str, text_col: str, min_len: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans whose anchor is there twice, their contents with counts, one row each, anchors with several contents and whether some are there once)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    every = materialise(_keyed(docs, id_col, text_col).mapInArrow(tidied(_emit_spans(min_len)), _SPAN_SCHEMA.format(id=id_type)), "spans")
    # what is joined with a table of counts is written first: Spark splits hot keys between plain tables only
    twice = every.groupBy("ahash").agg(F.count("*").alias("c"), F.max(F.col("m") > F.col("n")).alias("folded")).filter("c > 1 OR folded").select("ahash")
    met = materialise(every.join(materialise(twice, "anchors"), "ahash", "left_semi"), "met")
    release(docs.sparkSession, [p for p in written() if "/parlance-spans-" in p][-1:])  # all that is read later is in ``met``
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "s"))
    kinds = met.groupBy("ahash", "shash").agg(F.count("*").alias("c"), F.max(F.col("m") > F.col("n")).alias("folded"), F.first("n").alias("n"), least.alias("rep"))
    kinds = kinds.select("ahash", "shash", "n", ((F.col("c") == 1) & ~F.col("folded")).alias("single"), F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th"), F.col("rep.s").alias("s"))
    kinds = materialise(kinds, "kinds")
    contested = kinds.groupBy("ahash").agg(F.count("*").alias("kinds"), F.max("single").alias("some")).filter("kinds > 1")
    return met, kinds, materialise(contested, "contested")


def _asked(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str, min_len: int, windows: bool) -> DataFrame:
    """The text of each span in ``asked`` (of its parts, for crowded anchors; or the digests of its windows), cut from its document."""
    id_type = docs.schema[id_col].dataType.simpleString()
    keyed = _keyed(docs, id_col, text_col)
    ask = asked.groupBy("doc_id", "th").agg(F.collect_list(F.struct("s", "n", "ahash", "shash", "single", (F.col("kinds") > WIDE).alias("crowd"))).alias("ask"))  # of one text
    texts = keyed.join(ask, same_key(keyed, ask)).select(keyed["doc_id"], keyed["th"], keyed["text"], ask["ask"])
    own = "window binary, ahash long, shash long, single boolean, doc_id {0}, th long, place int, s int" if windows else "key long, first int, n int, anchor int, body binary, ahash long, shash long, single boolean, s int, doc_id {0}, th long"
    return texts.mapInArrow(tidied(_cut_spans(min_len, windows)), own.format(id_type))


def _bodies(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str, min_len: int) -> DataFrame:
    """Contested spans, and parts of those of crowded anchors, dealt and sorted by what has to meet."""
    return _asked(docs, asked.filter(F.col("kinds") <= HUGE), id_col, text_col, min_len, False).repartition("key").sortWithinPartitions("key")


def _checked(min_len: int) -> None:
    if not 2 * K <= min_len <= 1 << 20:
        raise ValueError(f"min_len must be from {2 * K} to {1 << 20}")


def covered_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 200) -> DataFrame:
    """Byte ranges of each text that a repeated string of ``min_len`` bytes (64 to 2 ** 20) covers.

    One row for each text with any: ``doc_id``, ``th`` (xxhash64 of the text, null as empty),
    ``cover`` (array of a, b: bytes [a, b), unordered, may overlap). Equal texts under different ids
    cover each other. Null and short texts have no row; an empty table gives an empty one.
    """
    _checked(min_len)
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    met, kinds, contested = _spans(docs, id_col, text_col, min_len)
    whole = met.join(kinds.filter(~F.col("single")).select("ahash", "shash"), ["ahash", "shash"], "left_semi")
    cover = whole.select("doc_id", "th", F.col("s").alias("a"), (F.col("s") + F.col("m") + F.lit(min_len - 1)).alias("b"))
    contested = contested.filter("some")  # contents that are there twice are covered as they are
    asked = kinds.join(contested, "ahash")
    found = _bodies(docs, asked, id_col, text_col, min_len).mapInArrow(tidied(_scan_blocks(min_len, False)), f"doc_id {id_type}, th long, a int, b int")
    cover = cover.unionByName(found)
    if contested.filter(F.col("kinds") > HUGE).limit(1).count():
        windows = _asked(docs, asked.filter(F.col("kinds") > HUGE), id_col, text_col, min_len, True)
        twice = materialise(windows.groupBy("window").count().filter("count > 1").select("window"), "windows")
        hit = windows.filter("single").join(twice, "window", "left_semi").withColumn("a", F.col("s") + F.col("place"))
        cover = cover.unionByName(hit.select("doc_id", "th", "a", (F.col("a") + min_len).alias("b")))
    return materialise(cover.groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b")).alias("cover")), "cover")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 200) -> DataFrame:
    """Repeat groups with all their occurrences: ``group, length, n_occurrences, doc_id, th, start``, one row each.

    A group is a string of at least ``min_len`` bytes; its rows are all places of the input where it
    stands (``start`` in bytes, ``th`` the xxhash64 of the text there). Strings that always stand in the
    same place of a longer one are joined into it, so neighbouring spans with the same occurrences are
    one group. The union of all rows is what :func:`covered_ranges` covers.
    """
    _checked(min_len)
    ship(docs.sparkSession)
    met, kinds, contested = _spans(docs, id_col, text_col, min_len)
    asked = kinds.join(contested, "ahash")
    members = _bodies(docs, asked, id_col, text_col, min_len).mapInArrow(tidied(_scan_blocks(min_len, True)), _MEMBERS)
    alone = kinds.filter(~F.col("single")).join(contested, "ahash", "left_anti")
    members = members.unionByName(alone.select("ahash", "shash", F.lit(0).alias("place"), (F.col("n") + F.lit(min_len - 1)).alias("length"), F.xxhash64("ahash", "shash").alias("gid")))
    if contested.filter(F.col("kinds") > HUGE).limit(1).count():
        windows = _asked(docs, asked.filter(F.col("kinds") > HUGE), id_col, text_col, min_len, True)
        copies = windows.groupBy("window").agg(F.count("*").alias("c"), F.max(~F.col("single")).alias("more")).filter("c > 1 OR more").select("window")
        hit = windows.join(materialise(copies, "windows"), "window", "left_semi")
        members = members.unionByName(hit.select("ahash", "shash", "place", F.lit(min_len).alias("length"), F.xxhash64("window").alias("gid")))
    members = materialise(members, "members")
    turns = met.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("m") - 1, F.col("n"))))  # folded spans stand several times
    spots = turns.join(members, ["ahash", "shash"]).select("gid", "length", "doc_id", "th", (F.col("s") + F.col("turn") + F.col("place")).alias("a")).distinct()
    spots = materialise(spots, "spots")
    total = materialise(spots.groupBy("gid").agg(F.count("*").alias("total"), F.first("length").alias("length")), "totals")
    known = spots.join(total.select("gid", "total"), "gid")
    longest = known.groupBy("doc_id", "th", "a").agg(F.max(F.struct("length", "gid", "total")).alias("x")).select("doc_id", "th", "a", "x.*")
    ends = longest.select("gid", "total", F.struct("doc_id", "th", (F.col("a") + F.col("length") - F.lit(min_len - 1)).alias("a")).alias("at"))
    begins = longest.select(F.col("gid").alias("to"), F.col("total").alias("total2"), F.struct("doc_id", "th", "a").alias("at2"))
    step = ends.join(begins, ends["at"].eqNullSafe(begins["at2"]) & (ends["total"] == begins["total2"]))
    links = step.groupBy("gid", "to", "total").count().filter("count = total").select(F.col("gid").alias("u"), F.col("to").alias("v"))
    links = materialise(links, "links")
    chains = materialise(components(links), "chains")  # a chain ends in every text, so none is a ring
    own = F.lit(min_len - 1)
    sizes = chains.join(total, chains["node"] == total["gid"]).groupBy("root").agg((F.sum(F.col("length") - own) + own).alias("whole"))
    firsts = chains.join(links, chains["node"] == links["v"], "left_anti").join(sizes, "root").select(F.col("node").alias("gid"), "whole")
    named = total.join(chains, total["gid"] == chains["node"], "left_anti").select("gid", "total", "length").unionByName(total.join(firsts, "gid").select("gid", "total", F.col("whole").alias("length")))
    out = spots.drop("length").join(named, "gid")
    return out.select(F.col("gid").alias("group"), F.col("length").cast("long").alias("length"), F.col("total").alias("n_occurrences"), "doc_id", "th", F.col("a").cast("long").alias("start"))


def _merged(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    return _ranges(a.astype(np.int64), (b - a).astype(np.int64)) if len(a) else []


def _each_text(batch: pa.RecordBatch, text: str, cover: str) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    data, offsets = flat(batch.column(text))
    raw = data.tobytes()
    ranges = batch.column(cover)
    inner = ranges.flatten()
    a, b = np.asarray(inner.field("a")), np.asarray(inner.field("b"))
    ends = np.asarray(ranges.value_lengths().fill_null(0)).cumsum()
    lo = 0
    for i, hi in enumerate(ends.tolist()):
        yield raw[offsets[i] : offsets[i + 1]], _merged(a[lo:hi], b[lo:hi])
        lo = hi


def _kept(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    if not gone:
        return raw
    edges = [0, *[x for r in gone for x in r], len(raw)]
    return b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(len(raw), sum(b - a for a, b in gone), len(gone), hashlib.sha256(_kept(raw, gone)).hexdigest()) for raw, gone in _each_text(batch, "text", "cover")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], pa.array([r[3] for r in rows], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 200) -> DataFrame:
    """One row for each document: bytes, removed bytes, removed runs, digest of what is left.

    Null text counts as empty. Repeated rows and null ids each get their row; texts shorter than
    ``min_len`` lose nothing. Other columns are ignored, whatever their names.
    """
    cover = covered_ranges(docs, id_col, text_col, min_len)
    keyed = _keyed(docs, id_col, text_col)
    joined = keyed.join(cover, same_key(keyed, cover), "left").select(keyed["doc_id"], keyed["text"], cover["cover"])
    return joined.mapInArrow(tidied(_digest), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _rewrite(names: list[str], text: str, count: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("repeats")
        for batch in batches:
            texts = []
            for i, (raw, gone) in enumerate(_each_text(batch, text, "__pl_cover")):
                texts.append(None if not batch.column(text)[i].is_valid else _kept(raw, gone).decode("utf-8", "ignore") if gone else raw.decode())
            new = {text: pa.array(texts, pa.string())}
            if count:
                new[count] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 200, count_col: str | None = None) -> DataFrame:
    """The documents without their covered bytes; ``count_col``, if given, gets the new length.

    A code point that is cut at a range's border goes as a whole. All columns stay, under any names
    but ``__pl_th`` and ``__pl_cover``.
    """
    cover = covered_ranges(docs, id_col, text_col, min_len)
    mine = docs.withColumn("__pl_th", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    theirs = cover.select(F.col("doc_id").alias("__pl_id"), F.col("th").alias("__pl_th2"), F.col("cover").alias("__pl_cover"))
    joined = mine.join(theirs, mine[id_col].eqNullSafe(theirs["__pl_id"]) & (mine["__pl_th"] == theirs["__pl_th2"]), "left").drop("__pl_id", "__pl_th2", "__pl_th")
    return joined.mapInArrow(tidied(_rewrite(docs.columns, text_col, count_col)), docs.schema)


def oracle_sql(table: str = "documents", min_len: int = 200) -> str:
    """:func:`removal_report` by brute force in DuckDB: each byte a row, windows hashed by doubling, every window counted."""
    steps, size = [], 1
    while 2 * size <= min_len:
        steps.append((2 * size, size))
        size *= 2
    steps.append((min_len, min_len - size))
    lead = lambda c, n: f"lead({c}, {n}) OVER (PARTITION BY r ORDER BY i)"
    passes, last = "", "b1"
    for k, (to, by) in enumerate(steps):
        passes += f"b{k + 2} AS (SELECT r, i, c, hash(h, {lead('h', by)}) AS h, {lead('i', to - 1)} AS e FROM {last}),\n    "
        last = f"b{k + 2}"
    return f"""
    WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM {table}),
    b1 AS (SELECT r, i, c, hash(c) AS h, i AS e FROM (SELECT r, unnest(regexp_extract_all(x, '..')) AS c, unnest(range(length(x) // 2)) AS i FROM t)),
    {passes}
    w AS (SELECT r, i, c, CASE WHEN e IS NULL THEN 0 ELSE (count(*) OVER (PARTITION BY h, e IS NULL) > 1)::INT END AS f FROM {last}),
    v AS (SELECT r, i, c, max(f) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {min_len - 1} PRECEDING AND CURRENT ROW) AS g FROM w),
    u AS (SELECT *, coalesce(lag(g) OVER (PARTITION BY r ORDER BY i), 0) AS before FROM v),
    s AS (SELECT r, sum(g) AS n_removed, sum((g = 1 AND before = 0)::INT) AS n_spans, coalesce(string_agg(c, '' ORDER BY i) FILTER (WHERE g = 0), '') AS kept FROM u GROUP BY r)
    SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
    FROM t LEFT JOIN s USING (r)"""
