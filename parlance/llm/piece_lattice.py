"""Sampled segmentations into pieces of a public vocabulary, without replacement, and decoding.

The lattice of a text has an edge for every piece that stands at a place. A segmentation's weight is
the product of its pieces' weights (Zipf's law over the vocabulary's ranks, with an exponent), and the
sampler draws the ``k`` segmentations of the largest Gumbel-perturbed log-probabilities: a draw of
distinct segmentations without replacement. The search is best-first over partial paths. A partial
path's key is the perturbed maximum of its subtree, an exact bound, drawn top-down: the best child
takes its parent's value, the others one below it. So each popped node leads straight to its best
leaf, and what it passes by stays in the queue.

No piece crosses from a word into the blank before the next, so the lattice is a chain of word
lattices; those are built once for each different word of a batch. Random numbers are hashes of the
row's key, the draw, the word's place and the step, so a row's draws never depend on its batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.scratch import ship
from parlance.llm.textbytes import mix

LONGEST = 16
#: Words over this length are cut where no piece that stands in them crosses; the parts' lattices are independent, so draws keep their odds.
LONG = 512
#: Partial paths this far below (in nats), and log(k) further for k draws, are left out: odds of about e ** -30 for any k.
FAR = 32.0
BATCH_CHARS = 80_000
_B = np.uint64(0x9E3779B97F4A7C15)
_T1, _T2, _T3 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _char_codes(chars: np.ndarray) -> np.ndarray:
    return mix(chars.astype(np.uint64) * _T1 + _T2)


def far(k: int) -> float:
    """How far below (in nats) a partial path is left out when ``k`` segmentations are drawn."""
    return FAR + float(np.log(max(k, 1)))


class Pieces:
    """A vocabulary: pieces by hash of each prefix, their weights, and the byte pieces."""

    def __init__(self, path: str, exponent: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.uint32)
        normal: list[tuple[str, int]] = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.text[i] = bytes([int(piece[3:5], 16)])
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and len(piece) <= LONGEST:
                plain = piece.replace("▁", " ")
                self.text[i] = plain.encode()
                normal.append((plain, i))
        rank = {i: r for r, (_, i) in enumerate(sorted(normal, key=lambda x: (-model.get_score(x[1]), x[1])))}
        self.single = np.zeros(0x110000, bool)
        self.first = np.full(0x110000, -2, np.int32)  # as find() for one character
        nodes: dict[int, int] = {}
        for plain, i in normal:
            if len(plain) == 1:
                self.single[ord(plain)] = True
            h = np.uint64(0)
            codes = _char_codes(np.array([ord(c) for c in plain]))
            with np.errstate(over="ignore"):
                for k, c in enumerate(codes):
                    h = h * _B + c
                    nodes.setdefault(int(h), -1)
                nodes[int(h)] = i
        bits = 20
        self.shift = np.uint64(64 - bits)
        self.keys, self.ids = np.zeros((1 << bits) + 64, np.uint64), np.full((1 << bits) + 64, -2, np.int32)
        self.probes = 1
        for h, i in nodes.items():
            at = (h * int(_T3) & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)
            k = 1
            while self.ids[at] != -2:
                at += 1
                k += 1
            self.keys[at], self.ids[at] = h, i
            self.probes = max(self.probes, k)
        for plain, _ in normal:
            self.first[ord(plain[0])] = max(self.first[ord(plain[0])], -1)
        for plain, i in normal:
            if len(plain) == 1:
                self.first[ord(plain)] = i
        self.weight = np.full(n, -np.inf)
        for _, i in normal:
            self.weight[i] = -exponent * np.log(rank[i] + 2.7)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece id of each hash; -1 for a mere prefix of pieces, -2 for none."""
        at = ((h * _T3) >> self.shift).astype(np.int64)
        out = np.full(len(h), -2, np.int32)
        todo = np.arange(len(h))
        for _ in range(self.probes):
            here = self.ids[at[todo]]
            hit = (self.keys[at[todo]] == h[todo]) & (here != -2)
            out[todo[hit]] = here[hit]
            todo = todo[~hit & (here != -2)]
            if not len(todo):
                break
            at[todo] += 1
        return out


    def crossings(self, chars: np.ndarray) -> np.ndarray:
        """Places within ``chars`` that no piece standing there crosses."""
        n = len(chars)
        codes = _char_codes(chars)
        reach = np.arange(1, n + 1)
        start, h = np.arange(n), np.zeros(n, np.uint64)
        for k in range(LONGEST):
            h = h * _B + codes[start + k]
            got = self.find(h) if k else self.first[chars]
            reach[start[got >= 0]] = start[got >= 0] + k + 1
            go = (got > -2) & (start + k + 1 < n)
            start, h = start[go], h[go]
            if not len(start):
                break
        return np.flatnonzero(np.maximum.accumulate(reach)[:-1] <= np.arange(1, n)) + 1


@cache
def pieces(path: str, exponent: float) -> Pieces:
    return Pieces(path, exponent)


class Lattices:
    """Lattices of the different words of a batch, laid out by distance from the word's end.

    The node at distance ``t`` of word ``w`` is number ``off[t] + w``. Words are sorted by length, longest first,
    so the nodes at a distance are one stretch and the sums over suffixes are sums of stretches.
    """

    def __init__(self, vocabulary: Pieces, chars: np.ndarray, size: np.ndarray):
        """``chars``: the words one after the other; ``size``: their lengths, longest first."""
        words = len(size)
        self.size = size
        longest = int(size[0]) if words else 0
        wide = np.searchsorted(-size, -np.arange(1, longest + 1), "right")  # words of at least each length
        count = np.concatenate(([words], wide))
        self.off = np.concatenate(([0], np.cumsum(count)))
        n = int(self.off[-1])
        word = np.repeat(np.arange(words), size)
        t = np.repeat(size, size) - (np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size))
        node = self.off[t] + word
        after = np.zeros(n, np.int64)
        after[node] = self.off[t - 1] + word
        codes = np.zeros(n, np.uint64)
        codes[node] = _char_codes(chars)
        ids, score, used = np.empty((LONGEST, n), np.int32), np.empty((LONGEST, n), np.float32), 0
        start, h, at = node, np.zeros(len(node), np.uint64), node
        for k in range(LONGEST):
            if not len(start):
                break
            h = h * _B + codes[at]
            got = vocabulary.find(h) if k else vocabulary.first[chars]
            piece = got >= 0
            if piece.any():
                hit, found = start[piece], got[piece]
            ids[k], score[k] = -1, -np.inf
            if piece.any():
                ids[k, hit], score[k, hit] = found, vocabulary.weight[found]
                used = k + 1
            at = after[at]
            go = (got > -2) & (at >= words)  # nodes before ``words`` are ends
            start, h, at = start[go], h[go], at[go]
        if not used:
            ids[0], score[0], used = -1, -np.inf, 1
        self.wide = used
        self.ids, self.score = ids[:used], score[:used]
        score = self.score
        self.mass = np.zeros(n, np.float32)  # of the suffix from each node
        up_to = np.zeros((max(self.wide, 8), n), np.float32)
        for t in range(1, longest + 1):
            lo, top = int(self.off[t]), int(count[t])
            k = min(t, self.wide)
            values = np.empty((k, top), np.float32)
            for i in range(k):
                back = int(self.off[t - 1 - i])
                np.add(score[i][lo : lo + top], self.mass[back : back + top], out=values[i])
            best = values.max(0)
            values -= best
            np.exp(values, out=values)
            for i in range(1, k):
                values[i] += values[i - 1]
            total = values[-1]
            self.mass[lo : lo + top] = best + np.log(total)
            up_to[:k, lo : lo + top] = values / total
            up_to[k:, lo : lo + top] = 1.0
        self.near = np.ascontiguousarray(up_to[:8].T)
        self.more = up_to[8:]

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each node that a uniform number falls on."""
        below = self.near[node] < u[:, None]
        edge = np.bitwise_count(below.view(np.uint64).ravel()).astype(np.int64)
        far = np.flatnonzero(edge == 8)
        for row in self.more:
            edge[far] += row[node[far]] < u[far]
        return edge

    def log_p(self, word: np.ndarray, t: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """ln P of an edge at a distance, given that its node is passed."""
        node = self.off[t] + word
        return self.score[edge, node].astype(np.float64) + self.mass[self.off[t - edge - 1] + word] - self.mass[node]

    def all_log_p(self, word: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The same for all edges of some nodes, a row for each node; -inf where there is none."""
        node = self.off[t] + word
        rows = [self.score[k][node] + self.mass[self.off[np.maximum(t - k - 1, 0)] + word] - self.mass[node] for k in range(self.wide)]
        return np.stack(rows, axis=1).astype(np.float64)

    def piece(self, word: np.ndarray, t: np.ndarray, edge: np.ndarray) -> np.ndarray:
        return self.ids[edge, self.off[t] + word].astype(np.uint32)


def _stream(number: int) -> np.uint64:
    """Start of a stream of random numbers, apart from the others."""
    return np.uint64((number + 1) * 0x8CB92BA72F3D8DD7 & 0xFFFFFFFFFFFFFFFF)


def _uniform(key: np.ndarray) -> np.ndarray:
    return ((mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


class Batch:
    """Texts of one batch as words, with the paths drawn for them."""

    def __init__(self, vocabulary: Pieces, texts: list[str], keys: np.ndarray):
        self.vocabulary, self.keys = vocabulary, keys
        raw = [(" " + t).encode("utf-32-le") if t else b"" for t in texts]
        size = np.array([len(x) // 4 for x in raw], np.int64)
        chars = np.frombuffer(b"".join(raw), np.uint32)
        self.rows = len(texts)
        row_of = np.repeat(np.arange(self.rows), size)
        odd = ~vocabulary.single[chars]
        blank = chars == 32
        first = np.zeros(len(chars), bool)
        if len(chars):
            first[0] = True
            first[1:] = (row_of[1:] != row_of[:-1]) | odd[1:] | odd[:-1] | (blank[1:] & ~blank[:-1])
        start = np.flatnonzero(first)
        length = np.diff(np.concatenate((start, [len(chars)])))
        long = np.flatnonzero(length > LONG)
        for a, n in zip(start[long].tolist(), length[long].tolist()):
            first[a + vocabulary.crossings(chars[a : a + n])] = True
        if len(long):
            start = np.flatnonzero(first)
            length = np.diff(np.concatenate((start, [len(chars)])))
        self.word_row = row_of[start]
        self.fixed = odd[start]  # a character without a piece: its bytes
        self.fixed_char = np.where(self.fixed, chars[start], 0)
        self.first_word = np.searchsorted(self.word_row, np.arange(self.rows + 1))
        self.place = np.arange(len(start)) - self.first_word[self.word_row]
        inner = np.arange(len(chars)) - np.repeat(start, length)
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(length.max()) if len(length) else 0, _B, np.uint64))))
        h = mix(np.add.reduceat(_char_codes(chars) * power[inner], start) + length.astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
        free = np.flatnonzero(~self.fixed)
        _, example, which = np.unique(h[free], return_index=True, return_inverse=True)
        order = np.argsort(-length[free[example]], kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        chosen = free[example[order]]
        many = length[chosen]
        at = np.repeat(start[chosen] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        self.lattices = Lattices(vocabulary, chars[at], many)
        self.word = np.full(len(start), -1, np.int64)
        self.word[free] = back[which]

    def walk(self, draw: int, occ: np.ndarray, t: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ancestral samples of the words ``occ`` from distance ``t`` on: (word, step, distance, edge) of each piece."""
        lat = self.lattices
        seed = mix(self.keys[self.word_row[occ]] + _stream(2 * draw)) + self.place[occ].astype(np.uint64) * _T2
        got = []
        live = np.flatnonzero(t > 0)
        o, s, w, t, step = occ[live], seed[live], self.word[occ[live]], t[live], step[live]
        while len(o):
            u = _uniform(s + (step.astype(np.uint64) + np.uint64(1)) * _T3).astype(np.float32)
            edge = lat.choose(lat.off[t] + w, u)
            got.append((o, step, t, edge))
            t = t - edge - 1
            step = step + 1
            live = t > 0
            o, s, w, t, step = o[live], s[live], w[live], t[live], step[live]
        if not got:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate([g[i] for g in got]) for i in range(4))

    def sample(self, k: int) -> list[dict]:
        """For each row its draws, best first: perturbed value, log-probability, inclusion, ids."""
        rows, lat = self.rows, self.lattices
        free = np.flatnonzero(~self.fixed)
        start_mass = np.bincount(self.word_row[free], lat.mass[lat.off[lat.size[self.word[free]]] + self.word[free]], rows)
        top = -np.log(-np.log(_uniform(self.keys * _T2 + _T1)))  # Gumbel of the whole mass, ln 1
        paths: list[tuple] = []
        heads: list[tuple] = []
        queue: list[dict] = []
        values: list[np.ndarray] = []
        totals: list[np.ndarray] = []
        branch: dict | None = None
        for draw in range(k + 1):
            if branch is not None:
                g = np.full(rows, -np.inf)
                bag = {c: np.concatenate([q[c] for q in queue]) for c in queue[0]}
                np.maximum.at(g, bag["row"], bag["g"])
                best = np.flatnonzero(bag["g"] == g[bag["row"]])
                best = best[np.unique(bag["row"][best], return_index=True)[1]]
                live_rows = np.isfinite(g)
                values.append(g)
                if draw == k:
                    break
                rest = np.ones(len(bag["g"]), bool)
                rest[best] = False
                queue = [{c: v[rest] for c, v in bag.items()}]
                branch = {c: v[best] for c, v in bag.items()}
            else:
                values.append(top)
                branch = {}
            if draw == 0:
                occ, step, at, edge = self.walk(0, free, lat.size[self.word[free]], np.zeros(len(free), np.int64))
            else:
                b_word, b_step, b_at, b_edge, b_from, b_index = (np.full(rows, -1, np.int64) for _ in range(6))
                for name, into in (("word", b_word), ("step", b_step), ("at", b_at), ("edge", b_edge), ("path", b_from), ("index", b_index)):
                    into[branch["row"]] = branch[name]
                kept = []
                for no, path in enumerate(heads):  # what comes before the branch, which is near the row's beginning
                    mine = np.flatnonzero(b_from == no)
                    first = np.searchsorted(path[0], self.first_word[mine])
                    many = b_index[mine] - first
                    keep = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                    kept.append(tuple(x[keep] for x in path))
                r = np.flatnonzero(live_rows)
                kept.append((b_word[r], b_step[r], b_at[r], b_edge[r]))
                later = free[live_rows[self.word_row[free]]]
                later = later[later > b_word[self.word_row[later]]]
                start = np.concatenate((b_word[r], later))
                left = np.concatenate((b_at[r] - b_edge[r] - 1, lat.size[self.word[later]]))
                steps = np.concatenate((b_step[r] + 1, np.zeros(len(later), np.int64)))
                kept.append(self.walk(draw, start, left, steps))
                occ, step, at, edge = (np.concatenate([x[i] for x in kept]) for i in range(4))
            paths.append((occ, step, at, edge))
            word, row = self.word[occ], self.word_row[occ]
            totals.append(np.bincount(row, lat.score[edge, lat.off[at] + word], rows) - start_mass)
            most = 48
            while True:  # the first words of each row, until their mass is far below
                picked = np.flatnonzero(self.place[occ] < most)
                picked = picked[np.lexsort((step[picked], occ[picked]))]
                occ_, step_, at_, edge_ = (x[picked] for x in (occ, step, at, edge))
                row_, word_ = row[picked], word[picked]
                log_p = lat.log_p(word_, at_, edge_)
                run = np.cumsum(log_p)
                head = np.searchsorted(row_, np.arange(rows + 1))
                before = run - log_p
                zero = np.where(head[:-1] < head[1:], np.concatenate((before, [0.0]))[head[:-1]], 0.0)
                before = before - zero[row_]
                end = np.where(head[:-1] < head[1:], np.concatenate(([0.0], run))[head[1:]] - zero, 0.0)
                if ((end < -far(k)) | (self.first_word[1:] - self.first_word[:-1] <= most) | (head[:-1] == head[1:])).all():
                    break
                most *= 4
            heads.append((occ_, step_, at_, edge_))
            occ, step, at, edge, row, word = occ_, step_, at_, edge_, row_, word_
            near = before > -far(k)
            if draw:
                near &= (occ > b_word[row]) | ((occ == b_word[row]) & (step > b_step[row]))
            i = np.flatnonzero(near)
            phi = before[i, None] + lat.all_log_p(word[i], at[i])
            phi[np.arange(len(i)), edge[i]] = -np.inf
            n, e = np.nonzero(np.isfinite(phi))
            p, r = phi[n, e], row[i[n]]
            u = _uniform(mix(self.keys[r] + _stream(2 * draw + 1)) + self.place[occ[i[n]]].astype(np.uint64) * _T1 + (step[i[n]] * LONGEST + e).astype(np.uint64) * _T2 + _T3)
            bound = values[draw][r]
            g = p - np.log(np.exp(np.minimum(p - bound, 700)) - np.log(u))
            queue.append({"row": r, "g": np.minimum(g, bound), "word": occ[i[n]], "step": step[i[n]], "at": at[i[n]], "edge": e, "path": np.full(len(r), draw), "index": i[n]})
        return self._results(k, paths, values, totals)

    def _results(self, k: int, paths: list[tuple], values: list[np.ndarray], totals: list[np.ndarray]) -> list[dict]:
        lat, out = self.lattices, []
        wide = [self.vocabulary.byte_id[list(chr(c).encode("utf-8", "surrogatepass"))] for c in self.fixed_char[self.fixed]]
        fixed_at = np.flatnonzero(self.fixed)
        fixed_n = np.array([len(w) for w in wide], np.int64)
        fixed_ids = np.concatenate(wide).astype(np.uint32) if wide else np.zeros(0, np.uint32)
        kappa = values[k]
        for draw in range(k):
            occ, step, at, edge = paths[draw]
            log_p = totals[draw]
            count = np.bincount(occ, minlength=len(self.word))
            count[fixed_at] = fixed_n
            base = np.cumsum(count) - count
            ids = np.zeros(int(count.sum()), np.uint32)
            ids[base[occ] + step] = lat.piece(self.word[occ], at, edge)
            ids[np.repeat(base[fixed_at] - (np.cumsum(fixed_n) - fixed_n), fixed_n) + np.arange(len(fixed_ids))] = fixed_ids
            edges = np.concatenate((base, [len(ids)]))[self.first_word]
            there = np.isfinite(values[draw])
            inclusion = -np.expm1(-np.exp(np.minimum(log_p - kappa, 700)))
            out.append({"there": there, "g": values[draw], "log_p": log_p, "inclusion": inclusion, "ids": ids, "edges": edges})
        return out


def _encode(path: str, exponent: float, k: int, seed: int, gone: str, verify: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path, exponent)
        for batch in batches:
            keys = mix(np.asarray(batch.column("__key")).astype(np.int64).view(np.uint64) + np.uint64(seed * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF))
            carried = [n for n in batch.schema.names if n not in ("__key", gone)]
            i = 0
            while i < batch.num_rows:
                texts: list[str] = []
                held = 0
                while i + len(texts) < batch.num_rows and held < BATCH_CHARS:
                    texts.append(batch.column("text")[i + len(texts)].as_py() or "")
                    held += len(texts[-1])
                n = len(texts)
                for draw, got in enumerate(Batch(vocabulary, texts, keys[i : i + n]).sample(k)):
                    rows = np.flatnonzero(got["there"])
                    raw, edges = got["ids"].astype("<u4").tobytes(), 4 * got["edges"]
                    at = pa.array(rows + i)
                    spelt = [raw[edges[r] : edges[r + 1]] for r in rows.tolist()]
                    more = {"round_trip": pa.array([decode_ids(vocabulary, x) == texts[r] for r, x in zip(rows.tolist(), spelt)], pa.bool_())} if verify else {}
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[batch.column(c).take(at) for c in carried], pa.array(np.full(len(rows), draw + 1, np.int32)), pa.array(got["log_p"][rows]), pa.array(got["g"][rows]), pa.array(got["inclusion"][rows]),
                            pa.array(spelt, pa.binary()), *more.values(),
                        ],
                        [*carried, "draw", "log_prob", "perturbed", "inclusion", "ids", *more],
                    )
                i += n

    return run


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", k: int = 2, seed: int = 42, exponent: float = 1.0, carry_text: bool = True, verify: bool = False) -> DataFrame:
    """Up to ``k`` rows for each document: ``doc_id, text, draw, log_prob, perturbed, inclusion, ids``.

    ``ids`` are little-endian unsigned 32-bit piece ids; draws are distinct segmentations in falling
    order of ``perturbed``; ``inclusion`` is the probability that a segmentation is drawn given the
    (k + 1)-th perturbed value. A text of any length is read whole; some 600 bytes a character are held for the longest
    stretch in which pieces cross every place (a run of one letter, not prose of a script without blanks). A text with fewer segmentations has as many rows. Null and empty
    text have the empty segmentation. The row's key is its id and text, so repeated rows repeat.
    Characters without a piece become their bytes. Without ``carry_text`` a digest of the text
    (``text_hash``, xxhash64) stands in its column's place; with ``verify`` each draw is decoded at once
    and ``round_trip`` says whether that gives the text.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    picked = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), F.xxhash64(F.col(id_col).cast("string"), text).alias("__key"))
    kind = docs.schema[id_col].dataType.simpleString()
    own, gone = ("text string", "text_hash") if carry_text else ("text_hash long", "text")
    return picked.mapInArrow(_encode(model_file, exponent, k, seed, gone, verify), f"doc_id {kind}, {own}, draw int, log_prob double, perturbed double, inclusion double, ids binary" + ", round_trip boolean" * verify)


def decode_ids(vocabulary: Pieces, ids: bytes) -> str:
    """The text that pieces spell; the blank before the first word is the encoder's."""
    out = b"".join(map(vocabulary.text.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
    return out[1:] if out.startswith(" ") else out


def decode(encoded: DataFrame, model_file: str, into: str = "decoded") -> DataFrame:
    """``encoded`` with the text that its ``ids`` spell."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model_file, 1.0)
        for batch in batches:
            texts = pa.array([None if x is None else decode_ids(vocabulary, x) for x in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, into])

    return encoded.mapInArrow(run, _with(encoded, into))


def _with(df: DataFrame, name: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{name}` string"])
