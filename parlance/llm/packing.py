"""Sum-of-squares packing of tokenised documents into fixed windows.

Each task packs the rows it reads, in their order. A document's ids fill whole windows first; the rest
of it goes, in one piece, to the fill level that leaves the smallest sum of squared numbers of partially
filled windows (or to a new window), which the level array tells without looking at windows. The windows that are
still open at a task's end go on in rounds: a task of the next round takes those of ``TASKS`` tasks, keeps
the first one's as they are and places the pieces of the others in the same way. What the last round leaves
open, some hundred windows of the whole input, is poured together: its pieces are cut to fill
windows, so that one padded window is left.

A packer holds at most ``MOST_OPEN`` open windows; beyond that (texts of which no two fit in a window) it pours them
together at once, which costs cuts but no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.scratch import held, materialise, ship

#: Tasks whose open windows one task of the next round takes.
TASKS = 8
MOST_OPEN = 8192
#: The normaliser and pre-tokeniser that the fast path stands for (fixed values of the tokenizer file).
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: What the fast path may hold: white space and printable characters of Latin-1, in which lower case, composition and classes are those of the tokenizer.
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xff]|<\|")
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+")


class WordEncoder:
    """Ids of texts under a tokenizer whose words are encoded one by one, with the words' ids kept.

    Gives exactly ``Tokenizer.encode(text, add_special_tokens=False).ids``. A text with characters
    beyond Latin-1, control characters or ``<|`` goes through the tokenizer as a whole, and so does every
    text if the file normalises or parts words in another way than the fast path (``fast`` is false then).
    """

    def __init__(self, path: str, most: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        told = json.loads(self.tokenizer.to_str())
        parted = told["normalizer"] == _NORMALIZER and told["pre_tokenizer"] == _PRE_TOKENIZER and told["model"].get("end_of_word_suffix") == "</w>"
        self.fast = parted and all(t["content"].startswith("<|") for t in told["added_tokens"])
        self.known: dict[str, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words, encoded together and parted at the ids that end a word."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
        cut = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else []
        if len(cut) != len(words):
            return {w: np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words}
        raw, at = ids.astype("<u4").tobytes(), [0, *(4 * np.asarray(cut)).tolist()]
        return {w: raw[at[i] : at[i + 1]] for i, w in enumerate(words)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        parts: dict[int, list[str]] = {}
        slow = [i for i, t in enumerate(texts) if not self.fast or _OTHER.search(t)]
        for i, e in zip(slow, self.tokenizer.encode_batch([texts[i] for i in slow], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4").tobytes()
        whole = set(slow)
        new: dict[str, None] = {}
        for i, t in enumerate(texts):
            if i not in whole:
                parts[i] = words = _PART.findall(t.lower())
                new.update(dict.fromkeys(set(words).difference(self.known)))
        words = list(new)
        learnt: dict[str, bytes] = {}
        for k in range(0, len(words), 5000):
            learnt |= self._learn(words[k : k + 5000])
        if len(self.known) + len(learnt) <= self.most:
            self.known |= learnt
            ids = self.known.__getitem__
        else:
            both = {**learnt}
            known = self.known
            ids = lambda w: known.get(w) or both[w]
        for i, ws in parts.items():
            out[i] = b"".join(map(ids, ws))
        return out


def encoder(path: str) -> WordEncoder:
    """The process's encoder for a tokenizer file."""
    kept = held("packing")
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


class Packer:
    """Places pieces into windows of ``size`` ids; ``place`` and ``flush`` give finished windows.

    A window is a list of pieces (key, start, ids, doc_tokens), ids as 4-byte words.
    """

    def __init__(self, size: int, most_open: int = MOST_OPEN):
        self.size, self.most_open = size, most_open
        self.levels = np.zeros(size + 1, np.int64)  # open windows by fill
        self.open: dict[int, list[list]] = {}

    def choose(self, n: int) -> int:
        """Fill level for a piece of ``n`` ids; 0 for a new window. Ties go to the fullest."""
        levels = self.levels
        at = np.flatnonzero(levels[1 : self.size - n + 1]) + 1
        fresh = 2 * int(levels[n]) + 1
        if not len(at):
            return 0
        cost = 2 * (levels[at + n] - levels[at]) + 2
        if at[-1] + n == self.size:
            cost[-1] = 1 - 2 * levels[at[-1]]
        best = len(at) - 1 - int(np.argmin(cost[::-1]))
        return int(at[best]) if cost[best] <= fresh else 0

    def place(self, key, ids: bytes) -> Iterator[list]:
        total = len(ids) // 4
        whole = total - total % self.size
        for a in range(0, whole, self.size):
            yield [(key, a, ids[4 * a : 4 * (a + self.size)], total)]
        if total > whole:
            yield from self.put((key, whole, ids[4 * whole :], total))

    def put(self, piece: tuple) -> Iterator[list]:
        """Place a piece of less than a window."""
        n = len(piece[2]) // 4
        at = self.choose(n)
        window = []
        if at:
            window = self.open[at].pop()
            self.levels[at] -= 1
        window.append(piece)
        if at + n == self.size:
            yield window
            return
        self.adopt(window, at + n)
        if int(self.levels.sum()) > self.most_open:
            yield from self.flush(last=False)

    def adopt(self, window: list, fill: int) -> None:
        """Take an open window as it is."""
        self.open.setdefault(fill, []).append(window)
        self.levels[fill] += 1

    def left(self) -> list[list]:
        """The open windows, fullest first."""
        return [w for at in sorted(self.open, reverse=True) for w in self.open[at]]

    def flush(self, last: bool = True) -> Iterator[list]:
        """Pour the open windows into each other; the one that stays partial is closed if ``last``."""
        pieces = [p for w in self.left() for p in w]
        self.levels[:] = 0
        self.open = {}
        window: list = []
        free = self.size
        for key, start, ids, total in pieces:
            while ids:
                take = min(free, len(ids) // 4)
                window.append((key, start, ids[: 4 * take], total))
                start, ids, free = start + take, ids[4 * take :], free - take
                if not free:
                    yield window
                    window, free = [], self.size
        if window and last:
            yield window
        elif window:
            self.levels[self.size - free] = 1
            self.open = {self.size - free: [window]}


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_COLUMNS = "doc_id {0}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _narrow(ids: bytes) -> bytes:
    """Ids as 16-bit words if all of them fit, for the way to the next round."""
    wide = np.frombuffer(ids, "<u4")
    return wide.astype("<u2").tobytes() if int(wide.max()) < 1 << 16 else ids


def _wide(ids: bytes, length: int) -> bytes:
    return ids if len(ids) == 4 * length else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def _rows(windows: Iterable[list], first: int, kind: pa.DataType, task: int, opened: bool) -> tuple[pa.RecordBatch, int]:
    """The pieces of windows numbered from ``first``; those of open windows with their ids."""
    flat: list[tuple] = []
    for window in windows:
        at = 0
        for key, start, ids, total in window:
            flat.append((key, start, len(ids) // 4, zlib.crc32(ids), total, first, at, _narrow(ids) if opened else None))
            at += len(ids) // 4
        first += 1
    cols = list(zip(*flat)) if flat else [[]] * 8
    made = [pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:7]], pa.array(np.full(len(flat), task, np.int64)), pa.array(cols[7], pa.binary())]
    return pa.RecordBatch.from_arrays(made, [*_NAMES, "task", "ids"]), first


def _pack(path: str, size: int, end_id: int, texts_bytes: int = 4 << 20):
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, enc = Packer(size), encoder(path)
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        number = task << 36
        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            i = 0
            while i < batch.num_rows:
                n, size_ = 0, 0
                texts = []
                while i + n < batch.num_rows and size_ < texts_bytes:
                    t = batch.column("text")[i + n].as_py() or ""
                    texts.append(t)
                    size_ += len(t)
                    n += 1
                keys = batch.column("doc_id").slice(i, n).to_pylist()
                done = [w for key, ids in zip(keys, enc.encode(texts)) for w in packer.place(key, ids + tail)]
                out, number = _rows(done, number, kind, task, False)
                yield out
                i += n
        left = packer.left()
        for k in range(0, len(left), 1024):
            out, number = _rows(left[k : k + 1024], number, kind, task, True)
            yield out

    return run


def _go_on(size: int, level: int, last: bool):
    """Open windows of tasks, sorted by the task they go to, to finished ones and those that are open still."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, task, first, number = Packer(size), None, None, 0
        window: list[tuple] = []
        now = None
        kind = None

        def close() -> Iterator[list]:
            """Give the collected window to the packer."""
            if not window:
                return
            if now[1] == first:
                packer.adopt(list(window), sum(len(p[2]) for p in window) // 4)
            else:
                for piece in window:
                    yield from packer.put(piece)
            window.clear()

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal number
            out, number = _rows(packer.flush() if last else (), number, kind, task, False)
            yield out
            out, number = _rows(() if last else packer.left(), number, kind, task, True)
            yield out

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            done: list[list] = []
            for r in batch.to_pylist():
                at = (r["to"], r["task"], r["sequence_id"])
                if at != now:
                    done += close()
                    if r["to"] != task:
                        if task is not None:
                            out, number = _rows(done, number, kind, task, False)
                            yield out
                            done = []
                            yield from finish()
                        packer, task, first, number = Packer(size), r["to"], r["task"], (level << 58) + (r["to"] << 36)
                    now = at
                window.append((r["doc_id"], r["start"], _wide(r["ids"], r["length"]), r["doc_tokens"]))
            out, number = _rows(done, number, kind, task or 0, False)
            yield out
        if task is not None:
            out, number = _rows(close(), number, kind, task, False)
            yield out
            yield from finish()

    return run


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 2) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its text's ids and ``end_id``; null text is empty, so it is one id. Repeated rows
    and null or repeated ids are packed each on its own. Sequence ids are unique: the round and the task
    stand in the upper bits. An empty table has no pieces. Pieces are written once, so a retried
    task cannot mix two orders of its rows.
    """
    ship(docs.sparkSession)
    columns = _COLUMNS.format(docs.schema[id_col].dataType.simpleString())
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"{columns}, task long, ids binary"
    made = materialise(picked.mapInArrow(_pack(tokenizer_file, size, end_id), schema), "pieces")
    done = made.filter("ids IS NULL").select(_NAMES)
    level = 0
    while True:
        level += 1
        opened = made.filter("ids IS NOT NULL").withColumn("to", F.floor(F.col("task") / TASKS).cast("long"))
        last = (made.agg(F.max("task")).first()[0] or 0) < TASKS
        made = opened.repartition("to").sortWithinPartitions("to", "task", "sequence_id", "offset").mapInArrow(_go_on(size, level, last), schema)
        if last:
            return done.unionByName(made.select(_NAMES))
        made = materialise(made, "pieces")
        done = done.unionByName(made.filter("ids IS NULL").select(_NAMES))
