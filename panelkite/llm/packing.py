"""Bounded-space online packing of token sequences.

Every partition keeps a fixed number of open windows. A piece goes into the window that it leaves
fullest; when it fits in none, the fullest window is closed and a new one opened. Leftover windows are
merged at the end: within the partition first, then over groups of partitions. Texts are encoded once;
a task holds its open windows, one batch of texts and a bounded cache of words.
"""

from __future__ import annotations

import re
import struct
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import one_row_per_doc, settled
from .words import chunks, slices

WINDOW = 4096
END_ID = 2

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("part", pa.int64()),
        ("closed", pa.bool_()),
    ]
)
DDL = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "part long, closed boolean"
)


class Known(dict):
    """What `make` gives for a key; beyond `room` keys the older ones go, unless asked for again."""

    def __init__(self, make: Callable, room: int):
        super().__init__()
        self.make, self.room, self.old = make, room, {}

    def __missing__(self, key):
        found = self.old.pop(key, None)
        self[key] = found = self.make(key) if found is None else found
        return found

    def turn(self) -> None:
        if len(self) > self.room:
            self.old = dict(self)
            self.clear()


class WordIds:
    """Token ids of texts as little-endian unsigned 32-bit bytes, with a cache by word.

    The vocabulary treats A-Z as a-z, drops white space and merges nothing across it, so the ids of a
    text are those of its words between ASCII white space. A word of printable ASCII and Latin letters
    is in normal form already; its parts (`PARTS`, as in the tokenizer file) go straight to the merge
    table. Any other word, and any text that may hold a special token, goes through the whole
    tokenizer. The caches have two generations of at most `room` words.
    """

    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
    SPECIAL = b"<|"
    MARKS = b".,;:!?"

    def __init__(self, path: str, room: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # printable characters for all bytes, as byte-level vocabularies write them
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}
        self.words = Known(self._word, room)
        self.parts = Known(self._part, room)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        mapped = part if part.isascii() else part.encode("utf-8").decode("latin-1").translate(self.letters)
        tokens = self.model.tokenize(mapped)
        if len(tokens) == 1:
            return tokens[0].id.to_bytes(4, "little")
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters only: one part
            return self.parts[word.decode("ascii")]
        head = word[:-1]
        if head.isalpha() and word[-1] in self.MARKS:  # and a mark behind them, which is a part too
            return self.parts[head.decode("ascii")] + self.parts[chr(word[-1])]
        text = word.decode("utf-8")
        if self.PLAIN.fullmatch(text):
            return b"".join(map(self.parts.__getitem__, self.PARTS.findall(text.lower())))
        return self._whole(text)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text; `texts` are bounded in size, as caches are cut down between calls only."""
        self.words.turn()
        self.parts.turn()
        known = self.words.__getitem__
        for text in texts:
            raw = (text or "").encode("utf-8")
            if self.SPECIAL in raw:
                yield self._whole(text)
            else:
                yield b"".join(map(known, raw.lower().split()))


def worker_ids(path: str) -> WordIds:
    """The encoder of this Python process: the tasks that Spark gives it share its bounded caches.

    It hangs on the `tokenizers` module, as the code of this package comes anew with every task.
    """
    import tokenizers

    encoders = vars(tokenizers).setdefault("_encoders_by_path", {})
    if path not in encoders:
        encoders[path] = WordIds(path)
    return encoders[path]


class OpenWindows:
    """The open windows of a partition, by free room. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, room: int, window: int):
        self.room, self.window = room, window
        self.free: list[tuple[int, int]] = []  # sorted (free ids, window number)
        self.held: dict[int, list] = {}
        self.opened = 0

    def place(self, piece: tuple) -> list | None:
        """Put a piece of at most a window's length; the pieces of a window that this closed."""
        size, closed = len(piece[2]) // 4, None
        k = bisect_left(self.free, (size, -1))
        if k < len(self.free):
            free, number = self.free.pop(k)
        else:
            if len(self.free) >= self.room:
                closed = self.held.pop(self.free.pop(0)[1])
            free, number = self.window, self.opened
            self.held[number] = []
            self.opened += 1
        self.held[number].append(piece)
        if free == size:
            return self.held.pop(number) if closed is None else closed + [None] + self.held.pop(number)
        insort(self.free, (free - size, number))
        return closed

    def leftovers(self) -> list:
        return [p for _, number in self.free for p in self.held[number]]


def cut(pieces: list, lengths: Callable[[int], int]) -> Iterator[list]:
    """Pieces end to end, cut into windows; `lengths` gives the next window's length for what is left."""
    left = sum(len(p[2]) // 4 for p in pieces)
    now, need = [], lengths(left)
    for doc, start, ids, total in pieces:
        while ids:
            head = ids[: 4 * need]
            now.append((doc, start, head, total))
            took = len(head) // 4
            start, ids, need, left = start + took, ids[4 * need :], need - took, left - took
            if not need:
                yield now
                now, need = [], lengths(left) if left else 0
    if now:
        yield now


def _table(windows: list[tuple[int, list, bool]], part: int) -> pa.RecordBatch:
    rows = []
    for number, pieces, closed in windows:
        offset = 0
        for doc, start, ids, total in pieces:
            rows.append((doc, start, len(ids) // 4, ids, total, number, offset, part, closed))
            offset += len(ids) // 4
    columns = list(zip(*rows)) or [[]] * len(PIECES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, PIECES)], schema=PIECES)


def _pack_partition(path: str, window: int, room: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        words, windows, number = worker_ids(path), OpenWindows(room, window), part << 32
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in slices(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                done = []
                for doc, tokens in zip(ids[a:b], words.encode(texts[a:b])):
                    tokens += end
                    total = len(tokens) // 4
                    for start in range(0, total, window):
                        piece = (doc, start, tokens[4 * start : 4 * (start + window)], total)
                        closed = windows.place(piece)
                        while closed:
                            stop = closed.index(None) if None in closed else len(closed)
                            done.append((number, closed[:stop], True))
                            number += 1
                            closed = closed[stop + 1 :]
                yield _table(done, part)
        rest = []
        for pieces in cut(windows.leftovers(), lambda _: window):
            full = sum(len(p[2]) for p in pieces) == 4 * window
            rest.append((number, pieces, full))
            number += 1
        yield _table(rest, part)

    return pack


def _merge_group(window: int):
    def length(left: int) -> int:
        return window if left >= window else 1 << (left.bit_length() - 1)

    def merge(key, group):
        group = group.sort_by([("part", "ascending"), ("offset", "ascending")])
        columns = [group.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")]
        number = -(key[0].as_py() << 32) - 1
        windows = [(number - k, pieces, True) for k, pieces in enumerate(cut(list(zip(*columns)), length))]
        return pa.Table.from_batches([_table(windows, -1)])

    return merge


def pack(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, open_windows: int = 256, merge_parts: int = 256
) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of packed sequences.

    A document is its token ids by the tokenizer file `tokenizer` and the end id; it is cut only into
    whole windows and a rest, and where leftovers are merged. `ids` are little-endian unsigned 32-bit.
    Sequences have at most `window` ids. Each partition merges its leftover windows end to end, which
    leaves one short sequence; those of `merge_parts` partitions are merged likewise, and the last ids
    of a group are cut into sequences of powers of two, which need no padding.

    A null or empty text is the end id alone. Repeated doc_ids count as one document
    (``one_row_per_doc``), rows without a doc_id are left out, an empty table gives an empty one, and
    other columns are not read.
    """
    packed = settled(
        one_row_per_doc(docs).select("doc_id", "text").mapInArrow(_pack_partition(tokenizer, window, open_windows), DDL),
        "pieces",
    )
    group = F.floor(F.col("part") / merge_parts).cast("long")
    merged = packed.where("NOT closed").groupBy(group.alias("_group")).applyInArrow(_merge_group(window), DDL)
    return packed.where("closed").unionByName(merged).drop("part", "closed")

