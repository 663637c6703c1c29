"""Words of texts as 64-bit numbers in numpy arrays, for operators that work on word sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_CHARS = 2_000_000
SLICE_ROWS = 1500
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

#: For words of 0-9, a-z and non-ASCII characters: all other ASCII bytes become spaces, A-Z become a-z.
ALNUM = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


class WordNumbers(dict):
    """Hash of each word, kept for the next time; emptied beyond `room` words."""

    def __init__(self, room: int = 500_000):
        super().__init__()
        self.room = room

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.room:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX[1])
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def grams(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of `size` words; runs of different sizes or salts differ."""
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(count, (size * MIX[0] + salt * MIX[1]) % 2**64, dtype=np.uint64)
    for k in range(size):
        out = mixed(out ^ words[k : k + count]) + np.uint64(MIX[0])
    return out


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` characters, one text at least."""
    begin = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= limit:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows: a task turns no more of its rows to objects at once."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def space_words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8").lower().split()


def alnum_words(text: str | None) -> list[bytes]:
    """Runs of 0-9, A-Z as a-z, and non-ASCII characters."""
    return (text or "").encode("utf-8").translate(ALNUM).split()
