"""Benchmark decontamination by winnowing.

The fingerprint of a window of words is the least hash of the k-grams in it. It depends on the window
alone, so a window that a document shares with a test item has the same fingerprint on both sides, and
looking up fingerprints finds every shared window. A hit is then extended from its k-gram to the whole
window by joining on the digest of all its words as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import one_row_per_doc, settled
from .words import WordNumbers, alnum_words, chunks, grams, mixed, slices

WINDOW = 10
GRAM = 5
FILTER_BITS = 1 << 23

WINDOWS = "owner long, size int, at int, print long, digest long, words int"


def winnowed(words: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint of each window of `size` words."""
    k = min(GRAM, size)
    g = grams(words, k, salt=size)
    count = max(0, len(words) - size + 1)
    least = g[:count].copy()
    for step in range(1, size - k + 1):
        np.minimum(least, g[step : step + count], out=least)
    return least


def digests(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Digest of the windows of `size` words that begin at `at`."""
    out = np.full(len(at), size, dtype=np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(3) + words[at + k])
    return out


def filter_bit(prints: np.ndarray) -> np.ndarray:
    return (mixed(prints + np.uint64(1)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _rows(owner, size, at, prints, digest, words) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(owner, pa.int64()),
            pa.array(size, pa.int32()),
            pa.array(at, pa.int32()),
            pa.array(prints.view(np.int64), pa.int64()),
            pa.array(digest.view(np.int64), pa.int64()),
            pa.array(words, pa.int32()),
        ],
        names=["owner", "size", "at", "print", "digest", "words"],
    )


def _windows(sizes: list[int], bits: bytes | None):
    """Windows of whole texts. For items (no `bits`): all, by the item's own size. For documents: those
    of each size whose fingerprint is in the filter, and one row of size 0 with the word count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        held = None if bits is None else np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)
        for batch in slices(batches):
            owners, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                found: list[list] = [[], [], [], [], [], []]
                for owner, text in zip(owners[a:b], texts[a:b]):
                    words = numbers.of(alnum_words(text))
                    n = len(words)
                    if held is not None:
                        for part, v in zip(found, (owner, 0, 0, 0, 0, n)):
                            part.append(np.array([v]))
                    for size in ([min(WINDOW, n)] if n else []) if held is None else sizes:
                        least = winnowed(words, size)
                        at = np.arange(len(least)) if held is None else np.flatnonzero(held[filter_bit(least)])
                        if len(at):
                            for part, v in zip(found[:2], (owner, size)):
                                part.append(np.full(len(at), v))
                            found[2].append(at)
                            found[3].append(least[at])
                            found[4].append(digests(words, at, size))
                            found[5].append(np.full(len(at), n))
                if found[0]:
                    o, s, p, w = (np.concatenate(found[k]).astype(np.int64) for k in (0, 1, 2, 5))
                    yield _rows(o, s, p, *(np.concatenate([x.astype(np.uint64) for x in found[k]]) for k in (3, 4)), w)

    return run


def _partial_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(FILTER_BITS, dtype=bool)
    for batch in batches:
        held[filter_bit(batch.column(0).to_numpy().view(np.uint64))] = True
    words = np.packbits(held).view(">i8")
    at = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays(
        [pa.array(at, pa.int32()), pa.array(words[at].astype(np.int64), pa.int64())], names=["at", "bits"]
    )


def fingerprint_filter(windows: DataFrame) -> bytes:
    """A bitmap of `FILTER_BITS` bits of all fingerprints: one megabyte whatever the benchmark's size.

    When a benchmark fills it, it lets more windows pass to the join, which decides alone.
    """
    parts = windows.select("print").mapInArrow(_partial_filter, "at int, bits long")
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for r in parts.groupBy("at").agg(F.bit_or("bits").alias("bits")).collect():
        bits[r["at"]] = r["bits"]
    return bits.astype(">i8").tobytes()


def _covered(pieces):
    """Words inside any of the sorted (at, size) windows."""
    ends = lambda acc, p: F.greatest(acc["end"], p["at"] + p["size"])
    return F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(
            ends(acc, p).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), p["at"] + p["size"] - F.greatest(acc["end"], p["at"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids): how far each document repeats test items.

    `items` has item_id and text. Words are runs of 0-9, A-Z read as a-z, and non-ASCII characters. An
    item's windows are its runs of `WINDOW` words, or the whole item if it is shorter but has words. A
    document word is hit if it lies inside a window that occurs in the document; `item_ids` are the
    items with such windows, sorted as strings.

    A null or empty text has no words. Rows of items without an item_id are left out; items of equal
    words are looked up once and reported all. Repeated doc_ids count as one document
    (``one_row_per_doc``), rows without a doc_id are left out, an empty `docs` gives an empty table, an
    empty `items` no hits. Other columns are not read.
    """
    classes = settled(
        items.where(F.col("item_id").isNotNull())
        .groupBy(F.coalesce("text", F.lit("")).alias("text"))
        .agg(F.min("item_id").alias("item"), F.collect_set("item_id").alias("item_ids")),
        "items",
    )
    windows = settled(
        classes.select("item", "text")
        .mapInArrow(_windows([], None), WINDOWS)
        .select(F.col("owner").alias("item"), "size", "print", "digest")
        .distinct(),
        "windows",
    )
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    found = settled(
        one_row_per_doc(docs).select("doc_id", "text").mapInArrow(_windows(sizes, fingerprint_filter(windows)), WINDOWS),
        "prints",
    )
    keys = ["print", "digest", "size"]
    hits = settled(
        found.where("size > 0")
        .join(settled(windows.select(*keys).distinct(), "keys"), keys)
        .select(F.col("owner").alias("doc_id"), "at", *keys),
        "hits",
    )
    places = hits.groupBy("doc_id").agg(
        _covered(F.sort_array(F.collect_set(F.struct("at", "size")))).alias("n_hit")
    )
    named = (
        hits.select("doc_id", *keys).distinct()
        .join(windows, keys).select("doc_id", "item").distinct()
        .join(classes.select("item", "item_ids"), "item")
        .select("doc_id", F.explode("item_ids").alias("item_id"))
        .groupBy("doc_id").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    return (
        found.where("size = 0").select(F.col("owner").alias("doc_id"), F.col("words").cast("long").alias("n_words"))
        .join(places.join(named, "doc_id"), "doc_id", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        )
    )
