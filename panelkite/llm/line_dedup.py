"""Line deduplication over levelled sorted runs.

A run is a table of line digests, bucketed and sorted by digest. A batch of documents is reduced to
its distinct digests, merge-anti-joined with every run, and what is left becomes a new run of level
0. When a level holds `fanout` runs they are compacted into one run of the next level, so there are
about ``fanout * log(batches)`` runs to join with, and each digest is rewritten once per level.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ASCII_SPACE, ascii_lower, one_row_per_doc, partitions_of, settled

MIN_KEY_CHARS = 10
DIGEST = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, h1, h2): each line whose key is long enough, as 128 bits of two hashes."""
    lines = docs.select("doc_id", F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc_id", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.length("key") >= MIN_KEY_CHARS).select(
        "doc_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


class LineRuns:
    """The levelled runs of one corpus, as managed tables of the session's shared warehouse."""

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None):
        self.spark = spark
        self.fanout = fanout
        self.buckets = buckets or partitions_of(spark)
        self.levels: list[list[str]] = [[]]

    @property
    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _store(self, digests: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        digests.write.bucketBy(self.buckets, *DIGEST).sortBy(*DIGEST).saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")

    def add(self, lines: DataFrame, last: bool = False) -> DataFrame:
        """Take in a batch of ``line_digests`` and return the (doc_id, pos) of its repeated lines.

        A line stays where its digest is in no run and its document has the smallest doc_id of the
        batch that holds it. Digests are counted before the shuffle, so a line of a third of all
        documents is one row per task; the lines themselves are matched by digest and document
        together. With `last`, the runs are not compacted again.
        """
        fresh = lines.groupBy(*DIGEST).agg(F.min("doc_id").alias("owner"))
        for name in self.runs:
            fresh = fresh.join(self.spark.table(name).select(*DIGEST), DIGEST, "left_anti")
        run = self._store(fresh)
        owned = self.spark.table(run).withColumnRenamed("owner", "doc_id")
        repeated = settled(lines.join(owned, ["doc_id", *DIGEST], "left_anti").select("doc_id", "pos"), "repeats")
        self.levels[0].append(run)
        if not last:
            self._compact()
        return repeated

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            names = self.levels[level]
            merged = self.spark.table(names[0])
            for name in names[1:]:
                merged = merged.unionByName(self.spark.table(name))
            run = self._store(merged.repartition(self.buckets, *DIGEST))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(run)
            self.levels[level] = []
            self._drop(names)
            level += 1

    def close(self) -> None:
        self._drop(self.runs)
        self.levels = [[]]


def without_positions(lines: Column, dropped: Column) -> Column:
    """The array `lines` without the positions of the sorted array `dropped`, in linear time."""
    before = lambda j: F.when(j == 0, F.lit(-1)).otherwise(F.get(dropped, j - 1))
    flags = F.flatten(
        F.transform(
            dropped,
            lambda p, j: F.concat(F.array_repeat(F.lit(False), p - before(j) - 1), F.array(F.lit(True))),
        )
    )
    return F.filter(lines, lambda _, i: ~F.coalesce(F.get(flags, i), F.lit(False)))


def repeated_lines(docs: DataFrame, batches: int = 4, fanout: int = 3) -> DataFrame:
    """(doc_id, pos) of every line to drop from `docs` (doc_id, text; one row per document).

    The corpus comes in `batches` of rising doc_id of about equal row counts, so "seen before"
    means "in a smaller doc_id".
    """
    spark = docs.sparkSession
    shares = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, F.lit(1000)).alias("cuts")).first().cuts or []
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + (F.col("doc_id") > cut).cast("int")
    lines = settled(line_digests(docs).withColumn("batch", batch), "lines")
    store, found = LineRuns(spark, fanout), []
    try:
        for b in range(batches):
            found.append(store.add(lines.where(F.col("batch") == b).drop("batch"), last=b == batches - 1))
    finally:
        store.close()
    repeats = found[0]
    for more in found[1:]:
        repeats = repeats.unionByName(more)
    return repeats


def dedup_lines(docs: DataFrame, batches: int = 4, fanout: int = 3) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): each document without the lines of smaller doc_ids.

    A text is split at line feeds; a null or empty text is one empty line. A line's key is the line
    without ASCII white space at its ends, A-Z lower-cased. Lines whose key has `MIN_KEY_CHARS` code
    points or more stay only in the smallest doc_id that holds the key (there, all of them stay).
    Repeated doc_ids count as one document (``one_row_per_doc``), rows without a doc_id are left out,
    and an empty table gives an empty one. Other columns are not read.
    """
    rows = one_row_per_doc(docs)
    drops = (
        repeated_lines(rows, batches, fanout).groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("drops"))
    )
    lines = rows.join(drops, "doc_id", "left").select("doc_id", text_lines(F.col("text")).alias("lines"), "drops")
    kept = F.when(F.col("drops").isNull(), F.col("lines")).otherwise(
        without_positions(F.col("lines"), F.col("drops"))
    )
    return lines.select(
        "doc_id",
        F.array_join(kept, "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )
