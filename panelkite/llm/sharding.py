"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in blocks (by a hash of what they hold). How many rows of block b go to shard s is drawn
first, exactly as a uniform shuffle of all rows would deal them: a multivariate hypergeometric
matrix with the block sizes as row sums and the shard sizes as column sums. Then each block permutes
its own rows, deals them out by the matrix, and every shard permutes what it got.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions_of

OUTPUT = ["shard", "slot"]


def shard_sizes(rows: int, shards: int) -> list[int]:
    """`rows` in `shards` parts that differ by one at most."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` balls are good, without replacement.

    Inversion from the mode outwards: the probabilities of neighbours have simple ratios, so the
    weights relative to the mode need no factorials, at any size. Weights below 1e-18 of the mode's
    end the walk; it takes a few standard deviations of steps.
    """
    low, high = max(0, drawn - bad), min(drawn, good)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    up, down = [1.0], []
    k, w = mode, 1.0
    while k < high and w > 1e-18:
        w *= (good - k) * (drawn - k) / ((k + 1) * (bad - drawn + k + 1))
        up.append(w)
        k += 1
    k, w = mode, 1.0
    while k > low and w > 1e-18:
        w *= k * (bad - drawn + k) / ((good - k + 1) * (drawn - k + 1))
        down.append(w)
        k -= 1
    u = rng.random() * math.fsum((*up, *down))
    for i, w in enumerate(up):
        if u < w:
            return mode + i
        u -= w
    for i, w in enumerate(down):
        if u < w:
            return mode - 1 - i
        u -= w
    return mode


def deal(block_sizes: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """The communication matrix: rows of block b that go to shard s."""
    rng, left, matrix = random.Random(seed), list(sizes), []
    for n in block_sizes:
        row, rest = [], sum(left)
        for s, room in enumerate(left):
            rest -= room
            k = hypergeometric(rng, room, rest, n)
            row.append(k)
            n -= k
        left = [a - b for a, b in zip(left, row)]
        matrix.append(row)
    return matrix


def _draw(seed: int, step: str, keys: list[Column]) -> Column:
    return F.xxhash64(F.lit(f"{seed}/{step}"), *keys)


def exact_shuffle(
    rows: DataFrame, keys: list[str], shards: int = 8, seed: int = 17, blocks: int | None = None
) -> DataFrame:
    """`rows` with `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard).

    `keys` tell rows apart; rows equal in all keys are interchangeable, and each gets its own slot.
    Nulls are values like others. Shard sizes differ by one at most, and every assignment is equally
    likely over the seeds. Input columns called shard or slot are replaced. An empty table gives an
    empty one.

    There are as many `blocks` as shuffle partitions unless given: the driver holds one count for
    each block, and the matrix of blocks x shards. Inside a shard the second permutation is cut at
    the leading bits of its random order, so no task sorts a whole shard. Rows are shuffled twice.
    """
    spark = rows.sparkSession
    blocks = blocks or partitions_of(spark)
    rows = rows.drop(*[c for c in OUTPUT if c in rows.columns])
    cols = [F.col(k) for k in keys]
    placed = rows.withColumn("_block", F.pmod(_draw(seed, "block", cols), F.lit(blocks)).cast("int"))
    counts = {r._block: r["count"] for r in placed.groupBy("_block").count().collect()}
    sizes = [counts.get(b, 0) for b in range(blocks)]
    matrix = deal(sizes, shard_sizes(sum(sizes), shards), seed)
    ends = [(b, [sum(row[: s + 1]) for s in range(shards)]) for b, row in enumerate(matrix)]
    plan = spark.createDataFrame(ends, "_block int, _ends array<long>")

    local = Window.partitionBy("_block").orderBy(_draw(seed, "local", cols), *cols)
    dealt = (
        placed.withColumn("_rank", F.row_number().over(local))
        .join(plan, "_block")
        .withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))))
        .drop("_block", "_rank", "_ends")
    )

    width = max(1, blocks // shards)
    order = _draw(seed, "shard", cols)
    part = F.floor((order / F.lit(2.0**63) + 1) / 2 * width).cast("int")
    dealt = dealt.withColumn("_order", order).withColumn("_part", F.least(part, F.lit(width - 1)))
    within = dealt.withColumn(
        "_at", F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_order", *cols))
    )
    fill: dict[int, list[int]] = {s: [0] * width for s in range(shards)}
    for r in dealt.groupBy("shard", "_part").count().collect():
        fill[r.shard][r._part] = r["count"]
    starts = [(s, p, sum(fill[s][:p])) for s in fill for p in range(width)]
    offsets = spark.createDataFrame(starts, "shard int, _part int, _start long")
    return (
        within.join(offsets, ["shard", "_part"])
        .withColumn("slot", (F.col("_start") + F.col("_at") - 1).cast("long"))
        .select(*rows.columns, *OUTPUT)
    )
