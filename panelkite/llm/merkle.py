"""A Merkle manifest of a table of documents.

The leaves of a language stand in a row. Each aligned block of them keeps a level as one string of hex
digests: parents are the digests of fixed-width substrings, and the siblings of a node are the two
substrings that flank it in its run. The roots of the blocks are the next row, until one is left; the
languages' roots are a last row, treated alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import numbered
from .shared import ascii_lower, settled

FANOUT = 8
LEVELS = 3  # levels of a block, which holds FANOUT ** LEVELS nodes
BLOCK = FANOUT**LEVELS
HEX = 64
RUN = FANOUT * HEX

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    """Digest of a row with `text` in the place of its text."""
    return digest(F.concat(*[_field(text if name == "text" else F.col(name)) for name in FIELDS]))


def tampered_rows() -> Column:
    """The rows whose text is tampered with: 3 divides the crc32 of the decimal doc_id."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 3 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang_key, leaf, found): the leaf, and the one that is found later.

    `lang_key` is not null and sorts as the language does, null first.
    """
    changed = F.when(tampered_rows(), ascii_lower(F.col("text"))).otherwise(F.col("text"))
    same = F.col("text").eqNullSafe(changed)
    return docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("lang_key"),
        leaf_of(F.col("text")).alias("leaf"),
        F.when(~same, leaf_of(changed)).alias("found"),
    )


def _parents(level: Column) -> Column:
    """The next level: digests of the runs of `level`, one after another."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / RUN).cast("int"))
    return F.array_join(F.transform(runs, lambda i: digest(F.substring(level, i * RUN + 1, F.lit(RUN)))), "")


def _siblings(level: Column, node: Column) -> Column:
    """The parts of `level` that flank `node` in its run."""
    begin = F.floor(node / FANOUT).cast("int") * RUN + 1
    own = (node % FANOUT).cast("int") * HEX
    return F.struct(
        F.substring(level, begin, own).alias("left"),
        F.substring(level, begin + own + HEX, F.lit(RUN - HEX) - own).alias("right"),
    )


def _levels(total: Column) -> Column:
    """How many levels of a block a row of `total` nodes needs."""
    return reduce(lambda a, b: a + b, [(total > FANOUT**k).cast("int") for k in range(LEVELS)])


def blocks(nodes: DataFrame, group: str, carried: tuple[str, ...], label: str) -> DataFrame:
    """Aligned blocks of (group, pos, total, digest, *carried): their levels, root and carried values.

    Blocks are bounded, so a row of any length is spread over as many tasks as it fills.
    """
    item = F.struct("pos", "digest", *carried)
    grouped = nodes.groupBy(group, F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        F.first("total").alias("total"), F.array_sort(F.collect_list(item)).alias("items")
    )
    depth = _levels(F.col("total"))
    out = grouped.select(
        group, "block", "total", "items.pos", *[f"items.{c}" for c in carried], depth.alias("depth"),
        F.array_join("items.digest", "").alias("level0"),
    )
    for k in range(LEVELS):
        up = F.when(F.col("depth") > k, _parents(F.col(f"level{k}"))).otherwise(F.col(f"level{k}"))
        out = out.withColumn(f"level{k + 1}", up)
    return settled(out.withColumnRenamed(f"level{LEVELS}", "root"), label)


def paths(
    built: DataFrame, group: str, above: DataFrame | None, carried: tuple[str, ...], kept: tuple[str, ...] = ()
) -> DataFrame:
    """(group, *kept, pos, path, digest, *carried) of the nodes in `built`: their siblings up to the last root.

    `above` has (group, pos, path) for the roots of the blocks, whose paths are put behind. `kept` are
    further columns of `built`.
    """
    rows = built
    if above is None:
        rows = rows.withColumn("upper", F.array().cast("array<struct<left:string,right:string>>"))
    else:
        upper = above.select(group, F.col("pos").alias("block"), F.col("path").alias("upper"))
        rows = rows.join(upper, [group, "block"])

    def one(i: Column) -> Column:
        steps = [_siblings(F.col(f"level{k}"), F.floor(i / FANOUT**k)) for k in range(LEVELS)]
        return F.struct(
            F.get("pos", i).alias("pos"),
            F.concat(F.slice(F.array(*steps), F.lit(1), F.col("depth")), F.col("upper")).alias("path"),
            F.substring(F.col("level0"), i * HEX + 1, F.lit(HEX)).alias("digest"),
            *[F.get(c, i).alias(c) for c in carried],
        )

    places = F.sequence(F.lit(0), F.size("pos") - 1)
    return rows.select(group, *kept, F.inline(F.transform(places, one)))


def tree(nodes: DataFrame, group: str, carried: tuple[str, ...], label: str) -> list[DataFrame]:
    """The blocks of each round over (group, pos, total, digest, *carried), the last with one block a group."""
    rounds: list[DataFrame] = []
    while True:
        built = blocks(nodes, group, () if rounds else carried, f"{label}-{len(rounds)}")
        rounds.append(built)
        if built.where(F.col("block") > 0).isEmpty():
            return rounds
        width = F.ceil(F.col("total") / BLOCK).cast("long")
        nodes = built.select(
            group, F.col("block").alias("pos"), width.alias("total"), F.col("root").alias("digest")
        )


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row of `docs`.

    Nulls in any column count as `-` in the leaf; a null lang is a language of its own, before the
    others; a null doc_id comes before the others and is not tampered with. Rows of equal doc_id stand
    in the order of their leaves, and equal rows are leaves of their own, interchangeable. Empty and very
    long texts are hashed whole. Columns other than the five are ignored. An empty table gives no rows.
    """
    rows = settled(leaves(docs), "leaves")
    placed = numbered(rows, "lang_key", ["doc_id", "leaf"], "leaf-order").withColumnRenamed("leaf", "digest")
    rounds = tree(placed, "lang_key", ("doc_id", "found"), "lang-tree")
    ends = rounds[-1].select(F.lit("all").alias("whole"), "lang_key", F.col("root").alias("digest"))
    tops = tree(numbered(ends, "whole", ["lang_key"], "lang-order"), "whole", ("lang_key",), "top-tree")

    above = None
    for built in reversed(tops[1:]):
        above = paths(built, "whole", above, ())
    langs = paths(tops[0], "whole", above, ("lang_key",)).join(tops[-1].select("whole", "root"), "whole")
    langs = settled(langs.withColumnRenamed("digest", "subroot"), "lang-paths")

    above = langs.select("lang_key", F.lit(0).cast("long").alias("pos"), "path")
    for built in reversed(rounds[1:]):
        above = paths(built, "lang_key", above, ())
    first = rounds[0].drop("root").join(langs.select("lang_key", "subroot", "root"), "lang_key")
    found = paths(first, "lang_key", above, ("doc_id", "found"), ("subroot", "root"))

    folded = F.aggregate(
        "path", F.coalesce("found", "digest"), lambda node, s: digest(F.concat(s["left"], node, s["right"]))
    )
    proof = digest(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""))
    out = found.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
