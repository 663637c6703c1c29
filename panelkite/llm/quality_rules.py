"""Quality rules with cutoffs that follow the data, from mergeable quantile sketches.

Statistics of a text are compared with fences of its own language and source. A fence comes from the
quartiles in a sketch of all documents of that group; sketches of small groups are merged into that of
their language, and those of small languages into one of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settled

SYMBOLS = "#*$%&|<>"
SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = (30, 100)

MIN_GROUP = 100  # documents for which a group's own sketch is used
FENCE = 3.0  # quartile distances beyond the upper quartile
#: Distance that a fence keeps from the upper quartile even where the quartiles are equal, so that a
#: group in which a flaw is rare does not lose texts with a trace of it.
SLACK = {"symbol_share": 0.05, "dup_line_share": 0.3, "repeat_share": 0.3, "word_length": 3.0}

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _paired(hashes: Column, step: int) -> Column:
    """Hash of each value with the one `step` places on; as many fewer values."""
    return F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - step, F.lit(0))),
        lambda h, i: F.xxhash64(h, F.get(hashes, i + step)),
    )


def _repeated_words(windows: Column) -> Column:
    """Words in windows of WINDOW words that come twice or more, from the windows' hashes.

    Sorted (hash, place) pairs put equal windows side by side; the places of those that have an equal
    neighbour are sorted again and the lengths that they cover are added up.
    """
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    twice = F.filter(
        F.transform(
            F.arrays_zip(
                pairs.alias("p"),
                F.concat(F.array(F.lit(None)), pairs).alias("q"),
                F.concat(F.slice(pairs, 2, F.size(pairs)), F.array(F.lit(None))).alias("r"),
            ),
            lambda t: F.when(same(t["p"], t["q"]) | same(t["p"], t["r"]), t["p"]["i"]),
        ),
        lambda i: i.isNotNull(),
    )
    zero = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        F.array_sort(twice),
        zero,
        lambda acc, i: F.struct(
            i.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["at"])).cast("long").alias("n")
        ),
        lambda acc: acc["n"],
    )


def with_stats(docs: DataFrame) -> DataFrame:
    """`docs` with the columns STATS of its whole texts, as longs; a null text counts as empty.

    Words are runs without ASCII white space. word_chars: code points in words. n_symbols: characters
    of SYMBOLS. n_dup_lines: lines with a word that equal an earlier line. n_repeat_words: words inside
    windows of WINDOW words that come at least twice, the first included. Input columns of these names
    are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.withColumn("_words", F.filter(F.split(text, SPACES), lambda w: w != "")).withColumn(
        "_lines", F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    )
    counted = (
        lines.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
        .drop("_words", "_lines")
    )
    for step in (1, 2, 4):  # windows of 2, 4 and 8 words
        counted = counted.withColumn("_h", _paired(F.col("_h"), step))
    repeats = F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.lit(0).cast("long")).otherwise(
        _repeated_words(F.col("_h"))
    )
    return counted.withColumn("n_repeat_words", repeats).drop("_h")


def base_failed() -> Column:
    share, whole = MAX_REPEATED
    return (F.col("n_words") < MIN_WORDS) | (whole * F.col("n_repeat_words") > share * F.col("n_words"))


def measures() -> dict[str, Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    }


def fences(stats: DataFrame) -> DataFrame:
    """One row for each (lang, source): the upper fence of each measure, as `fence_<measure>`.

    One sketch of each measure is built for a group where its rows are, and merged in the shuffle;
    languages and the whole corpus come from merging those sketches, not from the rows again. Groups
    without a language or source are groups like others.
    """
    names = list(measures())
    sketches = settled(
        stats.where(~base_failed()).select("lang", "source", *(c.alias(k) for k, c in measures().items()))
        .groupBy("lang", "source")
        .agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(k).alias(k) for k in names)),
        "sketches",
    )
    merged = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(k).alias(k) for k in names)]
    by_lang = sketches.groupBy("lang").agg(*merged)
    overall = sketches.agg(*merged)

    def cut(level: str) -> list[Column]:
        quartile = lambda k, q: F.kll_sketch_get_quantile_double(F.col(k), F.lit(q))
        fence = lambda k: quartile(k, 0.75) + F.greatest(
            FENCE * (quartile(k, 0.75) - quartile(k, 0.25)), F.lit(SLACK[k])
        )
        return [F.col("n").alias(f"n_{level}"), F.struct(*(fence(k).alias(k) for k in names)).alias(level)]

    own = sketches.where("n > 0").select("lang", "source", *cut("own"))
    lang = by_lang.where("n > 0").select(F.col("lang").alias("_lang"), *cut("of_lang"))
    whole = overall.where("n > 0").select(*cut("of_all"))
    joined = own.join(lang, own["lang"].eqNullSafe(lang["_lang"])).join(F.broadcast(whole))  # one row
    chosen = (
        F.when(F.col("n_own") >= MIN_GROUP, F.col("own"))
        .when(F.col("n_of_lang") >= MIN_GROUP, F.col("of_lang"))
        .otherwise(F.col("of_all"))
    )
    return joined.select("lang", "source", *(chosen[k].alias(f"fence_{k}") for k in names))


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, STATS, base_failed, kept) of each row of `docs`.

    Kept are texts that pass the base rules (MIN_WORDS words, at most MAX_REPEATED of them repeated) and
    lie within all fences of their language and source. Null and empty texts fail the base rules;
    repeated rows are judged like others and each comes back; texts of a group that has no fence, as
    none of it passed the base rules, have failed themselves. An empty table gives an empty one. Other
    columns are not read.
    """
    stats = settled(
        with_stats(docs.select("doc_id", "lang", "source", "text")).drop("text").withColumn("base_failed", base_failed()),
        "stats",
    )
    bars = settled(fences(stats), "fences").withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = stats["lang"].eqNullSafe(bars["_lang"]) & stats["source"].eqNullSafe(bars["_source"])
    within = F.lit(True)
    for name, measure in measures().items():
        within = within & (measure <= F.col(f"fence_{name}"))
    return stats.join(bars, same, "left").select(
        "doc_id", "lang", "source", *STATS, "base_failed",
        (~F.col("base_failed") & F.coalesce(within, F.lit(True))).alias("kept"),
    )
