"""A sparse rule ensemble for text quality.

Trees are grown on statistics of the texts; every path from a root to a node becomes a rule, a
conjunction of comparisons. A logistic model with an L1 penalty over all rules leaves few of them with
a weight, and those are compiled into one column expression over the statistics.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"

TREES = 16
DEPTH = 3
PENALTY = 0.001


def statistics(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Statistics of a text, from it, its words and its lines; zero where there is nothing to count."""
    chars = F.greatest(F.length(text), F.lit(1))
    count = F.greatest(F.size(words), F.lit(1))
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    share = lambda pattern: (F.length(text) - without(pattern)) / chars
    return {
        "n_words": F.size(words).cast("double"),
        "word_length": F.length(text) / count,
        "distinct_words": F.size(F.array_distinct(words)) / count,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "line_words": F.size(words) / F.greatest(F.size(lines), F.lit(1)),
        "upper": share(r"\p{Lu}+"),
        "digits": share("[0-9]+"),
        "marks": share("[#*$%&|<>{}=_~^]+"),
        "exclaims": share("[!?]+"),
        "stops": share("[.,;:]+"),
        "spaces": share(SPACES),
        "single_letters": F.size(F.filter(words, lambda w: F.length(w) == 1)) / count,
    }


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, features): whole texts, null as empty, become arrays of doubles in fixed order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        "doc_id", text.alias("text"),
        F.filter(F.split(text, SPACES), lambda w: w != "").alias("words"), F.split(text, "\n").alias("lines"),
    )
    found = statistics(F.col("text"), F.col("words"), F.col("lines"))
    return split.select("doc_id", F.array(*(c.cast("double") for c in found.values())).alias("features"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (place of the statistic, whether it is above, the bound)."""

    tests: tuple[tuple[int, bool, float], ...]

    def column(self, features: Column) -> Column:
        held = F.lit(True)
        for place, above, bound in self.tests:
            value = F.get(features, F.lit(place))
            held = held & ((value > bound) if above else (value <= bound))
        return held


_TEST = re.compile(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)")


def tree_rules(printed: str) -> set[Rule]:
    """The rules of every node below the roots, from the text in which Spark shows its trees."""
    rules, path = set(), []
    for line in printed.splitlines():
        found = _TEST.match(line)
        if not found:
            continue
        depth = len(found[1])
        path = [p for p in path if p[0] < depth] + [(depth, (int(found[2]), found[3] == ">", float(found[4])))]
        rules.add(Rule(_tightest([test for _, test in path])))
    return rules


def _tightest(tests: list[tuple[int, bool, float]]) -> tuple[tuple[int, bool, float], ...]:
    bounds: dict[tuple[int, bool], float] = {}
    for place, above, bound in tests:
        old = bounds.get((place, above), bound)
        bounds[place, above] = max(old, bound) if above else min(old, bound)
    return tuple(sorted((place, above, bound) for (place, above), bound in bounds.items()))


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted rules and an intercept; ``score`` is the compiled model."""

    weights: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self, features: Column) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(rule.column(features), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(labelled: DataFrame, seed: int = 7) -> RuleEnsemble:
    """The ensemble of (features, label) rows, all of them; rows without a label do not count.

    Without rows it scores one half, and with one label only, that label's share smoothed by one row of
    each kind.
    """
    rows = labelled.where(F.col("label").isNotNull()).select(
        array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label")
    )
    ones, total = rows.agg(F.sum("label"), F.count("*")).first()
    if not total or ones in (0, total):
        share = ((ones or 0) + 1) / (total + 2)
        return RuleEnsemble((), float(_logit(share)))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, subsamplingRate=0.7).fit(rows)
    rules = sorted(tree_rules(forest.toDebugString), key=lambda r: r.tests)
    if not rules:
        return RuleEnsemble((), float(_logit(ones / total)))
    held = F.array(*(rule.column(F.col("features")).cast("double") for rule in rules))
    design = labelled.where(F.col("label").isNotNull()).select(
        array_to_vector(held).alias("features"), F.col("label").cast("double").alias("label")
    )
    model = LogisticRegression(regParam=PENALTY, elasticNetParam=1.0, maxIter=60, standardization=False).fit(design)
    weights = zip(rules, model.coefficients.toArray().tolist())
    return RuleEnsemble(tuple((r, w) for r, w in weights if w != 0.0), float(model.intercept))


def _logit(share: float) -> float:
    return math.log(share / (1 - share))


def scored(stats: DataFrame, model: RuleEnsemble) -> DataFrame:
    """(doc_id, score) of each row of ``with_statistics``.

    Null, empty and very long texts have statistics like others and get a score; repeated rows each
    come back; an empty table gives an empty one.
    """
    return stats.select("doc_id", model.score(F.col("features")).alias("score"))
