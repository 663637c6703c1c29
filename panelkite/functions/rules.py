"""Rules of a strategy that know how far they look back.

A rule is a column over a dense panel, the longest window anywhere below it, and the steps that first
add what the column names: exponential filters and ranks need more than one expression. A strategy
derives its look-back from its rules, so warm-up and freshness cannot be stated too short.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkite.functions import crosssection, recursive
from panelkite.functions import factors as fx

_numbers = itertools.count()


@dataclass(frozen=True, eq=False)
class Step:
    """Adds the column `name` to a panel."""

    name: str
    add: Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True, eq=False)
class Rule:
    """`column` over a panel that went through `steps`; `reach` is its longest window in sessions."""

    column: Column
    reach: int = 0
    steps: tuple[Step, ...] = ()

    def map(self, fn: Callable[[Column], Column]) -> Rule:
        """The same windows under another expression."""
        return Rule(fn(self.column), self.reach, self.steps)


def close() -> Rule:
    return Rule(fx.field("close"))


def const(value: float) -> Rule:
    return Rule(fx.const(value))


def _joined(*rules: Rule) -> tuple[Step, ...]:
    """The steps of all rules in order, each once."""
    return tuple(dict.fromkeys(step for rule in rules for step in rule.steps))


def _windowed(factor: Callable[..., Column]) -> Callable[[Rule, int], Rule]:
    def rule(x: Rule, n: int) -> Rule:
        return Rule(factor(x.column, n), max(x.reach, n), x.steps)

    rule.__doc__ = f"``factors.{factor.__name__}`` over `n` sessions."
    return rule


sma = _windowed(fx.sma)
std = _windowed(fx.std)
momentum = _windowed(fx.momentum)
zscore = _windowed(fx.zscore)
linreg_slope = _windowed(fx.linreg_slope)
linreg_r2 = _windowed(fx.linreg_r2)


def shift(x: Rule, n: int = 1) -> Rule:
    """`x` of `n` sessions ago. What it reads is known or NULL, so it adds nothing to the reach."""
    return Rule(fx.shift(x.column, n), x.reach, x.steps)


def _stepped(x: Rule, reach: int, add: Callable[[DataFrame, str, str], DataFrame]) -> Rule:
    """A rule whose value `add` (panel, input column, output column) puts into the panel."""
    name = f"_rule{next(_numbers)}"

    def step(panel: DataFrame, out: str) -> DataFrame:
        return add(panel.withColumn("_input", x.column), "_input", out).drop("_input")

    return Rule(F.col(name), max(x.reach, reach), (*x.steps, Step(name, step)))


def ema(x: Rule, n: int) -> Rule:
    return _stepped(x, n, lambda panel, value, out: recursive.ema(panel, value, n, out=out))


def ewm_std(x: Rule, span: float) -> Rule:
    return _stepped(x, int(span), lambda panel, value, out: recursive.ewm_std(panel, value, span, out=out))


def llt(x: Rule, alpha: float) -> Rule:
    """The filter never forgets; its reach counts as 2 / alpha sessions."""
    if isinstance(alpha, bool) or not 0.0 < alpha < 1.0:
        raise ValueError(f"alpha must lie in (0, 1), got {alpha!r}")
    return _stepped(x, round(2.0 / alpha), lambda panel, value, out: recursive.llt(panel, value, alpha, out=out))


def rank(x: Rule, ascending: bool = False) -> Rule:
    """Rank of `x` among all symbols of a session; `ascending` gives the largest value the highest rank."""
    return _stepped(
        x, 0, lambda panel, value, out: crosssection.cross_sectional_rank(panel, value, out, ascending=ascending)
    )


def _combined(fn: Callable[..., Column]) -> Callable[..., Rule]:
    def rule(*rules: Rule) -> Rule:
        return Rule(fn(*(r.column for r in rules)), longest(*rules), _joined(*rules))

    rule.__doc__ = f"``factors.{fn.__name__}`` of rules."
    return rule


gt, lt, ge, le, eq = (_combined(f) for f in (fx.gt, fx.lt, fx.ge, fx.le, fx.eq))
cross_above, cross_below = _combined(fx.cross_above), _combined(fx.cross_below)
and_, or_, not_ = _combined(fx.and_), _combined(fx.or_), _combined(fx.not_)
add, sub, mul, div = (_combined(f) for f in (fx.add, fx.sub, fx.mul, fx.div))
neg, log, exp, condition = (_combined(f) for f in (fx.neg, fx.log, fx.exp, fx.condition))


def longest(*rules: Rule | None) -> int:
    """The longest window in any of the rules."""
    return max((r.reach for r in rules if r is not None), default=0)


def prepare(panel: DataFrame, *rules: Rule | None) -> DataFrame:
    """`panel` with the columns that the rules name; a step that several rules share runs once."""
    for step in _joined(*(r for r in rules if r is not None)):
        panel = step.add(panel, step.name)
    return panel
