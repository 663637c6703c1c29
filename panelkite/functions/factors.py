"""Causal factor expressions: Column in, Column out.

All of them read a dense panel (see ``operators.panel.densify``), one row per symbol and
session, so "n rows back" means "n sessions back" and every symbol holds the same number of
rows. ``lag`` shifts the input first, for factors that must not see the current session.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol_id").orderBy("ts")


def _col(x: Column | str | float) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def _window(n: int) -> int:
    if isinstance(n, bool) or n != int(n) or n < 1:
        raise ValueError(f"window must be an integer of at least 1, got {n!r}")
    return int(n)


def _lagged(x, lag: int, w: WindowSpec | None) -> Column:
    return shift(x, lag, w) if lag else _col(x)


def _trailing(w: WindowSpec | None, n: int) -> WindowSpec:
    return (w or by_symbol()).rowsBetween(-(n - 1), 0)


def _full(x: Column, n: int, w: WindowSpec | None, value: Column) -> Column:
    """`value` where the window holds n non-null inputs."""
    return F.when(F.count(x).over(_trailing(w, n)) == n, value)


def field(name: str) -> Column:
    if name not in ("close", "price"):
        raise ValueError(f"unknown field {name!r}: only the adjusted close is a factor input")
    return F.col("close")


def const(value: float) -> Column:
    return F.lit(float(value))


def shift(x, n: int = 1, w: WindowSpec | None = None) -> Column:
    if isinstance(n, bool) or n < 1:
        raise ValueError("shift needs n >= 1: a zero or negative shift looks ahead")
    return F.lag(_col(x), n).over(w or by_symbol())


def sma(x, n: int, lag: int = 0, w: WindowSpec | None = None) -> Column:
    n, x = _window(n), _lagged(x, lag, w)
    return _full(x, n, w, F.avg(x).over(_trailing(w, n)))


rolling_mean = sma


def std(x, n: int, lag: int = 0, w: WindowSpec | None = None) -> Column:
    n, x = _window(n), _lagged(x, lag, w)
    return _full(x, n, w, F.stddev_samp(x).over(_trailing(w, n)))


def momentum(x, n: int, lag: int = 0, w: WindowSpec | None = None) -> Column:
    n, x = _window(n), _lagged(x, lag, w)
    return F.try_divide(x, F.lag(x, n).over(w or by_symbol())) - 1.0


def zscore(x, n: int, lag: int = 0, w: WindowSpec | None = None) -> Column:
    n, x = _window(n), _lagged(x, lag, w)
    frame = _trailing(w, n)
    z = F.try_divide(x - F.avg(x).over(frame), F.stddev_samp(x).over(frame))
    return _full(x, n, w, z)


def linreg_slope(x, n: int, idx: str = "idx", lag: int = 0, w: WindowSpec | None = None) -> Column:
    """OLS slope of ln(x) on the session number."""
    n, y = _window(n), F.ln(_lagged(x, lag, w))
    return _full(y, n, w, F.regr_slope(y, F.col(idx)).over(_trailing(w, n)))


def linreg_r2(x, n: int, idx: str = "idx", lag: int = 0, w: WindowSpec | None = None) -> Column:
    """Squared correlation of ln(x) with the session number; NULL for a flat window."""
    n, y = _window(n), F.ln(_lagged(x, lag, w))
    frame = _trailing(w, n)
    varies = F.max(y).over(frame) != F.min(y).over(frame)
    return _full(y, n, w, F.when(varies, F.regr_r2(y, F.col(idx)).over(frame)))


def truth(p) -> Column:
    """NULL counts as false; any non-zero number as true."""
    return F.coalesce(_col(p).cast("boolean"), F.lit(False))


def gt(a, b) -> Column:
    return truth(_col(a) > _col(b))


def lt(a, b) -> Column:
    return truth(_col(a) < _col(b))


def ge(a, b) -> Column:
    return truth(_col(a) >= _col(b))


def le(a, b) -> Column:
    return truth(_col(a) <= _col(b))


def eq(a, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Equality within a tolerance relative to `b`."""
    a, b = _col(a), _col(b)
    return truth(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b))


def cross_above(a, b, w: WindowSpec | None = None) -> Column:
    a, b = _col(a), _col(b)
    return truth((a > b) & (F.lag(a).over(w or by_symbol()) <= F.lag(b).over(w or by_symbol())))


def cross_below(a, b, w: WindowSpec | None = None) -> Column:
    a, b = _col(a), _col(b)
    return truth((a < b) & (F.lag(a).over(w or by_symbol()) >= F.lag(b).over(w or by_symbol())))


def and_(a, b) -> Column:
    return truth(a) & truth(b)


def or_(a, b) -> Column:
    return truth(a) | truth(b)


def not_(a) -> Column:
    return ~truth(a)


def add(a, b) -> Column:
    return _col(a) + _col(b)


def sub(a, b) -> Column:
    return _col(a) - _col(b)


def mul(a, b) -> Column:
    return _col(a) * _col(b)


def div(a, b) -> Column:
    return F.try_divide(_col(a), _col(b))


def neg(a) -> Column:
    return -_col(a)


def log(a) -> Column:
    return F.ln(_col(a))


def exp(a) -> Column:
    return F.exp(_col(a))


def condition(p, a, b) -> Column:
    return F.when(truth(p), _col(a)).otherwise(_col(b))


def pct_change(x, w: WindowSpec | None = None) -> Column:
    """Change against the previous row, without filling gaps."""
    return F.try_divide(_col(x), F.lag(_col(x)).over(w or by_symbol())) - 1.0
