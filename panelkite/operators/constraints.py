"""Contract constraints, ingest invariants and audits, as (check, violations) rows."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkite import schema
from panelkite.operators.cleaning import fx_collisions
from panelkite.operators.joins import union_frames
from panelkite.operators.quality import PRICES


def count_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One pass over `df`: how many rows break each rule."""
    names = list(rules)
    counts = df.agg(*[F.count_if(rules[n]).alias(f"_{i}") for i, n in enumerate(names)])
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("check"), F.col(f"_{i}").alias("violations"))
            for i, n in enumerate(names)
        ]
    )
    return counts.select(F.inline(rows))


def extra_copies(df: DataFrame, keys: Sequence[str], check: str) -> DataFrame:
    """Rows beyond the first of each key."""
    per_key = df.groupBy(*keys).agg((F.count("*") - 1).alias("_more"))
    return per_key.agg(
        F.coalesce(F.sum("_more"), F.lit(0).cast("long")).alias("violations")
    ).select(F.lit(check).alias("check"), "violations")


def _ohlc_rules(prefix: str) -> dict[str, Column]:
    rules = {f"{prefix}_nonpositive_{c}": F.col(c) <= 0 for c in PRICES}
    rules[f"{prefix}_low_above"] = F.col("low") > F.least("open", "close")
    rules[f"{prefix}_high_below"] = F.col("high") < F.greatest("open", "close")
    return rules


def _bars(df: DataFrame) -> list[DataFrame]:
    early = F.col("available_utc") < F.col("ts").cast("timestamp_ntz")
    return [
        count_rules(df, {**_ohlc_rules("bars"), "bars_available_early": early}),
        extra_copies(df, ["symbol_id", "ts"], "bars_duplicates"),
    ]


def _actions(df: DataFrame) -> list[DataFrame]:
    late = F.col("available_utc") > F.col("ex_date").cast("timestamp_ntz")
    return [
        count_rules(df, {"actions_announced_late": late}),
        extra_copies(df, ["symbol_id", "ex_date", "kind"], "actions_duplicates"),
    ]


def _symbols(df: DataFrame) -> list[DataFrame]:
    return [extra_copies(df, ["symbol_id"], "symbols_duplicates")]


def _fund_adj(df: DataFrame) -> list[DataFrame]:
    return [
        count_rules(df, {"factors_nonpositive": F.col("adj_factor") <= 0}),
        extra_copies(df, ["symbol_id", "ts"], "factors_duplicates"),
    ]


def _index_daily(df: DataFrame) -> list[DataFrame]:
    return [
        count_rules(df, _ohlc_rules("index")),
        extra_copies(df, ["ts_code", "ts"], "index_duplicates"),
    ]


def _macro(df: DataFrame) -> list[DataFrame]:
    early = F.col("available_utc") < F.col("ts").cast("timestamp_ntz")
    return [
        count_rules(df, {"macro_available_early": early}),
        extra_copies(df, ["series_id", "ts"], "macro_duplicates"),
    ]


def _codes(name: str) -> Callable[[DataFrame], list[DataFrame]]:
    return lambda df: [extra_copies(df, ["ts_code"], f"{name}_duplicates")]


INVARIANTS: dict[str, Callable[[DataFrame], list[DataFrame]]] = {
    "bars_daily": _bars,
    "corporate_actions": _actions,
    "symbols": _symbols,
    "fund_adj": _fund_adj,
    "index_daily": _index_daily,
    "macro_series": _macro,
    "index_symbols": _codes("index_symbols"),
    "hk_symbols": _codes("hk_symbols"),
}


def bundle_invariants(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Structural red flags of an ingest, for whichever tables it brings."""
    rows = [part for name, check in INVARIANTS.items() if name in tables for part in check(tables[name])]
    if not rows:
        raise ValueError("no table to check")
    return union_frames(rows)


#: Required columns that an ingest stamps on the rows itself.
STAMPED = ("source", *schema.AUDIT_COLUMNS)


def ingest_gate(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All that may stop an ingest, as (check, violations): invariants, NULLs and value rules.

    Required columns count as broken where NULL; those stamped at ingest may still be absent. A code
    that no id is known for has a NULL symbol_id, an unknown suffix or market a NULL exchange or
    ticker, so both are found here. Fractions that are not a number are broken too.
    """
    parts = [bundle_invariants(tables)]
    for name, df in tables.items():
        if name not in schema.COLUMNS:
            continue
        have = set(df.columns)
        absent = [c for c in schema.required(name) if c not in {*have, *STAMPED}]
        if absent:
            raise ValueError(f"{name} lacks the required columns {absent}")
        rules = {f"{name}.{c} is null": F.col(c).isNull() for c in schema.required(name) if c in have}
        numbers = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
        rules |= {f"{name}.{c} is not a number": F.isnan(c) for c in numbers}
        parts.append(count_rules(df, rules))
        values = value_rules(name, have)
        if values:
            parts.append(count_rules(df, {f"{name}.{k}": rule for k, rule in values.items()}))
    if "fx_rates" in tables:
        found = fx_collisions(tables["fx_rates"]).agg(F.count("*").alias("violations"))
        parts.append(found.select(F.lit("fx_rates.quoted both ways").alias("check"), "violations"))
    return union_frames(parts)


def halted_with_volume(bars: DataFrame) -> DataFrame:
    return bars.where(~F.col("traded") & (F.col("volume") != 0))


def bars_outside_listing(bars: DataFrame, symbols: DataFrame) -> DataFrame:
    """Bars before the listing or after the delisting of their symbol."""
    life = symbols.select("symbol_id", "listed_on", "delisted_on")
    return bars.join(life, "symbol_id").where(
        (F.col("ts") < F.col("listed_on")) | (F.col("ts") > F.col("delisted_on"))
    )


def missing_columns(df: DataFrame, table: str) -> list[str]:
    """Contract columns the frame lacks, apart from the audit columns stamped later."""
    optional = {"source", *schema.AUDIT_COLUMNS}
    return [f.name for f in schema.struct_of(table).fields if f.name not in {*df.columns, *optional}]


def validate_normalized(df: DataFrame, table: str) -> DataFrame:
    """NULLs in key columns and in the availability time. Missing columns are an error at once."""
    gone = missing_columns(df, table)
    if gone:
        raise ValueError(f"{table} lacks the contract columns {gone}")
    required = [k for k in schema.KEYS[table] if k in df.columns]
    if "available_utc" in df.columns:
        if not df.schema["available_utc"].dataType.typeName().startswith("timestamp"):
            raise ValueError(f"{table}.available_utc must be a time")
        required.append("available_utc")
    return count_rules(df, {f"{table}.{c} is null": F.col(c).isNull() for c in required})


def primary_key_violations(df: DataFrame, table: str) -> DataFrame:
    return extra_copies(df, schema.KEYS[table], f"pk_{table}")


def foreign_key_violations(df: DataFrame, parent: DataFrame, key: str, check: str) -> DataFrame:
    """Rows whose key the parent table lacks. Keys are counted before they meet the parent."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("_n"))
        .join(parent.select(key), key, "left_anti")
        .agg(F.coalesce(F.sum("_n"), F.lit(0).cast("long")).alias("violations"))
        .select(F.lit(check).alias("check"), "violations")
    )


def value_rules(table: str, have: Collection[str] | None = None) -> dict[str, Column]:
    """Value constraints of a table that the columns `have` allow to check; a NULL comparison passes."""
    rules = {
        column: (~F.col(column).isin(members), [column])
        for (of, column), members in schema.ENUMS.items()
        if of == table
    }
    rules |= {
        rule: (F.expr(broken), columns)
        for (of, rule), (broken, columns) in schema.CHECKS.items()
        if of == table
    }
    return {name: rule for name, (rule, columns) in rules.items() if have is None or set(columns) <= set(have)}


def value_violations(df: DataFrame, table: str) -> DataFrame:
    return count_rules(df, {f"{table}.{n}": rule for n, rule in value_rules(table).items()})


def single_snapshot(df: DataFrame) -> DataFrame:
    """Whether the frame holds exactly one snapshot. Needs no distinct: least and greatest agree."""
    return df.agg(
        F.coalesce(F.min("snapshot_id") == F.max("snapshot_id"), F.lit(False)).alias("ok"),
        F.count("*").alias("rows"),
    )


def signal_violations(signals: DataFrame) -> DataFrame:
    """Signals other than -1, 0, 1 or NULL, and repeated (ts, symbol)."""
    return count_rules(signals, {"signal_value": ~F.col("signal").isin(-1, 0, 1)}).unionByName(
        extra_copies(signals, ["ts", "symbol_id"], "signal_duplicates")
    )


def weight_violations(
    weights: DataFrame,
    as_of: str | None = None,
    allow_short: bool = False,
    max_row_sum: float = 1.0,
) -> DataFrame:
    """Negative weights, over-invested dates and dates beyond `as_of`."""
    rules = {} if allow_short else {"negative_weight": F.col("weight") < -1e-9}
    if as_of is not None:
        rules["after_as_of"] = F.col("ts") > F.lit(as_of).cast("date")
    total = F.sum(F.abs("weight")) if allow_short else F.sum("weight")
    sums = weights.groupBy("ts").agg(total.alias("_sum"))
    out = count_rules(sums, {"row_sum": F.col("_sum") > max_row_sum + 1e-9})
    return out.unionByName(count_rules(weights, rules)) if rules else out


def listing_gate(universe: DataFrame, symbols: DataFrame, as_of: str) -> DataFrame:
    """Symbols of the universe that are unknown, have no listing date or list after `as_of`."""
    listed = symbols.select("symbol_id", "listed_on", F.lit(True).alias("_known"))
    return (
        universe.select("symbol_id")
        .distinct()
        .join(listed, "symbol_id", "left")
        .withColumn(
            "reason",
            F.when(F.col("_known").isNull(), "unknown")
            .when(F.col("listed_on").isNull(), "no_listing_date")
            .when(F.col("listed_on") > F.lit(as_of).cast("date"), "listed_later"),
        )
        .where("reason IS NOT NULL")
        .select("symbol_id", "listed_on", "reason")
    )


def lookahead_violations(inputs: DataFrame, decided: str = "decision_utc") -> DataFrame:
    """Factor inputs that only became available after the decision that used them."""
    return count_rules(inputs, {"lookahead": F.col("available_utc") > F.col(decided)})


def future_leak(
    bars: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    cut: str,
    factor: float = 3.0,
    value: str = "close",
    tasks: int | None = None,
) -> DataFrame:
    """Rows up to `cut` that change when every value after it is scaled; empty for causal operators.

    A row counts as often as the scaled values do not give it back. With `tasks`, so many tasks share
    the comparison, dealt by the columns that are not fractions.
    """
    end = F.lit(cut).cast("date")
    moved = bars.withColumn(
        value, F.when(F.col("ts") > end, F.col(value) * factor).otherwise(F.col(value))
    )
    before, after = (compute(df).where(F.col("ts") <= end) for df in (bars, moved))
    if tasks is None:
        return before.exceptAll(after)
    keys = [f.name for f in before.schema.fields if f.dataType.typeName() not in ("double", "float")]
    both = before.withColumn("_n", F.lit(1)).union(after.withColumn("_n", F.lit(-1)))
    return (
        both.repartition(tasks, *keys)
        .groupBy(*before.columns)
        .agg(F.sum("_n").alias("_n"))
        .where("_n > 0")
        .select(*before.columns, F.explode(F.array_repeat(F.lit(1), F.col("_n").cast("int"))).alias("_n"))
        .drop("_n")
    )
