"""The data contract compiled into one aggregate per table and one join per parent.

Every rule comes from the tables of `panelkite.schema`: columns, NULLs, members, checks, keys, links.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkite import schema
from panelkite.operators.constraints import value_rules
from panelkite.operators.joins import union_frames

KEY_RULE = "primary key"


def row_rules(table: str, have: set[str]) -> dict[str, Column]:
    """Rules on single rows: required columns, members of enumerations, checks between columns."""
    rules = {f"{c} is null": F.col(c).isNull() for c in schema.required(table) if c in have}
    rules |= {
        f"{c} is not a number": F.isnan(c)
        for c, kind in schema.columns_of(table).items()
        if c in have and kind == "DOUBLE"
    }
    return rules | value_rules(table, have)


def absent_columns(df: DataFrame, table: str) -> list[str]:
    return [c for c in schema.columns_of(table) if c not in df.columns]


def table_violations(df: DataFrame, table: str) -> DataFrame:
    """(check, violations): all rules of a contract table over `df` in one pass.

    Rows are counted by key, broken rules along with them, and the keys are summed up; the counts combine
    before the shuffle, so a key that repeats often costs nothing extra. Rows beyond the first of a key
    break the primary key unless a part of it is NULL, which its own rule counts. An absent column is
    one violation, and rules that read it are left out.
    """
    have = set(df.columns)
    absent = absent_columns(df, table)
    rules = row_rules(table, have)
    keys = [k for k in schema.KEYS[table] if k in have]
    counts = [F.count_if(rule).alias(f"_{i}") for i, rule in enumerate(rules.values())]
    parts = {f"{table}.{name}": F.sum(f"_{i}") for i, name in enumerate(rules)}
    if keys:
        whole = F.lit(True)
        for key in keys:
            whole = whole & F.col(key).isNotNull()
        df = df.groupBy(*keys).agg((F.count("*") - 1).alias("_more"), *counts)
        parts[f"{table}.{KEY_RULE}"] = F.sum(F.when(whole, F.col("_more")))
    else:
        df = df.agg(F.count("*").alias("_rows"), *counts)
    zero = F.lit(0).cast("long")
    parts = {name: F.coalesce(total, zero) for name, total in parts.items()}
    parts |= {f"{table}.{c} is absent": F.lit(1).cast("long") for c in absent}
    names = list(parts)
    sums = df.agg(*[parts[n].alias(f"_r{i}") for i, n in enumerate(names)])
    rows = [F.struct(F.lit(n).alias("check"), F.col(f"_r{i}").alias("violations")) for i, n in enumerate(names)]
    return sums.select(F.inline(F.array(*rows)))


def link_violations(tables: Mapping[str, DataFrame]) -> DataFrame | None:
    """(check, violations): rows whose parent is missing, for the links between tables that are given.

    All children of a parent are counted by key and meet it in one join. None without linked tables.
    """
    by_parent: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for (child, column), parent in schema.LINKS.items():
        if child in tables and parent[0] in tables:
            by_parent.setdefault(parent, []).append((child, column))
    out = []
    for (parent, key), children in by_parent.items():
        names = [f"{child}.{column} in {parent}" for child, column in children]
        keys = union_frames(
            [
                tables[child].where(F.col(column).isNotNull()).groupBy(F.col(column).alias(key))
                .agg(F.count("*").alias("_n")).withColumn("check", F.lit(name))
                for (child, column), name in zip(children, names)
            ]
        )
        # an outer join, as an anti join would be pushed into the union and read the parent once per child
        known = tables[parent].select(key, F.lit(True).alias("_known"))
        orphans = keys.join(known, key, "left").where(F.col("_known").isNull())
        found = orphans.groupBy().pivot("check", names).agg(F.sum("_n"))
        zero = F.lit(0).cast("long")
        rows = [
            F.struct(F.lit(n).alias("check"), F.coalesce(F.col(f"`{n}`"), zero).alias("violations")) for n in names
        ]
        out.append(found.select(F.inline(F.array(*rows))))
    return union_frames(out) if out else None


def contract_violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every rule of the contract over the tables that are given, as (check, violations)."""
    unknown = sorted(set(tables) - set(schema.COLUMNS))
    if unknown:
        raise ValueError(f"not tables of the contract: {unknown}")
    parts = [table_violations(df, name) for name, df in tables.items()]
    links = link_violations(tables)
    return union_frames([*parts, links] if links is not None else parts)


def refuse(tables: Mapping[str, DataFrame]) -> None:
    """Raise with the broken rules, of which one small row each comes back."""
    broken = contract_violations(tables).where("violations > 0").collect()
    if broken:
        raise ValueError("contract broken: " + ", ".join(sorted(f"{r.check}={r.violations}" for r in broken)))
