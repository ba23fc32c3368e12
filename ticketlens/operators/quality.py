"""Data quality: declared rules as one-pass aggregates, profile and fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.fixed_values import CATEGORIES, PRIORITIES
from ticketlens.functions.text import strip_space


def _repeats(column: str) -> Column:
    """Rows beyond the first of each value; repeated NULLs count too."""
    nulls = F.count_if(F.col(column).isNull())
    extra_nulls = F.greatest(nulls - 1, F.lit(0))
    return F.count(column) - F.count_distinct(column) + extra_nulls


def _outside(column: str, values: list[str]) -> Column:
    return F.col(column).isNull() | ~F.col(column).isin(values)


def quality_issues(
    tickets: DataFrame, categories: list[str] = CATEGORIES, priorities: list[str] = PRIORITIES
) -> DataFrame:
    return tickets.agg(
        F.count_if(F.col("body").isNull()).alias("null_body"),
        F.count_if(strip_space(F.col("body")) == "").alias("empty_body"),
        F.count_if(_outside("category", categories)).alias("unknown_category"),
        F.count_if(_outside("priority", priorities)).alias("unknown_priority"),
        _repeats("ticket_id").alias("duplicate_ids"),
    )


def assert_quality(tickets: DataFrame, **rules: list[str]) -> None:
    issues = quality_issues(tickets, **rules).first().asDict()
    if any(issues.values()):
        raise ValueError(f"Data quality check failed: {issues}")


def constraint_violations(
    df: DataFrame, key: str, required: list[str], allowed: dict[str, list[str]]
) -> DataFrame:
    """One row per declared rule: unique key, required columns, allowed values. As in SQL, a NULL
    passes an allowed-values rule."""
    checks = {f"unique {key}": _repeats(key)}
    for name in required:
        checks[f"not null {name}"] = F.count_if(F.col(name).isNull())
    for name, values in allowed.items():
        checks[f"values {name}"] = F.count_if(~F.col(name).isin(values))
    names = list(checks)
    row = df.agg(*[checks[n].alias(f"c{i}") for i, n in enumerate(names)])
    pairs = F.array(*[
        F.struct(F.lit(n).alias("check_name"), F.col(f"c{i}").alias("violations"))
        for i, n in enumerate(names)
    ])
    return row.select(F.inline(pairs))


def orphan_rows(keys: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Rows whose foreign key has no parent, per key. NULL keys are allowed. The child side is
    counted per key value before the join, so a hot key is one row there."""
    parts = []
    for label, child, column, parent, parent_key in keys:
        present = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_k"))
        lost = present.agg(F.count("*").alias("_n")).join(
            parent.select(F.col(parent_key).alias("_k")), "_k", "left_anti"
        )
        parts.append(
            lost.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("orphans"))
            .select(F.lit(label).alias("foreign_key"), "orphans")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def value_shares(df: DataFrame, field: str, digits: int) -> DataFrame:
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return (
        df.groupBy(F.col(field).alias("value"))
        .agg(F.count("*").alias("n"))
        .select(F.lit(field).alias("field"), "value", F.round(share, digits).alias("figure"))
    )


def profile(tickets: DataFrame, chars: Column | None = None) -> DataFrame:
    """Tidy figures: shares per category and priority, row count, mean body length. ``chars`` is the
    length where the body itself was left behind."""
    chars = F.length("body") if chars is None else chars
    totals = tickets.agg(
        F.count("*").cast("double").alias("rows"),
        F.round(F.avg(chars), 1).alias("avg_body_chars"),
    ).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("field"), F.lit(None).cast("string").alias("value"),
                 F.col(name).alias("figure"))
        for name in ("rows", "avg_body_chars")
    ])))
    return (
        value_shares(tickets, "category", 3)
        .unionByName(value_shares(tickets, "priority", 3))
        .unionByName(totals)
    )


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Twelve hex digits that do not depend on row order or partitioning: the digest of the row count
    and of the sums of the eight 16-bit slices of every row's MD5. Plain enough for another engine to
    check."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"),
                                 F.col(c).cast("string")), F.lit("-")) for c in columns]
    rows = df.select(F.md5(F.concat(*parts)).alias("row"))
    slices = [F.conv(F.substring("row", 4 * i + 1, 4), 16, 10).cast("long") for i in range(8)]
    sums = [F.coalesce(F.sum(s), F.lit(0)).cast("string") for s in slices]
    digest = F.sha2(F.concat_ws(":", F.count("*").cast("string"), *sums), 256)
    return rows.agg(F.substring(digest, 1, 12).alias("fingerprint"))
