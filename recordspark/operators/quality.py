"""Quality checks as queries of violating rows, and the gate that stops on errors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def nulls(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def reconcile(a: DataFrame, b: DataFrame, amount_a: Column, amount_b: Column) -> DataFrame:
    """One row with both counts and sums where these differ, else none."""
    one = a.agg(F.count("*").alias("rows_a"), F.round(F.sum(amount_a), 2).alias("sum_a")).crossJoin(b.agg(F.count("*").alias("rows_b"), F.round(F.sum(amount_b), 2).alias("sum_b")))
    return one.filter(~F.col("rows_a").eqNullSafe(F.col("rows_b")) | ~F.col("sum_a").eqNullSafe(F.col("sum_b")))


def stale(df: DataFrame, stamp: str, now: Column, hours: int) -> DataFrame:
    """One row with the latest stamp where it is older than allowed or there is none."""
    top = df.agg(F.max(F.col(stamp).cast("timestamp")).alias("latest"))
    return top.filter(F.col("latest").isNull() | (F.col("latest") < now - F.expr(f"interval {hours} hours")))


def quarantine_rate(landed: DataFrame, quarantined: DataFrame, most: float) -> DataFrame:
    """landed and quarantined: source, n. Sources whose quarantined share of all rows is above `most`."""
    q = quarantined.select("source", F.col("n").alias("quarantined"))
    return landed.select("source", F.col("n").alias("landed")).join(q, "source").filter(F.col("quarantined") > most * (F.col("landed") + F.col("quarantined")))


@dataclass(frozen=True)
class Check:
    name: str
    severity: str
    violations: Callable[[], DataFrame]


class GateError(RuntimeError):
    """An error check has violations."""


def run_checks(checks: list[Check]) -> list[tuple[str, str, int, list[str]]]:
    """(name, severity, violations, the first three) per check; severities other than error and warn raise."""
    out = []
    for c in checks:
        if c.severity not in ("error", "warn"):
            raise ValueError(f"unknown severity of {c.name}: {c.severity}")
        rows = c.violations()
        out.append((c.name, c.severity, rows.count(), [str(r.asDict()) for r in rows.limit(3).collect()]))
    return out


def gate(results: list[tuple[str, str, int, list[str]]]) -> None:
    failed = [name for name, severity, n, _ in results if severity == "error" and n]
    if failed:
        raise GateError("checks failed: " + ", ".join(sorted(failed)))
