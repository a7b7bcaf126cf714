"""Models in layers, run in order with an audit, on parquet tables that are swapped in as a whole.

A model is a function from the run's context to a DataFrame; its name is `layer.table`. A run writes each table beside
the old one and then renames, so readers see the old or the new table, and a failed model leaves the old one.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LAYERS = ["staging", "identity", "core", "marts"]
AUDIT = "run_id string, kind string, name string, status string, n_rows long, seconds double, detail string, at timestamp"


@dataclass
class Context:
    """Where inputs and tables lie, and the time of the run, one value for all its models."""

    spark: SparkSession
    source: str
    warehouse: str
    run_at: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None))
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.source}/{name}.parquet")

    def table(self, name: str) -> DataFrame:
        path = f"{self.warehouse}/{name.replace('.', '/')}"
        settle(self.spark, path)
        return self.spark.read.parquet(path)


Model = Callable[[Context], DataFrame]


def in_order(models: dict[str, Model], layers: Iterable[str] | None = None, select: Iterable[str] | None = None) -> list[str]:
    """Model names by layer, then as registered; unknown layers and names raise."""
    for name in models:
        if name.partition(".")[0] not in LAYERS or not name.partition(".")[2]:
            raise ValueError(f"a model is named layer.table: {name}")
    wanted = set(select) if select is not None else None
    if wanted and (unknown := wanted - set(models) - {n.partition(".")[2] for n in models}):
        raise ValueError(f"no such model: {', '.join(sorted(unknown))}")
    own = [n for n in models if (layers is None or n.partition(".")[0] in set(layers)) and (wanted is None or n in wanted or n.partition(".")[2] in wanted)]
    return sorted(own, key=lambda n: (LAYERS.index(n.partition(".")[0]), list(models).index(n)))


def _paths(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def swap_in(df: DataFrame, path: str) -> int:
    """Writes beside the table, sets the old one aside, renames the new one and deletes the old; the number of rows.

    A crash leaves the old table, the new one, or the old one aside, which `settle` puts back.
    """
    spark, fresh = df.sparkSession, f"{path}.new-{uuid.uuid4().hex[:8]}"
    settle(spark, path)
    watch = Observation()
    df.observe(watch, F.count(F.lit(1)).alias("n")).write.parquet(fresh)
    (new, fs), (old, _), (aside, _) = _paths(spark, fresh), _paths(spark, path), _paths(spark, f"{path}.old")
    fs.mkdirs(old.getParent())
    if fs.exists(old) and not fs.rename(old, aside) or not fs.rename(new, old):
        settle(spark, path)
        raise OSError(f"{path} could not be swapped in")
    fs.delete(aside, True)
    return watch.get["n"]


def settle(spark: SparkSession, path: str) -> None:
    """Ends a swap that a crash has left half done."""
    (old, fs), (aside, _) = _paths(spark, path), _paths(spark, f"{path}.old")
    if fs.exists(aside):
        if fs.exists(old):
            fs.delete(aside, True)
        else:
            fs.rename(aside, old)


def audit(ctx: Context, kind: str, name: str, status: str, n_rows: int | None = None, seconds: float | None = None, detail: str | None = None) -> None:
    ctx.spark.createDataFrame([(ctx.run_id, kind, name, status, n_rows, seconds, detail, dt.datetime.now(dt.UTC).replace(tzinfo=None))], AUDIT).coalesce(1).write.mode("append").parquet(f"{ctx.warehouse}/ops/audit")


def run(ctx: Context, models: dict[str, Model], layers: Iterable[str] | None = None, select: Iterable[str] | None = None) -> list[tuple[str, int, float]]:
    """(name, rows, seconds) of the models run. The first failure is audited and raised; auditing never hides it."""
    out = []
    for name in in_order(models, layers, select):
        start = time.time()
        try:
            n = swap_in(models[name](ctx), f"{ctx.warehouse}/{name.replace('.', '/')}")
        except Exception as e:
            try:
                audit(ctx, "model", name, "failed", None, time.time() - start, str(e)[:500])
            except Exception:  # the model's own error is the one to show
                pass
            raise
        out.append((name, n, time.time() - start))
        audit(ctx, "model", name, "done", n, out[-1][2])
    return out


def latest_runs(ctx: Context, kind: str = "model") -> DataFrame:
    """The last audit row of each name."""
    rows = ctx.spark.read.parquet(f"{ctx.warehouse}/ops/audit").filter(F.col("kind") == kind)
    return rows.groupBy("name").agg(F.max_by(F.struct("run_id", "status", "n_rows", "seconds", "at"), "at").alias("r")).select("name", "r.*")


def require_rows(counts: dict[str, int]) -> None:
    """Published tables must not be empty."""
    empty = sorted(k for k, n in counts.items() if not n)
    if empty:
        raise ValueError(f"empty tables: {', '.join(empty)}")


def report_json(path: str, rows: list[dict]) -> None:
    """A small report, already on the driver, as JSON."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, indent=2, default=str, sort_keys=True)


def report_markdown(path: str, title: str, rows: list[dict]) -> None:
    """The same as a table."""
    head = list(rows[0]) if rows else []
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "-|" * len(head)] if head else [f"# {title}", "", "nothing"]
    lines += ["| " + " | ".join("" if r[k] is None else str(r[k]) for k in head) + " |" for r in rows]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def masked(settings: dict[str, str]) -> dict[str, str]:
    """Settings for display, without secrets."""
    secret = ("secret", "password", "token", "key")
    return {k: "***" if v and any(s in k.lower() for s in secret) else v for k, v in settings.items()}
