"""Files of a drop zone into raw tables: month pruning, content-hash skip, contracts, quarantine, registry and audit."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspark.operators import contracts as K
from recordspark.operators.dimensions import upsert_latest
from recordspark.ops.runner import Context, audit, swap_in
from recordspark.sources import files as S

# Source, folder, file pattern and format.
SOURCES = {
    "ticketing_orders": ("ticketing", "orders_*.jsonl", "jsonl"),
    "merch_order_items": ("merch", "merch_*.csv", "csv"),
    "email_subscribers": ("email", "subscribers*.csv", "csv"),
    "email_events": ("email", "events_*.jsonl", "jsonl"),
    "email_campaigns": ("email", "campaigns*.csv", "csv"),
    "fixtures": ("fixtures", "fixtures*.csv", "csv"),
}
REGISTRY = "path string, sha256 string, seen_at timestamp"


def _registry(ctx: Context) -> DataFrame:
    try:
        return ctx.table("ops.ingested_files")
    except Exception as e:  # nothing has been ingested yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return ctx.spark.createDataFrame([], REGISTRY)


def _columns(ctx: Context, source: str, paths: list[str], form: str) -> DataFrame:
    """The contract's columns as text, the payload as it came, and the file."""
    if form == "csv":
        rows = S.read_csv(ctx.spark, paths)
        return rows.withColumn("payload", F.to_json(F.struct(*[c for c in rows.columns if c != "source_file"])))
    lines = S.read_json_lines(ctx.spark, paths)
    return lines.select(*[F.get_json_object("payload", f"$.{r.column}").alias(r.column) for r in K.CONTRACTS[source].rules], "payload", "source_file")


def ingest(ctx: Context, drop_zone: str, sources: Iterable[str] | None = None, first: str | None = None, last: str | None = None, force: bool = False) -> list[tuple[str, int, int]]:
    """(source, accepted, rejected) for sources with new files. A file that comes again replaces its rows."""
    out = []
    for source in sources or SOURCES:
        folder, pattern, form = SOURCES[source]
        try:
            found = S.list_files(ctx.spark, f"{drop_zone}/{folder}", pattern)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        wanted = S.prune_months(found, "path", first, last)
        fresh = S.unseen(wanted, _registry(ctx), force).select("path", "sha256").collect()  # a row per new file
        if not fresh:
            continue
        paths = [r["path"] for r in fresh]
        judged = K.judge(_columns(ctx, source, paths, form), K.CONTRACTS[source]).select("payload", "source_file", "reason").withColumn("batch_id", F.lit(ctx.run_id)).withColumn("loaded_at", F.lit(ctx.run_at))
        names = [p.rsplit("/", 1)[-1] for p in paths]
        good, bad = judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")
        counts = judged.agg(F.count_if(F.col("reason").isNull()), F.count_if(F.col("reason").isNotNull())).first()
        K.FileTable(ctx.spark, f"{ctx.warehouse}/raw/{source}").load(good, names)
        K.FileTable(ctx.spark, f"{ctx.warehouse}/quarantine/{source}").load(bad, names)
        seen = ctx.spark.createDataFrame([(r["path"], r["sha256"], ctx.run_at) for r in fresh], REGISTRY)
        swap_in(upsert_latest(_registry(ctx), seen, ["path"], "seen_at"), f"{ctx.warehouse}/ops/ingested_files")
        audit(ctx, "load", source, "done", counts[0], None, f"{counts[1]} rejected, {len(paths)} files")
        out.append((source, counts[0], counts[1]))
    return out
