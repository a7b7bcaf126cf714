"""Hybrid type-1/type-2 dimensions, append-only facts, keyed upserts and watermarks as one-pass snapshot algebra.

Plain files know no UPDATE: the next state of a table is a DataFrame of the present one and the batch, with one
shuffle on the key, and the caller swaps it in. Rerunning a batch changes nothing. Keys that are null match nothing;
a batch with several rows for a key must be deduplicated by the caller (`clusters.last_of`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordspark.runtime import Cut


def scd2_next(dim: DataFrame, batch: DataFrame, key: str, tracked: list[str], refreshed: list[str], run_ts: Column, cut: Cut, surrogate: str = "dim_key") -> DataFrame:
    """The dimension after a batch: changed and vanished current rows are closed at run_ts, new and changed ones opened,
    `refreshed` columns of unchanged rows are overwritten. Surrogates of new versions follow the greatest one, in key order.
    """
    past, cur = dim.filter("not is_current"), dim.filter("is_current")
    j = cur.select(F.struct(*cur.columns).alias("d")).join(batch.select(F.struct(*batch.columns).alias("g")), F.col(f"d.{key}") == F.col(f"g.{key}"), "full_outer")
    changed = F.lit(False)
    for c in tracked:
        changed = changed | ~F.col(f"d.{c}").eqNullSafe(F.col(f"g.{c}"))
    fresh, gone = F.col(f"d.{key}").isNull(), F.col(f"g.{key}").isNull()
    state = F.when(fresh, "new").when(gone, "gone").when(changed, "changed").otherwise("same")
    j = j.withColumn("state", state)
    ends = j.filter("state <> 'new'").select(
        F.col(f"d.{surrogate}").alias(surrogate), F.col(f"d.{key}").alias(key), *[F.col(f"d.{c}").alias(c) for c in tracked],
        *[F.when(F.col("state") == "same", F.coalesce(F.col(f"g.{c}"), F.col(f"d.{c}"))).otherwise(F.col(f"d.{c}")).alias(c) for c in refreshed],
        F.col("d.valid_from").alias("valid_from"), F.when(F.col("state") != "same", run_ts).alias("valid_to"), (F.col("state") == "same").alias("is_current"),
    )
    top = dim.agg(F.coalesce(F.max(surrogate), F.lit(0)).cast("long").alias("top"))
    opened = j.filter("state in ('new', 'changed')").select("g.*").crossJoin(F.broadcast(top))  # top is one row
    numbered = number_rows(opened, key, "_n", cut)
    starts = numbered.select((F.col("top") + F.col("_n")).alias(surrogate), key, *tracked, *refreshed, run_ts.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit(True).alias("is_current"))
    return past.select(*starts.columns).unionByName(ends).unionByName(starts)


def number_rows(df: DataFrame, key: str, name: str, cut: Cut) -> DataFrame:
    """1, 2, ... in the order of a unique key, without bringing all rows to one task.

    Rows are range-partitioned by the key and written with their partition's number; a partition's rows are numbered in
    a window and start after the counts of the partitions before, one row each.
    """
    banded = cut.table(df.repartitionByRange(key).withColumn("_band", F.spark_partition_id()))
    counts = banded.groupBy("_band").agg(F.count("*").alias("_c"), F.lit(1).alias("_one"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_one").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_band", before.alias("_before"))
    local = F.row_number().over(Window.partitionBy("_band").orderBy(key))
    return banded.withColumn("_local", local).join(starts, "_band").withColumn(name, (F.col("_before") + F.col("_local")).cast("long")).drop("_band", "_before", "_local")


def append_absent(fact: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of the batch whose key the fact lacks, one per key; what is loaded keeps its values."""
    return batch.dropDuplicates([key]).join(fact.select(key), key, "left_anti")


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """One row per key: the one with the latest stamp, the new table's on a tie."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col(stamp).desc(), F.col("_new").desc())
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_new")


def next_watermark(rows: DataFrame, stamp: str, accepted: Column, current: str | None, by: str | None = None) -> DataFrame:
    """One row (with `by` one per value of it): the greatest accepted stamp before the earliest rejected one, or null where the mark must stay.

    A rejected row without a stamp holds the mark, since nothing tells which rows precede it; so does an empty batch.
    """
    rows = rows.select(F.col(by).alias("_by") if by else F.lit(1).alias("_by"), F.col(stamp).alias("_stamp"), accepted.alias("_ok"))
    agg = rows.groupBy("_by").agg(F.min(F.when(~F.col("_ok"), F.col("_stamp"))).alias("ceiling"), F.count_if(~F.col("_ok") & F.col("_stamp").isNull()).alias("blind"))
    safe = F.col("_ok") & (F.col("blind") == 0) & (F.col("ceiling").isNull() | (F.col("_stamp") < F.col("ceiling")))
    met = rows.withColumnRenamed("_by", "_key").join(agg, F.col("_key").eqNullSafe(F.col("_by")))
    top = F.max(F.when(safe, F.col("_stamp")))
    mark = (F.when(top > F.lit(current), top) if current is not None else top).alias("watermark")
    return met.groupBy("_by").agg(mark).select(F.col("_by").alias(by), "watermark") if by else met.agg(mark)
