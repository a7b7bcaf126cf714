"""Reading the input tables and cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import unquote

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
# Spark's settings for shuffle files that go with their query, and parquet's for small files.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
DENSE = {"compression": "zstd"}
DIFFERENCES = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}
_LEFT: set[str] = set()  # tables that a returned DataFrame still reads; deleted when the program ends


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only for a local master that names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="recordspark-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return f"file://{_OWN['dir']}"


def _delete(path: str) -> None:
    sc = SparkContext._active_spark_context
    if sc is None or sc._jsc is None:
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _delete_left() -> None:
    for path in list(_LEFT):
        try:
            _delete(path)
        except Exception:  # the session is gone; the cluster's own cleaning takes what stays
            return


class Cut:
    """Tables written to the shared folder so that a plan starts anew from files that outlive executors.

    `table` writes and reads back one DataFrame; `drop` deletes a table that no later step reads. `finish` deletes all
    tables but those that the result reads, which go when the program ends. A `dense` one spares disk: tables are packed
    more tightly, and the shuffle files of a table go as soon as it is written instead of when the driver collects garbage.
    """

    def __init__(self, spark: SparkSession, label: str, dense: bool = False) -> None:
        self.spark, self.base, self.n, self.dense = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0, dense
        self.live: dict[int, str] = {}

    def table(self, df: DataFrame, mark: list[str] | None = None, seen: list[Column] | None = None, by: str | None = None, numbers: bool = False) -> DataFrame:
        """The rows, written and read back. Aggregates are observed while they are written: with `mark` the result's `.mark`
        tells sets of rows apart by these columns, and the named aggregates `seen` come as `.seen`. The values of `by` have
        folders of their own, see `drop_part`; `numbers` packs columns of long numbers by their differences."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        asked = list(seen or []) + ([F.count(F.lit(1)).alias("mark_n"), F.sum(F.xxhash64(*mark).cast("decimal(38,0)")).alias("mark_h")] if mark else [])
        watch = Observation() if asked else None
        out = (df.observe(watch, *asked) if watch else df).write.options(**(DENSE if self.dense else {}), **(DIFFERENCES if numbers else {}))
        before = self.spark.conf.get(RELEASE, "false")
        try:
            self.spark.conf.set(RELEASE, "true" if self.dense else before)
            (out.partitionBy(by) if by else out).parquet(path)
        finally:
            self.spark.conf.set(RELEASE, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.seen = dict(watch.get) if watch else {}
        out._cut, out.mark = self.n, (out.seen.pop("mark_n", None), out.seen.pop("mark_h", None))
        self.live[self.n] = path
        return out

    def together(self, dfs: list[DataFrame]) -> DataFrame:
        """The rows of several tables of the same columns, as one scan."""
        out = self.spark.read.schema(dfs[0].schema).parquet(*[self.live[df._cut] for df in dfs])
        out._cuts = [df._cut for df in dfs]
        return out

    def drop(self, *dfs: DataFrame | None) -> None:
        for n in [n for df in dfs for n in getattr(df, "_cuts", [getattr(df, "_cut", 0)])]:
            path = self.live.pop(n, None)
            if path:
                _delete(path)

    def drop_part(self, df: DataFrame, by: str, value: int) -> None:
        """Deletes the rows of one value of `by`, which no later step may read."""
        _delete(f"{self.live[df._cut]}/{by}={value}")

    def release(self) -> None:
        """Has the driver collect its garbage, as Spark does by itself every half an hour: a loop of many short queries leaves
        plans behind faster than the heap is worth growing for, and their shuffle files and broadcasts go only with them."""
        self.spark.sparkContext._jvm.System.gc()

    def finish(self, df: DataFrame) -> DataFrame:
        files = [unquote(f) for f in df.inputFiles()]
        for n, path in list(self.live.items()):
            tail = f"{self.base.split('/')[-1]}/{n}/"
            if any(tail in f for f in files):
                _LEFT.add(self.base)
            else:
                _delete(path)
                del self.live[n]
        if not self.live:
            _delete(self.base)
        return df


def blank_to_null(c: Column) -> Column:
    """Null for null, empty and blank strings, else the string without surrounding white space."""
    t = F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")
    return F.when(t != "", t)


def spread(df: DataFrame) -> DataFrame:
    """The scan as it is; spread over the cores only where it has fewer partitions than these (a small file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
