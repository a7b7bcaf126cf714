"""Files of a drop zone: listing, month pruning, content-hash skip, schemaless JSON lines and CSV scans, landing copies."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def batch_month(name: Column) -> Column:
    """YYYY-MM out of a file name such as orders_2025-03.jsonl; null where it names none."""
    m = F.regexp_extract(name, r"_([0-9]{4}-[0-9]{2})\.(csv|jsonl)$", 1)
    return F.when(m != "", m)


def prune_months(files: DataFrame, name: str, first: str | None, last: str | None) -> DataFrame:
    """Files whose month lies in the range; files without a month always stay."""
    m = batch_month(F.col(name))
    keep = F.lit(True)
    if first:
        keep = keep & (m.isNull() | (m >= first))
    if last:
        keep = keep & (m.isNull() | (m <= last))
    return files.filter(keep)


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, length and sha of the content of every file that matches, in name order."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy("path")


def unseen(files: DataFrame, registry: DataFrame, force: bool = False) -> DataFrame:
    """Files whose content the registry (path, sha256) does not have under that path."""
    return files if force else files.join(registry.select("path", "sha256"), ["path", "sha256"], "left_anti")


def read_json_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """payload and source_file of every line that is not blank, unparsed, so that new fields break nothing."""
    lines = spark.read.text(path).select(F.col("value").alias("payload"), F.col("_metadata.file_name").alias("source_file"))
    return lines.filter(F.trim("payload") != "")


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as strings under the header's names; empty cells stay empty strings.

    Files whose headers differ are read one header at a time and brought together by name, absent columns as null.
    """
    paths = [path] if isinstance(path, str) else path
    heads: dict[str, list[str]] = {}
    for p in paths:
        first = spark.read.text(p).first()  # the header line of one file
        heads.setdefault(first[0] if first else "", []).append(p)
    read = lambda ps: spark.read.option("header", True).csv(ps).select("*", F.col("_metadata.file_name").alias("source_file")).fillna("")
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (read(ps) for ps in heads.values()))


def land(files: DataFrame, target: str) -> None:
    """Writes text rows (payload, source_file) under the lake folder, one partition a file."""
    files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_file").parquet(target)
