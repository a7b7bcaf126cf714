"""References to records that do not exist, were deleted, or arrived only later.

Method: sorted integer parent keys are compressed into contiguous runs; each distinct referenced number is matched
as of the preceding run start, and numbers beyond the run's end are missing. Runs are cut at blocks of BLOCK
numbers, which makes the as-of match a window over one block: at most BLOCK distinct numbers of parents and as many
references, whatever the size of the tables. Only references within a run meet a parent, for its times of load and
deletion; numbers of more than 18 digits are compared as text instead. References are brought to distinct keys before the match, so a key
that holds a third of all rows is one row there; back at the rows it meets an equi-join which AQE may split.

Defined results: null and blank references are no cases; keys that are not letters, hyphen and number are missing;
a child key's first loaded row counts (a null load time is the last, then the least text of the row); a child
without its own key or time is reported with null there; extra columns are not read; empty tables are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
KEY = r"^\s*([A-Za-z]+)-0*([0-9]+)\s*$"


def key_prefix(c: Column) -> Column:
    p = F.upper(F.regexp_extract(c, KEY, 1))
    return F.when(p != "", p)


def key_number(c: Column) -> Column:
    """The number as text without leading zeros; null if the key has no such form."""
    n = F.regexp_extract(c, KEY, 2)
    return F.when(n != "", n)


def _keyed(df: DataFrame, key: str) -> DataFrame:
    """prefix, num (numbers too long for 18 digits stay null and are compared as text only) and `digits`."""
    digits = key_number(F.col(key))
    return df.withColumn("prefix", key_prefix(F.col(key))).withColumn("digits", digits).withColumn("num", F.when(F.length(digits) <= 18, digits.cast("long")))


def parent_keys(parents: DataFrame, key: str, loaded: str, deleted: str | None) -> DataFrame:
    """One row per parent key: its first load and its earliest deletion."""
    gone = F.min(F.col(deleted)) if deleted else F.lit(None).cast("timestamp")
    return _keyed(parents, key).filter("digits is not null").groupBy("prefix", "digits", "num").agg(F.min(loaded).alias("first_loaded"), gone.alias("deleted_at"))


def key_runs(keys: DataFrame) -> DataFrame:
    """Contiguous runs of numbers: prefix, block, run_start, run_end; a run never crosses a block."""
    blocked = keys.filter("num is not null").select("prefix", F.expr(f"num div {BLOCK}").alias("block"), "num")
    w = Window.partitionBy("prefix", "block").orderBy("num")
    island = blocked.withColumn("island", F.col("num") - F.row_number().over(w))
    return island.groupBy("prefix", "block", "island").agg(F.min("num").alias("run_start"), F.max("num").alias("run_end")).drop("island")


def run_match(refs: DataFrame, runs: DataFrame) -> DataFrame:
    """Distinct referenced (prefix, num) with `absent`: whether it lies beyond the end of the run that starts at or before it."""
    a = runs.select("prefix", "block", F.col("run_start").alias("at"), F.lit(0).alias("is_ref"), "run_end")
    b = refs.select("prefix", F.expr(f"num div {BLOCK}").alias("block"), F.col("num").alias("at"), F.lit(1).alias("is_ref"), F.lit(None).cast("long").alias("run_end"))
    w = Window.partitionBy("prefix", "block").orderBy("at", "is_ref")
    seen = a.unionByName(b).withColumn("end", F.last("run_end", ignorenulls=True).over(w)).filter("is_ref = 1")
    return seen.select("prefix", F.col("at").alias("num"), (F.col("end").isNull() | (F.col("at") > F.col("end"))).alias("absent"))


def orphan_references(children: DataFrame, child_table: str, child_key: str, ref: str, happened: str, loaded: str,
                      parents: DataFrame, parent_key: str, parent_loaded: str, parent_deleted: str | None) -> DataFrame:
    """child_table, child_key, ref_month, orphan_kind (`missing`, `deleted` or `late`) of every orphan reference."""
    cols = [child_key, ref, happened, loaded]
    rest = F.struct(F.col(loaded).isNull().alias("n"), F.col(loaded).alias("l"), F.col(ref).alias("ref"), F.col(happened).alias("happened"))
    first = children.select(*cols).filter(F.col(child_key).isNotNull()).groupBy(child_key).agg(F.min(rest).alias("r"))
    nokey = children.filter(F.col(child_key).isNull()).select(F.lit(None).cast("string").alias(child_key), rest.alias("r"))
    rows = first.unionByName(nokey).select(F.col(child_key).alias("child_key"), F.col("r.ref").alias("ref"), F.col("r.happened").alias("happened"), F.col("r.l").alias("loaded"))
    rows = _keyed(rows.filter(F.regexp_replace("ref", r"\s+", "") != ""), "ref").drop("ref")
    keys = parent_keys(parents, parent_key, parent_loaded, parent_deleted)
    refs = rows.filter("digits is not null").select("prefix", "digits", "num").distinct()
    by_runs = run_match(refs.filter("num is not null"), key_runs(keys)).select("prefix", F.col("num").cast("string").alias("digits"), "absent")
    known = keys.select("prefix", "digits", "first_loaded", "deleted_at")
    too_long = refs.filter("num is null").select("prefix", "digits").join(known.select("prefix", "digits", F.lit(False).alias("absent")), ["prefix", "digits"], "left").fillna(True, ["absent"])
    # the runs say which references are absent; the others meet their parent's times, once per distinct reference
    judged = by_runs.unionByName(too_long)
    status = judged.filter("not absent").join(known, ["prefix", "digits"]).unionByName(judged.filter("absent"), allowMissingColumns=True)
    met = rows.join(status, ["prefix", "digits"], "left")
    kind = (
        F.when(F.col("absent") | F.col("digits").isNull(), "missing")
        .when(F.col("deleted_at") <= F.col("happened"), "deleted")
        .when(F.col("first_loaded") > F.col("loaded"), "late")
    )
    return met.select(F.lit(child_table).alias("child_table"), "child_key", F.date_format("happened", "yyyy-MM").alias("ref_month"), kind.alias("orphan_kind")).filter("orphan_kind is not null")


def orphan_counts(orphans: DataFrame) -> DataFrame:
    return orphans.groupBy("child_table", "ref_month", "orphan_kind").agg(F.count("*").alias("n_orphans"))
