"""Schemas that drift between files: changes per file, and one table with one set of columns and types.

Method: profile columns (value sketches, content forms and types, name similarity), solve the bipartite matching
between a file and the one before it to find renames, then unify the matched columns. Sketches of columns with a
known name are pooled over all feeds, so two columns are also alike by what both share with a known one.

Names that are the same in both files stay the same column; only the others are matched. Files without records,
repeated lines and empty values are defined: a column without values keeps the type it had, and an added one has
none until a file brings values. Column metadata is a row per file and column, whatever the number of records.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspark.operators.delimited import COUNTS, PART_NAMES, Pools, matched_files, profile
from recordspark.operators.parse_failures import judged_lines
from recordspark.runtime import Cut

CHANGE = "source_file string, change_kind string, old_name string, new_name string"


def narrowest_type(r: pd.Series) -> str | None:
    """Of integer, decimal, timestamp and text the narrowest that fits all non-empty values; None without values."""
    n = r["n"]
    if not n:
        return None
    return "integer" if r["n_int"] == n else "decimal" if r["n_dec"] == n else "timestamp" if r["n_ts"] == n else "text"


def feed_changes(columns: pd.DataFrame, pools: Pools) -> pd.DataFrame:
    """Changes of one feed's files in order of month; the first has none."""
    out, before, kinds = [], None, {}
    for f, g, _, renamed in matched_files(columns, pools):
        now = {r["name"]: r for _, r in g.drop_duplicates("name").iterrows()}
        if before is None:
            kinds = {k: narrowest_type(r) for k, r in now.items()}
        else:
            gone, fresh = [k for k in before if k not in now], [k for k in now if k not in before]
            out += [(f, "renamed", a, b) for b, a in renamed.items()]
            out += [(f, "removed", a, "") for a in gone if a not in renamed.values()]
            out += [(f, "added", "", b) for b in fresh if b not in renamed]
            had, kinds = kinds, {}
            for k, r in now.items():
                was = had.get(renamed.get(k, k)) if k in before or k in renamed else None
                is_now = narrowest_type(r) or was
                if was and is_now != was:
                    out.append((f, "retyped", k, k))
                kinds[k] = is_now
        before = now
    return pd.DataFrame(out, columns=["source_file", "change_kind", "old_name", "new_name"])


def loaded_columns(raw: DataFrame, cut: Cut) -> tuple[DataFrame, DataFrame, Pools]:
    """(judged lines, metadata of every file's columns with counts over the lines that load, pooled sketches).

    The lines were profiled once to find their columns; what the few lines with an invalid value had added is taken off.
    """
    judged, meta, pools = judged_lines(raw, cut)
    failed = profile(judged.filter("reason is not null and broken is null")).drop("sketch")
    off = failed.select("source_file", "pos", *[F.col(c).alias(f"_{c}") for c in COUNTS])
    less = [(F.col(c) - F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in COUNTS]
    return judged, meta.join(off, ["source_file", "pos"], "left").select("feed", "month", "source_file", "pos", "name", "sketch", *less), pools


def drift_report(raw: DataFrame, cut: Cut) -> DataFrame:
    """source_file, change_kind, old_name and new_name of every change."""
    _, meta, pools = loaded_columns(raw, cut)
    return meta.groupBy("feed").applyInPandas(lambda pdf: feed_changes(pdf, pools), CHANGE)


def price_scales(lines: DataFrame) -> DataFrame:
    """source_file, price_scale and total_scale of files whose whole-number prices are shown to be hundredths.

    A file's unit prices are compared with those of the same goods in files that write them with a point; they are
    hundredths where most goods cost about a hundred times as much. Line totals are compared with quantity times price
    in their own lines. Without such evidence a scale is 1, whatever the numbers look like.
    """
    usual = lines.filter("not whole_price and unit_price > 0").groupBy("sku").agg(F.percentile_approx("unit_price", 0.5).alias("usual"))
    here = lines.filter("whole_price and unit_price > 0").groupBy("source_file", "sku").agg(F.min("unit_price").alias("price")).join(usual, "sku")
    far = F.round(F.log10((F.col("price") / F.col("usual")).cast("double"))) == 2
    unit = here.groupBy("source_file").agg(F.when(2 * F.count_if(far) > F.count("*"), 100).otherwise(1).alias("price_scale"))
    with_unit = lines.filter("whole_price or whole_total").join(unit, "source_file", "left").withColumn("price_scale", F.coalesce("price_scale", F.lit(1)))
    worth = F.col("quantity") * F.col("unit_price") / F.col("price_scale")
    cents = (F.col("line_total") - worth * 100) == 0
    plain = (F.col("line_total") - worth) == 0
    total = F.when(F.max(F.col("whole_total").cast("int")) == 0, 1).when(F.count_if(cents & (worth != 0)) > F.count_if(plain & (worth != 0)), 100).otherwise(1)
    return with_unit.groupBy("source_file").agg(F.max("price_scale").alias("price_scale"), total.alias("total_scale"))


def unified_lines(raw: DataFrame, cut: Cut) -> DataFrame:
    """All lines that load as one table; columns beyond the shop order's own come in `extras`, by name.

    Prices keep their value; where `price_scales` shows that a file writes hundredths they come out in units, and
    price_scale or total_scale says so.
    """
    judged, meta, _ = loaded_columns(raw, cut)
    whole = meta.filter("n > 0 and n = n_int").groupBy("source_file").agg(F.collect_set("pos").alias("whole"))
    good = judged.filter("reason is null").join(whole, "source_file", "left")
    at = lambda p: F.array_position("parts", p)
    v = lambda p: F.nullif(F.try_element_at("values", F.nullif(at(p), F.lit(0)).cast("int")), F.lit(""))
    is_whole = lambda p: F.coalesce(F.array_contains("whole", (at(p) - 1).cast("int")), F.lit(False))
    number = lambda p: v(p).cast("decimal(18,4)").alias(p)
    made = F.when(F.col("time_form") == "epoch", F.timestamp_seconds(v("created_at").cast("long"))).otherwise(F.try_to_timestamp(v("created_at"), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))
    named = F.arrays_zip(F.col("names").alias("k"), F.col("parts").alias("p"), F.col("values").alias("x"))
    extras = F.map_from_entries(F.transform(F.filter(named, lambda c: (c["p"] == "") & (c["k"] != "")), lambda c: F.struct(c["k"], c["x"])))
    texts = [v(p).alias(p) for p in PART_NAMES if p not in ("created_at", "quantity", "unit_price", "line_total")]
    lines = cut.table(good.select(
        "row_id", "source_file", "line_no", *texts, made.alias("created_at"), *[number(p) for p in ("quantity", "unit_price", "line_total")],
        F.to_json(extras).alias("extras"), is_whole("unit_price").alias("whole_price"), is_whole("line_total").alias("whole_total"),
    ))
    scales = price_scales(lines)
    out = lines.join(scales, "source_file", "left").fillna(1, ["price_scale", "total_scale"])
    units = lambda p, k: (F.col(p) / F.col(k)).cast("decimal(18,2)").alias(p)
    kept = [c for c in lines.columns if c not in ("whole_price", "whole_total", "quantity", "unit_price", "line_total", "extras")]
    return out.select(*kept, F.col("quantity").cast("decimal(18,2)").alias("quantity"), units("unit_price", "price_scale"), units("line_total", "total_scale"), "price_scale", "total_scale", "extras")
