"""History of changing entity attributes from periodic snapshots.

Method: an event-sourced change log per attribute, each attribute with its own intervals; versions come from
splitting at the union of all boundary dates and coalescing equal neighbours.

Defined results: rows with a null entity or date are no observations; of several rows for one entity and date the
one loaded last counts (a null load time is the earliest, then the greatest text of the row); an entity missing
from a snapshot, or not current in it, has no version there. Blank values are null and null equals null. Columns
beyond those named are ignored. After the first step an entity has at most one row per snapshot date, so windows
by entity are bounded by the calendar of the table; the dates themselves are one row per snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"
PRESENT = "_present"


def same_text(c: Column) -> Column:
    """Text without case, surrounding and repeated blanks; null if blank."""
    t = F.lower(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+", " "))
    return F.when(t != "", t)


def last_digits(c: Column, n: int = 10) -> Column:
    """The last n digits; null without digits."""
    d = F.right(F.regexp_replace(c, "[^0-9]", ""), F.lit(n))
    return F.when(d != "", d)


def first_chars(c: Column, n: int = 5) -> Column:
    t = F.substring(F.regexp_replace(c, r"^\s+|\s+$", ""), 1, n)
    return F.when(t != "", t)


def fan_attributes() -> dict[str, Column]:
    """The attributes of a fan whose change opens a version, as compared."""
    texts = {k: same_text(F.col(k)) for k in ("first_name", "last_name", "email", "city", "state")}
    return texts | {"phone": last_digits(F.col("phone")), "zip": first_chars(F.col("zip")), "dob": F.col("dob").cast("string")}


def latest_rows(snapshots: DataFrame, entity: str, date: str, loaded: str) -> DataFrame:
    """One row per entity and date: the one loaded last."""
    w = Window.partitionBy(entity, date).orderBy(F.col(loaded).desc_nulls_last(), F.to_json(F.struct(*snapshots.columns)).desc())
    return snapshots.filter(F.col(entity).isNotNull() & F.col(date).isNotNull()).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def calendar(snapshots: DataFrame, date: str) -> DataFrame:
    """Every snapshot date of the whole table with the one that follows it (null after the last)."""
    days = snapshots.filter(F.col(date).isNotNull()).groupBy(date).agg(F.lit(1).alias("_one"))
    return days.select(F.col(date).alias("_day"), F.lead(date).over(Window.partitionBy("_one").orderBy(date)).alias("_next_day"))


def change_log(snapshots: DataFrame, entity: str, date: str, loaded: str, attributes: dict[str, Column], current: str | None = None) -> DataFrame:
    """The log: entity, attribute, value, valid_from, valid_to (null while it lasts).

    An interval ends where the value changes or the entity is absent. PRESENT is an attribute of its own, whose
    intervals are the periods of unbroken presence.
    """
    rows = latest_rows(snapshots, entity, date, loaded)
    if current:
        rows = rows.filter(F.col(current))
    seen = rows.join(calendar(snapshots, date), F.col(date) == F.col("_day")).select(entity, F.col(date).alias("_day"), "_next_day", *[v.alias(f"a_{k}") for k, v in attributes.items()])
    w = Window.partitionBy(entity).orderBy("_day")
    seen = seen.withColumn("_gap", ~F.lag("_next_day").over(w).eqNullSafe(F.col("_day")))
    for k in attributes:
        seen = seen.withColumn(f"c_{k}", F.col("_gap") | ~F.lag(f"a_{k}").over(w).eqNullSafe(F.col(f"a_{k}")))
    ends = F.lead("_gap").over(w)
    seen = seen.withColumn("_ends", F.coalesce(ends, F.lit(True)))
    events = [F.when(F.col(f"c_{k}"), F.struct(F.lit(k).alias("attribute"), F.col(f"a_{k}").alias("value"), F.col("_day").alias("day"), F.lit(True).alias("opens"))) for k in attributes]
    events += [F.when(F.col("_gap"), F.struct(F.lit(PRESENT).alias("attribute"), F.lit(None).cast("string").alias("value"), F.col("_day").alias("day"), F.lit(True).alias("opens")))]
    closing = [F.when(F.col("_ends") & F.col("_next_day").isNotNull(), F.struct(F.lit(k).alias("attribute"), F.lit(None).cast("string").alias("value"), F.col("_next_day").alias("day"), F.lit(False).alias("opens"))) for k in [*attributes, PRESENT]]
    log = seen.select(entity, F.inline(F.filter(F.array(*events, *closing), lambda e: e.isNotNull())))
    v = Window.partitionBy(entity, "attribute").orderBy("day", "opens")
    log = log.withColumn("valid_to", F.lead("day").over(v))
    return log.filter("opens").select(entity, "attribute", "value", F.col("day").alias("valid_from"), "valid_to")


def combine_intervals(log: DataFrame, entity: str, attributes: list[str]) -> DataFrame:
    """Versions: split at the union of the attributes' boundary dates, carry each attribute's value, coalesce equal neighbours."""
    w = Window.partitionBy(entity).orderBy("day")
    opened = log.groupBy(entity, F.col("valid_from").alias("day")).agg(
        F.bool_or(F.col("attribute") == PRESENT).alias("_starts"),
        F.max(F.when(F.col("attribute") == PRESENT, F.coalesce("valid_to", F.to_date(F.lit(OPEN_END))))).alias("_until"),
        *[F.max(F.when(F.col("attribute") == k, F.struct(F.lit(1).alias("set"), F.col("value").alias("v")))).alias(f"s_{k}") for k in attributes],
    )
    filled = opened.withColumn("_until", F.last("_until", ignorenulls=True).over(w))
    for k in attributes:
        filled = filled.withColumn(k, F.last(f"s_{k}", ignorenulls=True).over(w)["v"])
    same = F.lit(True)
    for k in attributes:
        same = same & F.lag(k).over(w).eqNullSafe(F.col(k))
    kept = filled.withColumn("_same", same & ~F.col("_starts")).filter("not _same")
    end = F.least(F.coalesce(F.lead("day").over(w), F.to_date(F.lit(OPEN_END))), F.col("_until"))
    return kept.select(entity, F.col("day").alias("valid_from"), end.alias("valid_to"), *attributes)


def versions(snapshots: DataFrame, entity: str, date: str, loaded: str, attributes: dict[str, Column], current: str | None = None) -> DataFrame:
    log = change_log(snapshots, entity, date, loaded, attributes, current)
    return combine_intervals(log, entity, list(attributes))


def fan_history(snapshots: DataFrame) -> DataFrame:
    """The fan dimension's history: a surrogate fan_key per version, the period, is_current and the attributes as compared."""
    v = versions(snapshots, "fan_id", "snapshot_date", "loaded_at", fan_attributes(), "is_current")
    names = list(fan_attributes())
    return v.select(F.conv(F.substring(F.sha1(F.concat_ws("|", "fan_id", F.col("valid_from").cast("string"))), 1, 15), 16, 10).cast("long").alias("fan_key"), "fan_id", "valid_from", "valid_to", (F.col("valid_to") == F.to_date(F.lit(OPEN_END))).alias("is_current"), *names)
