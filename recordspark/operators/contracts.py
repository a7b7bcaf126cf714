"""Row contracts over landed text: rejects with reasons, whole-file rejects, replace-by-file loads and quarantine.

A contract is a list of column rules. A rule sees blank as null, while the row that lands stays as it came. Reasons of
a row are distinct, sorted and joined. A required column that no row of a file carries rejects the whole file. Keys met
twice in a file reject all their rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordspark.runtime import blank_to_null

ISO_INSTANT, ISO_DAY, DECIMAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$", r"^\d{4}-\d{2}-\d{2}$", r"^\d+(\.\d+)?$"


@dataclass(frozen=True)
class Rule:
    """A column, what it must be, and whether it must be there and filled."""

    column: str
    says: str = ""
    holds: Callable[[Column], Column] | None = None
    required: bool = True
    nullable: bool = False


@dataclass(frozen=True)
class Contract:
    rules: list[Rule] = field(default_factory=list)
    key: str | None = None


def starts(prefix: str) -> tuple[str, Callable[[Column], Column]]:
    return f"must start with {prefix}", lambda c: F.startswith(c, F.lit(prefix))


def matches(pattern: str) -> tuple[str, Callable[[Column], Column]]:
    return f"must match {pattern}", lambda c: c.rlike(pattern)


def one_of(*values: str) -> tuple[str, Callable[[Column], Column]]:
    return f"must be one of {', '.join(values)}", lambda c: c.isin(*values)


MAIL = ("must look like an e-mail address", lambda c: c.rlike(r"@[^@]*\.[^@]*$"))
NUMBER_TEXT = ("must be a non-negative number", lambda c: c.rlike(DECIMAL))
POSITIVE = ("must be positive", lambda c: F.coalesce(c.try_cast("double") > 0, F.lit(False)))
COUNT_1_10 = ("must be a whole number from 1 to 10", lambda c: c.rlike(r"^\d+$") & F.coalesce(c.try_cast("int").between(1, 10), F.lit(False)))

CONTRACTS = {
    "crm_contacts": Contract([Rule("Id", *starts("003")), Rule("LastName"), Rule("Email", *MAIL, nullable=True), Rule("SystemModstamp", *matches(ISO_INSTANT)), Rule("Birthdate", *matches(ISO_DAY), nullable=True)], "Id"),
    "crm_opportunities": Contract([Rule("Id", *starts("006")), Rule("ContactId", *starts("003")), Rule("Amount", *POSITIVE), Rule("Type", *one_of("Membership", "Donation")), Rule("CloseDate", *matches(ISO_DAY)), Rule("SystemModstamp", *matches(ISO_INSTANT))], "Id"),
    "ticketing_orders": Contract([Rule("order_id", *starts("T-")), Rule("match_id", *starts("MTCH-")), Rule("purchased_at", *matches(ISO_INSTANT)), Rule("qty", *COUNT_1_10), Rule("total", *POSITIVE), Rule("purchaser_name"), Rule("purchaser_email", *MAIL)], "order_id"),
    "merch_order_items": Contract([Rule("order_number", *starts("M-")), Rule("created_at", *matches(ISO_INSTANT)), Rule("customer_email", *MAIL), Rule("billing_name"), Rule("sku"), Rule("item_name"), Rule("quantity", *NUMBER_TEXT), Rule("unit_price", *NUMBER_TEXT), Rule("line_total", *NUMBER_TEXT)] + [Rule(c, required=False, nullable=True) for c in ("billing_zip", "billing_postal_code", "discount_code")]),
    "email_subscribers": Contract([Rule("subscriber_id", *starts("S-")), Rule("email", *MAIL), Rule("signup_date", *matches(ISO_DAY)), Rule("status", *one_of("subscribed", "unsubscribed"))], "subscriber_id"),
    "email_events": Contract([Rule("event_id", *starts("E-")), Rule("subscriber_id", *starts("S-")), Rule("campaign_id", *starts("C-")), Rule("event_type", *one_of("send", "open", "click")), Rule("occurred_at", *matches(ISO_INSTANT))], "event_id"),
    "email_campaigns": Contract([Rule("campaign_id", *starts("C-")), Rule("name"), Rule("sent_at", *matches(ISO_INSTANT))], "campaign_id"),
    "fixtures": Contract([Rule("match_id", *starts("MTCH-")), Rule("kickoff_at", *matches(ISO_INSTANT)), Rule("home_team"), Rule("away_team")], "match_id"),
}


def judge(rows: DataFrame, contract: Contract, file_column: str = "source_file") -> DataFrame:
    """Adds `reason`, null for accepted rows. Columns of the contract that the table lacks count as missing from every file."""
    present = [r for r in contract.rules if r.column in rows.columns]
    absent = [r for r in contract.rules if r.column not in rows.columns and r.required]
    whole = [F.lit(f"{r.column}: column missing") for r in absent]
    counted = rows
    needed = [r for r in present if r.required]
    if needed:  # a column that is null in all rows of a file was not in the file
        seen = rows.groupBy(file_column).agg(*[F.bool_or(F.col(r.column).isNotNull()).alias(f"_has_{r.column}") for r in needed])
        counted = rows.join(seen.withColumnRenamed(file_column, "_file"), F.col(file_column).eqNullSafe(F.col("_file"))).drop("_file")
        whole += [F.when(~F.col(f"_has_{r.column}"), f"{r.column}: column missing") for r in needed]
    if contract.key and contract.key in rows.columns:
        twice = rows.groupBy(file_column, contract.key).agg(F.count("*").alias("_k")).filter(F.col(contract.key).isNotNull() & (F.col("_k") > 1))
        twice = twice.select(F.col(file_column).alias("_file"), F.col(contract.key).alias("_key"), F.lit(True).alias("_twice"))
        counted = counted.join(twice, F.col(file_column).eqNullSafe(F.col("_file")) & (F.col(contract.key) == F.col("_key")), "left").drop("_file", "_key")
    own = []
    for r in present:
        v = blank_to_null(F.col(r.column))
        if not r.nullable:
            own.append(F.when(v.isNull(), f"{r.column}: empty"))
        if r.holds:
            own.append(F.when(v.isNotNull() & ~r.holds(v), f"{r.column}: {r.says}"))
    if "_twice" in counted.columns:
        own.append(F.when(F.col("_twice"), f"{contract.key}: not unique in its file"))
    text = lambda cs: F.nullif(F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*cs)))), "; "), F.lit(""))
    reason = F.coalesce(text(whole) if whole else F.lit(None).cast("string"), text(own) if own else F.lit(None).cast("string"))
    return counted.withColumn("reason", reason).select(*rows.columns, "reason")


def split(judged: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows as they came, rejected rows with their reason)."""
    return judged.filter("reason is null").select(*columns), judged.filter("reason is not null").select(*columns, "reason")


def replace_by_file(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """The table after a load: rows of `files` (source_file) give way to the new ones, also where a file has none."""
    return old.join(files.select("source_file").distinct(), "source_file", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def supersede(quarantine: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Quarantined rows whose key has not come again."""
    return quarantine.join(batch.select(key).distinct(), key, "left_anti").select(*quarantine.columns)


class FileTable:
    """A parquet table partitioned by source_file whose files are replaced one by one; a replay is a clean replace."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def load(self, rows: DataFrame, files: list[str]) -> None:
        """Replaces the named files. A file without rows leaves no partition behind, which an overwrite alone would."""
        from urllib.parse import quote

        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_file").parquet(self.path))
        have = {r["source_file"] for r in rows.select("source_file").distinct().collect()} if files else set()  # a load names its files, so at most these
        jvm = self.spark.sparkContext._jvm
        for f in set(files) - have:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/source_file={quote(f, safe='')}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)
