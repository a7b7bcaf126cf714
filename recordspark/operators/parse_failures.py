"""Rows that fail to parse, apart with reasons, and typed rows of all others.

Method: cast each distinct value per column once, keep the invalid ones with a reason in a dictionary, and join
that back to the rows beside the structural checks. The dictionary joins as a broadcast only where the adaptive
plan has measured it as small; hot values are met once, since the distinct step aggregates before its shuffle.

Defined results: a null payload is an empty line or text and fails; repeated rows are judged each on its own; rows
keep their row_id, which may be null or repeated; extra columns of the input, whatever their names, are not
read; empty tables give empty results; very long texts are read whole.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordspark.operators.delimited import DECIMAL, Pools, column_metadata, file_parts, is_instant, mail_shape, part_pools, profile, read_headers, split_lines
from recordspark.runtime import Cut, spread

RAW_LINE = ["row_id", "payload", "source_file", "line_no"]
CHECKED = ["order_number", "created_at", "customer_email", "billing_name", "sku", "item_name", "quantity", "unit_price", "line_total"]


def line_value_reason(kind: Column, v: Column) -> Column:
    """Null for a valid value of this kind; kinds are the parts of PART_NAMES, created_at with its file's form."""
    number = v.rlike(DECIMAL)
    return (
        F.when((kind == "order_number") & ~F.startswith(v, F.lit("M-")), "order_number: does not start with M-")
        .when(kind.isin("billing_name", "sku", "item_name") & (v == ""), F.concat(kind, F.lit(": empty")))
        .when((kind == "customer_email") & ~mail_shape(v), "customer_email: no e-mail shape")
        .when(kind.isin("quantity", "unit_price", "line_total") & ~number, F.concat(kind, F.lit(": not a number")))
        .when((kind == "created_at:iso") & ~is_instant(v), "created_at: no instant")
        .when((kind == "created_at:epoch") & ~v.rlike(r"^[0-9]+$"), "created_at: no seconds since 1970")
    )


def _dictionary(cells: DataFrame, reason) -> DataFrame:
    """Invalid distinct values with their reason."""
    return cells.select("kind", "v").distinct().withColumn("reason", reason(F.col("kind"), F.col("v"))).filter("reason is not null")


def _with_reasons(rows: DataFrame, cells: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows with the sorted reasons of their invalid values; `_row` numbers them, since a row_id may be null or repeated."""
    hits = cells.join(bad, ["kind", "v"])
    failed = hits.groupBy("_row").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reason"))
    return rows.join(failed, "_row", "left").drop("_row")


def parsed_lines(raw: DataFrame, cut: Cut) -> tuple[DataFrame, DataFrame, Pools]:
    """(lines with values, names, parts, time_form and broken; metadata of every file's columns; pooled sketches)."""
    raw = raw.select(*RAW_LINE)
    headers = cut.table(read_headers(raw))
    lines = cut.table(split_lines(spread(raw), headers).withColumn("_row", F.monotonically_increasing_id()))
    meta = cut.table(column_metadata(headers, profile(lines.filter("broken is null"))))
    pools = part_pools(meta)
    parts = cut.table(file_parts(meta, pools))
    cut.drop(headers)
    return lines.join(parts, "source_file", "left"), meta, pools


def judged_lines(raw: DataFrame, cut: Cut) -> tuple[DataFrame, DataFrame, Pools]:
    """All records with `reason` (null where the line loads), the column metadata and the pooled sketches."""
    lines, meta, pools = parsed_lines(raw, cut)
    whole = lines.filter("broken is null")
    kind = F.transform("parts", lambda p: F.when(p == "created_at", F.concat(p, F.lit(":"), F.col("time_form"))).when(p.isin(CHECKED), p))
    cells = (
        whole.withColumn("kinds", kind)
        .select("_row", F.inline(F.arrays_zip(F.col("kinds").alias("kind"), F.col("values").alias("v"))))
        .filter("kind is not null")
    )
    out = _with_reasons(lines, cells, _dictionary(cells, line_value_reason))
    return out.withColumn("reason", F.coalesce("broken", "reason")), meta, pools


def _json_fields(payload: pd.Series) -> pd.DataFrame:
    """Strict reading of one JSON object a row. A string comes as `s` and its text, another value as `x`, an absent or null one as null."""

    def refuse(_: str) -> None:
        raise ValueError("constant")

    def mark(v: object) -> str | None:
        return None if v is None else "s" + v if isinstance(v, str) else "x"

    rows = []
    for text in payload:
        error, got = None, {}
        try:
            doc = json.loads(text if text is not None else "", parse_constant=refuse, parse_int=str.__len__, parse_float=str.__len__)
            if isinstance(doc, dict):
                got = doc
            else:
                error = "not_an_object"
        except (ValueError, RecursionError, TypeError):
            error = "not_json"
        out = [error, *(mark(got.get(k)) for k in CONTACT_FIELDS)]
        rows.append([x.encode("utf-8", "replace").decode() if x else x for x in out])
    return pd.DataFrame(rows, columns=["error", *CONTACT_FIELDS])


CONTACT_FIELDS = ["Id", "FirstName", "LastName", "Email", "Phone", "MailingCity", "MailingState", "MailingPostalCode", "Birthdate", "Member_Since__c", "CreatedDate", "SystemModstamp"]
_CONTACT_TYPE = "error string, " + ", ".join(f"`{k}` string" for k in CONTACT_FIELDS)


def contact_value_reason(kind: Column, v: Column) -> Column:
    """v is null where absent or null, else `s` and a text, or `x` for any other JSON value."""
    text = F.substring(v, F.lit(2), F.length(v))
    is_text = F.coalesce(F.startswith(v, F.lit("s")), F.lit(False))
    day = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull()
    given = F.coalesce(v != "s", F.lit(False))
    return (
        F.when((kind == "Id") & ~(is_text & F.startswith(text, F.lit("003"))), "Id: does not start with 003")
        .when((kind == "LastName") & ~(is_text & text.rlike(r"[^\s]")), "LastName: blank")
        .when((kind == "Email") & given & ~(is_text & mail_shape(text)), "Email: no e-mail shape")
        .when((kind == "SystemModstamp") & ~(is_text & is_instant(text)), "SystemModstamp: no instant")
        .when((kind == "Birthdate") & given & ~(is_text & day), "Birthdate: no date")
    )


def judged_contacts(raw: DataFrame, cut: Cut) -> DataFrame:
    """All payloads with their fields (`c`) and `reason` (null where the payload loads)."""
    read = F.pandas_udf(_json_fields, _CONTACT_TYPE)
    rows = cut.table(raw.select("row_id", "batch_id", "source_file", "loaded_at", read("payload").alias("c")).withColumn("_row", F.monotonically_increasing_id()))
    kinds = ["Id", "LastName", "Email", "SystemModstamp", "Birthdate"]
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(f"c.`{k}`"), F.lit("")).alias("v")) for k in kinds])
    cells = rows.filter("c.error is null").select("_row", F.inline(pairs))
    out = _with_reasons(rows, cells, _dictionary(cells, lambda k, v: contact_value_reason(k, F.nullif(v, F.lit("")))))
    return out.withColumn("reason", F.coalesce("c.error", "reason"))


def contact_rows(judged: DataFrame) -> DataFrame:
    """Typed contact versions of the payloads that load. Fields that are no strings there come out as null."""
    text = lambda k: F.when(F.startswith(F.col(f"c.`{k}`"), F.lit("s")), F.substring(F.col(f"c.`{k}`"), F.lit(2), F.length(F.col(f"c.`{k}`"))))
    stamp = lambda k: F.try_to_timestamp(text(k), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    day = lambda k: F.try_to_timestamp(text(k), F.lit("yyyy-MM-dd")).cast("date")
    return judged.filter("reason is null").select(
        "row_id", text("Id").alias("contact_id"), text("FirstName").alias("first_name"), text("LastName").alias("last_name"), text("Email").alias("email"),
        text("Phone").alias("phone"), text("MailingCity").alias("city"), text("MailingState").alias("state"), text("MailingPostalCode").alias("zip"),
        day("Birthdate").alias("dob"), day("Member_Since__c").alias("member_since"), stamp("CreatedDate").alias("created_at"),
        stamp("SystemModstamp").alias("modified_at"), "batch_id", "source_file", "loaded_at",
    )


def rejects(lines: DataFrame, contacts: DataFrame) -> DataFrame:
    """source_table, row_id and reason of every row that cannot be loaded."""
    a = lines.filter("reason is not null").select(F.lit("raw_merch_order_items").alias("source_table"), "row_id", "reason")
    return a.unionByName(contacts.filter("reason is not null").select(F.lit("raw_crm_contacts").alias("source_table"), "row_id", "reason"))
