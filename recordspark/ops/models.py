"""The warehouse's models over the domain's tables, by layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspark.operators import clusters as C
from recordspark.operators import dimensions as D
from recordspark.operators import parse_failures as P
from recordspark.operators import quality as Q
from recordspark.operators import schema_drift
from recordspark.operators import scored_linkage as S
from recordspark.ops.runner import Context, Model
from recordspark.plans import relational, text_queries
from recordspark.runtime import Cut

TRACKED = ["first_name", "last_name", "email", "phone", "city", "state", "zip", "dob"]
REFRESHED = ["sources", "record_count"]
ANALYST_COLUMNS = ["fan_key", "fan_id", "state", "sources", "record_count", "n_records", "first_seen", "last_seen"]


def _contacts(ctx: Context) -> DataFrame:
    rows = P.contact_rows(P.judged_contacts(ctx.read("raw_crm_contacts"), Cut(ctx.spark, "stg")))
    return C.last_of(rows, ["contact_id"], F.col("modified_at").desc_nulls_first(), F.col("loaded_at").desc_nulls_first())


def _merch(ctx: Context) -> DataFrame:
    return schema_drift.unified_lines(ctx.read("raw_merch_order_items"), Cut(ctx.spark, "stg"))


def _identity(ctx: Context) -> DataFrame:
    return ctx.read("identity_records")


def _links(mode: str) -> Model:
    def build(ctx: Context) -> DataFrame:
        return S.linkage(C.identity_input(ctx.table("staging.identity_records")), Cut(ctx.spark, "links"), mode)

    return build


def _golden(ctx: Context) -> DataFrame:
    return C.golden_records(C.identity_input(ctx.table("staging.identity_records")), ctx.table("identity.clusters").select("ref", "root"))


def _xref(ctx: Context) -> DataFrame:
    people = C.identity_input(ctx.table("staging.identity_records")).select("ref", "source_system", "source_record_id")
    return people.join(ctx.table("identity.clusters"), "ref").select("source_system", "source_record_id", C.person_id(F.col("root")).alias("fan_id"), "method", "score")


def _dim_fan(ctx: Context) -> DataFrame:
    golden = ctx.table("identity.golden_fans")
    try:
        dim = ctx.table("core.dim_fan")
    except Exception as e:  # the first run has no dimension yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stamp = F.lit(None).cast("timestamp")
        dim = golden.limit(0).select(F.lit(0).cast("long").alias("fan_key"), "fan_id", *TRACKED, *REFRESHED, stamp.alias("valid_from"), stamp.alias("valid_to"), F.lit(True).alias("is_current"))
    cut = Cut(ctx.spark, "dim")
    return cut.table(D.scd2_next(dim, golden.select("fan_id", *TRACKED, *REFRESHED), "fan_id", TRACKED, REFRESHED, F.lit(ctx.run_at).cast("timestamp"), cut, "fan_key"))


def _fact_email(ctx: Context) -> DataFrame:
    """Append-only: what is loaded keeps its values."""
    events = C.last_of(ctx.read("email_events").filter("event_id is not null"), ["event_id"], F.col("loaded_at").desc_nulls_first()).select("event_id", "subscriber_id", "campaign_id", "event_type", "occurred_at")
    try:
        fact = ctx.table("core.fact_email")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return events
    return fact.unionByName(D.append_absent(fact, events, "event_id"))


def _fan_activity(ctx: Context) -> DataFrame:
    """Current fans with their records' activity, rolled up before the join."""
    rec = ctx.table("staging.identity_records").join(ctx.table("identity.xref").select("source_system", "source_record_id", "fan_id"), ["source_system", "source_record_id"])
    act = rec.groupBy("fan_id").agg(F.count("*").alias("n_records"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"))
    return ctx.table("core.dim_fan").filter("is_current").join(act, "fan_id", "left").select("fan_key", "fan_id", "first_name", "last_name", "email", "city", "state", "zip", *REFRESHED, "n_records", "first_seen", "last_seen")


def analyst_view(ctx: Context) -> DataFrame:
    """What analysts may read of the fans: no names, addresses or contacts."""
    return ctx.table("marts.fan_activity").select(*ANALYST_COLUMNS)


def models(mode: str = "full") -> dict[str, Model]:
    return {
        "staging.crm_contacts": _contacts,
        "staging.merch_lines": _merch,
        "staging.ticketing_orders": lambda ctx: text_queries.stg_ticketing_orders(ctx.spark, ctx.source),
        "staging.email_subscribers": lambda ctx: text_queries.stg_email_subscribers(ctx.spark, ctx.source),
        "staging.identity_records": _identity,
        "identity.clusters": _links(mode),
        "identity.xref": _xref,
        "identity.golden_fans": _golden,
        "core.dim_date": lambda ctx: relational.dim_date_span(ctx.spark, ctx.source),
        "core.dim_match": lambda ctx: relational.dim_match(ctx.spark, ctx.source),
        "core.dim_fan": _dim_fan,
        "core.fact_tickets": lambda ctx: relational.fact_left_lookup(ctx.spark, ctx.source),
        "core.fact_email": _fact_email,
        "marts.fan_activity": _fan_activity,
        "marts.campaign_engagement": lambda ctx: relational.campaign_engagement(ctx.spark, ctx.source),
        "marts.cluster_sizes": lambda ctx: ctx.table("identity.xref").groupBy("fan_id").count().groupBy(F.col("count").alias("cluster_size")).agg(F.count("*").alias("n_clusters")),
    }


def checks(ctx: Context) -> list[Q.Check]:
    people = ["source_system", "source_record_id"]
    return [
        Q.Check("one_current_version", "error", lambda: Q.duplicates(ctx.table("core.dim_fan").filter("is_current"), "fan_id")),
        Q.Check("fact_email_unique", "error", lambda: Q.duplicates(ctx.table("core.fact_email"), "event_id")),
        Q.Check("staging_ids_unique", "error", lambda: Q.duplicates(ctx.table("staging.ticketing_orders"), "order_id")),
        Q.Check("xref_covers_all", "error", lambda: Q.orphans(ctx.table("staging.identity_records"), ctx.table("identity.xref"), people)),
        Q.Check("xref_targets_exist", "error", lambda: Q.orphans(ctx.table("identity.xref"), ctx.table("identity.golden_fans"), ["fan_id"])),
        Q.Check("ticket_match_known", "warn", lambda: Q.nulls(ctx.table("core.fact_tickets"), "match_key")),
        Q.Check("email_subscriber_known", "warn", lambda: Q.orphans(ctx.table("core.fact_email").filter("subscriber_id is not null"), ctx.table("staging.email_subscribers"), ["subscriber_id"])),
    ]
