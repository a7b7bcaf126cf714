"""Dimensions, incremental loads, contracts, quality checks, serving views and sources as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordspark.operators import contracts as K
from recordspark.operators import dimensions as D
from recordspark.operators import quality as Q
from recordspark.operators.clusters import last_of
from recordspark.runtime import Cut, table
from recordspark.sources import files as S
from recordspark.sources import objects as O

_T = table
TRACKED = ["first_name", "last_name", "email", "phone", "city", "state", "zip", "dob"]
REFRESHED = ["sources", "record_count"]


def _batch(spark: SparkSession, d: str, day: str) -> DataFrame:
    """The golden fans of one dump, each once: the row loaded last."""
    rows = _T(spark, d, "fan_snapshots").filter(F.col("snapshot_date") == F.lit(day).cast("date")).filter("is_current and fan_id is not null")
    return last_of(rows, ["fan_id"], F.col("loaded_at").desc_nulls_last()).select("fan_id", *TRACKED, *REFRESHED)


def _empty_dim(batch: DataFrame) -> DataFrame:
    return batch.limit(0).select(F.lit(0).cast("long").alias("dim_key"), *batch.columns, F.lit(None).cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit(True).alias("is_current"))


def scd2_two_batches(spark: SparkSession, d: str) -> DataFrame:
    """The dimension after two dumps: closed, kept and opened versions with surrogates in key order."""
    cut = Cut(spark, "scd")
    a, b = _batch(spark, d, "2024-09-01"), _batch(spark, d, "2024-11-01")
    dim = _empty_dim(a)
    for batch, at in ((a, "2024-09-01"), (b, "2024-11-01")):
        dim = cut.table(D.scd2_next(dim, batch, "fan_id", TRACKED, REFRESHED, F.lit(at).cast("timestamp"), cut))
    return dim.select("dim_key", "fan_id", "email", "record_count", F.col("valid_from").cast("date").alias("valid_from"), F.col("valid_to").cast("date").alias("valid_to"), "is_current")


def scd2_rerun_changes(spark: SparkSession, d: str) -> DataFrame:
    """Versions after loading the same dump twice, by state: as many as after loading it once."""
    cut = Cut(spark, "scd")
    a = _batch(spark, d, "2024-09-01")
    dim = _empty_dim(a)
    for _ in range(2):
        dim = cut.table(D.scd2_next(dim, a, "fan_id", TRACKED, REFRESHED, F.lit("2024-09-01").cast("timestamp"), cut))
    return dim.groupBy("is_current").agg(F.count("*").alias("n"))


def append_only_fact(spark: SparkSession, d: str) -> DataFrame:
    """Events of two overlapping loads: each once, as first loaded."""
    e = _T(spark, d, "email_events").filter("event_id is not null")
    first = last_of(e.filter("occurred_at < timestamp '2025-06-01'"), ["event_id"], F.col("loaded_at").asc_nulls_last())
    later = last_of(e.filter("occurred_at >= timestamp '2025-05-01'"), ["event_id"], F.col("loaded_at").asc_nulls_last())
    fact = first.unionByName(D.append_absent(first, later, "event_id"))
    return fact.groupBy(F.date_format("occurred_at", "yyyy-MM").alias("month"), "event_type").agg(F.count("*").alias("n"))


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """A registry of files with the last load of each, brought up to date by a second table."""
    o = _T(spark, d, "ticketing_orders").groupBy("source_file").agg(F.max("loaded_at").alias("seen_at"), F.count("*").alias("n"))
    old, new = o.withColumn("seen_at", F.col("seen_at") - F.expr("interval 1 day")), o.filter("n > 50")
    return D.upsert_latest(old, new, ["source_file"], "seen_at")


def watermark_advance(spark: SparkSession, d: str) -> DataFrame:
    """Per file the change stamp up to which its contacts are done: before the earliest rejected one; none where a rejected row has no stamp."""
    g = lambda k: F.get_json_object("payload", f"$.{k}")
    whole = F.expr("try_parse_json(payload) is not null and payload like '{\"%\"}'")
    rows = _T(spark, d, "raw_crm_contacts").select("source_file", F.when(whole, g("SystemModstamp")).alias("s"), g("Birthdate").alias("b"), g("Id").alias("id"), g("LastName").alias("n"), g("Email").alias("e"))
    stamp = F.when(F.col("s").rlike(K.ISO_INSTANT), F.col("s"))
    given = lambda c, ok: F.coalesce(ok | (F.col(c) == ""), F.lit(True))
    ok = F.coalesce(F.startswith("id", F.lit("003")), F.lit(False)) & F.coalesce(F.trim("n") != "", F.lit(False)) & given("b", F.col("b").rlike(K.ISO_DAY)) & given("e", F.col("e").rlike(r"@[^@]*\.[^@]*$"))
    return D.next_watermark(rows.select("source_file", stamp.alias("stamp"), (ok & stamp.isNotNull()).alias("ok")), "stamp", F.col("ok"), "2020-01-01T00:00:00Z", "source_file")


def _wire_orders(spark: SparkSession, d: str) -> DataFrame:
    o = _T(spark, d, "ticketing_orders")
    return o.select("order_id", "match_id", F.date_format("purchased_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("purchased_at"), F.col("qty").cast("string").alias("qty"), F.col("total").cast("string").alias("total"), "purchaser_name", "purchaser_email", "source_file")


def contract_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Ticket orders by the reason for which their contract rejects them."""
    judged = K.judge(_wire_orders(spark, d), K.CONTRACTS["ticketing_orders"])
    return judged.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def quarantine_split(spark: SparkSession, d: str) -> DataFrame:
    """Accepted and quarantined rows per file."""
    judged = K.judge(_wire_orders(spark, d), K.CONTRACTS["ticketing_orders"])
    return judged.groupBy("source_file").agg(F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("quarantined"))


def whole_file_reject(spark: SparkSession, d: str) -> DataFrame:
    """Files whose rows all fail because a required column is not in them: every other month comes without totals."""
    o = _wire_orders(spark, d).withColumn("total", F.when(~F.col("source_file").rlike("[02468].jsonl$"), F.col("total")))
    judged = K.judge(o, K.CONTRACTS["ticketing_orders"])
    return judged.groupBy("source_file").agg(F.count("*").alias("n"), F.count_if(F.contains("reason", F.lit("total: column missing"))).alias("missing"))


def replace_by_file(spark: SparkSession, d: str) -> DataFrame:
    """A table after two of its files came again, one of them empty."""
    o = _T(spark, d, "ticketing_orders").select("order_id", "source_file", "qty")
    again = o.filter("source_file = 'orders_2025-01.jsonl'").withColumn("qty", F.col("qty") + 100)
    files = spark.createDataFrame([("orders_2025-01.jsonl",), ("orders_2025-02.jsonl",)], "source_file string")
    return K.replace_by_file(o, again, files).groupBy("source_file").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


def supersede_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Quarantined orders that no later file brought again."""
    o = _wire_orders(spark, d)
    q = K.judge(o, K.CONTRACTS["ticketing_orders"]).filter("reason is not null")
    return K.supersede(q, o.filter("source_file > 'orders_2025-06'"), "order_id").select("order_id", "source_file").distinct()


def dq_unique(spark: SparkSession, d: str) -> DataFrame:
    """Keys met more than once in three staging tables."""
    k = lambda t, c: Q.duplicates(_T(spark, d, t), c).select(F.lit(t).alias("tbl"), F.col(c).alias("key"), "n")
    return k("ticketing_orders", "order_id").unionByName(k("email_subscribers", "subscriber_id")).unionByName(k("email_events", "event_id"))


def dq_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Ticket orders against their last deliveries: one row, since repeats make them differ."""
    o = _T(spark, d, "ticketing_orders")
    money = F.col("total").cast("decimal(18,2)")
    r = Q.reconcile(o, last_of(o, ["order_id"], F.col("loaded_at").desc_nulls_first()), money, money)
    return r.select("rows_a", F.col("sum_a").cast("double").alias("sum_a"), "rows_b", F.col("sum_b").cast("double").alias("sum_b"))


def dq_fk(spark: SparkSession, d: str) -> DataFrame:
    return Q.orphans(_T(spark, d, "ticketing_orders").filter("match_id is not null"), _T(spark, d, "fixtures"), ["match_id"]).select("order_id", "match_id").distinct()


def dq_cover(spark: SparkSession, d: str) -> DataFrame:
    """Records that the crosswalk lacks, by system and state; no resolved one is among them."""
    r = _T(spark, d, "identity_records").select("source_system", "source_record_id", "link_state")
    return Q.orphans(r, _T(spark, d, "fan_xref"), ["source_system", "source_record_id"]).groupBy("source_system", "link_state").agg(F.count("*").alias("n"))


def dq_orphans_with_measures(spark: SparkSession, d: str) -> DataFrame:
    o = Q.orphans(_T(spark, d, "email_events").filter("subscriber_id is not null"), _T(spark, d, "email_subscribers"), ["subscriber_id"])
    return o.groupBy("campaign_id").agg(F.count("*").alias("n_events"), F.count_distinct("subscriber_id").alias("n_subscribers"))


def dq_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Tables whose last load is more than 26 hours before a fixed clock."""
    now = F.lit("2026-08-15 00:00:00").cast("timestamp")
    out = None
    for t in ("ticketing_orders", "email_events", "fixtures"):
        r = Q.stale(_T(spark, d, t), "loaded_at", now, 26).select(F.lit(t).alias("tbl"), F.col("latest").cast("timestamp_ntz").alias("latest"))
        out = r if out is None else out.unionByName(r)
    return out


def dq_quarantine_rate(spark: SparkSession, d: str) -> DataFrame:
    judged = K.judge(_wire_orders(spark, d), K.CONTRACTS["ticketing_orders"])
    n = lambda df: df.agg(F.count("*").alias("n")).select(F.lit("ticketing_orders").alias("source"), "n")
    return Q.quarantine_rate(n(judged.filter("reason is null")), n(judged.filter("reason is not null")), 0.01)


def policy_view(spark: SparkSession, d: str) -> DataFrame:
    """What analysts may read of the fans: no name, address or contact, but state and counts."""
    f = last_of(_T(spark, d, "fan_snapshots").filter("is_current"), ["fan_id"], F.col("snapshot_date").desc_nulls_last(), F.col("loaded_at").desc_nulls_last())
    return f.select("fan_id", "state", "sources", "record_count", "snapshot_date")


def ops_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last load of each batch file with its rows: an audit view."""
    m = _T(spark, d, "raw_merch_order_items")
    return m.groupBy("source_file").agg(F.max("loaded_at").alias("loaded_at"), F.count("*").alias("n_rows"), F.count_distinct("batch_id").alias("n_batches"))


def warehouse_trace(spark: SparkSession, d: str) -> DataFrame:
    """All versions of the fans with the most records, beside their present row."""
    s = _T(spark, d, "fan_snapshots").filter("fan_id is not null")
    top = s.groupBy("fan_id").agg(F.max("record_count").alias("m")).orderBy(F.col("m").desc_nulls_last(), "fan_id").limit(1)
    return s.join(F.broadcast(top), "fan_id").groupBy("fan_id", "snapshot_date").agg(F.count("*").alias("n"), F.max("record_count").alias("record_count"))


def query_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of an object query: filter on the stamp, order, limit, page."""
    text = O.query_text("Order", "1998-01-01", 1000)
    o = _T(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("stamp"))
    return O.run_query(o, text, "stamp", "o_orderkey", 1)


def month_prune(spark: SparkSession, d: str) -> DataFrame:
    """Merch and ticket files of six months; files that name no month stay."""
    f = _T(spark, d, "raw_merch_order_items").select("source_file").unionByName(_T(spark, d, "ticketing_orders").select("source_file")).unionByName(_T(spark, d, "raw_crm_contacts").select("source_file")).distinct()
    return S.prune_months(f, "source_file", "2025-01", "2025-06").groupBy(S.batch_month(F.col("source_file")).alias("month")).agg(F.count("*").alias("n"))


def sha_skip(spark: SparkSession, d: str) -> DataFrame:
    """Content hashes of files that a registry of half of them does not know."""
    m = _T(spark, d, "ticketing_orders").select(F.col("source_file").alias("path"), F.sha2(F.concat_ws("|", "order_id", "loaded_at"), 256).alias("sha256")).distinct()
    known = m.filter(F.col("path") < "orders_2025-06.jsonl")
    return S.unseen(m, known).groupBy("path").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (scd2_two_batches, scd2_rerun_changes, append_only_fact, upsert_latest, watermark_advance, contract_reasons, quarantine_split, whole_file_reject, replace_by_file, supersede_quarantine, dq_unique,
              dq_reconcile, dq_fk, dq_cover, dq_orphans_with_measures, dq_freshness, dq_quarantine_rate, policy_view, ops_latest, warehouse_trace, query_page, month_prune, sha_skip)
}

_BATCH = "(SELECT * FROM fan_snapshots WHERE snapshot_date = DATE '{}' AND is_current AND fan_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fan_id ORDER BY loaded_at DESC NULLS LAST) = 1)"
_DIFF = " OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in TRACKED)
_WIRE = r"""w AS (SELECT source_file, order_id, list_sort(list_distinct(list_filter([
   CASE WHEN order_id IS NULL OR trim(order_id)='' THEN 'order_id: empty' WHEN NOT starts_with(trim(order_id),'T-') THEN 'order_id: must start with T-' END,
   CASE WHEN match_id IS NULL OR trim(match_id)='' THEN 'match_id: empty' WHEN NOT starts_with(trim(match_id),'MTCH-') THEN 'match_id: must start with MTCH-' END,
   CASE WHEN purchased_at IS NULL THEN 'purchased_at: empty' END,
   CASE WHEN qty IS NULL THEN 'qty: empty' WHEN qty NOT BETWEEN 1 AND 10 THEN 'qty: must be a whole number from 1 to 10' END,
   CASE WHEN total IS NULL THEN 'total: empty' WHEN total <= 0 THEN 'total: must be positive' END,
   CASE WHEN purchaser_name IS NULL OR trim(purchaser_name)='' THEN 'purchaser_name: empty' END,
   CASE WHEN purchaser_email IS NULL OR trim(purchaser_email)='' THEN 'purchaser_email: empty' WHEN NOT regexp_matches(trim(purchaser_email),'@[^@]*\.[^@]*$') THEN 'purchaser_email: must look like an e-mail address' END,
   CASE WHEN order_id IS NOT NULL AND count(*) OVER (PARTITION BY source_file, order_id) > 1 THEN 'order_id: not unique in its file' END], lambda x: x IS NOT NULL))) AS r FROM ticketing_orders)"""

ORACLES = {
    "scd2_two_batches": f"""WITH a0 AS (SELECT *, row_number() OVER (ORDER BY fan_id) AS k FROM {_BATCH.format('2024-09-01')}), b0 AS (SELECT * FROM {_BATCH.format('2024-11-01')}),
 j AS (SELECT a.fan_id AS af, b.fan_id AS bf, k, a.email AS ae, a.record_count AS ac, b.email AS be, b.record_count AS bc, CASE WHEN a.fan_id IS NULL THEN 'new' WHEN b.fan_id IS NULL THEN 'gone' WHEN {_DIFF} THEN 'changed' ELSE 'same' END AS s FROM a0 a FULL JOIN b0 b ON a.fan_id = b.fan_id)
 SELECT k AS dim_key, af AS fan_id, ae AS email, CASE WHEN s='same' THEN coalesce(bc, ac) ELSE ac END AS record_count, DATE '2024-09-01' AS valid_from, CASE WHEN s<>'same' THEN DATE '2024-11-01' END AS valid_to, s='same' AS is_current FROM j WHERE s<>'new'
 UNION ALL SELECT (SELECT max(k) FROM a0) + row_number() OVER (ORDER BY bf), bf, be, bc, DATE '2024-11-01', NULL, true FROM j WHERE s IN ('new','changed')""",
    "scd2_rerun_changes": f"SELECT true AS is_current, count(*) AS n FROM {_BATCH.format('2024-09-01')}",
    "append_only_fact": """WITH f AS (SELECT * FROM email_events WHERE occurred_at < TIMESTAMP '2025-06-01' QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY loaded_at)=1), l AS (SELECT * FROM email_events WHERE occurred_at >= TIMESTAMP '2025-05-01' QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY loaded_at)=1)
 SELECT strftime(occurred_at,'%Y-%m') AS month, event_type, count(*) AS n FROM (SELECT * FROM f UNION ALL SELECT * FROM l WHERE event_id NOT IN (SELECT event_id FROM f)) GROUP BY 1,2""",
    "upsert_latest": "SELECT source_file, CASE WHEN count(*) > 50 THEN max(loaded_at) ELSE max(loaded_at) - INTERVAL 1 DAY END AS seen_at, count(*) AS n FROM ticketing_orders GROUP BY 1",
    "watermark_advance": r"""WITH r AS (SELECT source_file, json_valid(payload) AND payload LIKE '{"%"}' AND NOT regexp_matches(payload, ':\s*-?(NaN|Infinity)') AS whole, payload FROM raw_crm_contacts),
 f AS (SELECT source_file, CASE WHEN whole THEN json_extract_string(payload,'$.SystemModstamp') END AS s, CASE WHEN whole THEN json_extract_string(payload,'$.Birthdate') END AS b, CASE WHEN whole THEN json_extract_string(payload,'$.Id') END AS i, CASE WHEN whole THEN json_extract_string(payload,'$.LastName') END AS n, CASE WHEN whole THEN json_extract_string(payload,'$.Email') END AS e FROM r),
 o AS (SELECT source_file, CASE WHEN regexp_full_match(s,'[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z') THEN s END AS stamp, coalesce(starts_with(i,'003'),false) AND coalesce(trim(n)<>'',false) AND coalesce(regexp_full_match(b,'[0-9]{4}-[0-9]{2}-[0-9]{2}') OR b='',true) AND coalesce(regexp_matches(e,'@[^@]*\.[^@]*$') OR e='',true) AS good FROM f),
 v AS (SELECT source_file, stamp, good AND stamp IS NOT NULL AS ok FROM o), c AS (SELECT source_file, min(stamp) FILTER (WHERE NOT ok) AS ceiling, count(*) FILTER (WHERE NOT ok AND stamp IS NULL) AS blind FROM v GROUP BY 1),
 t AS (SELECT c.source_file, max(stamp) FILTER (WHERE ok AND blind=0 AND (ceiling IS NULL OR stamp < ceiling)) AS top FROM c JOIN v USING (source_file) GROUP BY 1) SELECT source_file, CASE WHEN top > '2020-01-01T00:00:00Z' THEN top END AS watermark FROM t""",
    "contract_reasons": f"WITH {_WIRE} SELECT CASE WHEN len(r)=0 THEN 'accepted' ELSE array_to_string(r,'; ') END AS reason, count(*) AS n FROM w GROUP BY 1",
    "quarantine_split": f"WITH {_WIRE} SELECT source_file, count(*) FILTER (WHERE len(r)=0) AS accepted, count(*) FILTER (WHERE len(r)>0) AS quarantined FROM w GROUP BY 1",
    "whole_file_reject": "SELECT source_file, count(*) AS n, CASE WHEN regexp_matches(source_file,'[02468].jsonl$') THEN count(*) ELSE 0 END AS missing FROM ticketing_orders GROUP BY 1",
    "replace_by_file": "SELECT source_file, count(*) AS n, sum(CASE WHEN source_file='orders_2025-01.jsonl' THEN qty+100 ELSE qty END)::BIGINT AS qty FROM ticketing_orders WHERE source_file<>'orders_2025-02.jsonl' GROUP BY 1",
    "supersede_quarantine": f"WITH {_WIRE} SELECT DISTINCT order_id, source_file FROM w WHERE len(r)>0 AND order_id NOT IN (SELECT order_id FROM ticketing_orders WHERE source_file > 'orders_2025-06' AND order_id IS NOT NULL)",
    "dq_unique": "SELECT 'ticketing_orders' AS tbl, order_id AS key, count(*) AS n FROM ticketing_orders GROUP BY 2 HAVING count(*)>1 UNION ALL SELECT 'email_subscribers', subscriber_id, count(*) FROM email_subscribers GROUP BY 2 HAVING count(*)>1 UNION ALL SELECT 'email_events', event_id, count(*) FROM email_events GROUP BY 2 HAVING count(*)>1",
    "dq_reconcile": "WITH b AS (SELECT * FROM ticketing_orders QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY loaded_at DESC)=1), x AS (SELECT (SELECT count(*) FROM ticketing_orders) AS rows_a, (SELECT sum(total::DECIMAL(18,2))::DOUBLE FROM ticketing_orders) AS sum_a, (SELECT count(*) FROM b) AS rows_b, (SELECT sum(total::DECIMAL(18,2))::DOUBLE FROM b) AS sum_b) SELECT * FROM x WHERE rows_a IS DISTINCT FROM rows_b OR sum_a IS DISTINCT FROM sum_b",
    "dq_fk": "SELECT DISTINCT order_id, match_id FROM ticketing_orders o WHERE match_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fixtures f WHERE f.match_id=o.match_id)",
    "dq_cover": "SELECT source_system, link_state, count(*) AS n FROM identity_records r WHERE NOT EXISTS (SELECT 1 FROM fan_xref x WHERE x.source_system=r.source_system AND x.source_record_id=r.source_record_id) GROUP BY 1, 2",
    "dq_orphans_with_measures": "SELECT campaign_id, count(*) AS n_events, count(DISTINCT subscriber_id) AS n_subscribers FROM email_events e WHERE subscriber_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM email_subscribers s WHERE s.subscriber_id=e.subscriber_id) GROUP BY 1",
    "dq_freshness": "SELECT * FROM (SELECT 'ticketing_orders' AS tbl, max(loaded_at) AS latest FROM ticketing_orders UNION ALL SELECT 'email_events', max(loaded_at) FROM email_events UNION ALL SELECT 'fixtures', max(loaded_at) FROM fixtures) WHERE latest IS NULL OR latest < TIMESTAMP '2026-08-15' - INTERVAL 26 HOUR",
    "dq_quarantine_rate": f"WITH {_WIRE}, c AS (SELECT 'ticketing_orders' AS source, count(*) FILTER (WHERE len(r)=0) AS landed, count(*) FILTER (WHERE len(r)>0) AS quarantined FROM w) SELECT * FROM c WHERE quarantined > 0.01*(landed+quarantined)",
    "policy_view": "SELECT fan_id, state, sources, record_count, snapshot_date FROM fan_snapshots WHERE is_current QUALIFY row_number() OVER (PARTITION BY fan_id ORDER BY snapshot_date DESC NULLS LAST, loaded_at DESC NULLS LAST)=1",
    "ops_latest": "SELECT source_file, max(loaded_at) AS loaded_at, count(*) AS n_rows, count(DISTINCT batch_id) AS n_batches FROM raw_merch_order_items GROUP BY 1",
    "warehouse_trace": "WITH t AS (SELECT fan_id FROM fan_snapshots WHERE fan_id IS NOT NULL GROUP BY 1 ORDER BY max(record_count) DESC NULLS LAST, fan_id LIMIT 1) SELECT fan_id, snapshot_date, count(*) AS n, max(record_count) AS record_count FROM fan_snapshots JOIN t USING (fan_id) GROUP BY 1,2",
    "query_page": "SELECT o_orderkey, strftime(o_orderdate,'%Y-%m-%d') AS stamp FROM orders WHERE strftime(o_orderdate,'%Y-%m-%d') > '1998-01-01' ORDER BY 2, 1 LIMIT 200 OFFSET 200",
    "month_prune": r"""WITH f AS (SELECT DISTINCT source_file FROM (SELECT source_file FROM raw_merch_order_items UNION ALL SELECT source_file FROM ticketing_orders UNION ALL SELECT source_file FROM raw_crm_contacts)), m AS (SELECT nullif(regexp_extract(source_file,'_([0-9]{4}-[0-9]{2})\.(csv|jsonl)$',1),'') AS month FROM f)
 SELECT month, count(*) AS n FROM m WHERE month IS NULL OR month BETWEEN '2025-01' AND '2025-06' GROUP BY 1""",
    "sha_skip": "SELECT source_file AS path, count(DISTINCT (order_id, loaded_at)) AS n FROM ticketing_orders WHERE source_file >= 'orders_2025-06.jsonl' GROUP BY 1",
}
