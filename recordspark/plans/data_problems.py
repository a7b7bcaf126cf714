"""Queries of the data problems whose operators are in the core: drift, history, orphans and parse failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordspark.operators import attribute_history as history
from recordspark.operators import orphans, parse_failures, schema_drift
from recordspark.operators.clusters import last_of
from recordspark.runtime import Cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    cut = Cut(spark, "p1")
    return cut.finish(schema_drift.drift_report(table(spark, d, "raw_merch_order_items"), cut))


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    cut = Cut(spark, "p1")
    return cut.finish(schema_drift.unified_lines(table(spark, d, "raw_merch_order_items"), cut))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    h = history.fan_history(table(spark, d, "fan_snapshots"))
    return h.select("fan_id", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"))


def p5_history(spark: SparkSession, d: str) -> DataFrame:
    return history.fan_history(table(spark, d, "fan_snapshots"))


def p5_change_log(spark: SparkSession, d: str) -> DataFrame:
    log = history.change_log(table(spark, d, "fan_snapshots"), "fan_id", "snapshot_date", "loaded_at", history.fan_attributes(), "is_current")
    return log.filter(F.col("attribute") != history.PRESENT)


def fact_current_version(spark: SparkSession, d: str) -> DataFrame:
    """Ticket orders with the present version of the fan who holds the buyer's address (the least fan_id of several)."""
    cur = history.fan_history(table(spark, d, "fan_snapshots")).filter("is_current").select("fan_id", F.col("valid_from").alias("version_from"), F.col("email").alias("mail"))
    one = cur.filter("mail is not null").groupBy("mail").agg(F.min(F.struct("fan_id", "version_from")).alias("c"))
    o = last_of(table(spark, d, "ticketing_orders"), ["order_id"], F.col("loaded_at").desc_nulls_first()).select("order_id", "qty", history.same_text(F.col("purchaser_email")).alias("buyer"))
    return o.join(one, F.col("buyer") == F.col("mail"), "left").select("order_id", "qty", F.col("c.fan_id").alias("fan_id"), F.col("c.version_from").alias("version_from"))


def fan_activity(spark: SparkSession, d: str) -> DataFrame:
    """Per present fan its orders, seats and e-mail events, followed by every address that any of its versions has had."""
    log = history.change_log(table(spark, d, "fan_snapshots"), "fan_id", "snapshot_date", "loaded_at", history.fan_attributes(), "is_current")
    own = log.filter("attribute = 'email' and value is not null").groupBy(F.col("value").alias("mail")).agg(F.min("fan_id").alias("fan_id"))
    last = lambda t, k: last_of(table(spark, d, t), [k], F.col("loaded_at").desc_nulls_first())
    mail = lambda c: F.lower(F.trim(c)).alias("mail")
    orders = last("ticketing_orders", "order_id").select(mail("purchaser_email"), "qty").groupBy("mail").agg(F.count("*").alias("n"), F.sum("qty").alias("q")).join(own, "mail")
    orders = orders.groupBy("fan_id").agg(F.sum("n").alias("o_n"), F.sum("q").alias("o_q"))
    sent = last("email_events", "event_id").groupBy("subscriber_id").agg(F.count("*").alias("n"))
    events = sent.join(last("email_subscribers", "subscriber_id").select("subscriber_id", mail("email")), "subscriber_id").join(own, "mail").groupBy("fan_id").agg(F.sum("n").alias("e_n"))
    cur = history.fan_history(table(spark, d, "fan_snapshots")).filter("is_current").select("fan_id", F.col("valid_from").alias("version_from"))
    zero = lambda c, k: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(k)
    return cur.join(orders, "fan_id", "left").join(events, "fan_id", "left").select("fan_id", "version_from", zero("o_n", "n_orders"), zero("o_q", "n_seats"), zero("e_n", "n_events"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    mail = orphans.orphan_references(
        table(spark, d, "email_events"), "email_events", "event_id", "subscriber_id", "occurred_at", "loaded_at",
        table(spark, d, "email_subscribers"), "subscriber_id", "loaded_at", "deleted_at",
    )
    seats = orphans.orphan_references(
        table(spark, d, "ticketing_orders"), "ticketing_orders", "order_id", "match_id", "purchased_at", "loaded_at",
        table(spark, d, "fixtures"), "match_id", "loaded_at", "deleted_at",
    )
    return mail.unionByName(seats)


def p6_monthly(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(p6_found(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_reasons(spark, d).select("source_table", "row_id")


def p7_reasons(spark: SparkSession, d: str) -> DataFrame:
    cut = Cut(spark, "p7")
    lines, _, _ = parse_failures.judged_lines(table(spark, d, "raw_merch_order_items"), cut)
    return cut.finish(parse_failures.rejects(lines, parse_failures.judged_contacts(table(spark, d, "raw_crm_contacts"), cut)))


def p7_contacts(spark: SparkSession, d: str) -> DataFrame:
    cut = Cut(spark, "p7")
    return cut.finish(parse_failures.contact_rows(parse_failures.judged_contacts(table(spark, d, "raw_crm_contacts"), cut)))


QUERIES = {f.__name__: f for f in (p1_found, p1_unified, p5_found, p5_history, p5_change_log, fact_current_version, fan_activity, p6_found, p6_monthly, p7_found, p7_reasons, p7_contacts)}

_P5 = r"""
WITH days AS (SELECT snapshot_date AS d, lead(snapshot_date) OVER (ORDER BY snapshot_date) AS nxt, row_number() OVER (ORDER BY snapshot_date) AS k
              FROM (SELECT DISTINCT snapshot_date FROM fan_snapshots WHERE snapshot_date IS NOT NULL)),
latest AS (SELECT * FROM fan_snapshots WHERE fan_id IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY fan_id, snapshot_date ORDER BY loaded_at DESC NULLS LAST) = 1),
norm AS (SELECT fan_id, k, d, nxt,
    nullif(lower(regexp_replace(regexp_replace(first_name,'^\s+|\s+$','','g'),'\s+',' ','g')),'') AS first_name, nullif(lower(regexp_replace(regexp_replace(last_name,'^\s+|\s+$','','g'),'\s+',' ','g')),'') AS last_name,
    nullif(lower(regexp_replace(regexp_replace(email,'^\s+|\s+$','','g'),'\s+',' ','g')),'') AS email, nullif(lower(regexp_replace(regexp_replace(city,'^\s+|\s+$','','g'),'\s+',' ','g')),'') AS city,
    nullif(lower(regexp_replace(regexp_replace(state,'^\s+|\s+$','','g'),'\s+',' ','g')),'') AS state, nullif(right(regexp_replace(phone,'[^0-9]','','g'),10),'') AS phone,
    nullif(left(regexp_replace(zip,'^\s+|\s+$','','g'),5),'') AS zip, dob::VARCHAR AS dob
  FROM latest JOIN days ON snapshot_date = d WHERE is_current),
valued AS (SELECT *, row(first_name, last_name, email, city, state, phone, zip, dob)::VARCHAR AS v FROM norm),
marked AS (SELECT *, CASE WHEN lag(k) OVER w = k - 1 AND lag(v) OVER w = v THEN 0 ELSE 1 END AS starts FROM valued WINDOW w AS (PARTITION BY fan_id ORDER BY k)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY fan_id ORDER BY k) AS run FROM marked)
"""

_P6 = r"""
WITH refs AS (
  SELECT * FROM (SELECT 'email_events' AS child_table, event_id AS child_key, subscriber_id AS ref, occurred_at AS at, loaded_at FROM email_events
                 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY loaded_at) = 1)
  UNION ALL
  SELECT * FROM (SELECT 'ticketing_orders', order_id, match_id, purchased_at, loaded_at FROM ticketing_orders
                 QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY loaded_at) = 1)),
keyed AS (SELECT *, CASE WHEN regexp_full_match(ref, '\s*[A-Za-z]+-[0-9]+\s*') THEN upper(regexp_extract(ref,'([A-Za-z]+)-',1)) || '-' || regexp_extract(ref,'-0*([0-9]+)',1) END AS k
          FROM refs WHERE regexp_replace(ref,'\s+','','g') <> ''),
parents AS (
  SELECT 'email_events' AS child_table, upper(regexp_extract(subscriber_id,'([A-Za-z]+)-',1)) || '-' || regexp_extract(subscriber_id,'-0*([0-9]+)',1) AS k, min(loaded_at) AS first_loaded, min(deleted_at) AS deleted_at FROM email_subscribers GROUP BY 1, 2
  UNION ALL
  SELECT 'ticketing_orders', upper(regexp_extract(match_id,'([A-Za-z]+)-',1)) || '-' || regexp_extract(match_id,'-0*([0-9]+)',1), min(loaded_at), min(deleted_at) FROM fixtures GROUP BY 1, 2),
found AS (
  SELECT c.child_table, c.child_key, strftime(c.at, '%Y-%m') AS ref_month,
         CASE WHEN p.k IS NULL THEN 'missing' WHEN p.deleted_at <= c.at THEN 'deleted' WHEN p.first_loaded > c.loaded_at THEN 'late' END AS orphan_kind
  FROM keyed c LEFT JOIN parents p ON p.child_table = c.child_table AND p.k = c.k)
"""

ORACLES = {
    "p5_found": _P5 + "SELECT fan_id, min(d)::VARCHAR AS valid_from, arg_max(coalesce(nxt, DATE '9999-12-31'), k)::VARCHAR AS valid_to FROM numbered GROUP BY fan_id, run",
    "p5_history": _P5 + """SELECT ('0x' || left(sha1(fan_id || '|' || min(d)::VARCHAR), 15))::BIGINT AS fan_key, fan_id, min(d) AS valid_from, arg_max(coalesce(nxt, DATE '9999-12-31'), k) AS valid_to, max(k) = (SELECT max(k) FROM days) AS is_current,
 any_value(first_name) AS first_name, any_value(last_name) AS last_name, any_value(email) AS email, any_value(city) AS city, any_value(state) AS state, any_value(phone) AS phone, any_value(zip) AS zip, any_value(dob) AS dob FROM numbered GROUP BY fan_id, run""",
    "p5_change_log": _P5 + """, long AS (UNPIVOT (SELECT fan_id, k, d, nxt, coalesce(first_name,chr(1)) AS first_name, coalesce(last_name,chr(1)) AS last_name, coalesce(email,chr(1)) AS email, coalesce(city,chr(1)) AS city, coalesce(state,chr(1)) AS state,
   coalesce(phone,chr(1)) AS phone, coalesce(zip,chr(1)) AS zip, coalesce(dob,chr(1)) AS dob FROM norm) ON first_name, last_name, email, city, state, phone, zip, dob INTO NAME attribute VALUE value),
 steps AS (SELECT *, CASE WHEN lag(k) OVER w = k - 1 AND lag(value) OVER w = value THEN 0 ELSE 1 END AS starts FROM long WINDOW w AS (PARTITION BY fan_id, attribute ORDER BY k)),
 runs AS (SELECT *, sum(starts) OVER (PARTITION BY fan_id, attribute ORDER BY k) AS run FROM steps)
 SELECT fan_id, attribute, nullif(any_value(value), chr(1)) AS value, min(d) AS valid_from, nullif(arg_max(coalesce(nxt, DATE '9999-12-31'), k), DATE '9999-12-31') AS valid_to FROM runs GROUP BY fan_id, attribute, run""",
    "fact_current_version": _P5 + """, cur AS (SELECT fan_id, min(d) AS version_from, any_value(email) AS email FROM numbered GROUP BY fan_id, run HAVING max(k) = (SELECT max(k) FROM days)),
 one AS (SELECT email, min(fan_id) AS fan_id FROM cur WHERE email IS NOT NULL GROUP BY 1), o AS (SELECT * FROM ticketing_orders QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY loaded_at DESC) = 1)
 SELECT order_id, qty, c.fan_id, version_from FROM o LEFT JOIN one ON one.email = nullif(lower(regexp_replace(regexp_replace(purchaser_email,'^\\s+|\\s+$','','g'),'\\s+',' ','g')),'') LEFT JOIN cur c ON c.fan_id = one.fan_id""",
    "fan_activity": _P5 + """, mails AS (SELECT DISTINCT email, fan_id FROM norm WHERE email IS NOT NULL), own AS (SELECT email, min(fan_id) AS fan_id FROM mails GROUP BY 1),
 cur AS (SELECT fan_id, min(d) AS version_from FROM numbered GROUP BY fan_id, run HAVING max(k) = (SELECT max(k) FROM days)),
 o AS (SELECT * FROM ticketing_orders QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY loaded_at DESC) = 1), s AS (SELECT * FROM email_subscribers QUALIFY row_number() OVER (PARTITION BY subscriber_id ORDER BY loaded_at DESC) = 1),
 e AS (SELECT * FROM email_events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY loaded_at DESC) = 1),
 a AS (SELECT own.fan_id, count(*) AS n, sum(qty) AS q FROM o JOIN own ON own.email = lower(trim(purchaser_email)) GROUP BY 1), b AS (SELECT own.fan_id, count(*) AS n FROM e JOIN s USING (subscriber_id) JOIN own ON own.email = lower(trim(s.email)) GROUP BY 1)
 SELECT cur.fan_id, version_from, coalesce(a.n,0) AS n_orders, coalesce(a.q,0)::BIGINT AS n_seats, coalesce(b.n,0) AS n_events FROM cur LEFT JOIN a USING (fan_id) LEFT JOIN b USING (fan_id)""",
    "p6_found": _P6 + "SELECT * FROM found WHERE orphan_kind IS NOT NULL",
    "p6_monthly": _P6 + "SELECT child_table, ref_month, orphan_kind, count(*) AS n_orphans FROM found WHERE orphan_kind IS NOT NULL GROUP BY ALL",
}
