"""Scalar functions, JSON extraction, staging parsers and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordspark.functions import text as X
from recordspark.operators.clusters import last_of
from recordspark.operators.delimited import ISO_INSTANT
from recordspark.runtime import blank_to_null, table

_T = table


def json_extract_typed(spark: SparkSession, d: str) -> DataFrame:
    return _T(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.get_json_object("props", "$.absent").alias("absent"))


def json_has_key(spark: SparkSession, d: str) -> DataFrame:
    keys = F.json_object_keys("props")
    return _T(spark, d, "events").groupBy(F.coalesce(F.array_contains(keys, "k"), F.lit(False)).alias("has_k"), F.coalesce(F.array_contains(keys, "z"), F.lit(False)).alias("has_z")).agg(F.count("*").alias("n"))


def drift_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """One postal code out of columns of different sources, blanks as null."""
    o = _T(spark, d, "ticketing_orders").select(F.col("order_id").alias("id"), F.lit(None).cast("string").alias("billing_zip"), F.col("purchaser_zip").alias("billing_postal_code"))
    s = _T(spark, d, "email_subscribers").select(F.col("subscriber_id").alias("id"), F.col("zip").alias("billing_zip"), F.lit(None).cast("string").alias("billing_postal_code"))
    u = o.unionByName(s)
    return u.groupBy("id").agg(F.max(F.left(F.coalesce(F.nullif("billing_zip", F.lit("")), F.nullif("billing_postal_code", F.lit(""))), F.lit(5))).alias("zip5"))


def stg_ticketing_orders(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of each order with parsed names, plain e-mail, ten-digit phone and five-digit zip."""
    o = last_of(_T(spark, d, "ticketing_orders"), ["order_id"], F.col("loaded_at").desc_nulls_first())
    n = F.col("purchaser_name")
    return o.select("order_id", "match_id", "channel", "section", "qty", F.col("total").cast("decimal(10,2)").cast("double").alias("total"), X.parsed_first_name(n).alias("first_name"), X.parsed_last_name(n).alias("last_name"), F.lower(F.trim("purchaser_email")).alias("email"), X.phone10(F.coalesce("purchaser_phone", F.lit(""))).alias("phone"), F.left(F.nullif("purchaser_zip", F.lit("")), F.lit(5)).alias("zip"))


def stg_email_subscribers(spark: SparkSession, d: str) -> DataFrame:
    s = last_of(_T(spark, d, "email_subscribers"), ["subscriber_id"], F.col("loaded_at").desc_nulls_first())
    return s.select("subscriber_id", F.lower(F.trim("email")).alias("email"), X.initcap_alnum(F.trim("first_name")).alias("first_name"), X.initcap_alnum(F.trim("last_name")).alias("last_name"), "signup_date", "status", "birth_year", F.nullif("zip", F.lit("")).alias("zip"))


def phone10_zip5(spark: SparkSession, d: str) -> DataFrame:
    return _T(spark, d, "identity_records").select("rec_id", X.phone10(F.col("phone")).alias("phone10"), X.zip5(F.col("zip")).alias("zip5"))


def fold_names(spark: SparkSession, d: str) -> DataFrame:
    return _T(spark, d, "identity_records").select("rec_id", X.fold(F.col("first_name")).alias("first_f"), X.fold(F.col("last_name")).alias("last_f"))


def nickname_canon(spark: SparkSession, d: str) -> DataFrame:
    return _T(spark, d, "identity_records").groupBy(X.canonical_first_name(X.fold(F.col("first_name"))).alias("first_c")).agg(F.count("*").alias("n"))


def person_ids(spark: SparkSession, d: str) -> DataFrame:
    ref = F.concat_ws(":", "source_system", "source_record_id")
    return _T(spark, d, "identity_records").select("rec_id", ref.alias("ref"), X.person_id(ref).alias("fan_id"), F.sha2(F.coalesce("email", F.lit("")), 256).alias("email_sha"))


def name_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Jaro–Winkler and bounded edit distance of the names of pairs that were scored."""
    p = _T(spark, d, "match_pairs").filter("rec_l is not null and rec_r is not null")
    r = _T(spark, d, "identity_records").select("rec_id", X.fold(F.col("last_name")).alias("n"), F.lower("email").alias("e"))
    j = p.select("pair_id", "rec_l", "rec_r").join(r.toDF("rec_l", "nl", "el"), "rec_l").join(r.toDF("rec_r", "nr", "er"), "rec_r")
    return j.select("pair_id", F.round(X.jaro_winkler(F.col("nl"), F.col("nr")), 6).alias("jw"), F.when(F.col("el").isNotNull() & F.col("er").isNotNull(), F.levenshtein("el", "er", 2) >= 0).alias("near_mail"))


def date_parts(spark: SparkSession, d: str) -> DataFrame:
    o = _T(spark, d, "orders")
    dt = F.col("o_orderdate")
    return o.select("o_orderkey", F.date_format(dt, "yyyyMMdd").cast("int").alias("date_key"), F.date_format(dt, "yyyy-MM").alias("month_key"), (F.weekday(dt) + 1).alias("iso_dow"), (F.weekday(dt) >= 5).alias("is_weekend"), F.date_add(dt.cast("date"), 7).alias("week_later"), F.date_sub(dt.cast("date"), 7).alias("week_before"))


def interval_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Seconds between event and load, and whether the load came within 26 hours."""
    e = _T(spark, d, "email_events").filter("loaded_at is not null and occurred_at is not null")
    a, b = F.col("occurred_at").cast("timestamp"), F.col("loaded_at").cast("timestamp")
    return e.select("event_id", "loaded_at", ((F.unix_micros(b) - F.unix_micros(a)) / 1e6).alias("seconds"), (b <= a + F.expr("interval 26 hours")).alias("prompt"))


def null_safe_diff(spark: SparkSession, d: str) -> DataFrame:
    """Dumps in which a fan's e-mail or zip is distinct from the fan's least one, nulls comparing as values."""
    s = _T(spark, d, "fan_snapshots").filter("fan_id is not null")
    least = s.groupBy(F.col("fan_id").alias("f")).agg(F.min("email").alias("e"), F.min("zip").alias("z"))
    mail, zips = ~F.col("email").eqNullSafe(F.col("e")), ~F.col("zip").eqNullSafe(F.col("z"))
    j = s.join(least, F.col("fan_id") == F.col("f")).filter(mail | zips)
    return j.groupBy("fan_id", mail.alias("mail_differs"), zips.alias("zip_differs")).agg(F.count("*").alias("n"))


def case_label_like_in(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("p_name").like("%ring"), "ring").when(F.col("p_type").isin("ECONOMY", "SMALL"), "plain").otherwise("other")
    return _T(spark, d, "part").groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.max("p_size").alias("top_size"))


def row_compare(spark: SparkSession, d: str) -> DataFrame:
    """Records other than the least one with their e-mail: inequality of row constructors, one row a record."""
    r = _T(spark, d, "identity_records").filter("email is not null and email <> ''").select("source_system", "source_record_id", F.lower("email").alias("email"))
    least = r.groupBy("email").agg(F.min(F.struct("source_system", "source_record_id")).alias("m"))
    j = r.join(least, "email").filter(F.expr("(source_system, source_record_id) <> (m.source_system, m.source_record_id)"))
    return j.groupBy("email").agg(F.count("*").alias("n_other"))


def round_half_away(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("l_extendedprice").cast("decimal(18,2)")
    return _T(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum(x), 1).cast("double").alias("rounded"), F.round(-F.sum(x), 0).cast("double").alias("negative"), F.round(100.0 * F.count_if(F.col("l_quantity") > 25) / F.nullif(F.count("*"), F.lit(0)), 2).cast("double").alias("pct"))


def stamp_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Format tests on text: stamps, days, prefixes, mail shape, decimals."""
    g = lambda k: F.get_json_object("payload", f"$.{k}")
    c = _T(spark, d, "raw_crm_contacts").filter("payload like '{\"%\"}' and try_parse_json(payload) is not null")
    return c.select("row_id", F.coalesce(g("SystemModstamp").rlike(ISO_INSTANT), F.lit(False)).alias("stamp_ok"), F.coalesce(F.startswith(g("Id"), F.lit("003")), F.lit(False)).alias("id_ok"), F.coalesce(g("Email").rlike(r"@[^@]*\.[^@]*$"), F.lit(False)).alias("mail_ok"))


QUERIES = {
    f.__name__: f
    for f in (json_extract_typed, json_has_key, drift_coalesce, stg_ticketing_orders, stg_email_subscribers, phone10_zip5, fold_names, nickname_canon, person_ids, name_similarity, date_parts,
              interval_seconds, null_safe_diff, case_label_like_in, row_compare, round_half_away, stamp_predicates)
}


def _initcap_sql(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '([\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+)'), lambda w: upper(left(w,1)) || lower(substr(w,2))), '')"


def _fold_sql(x: str) -> str:
    return f"nullif(trim(lower(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g'))), '')"


_LAST_SUB = "(SELECT * FROM email_subscribers QUALIFY row_number() OVER (PARTITION BY subscriber_id ORDER BY loaded_at DESC NULLS FIRST)=1)"
_NICK = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.SHORT_FORMS.items())

ORACLES = {
    "json_extract_typed": "SELECT event_id, TRY_CAST(json_extract_string(props,'$.k') AS INT) AS k, json_extract_string(props,'$.absent') AS absent FROM events",
    "json_has_key": "SELECT coalesce(json_exists(props,'$.k'),false) AS has_k, coalesce(json_exists(props,'$.z'),false) AS has_z, count(*) AS n FROM events GROUP BY 1,2",
    "drift_coalesce": "SELECT id, max(left(coalesce(nullif(a,''),nullif(b,'')),5)) AS zip5 FROM (SELECT order_id id, NULL::VARCHAR a, purchaser_zip b FROM ticketing_orders UNION ALL SELECT subscriber_id, zip, NULL FROM email_subscribers) GROUP BY 1",
    "stg_ticketing_orders": f"""SELECT order_id, match_id, channel, section, qty, total::DECIMAL(10,2)::DOUBLE AS total,
  CASE WHEN purchaser_name LIKE '%,%' THEN {_initcap_sql("trim(split_part(purchaser_name,',',2))")} ELSE {_initcap_sql("split_part(trim(purchaser_name),' ',1)")} END AS first_name,
  CASE WHEN purchaser_name LIKE '%,%' THEN {_initcap_sql("trim(split_part(purchaser_name,',',1))")} ELSE {_initcap_sql("regexp_replace(trim(purchaser_name),'(?s)^.*\\s','')")} END AS last_name,
  lower(trim(purchaser_email)) AS email, nullif(right(regexp_replace(coalesce(purchaser_phone,''),'[^0-9]','','g'),10),'') AS phone, left(nullif(purchaser_zip,''),5) AS zip
 FROM ticketing_orders QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY loaded_at DESC NULLS FIRST)=1""",
    "stg_email_subscribers": f"SELECT subscriber_id, lower(trim(email)) AS email, {_initcap_sql('trim(first_name)')} AS first_name, {_initcap_sql('trim(last_name)')} AS last_name, signup_date, status, birth_year, nullif(zip,'') AS zip FROM {_LAST_SUB}",
    "phone10_zip5": "SELECT rec_id, nullif(right(regexp_replace(phone,'[^0-9]','','g'),10),'') AS phone10, nullif(left(zip,5),'') AS zip5 FROM identity_records",
    "fold_names": f"SELECT rec_id, {_fold_sql('first_name')} AS first_f, {_fold_sql('last_name')} AS last_f FROM identity_records",
    "nickname_canon": f"SELECT CASE f {_NICK} ELSE f END AS first_c, count(*) AS n FROM (SELECT {_fold_sql('first_name')} AS f FROM identity_records) GROUP BY 1",
    "person_ids": "SELECT rec_id, source_system||':'||source_record_id AS ref, 'FAN-'||left(sha1(source_system||':'||source_record_id),12) AS fan_id, sha256(coalesce(email,'')) AS email_sha FROM identity_records",
    "name_similarity": f"""SELECT pair_id, round(jaro_winkler_similarity({_fold_sql("a.last_name")}, {_fold_sql("b.last_name")}),6) AS jw, levenshtein(lower(a.email), lower(b.email)) <= 2 AS near_mail
 FROM match_pairs JOIN identity_records a ON a.rec_id=rec_l JOIN identity_records b ON b.rec_id=rec_r""",
    "date_parts": "SELECT o_orderkey, strftime(o_orderdate,'%Y%m%d')::INT AS date_key, strftime(o_orderdate,'%Y-%m') AS month_key, isodow(o_orderdate)::INT AS iso_dow, isodow(o_orderdate)>=6 AS is_weekend, o_orderdate::DATE+7 AS week_later, o_orderdate::DATE-7 AS week_before FROM orders",
    "interval_seconds": "SELECT event_id, loaded_at, epoch(loaded_at - occurred_at)::DOUBLE AS seconds, loaded_at <= occurred_at + INTERVAL 26 HOUR AS prompt FROM email_events WHERE loaded_at IS NOT NULL AND occurred_at IS NOT NULL",
    "null_safe_diff": """WITH l AS (SELECT fan_id AS f, min(email) AS e, min(zip) AS z FROM fan_snapshots WHERE fan_id IS NOT NULL GROUP BY 1)
 SELECT fan_id, email IS DISTINCT FROM e AS mail_differs, zip IS DISTINCT FROM z AS zip_differs, count(*) AS n FROM fan_snapshots JOIN l ON fan_id=f WHERE email IS DISTINCT FROM e OR zip IS DISTINCT FROM z GROUP BY 1,2,3""",
    "case_label_like_in": "SELECT CASE WHEN p_name LIKE '%ring' THEN 'ring' WHEN p_type IN ('ECONOMY','SMALL') THEN 'plain' ELSE 'other' END AS label, count(*) AS n, max(p_size) AS top_size FROM part GROUP BY 1",
    "row_compare": """WITH r AS (SELECT source_system s, source_record_id i, lower(email) email FROM identity_records WHERE email IS NOT NULL AND email<>''), m AS (SELECT email, min(row(s,i)) k FROM r GROUP BY 1)
 SELECT r.email, count(*) AS n_other FROM r JOIN m USING (email) WHERE row(r.s, r.i) <> m.k GROUP BY 1""",
    "round_half_away": "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice::DECIMAL(18,2)),1)::DOUBLE AS rounded, round(-sum(l_extendedprice::DECIMAL(18,2)),0)::DOUBLE AS negative, round(100.0*count(*) FILTER (WHERE l_quantity>25)/nullif(count(*),0),2)::DOUBLE AS pct FROM lineitem GROUP BY 1,2",
    "stamp_predicates": r"""SELECT row_id, coalesce(regexp_full_match(json_extract_string(payload,'$.SystemModstamp'),'[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z'),false) AS stamp_ok, coalesce(starts_with(json_extract_string(payload,'$.Id'),'003'),false) AS id_ok,
 coalesce(regexp_matches(json_extract_string(payload,'$.Email'),'@[^@]*\.[^@]*$'),false) AS mail_ok FROM raw_crm_contacts WHERE payload LIKE '{"%"}' AND json_valid(payload) AND NOT regexp_matches(payload, ':\s*-?(NaN|Infinity)')""",
}
