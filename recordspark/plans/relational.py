"""Joins, aggregates, windows, set operations and marts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordspark.operators.clusters import last_of
from recordspark.operators.dimensions import number_rows
from recordspark.runtime import Cut, table

_T = table


def crossover_90d(spark: SparkSession, d: str) -> DataFrame:
    """Per month of first order: customers, and those with a line shipped within 90 days; cohorts whose window is not over are left out."""
    orders, lines = _T(spark, d, "orders"), _T(spark, d, "lineitem")
    first = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_at"))
    # one row per customer and day: the exchange serves the greatest day and the match
    ships = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("ck"), "l_shipdate").distinct()
    last = ships.agg(F.max("l_shipdate").alias("last_seen"))
    ninety = F.expr("interval 90 days")
    live = first.crossJoin(F.broadcast(last)).filter(F.col("first_at") + ninety <= F.col("last_seen"))
    met = live.join(ships, (F.col("o_custkey") == F.col("ck")) & (F.col("l_shipdate") >= F.col("first_at")) & (F.col("l_shipdate") < F.col("first_at") + ninety), "left")
    conv = met.groupBy("o_custkey", F.trunc("first_at", "MM").alias("cohort_month")).agg((F.count("ck") > 0).alias("converted"))
    hit = F.sum(F.when(F.col("converted"), 1).otherwise(0))
    return conv.groupBy("cohort_month").agg(F.count("*").alias("n_new"), hit.alias("n_converted"), F.round(100.0 * hit / F.count("*"), 1).cast("double").alias("conversion_pct"))


def person_360(spark: SparkSession, d: str) -> DataFrame:
    """A row per customer with activity rolled up before four left joins, so nothing fans out."""
    orders = _T(spark, d, "orders")
    o = orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spent"), F.max("o_orderdate").alias("last_order"))
    lines = _T(spark, d, "lineitem").join(orders.select("o_orderkey", F.col("o_custkey").alias("l_cust")), F.col("l_orderkey") == F.col("o_orderkey"))
    li = lines.groupBy("l_cust").agg(F.count_distinct("l_orderkey").alias("n_shipped"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("goods"), F.max("l_shipdate").alias("last_ship"))
    kinds = [F.sum(F.when(F.col("event_type") == k, 1).otherwise(0)).alias(f"n_{k}") for k in ("view", "click")]
    e = _T(spark, d, "events").groupBy("user_id").agg(*kinds)
    s = lines.groupBy(F.col("l_cust").alias("s_cust")).agg(F.count_distinct("l_suppkey").alias("n_suppliers"))
    c = _T(spark, d, "customer")
    j = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").join(li, F.col("c_custkey") == F.col("l_cust"), "left").join(e, F.col("c_custkey") == F.col("user_id"), "left").join(s, F.col("c_custkey") == F.col("s_cust"), "left")
    z = lambda k, t: F.coalesce(F.col(k), F.lit(0)).cast(t).alias(k)
    pct = F.when(F.coalesce("n_view", F.lit(0)) > 0, F.round(100.0 * F.col("n_click") / F.col("n_view"), 1)).cast("double").alias("click_pct")
    return j.select("c_custkey", "c_mktsegment", z("n_orders", "bigint"), z("spent", "double"), z("n_shipped", "bigint"), z("goods", "double"), z("n_view", "bigint"), z("n_click", "bigint"), z("n_suppliers", "bigint"), pct, F.greatest("last_order", "last_ship").cast("date").alias("last_activity"))


def revenue_by_part(spark: SparkSession, d: str) -> DataFrame:
    """Every part with its sales, parts without any included."""
    li = _T(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("lines"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("rev"), F.count_distinct("l_orderkey").alias("ords"))
    j = _T(spark, d, "part").join(li, F.col("p_partkey") == F.col("l_partkey"), "left")
    return j.select("p_partkey", F.coalesce("lines", F.lit(0)).alias("n_lines"), F.coalesce("rev", F.lit(0)).cast("double").alias("revenue"), F.coalesce("ords", F.lit(0)).alias("n_orders"))


def campaign_engagement(spark: SparkSession, d: str) -> DataFrame:
    e = last_of(_T(spark, d, "email_events"), ["event_id"], F.col("loaded_at").desc_nulls_first())
    n = {k: F.sum(F.when(F.col("event_type") == k, 1).otherwise(0)) for k in ("send", "open", "click")}
    rate = lambda k: F.round(100.0 * n[k] / F.nullif(n["send"], F.lit(0)), 1).cast("double")
    return e.groupBy("campaign_id").agg(n["send"].alias("sends"), n["open"].alias("opens"), n["click"].alias("clicks"), rate("open").alias("open_rate_pct"), rate("click").alias("click_rate_pct"))


def monthly_activity(spark: SparkSession, d: str) -> DataFrame:
    """Amounts by month and kind out of three sources of different shape."""
    month = lambda c: F.trunc(c, "MM").alias("month")
    a = _T(spark, d, "orders").select(month("o_orderdate"), F.lit("orders").alias("kind"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    b = _T(spark, d, "lineitem").select(month("l_shipdate"), F.when(F.col("l_returnflag") == "R", "returns").otherwise("goods").alias("kind"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    c = _T(spark, d, "ticketing_orders").select(month("purchased_at"), F.lit("tickets").alias("kind"), F.col("total").cast("decimal(18,2)").alias("amount"))
    return a.unionByName(b).unionByName(c).groupBy("month", "kind").agg(F.sum("amount").cast("double").alias("amount"), F.count("*").alias("n"))


def linkage_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row of global aggregates over the crosswalk."""
    x = _T(spark, d, "fan_xref")
    per = x.groupBy("fan_id").agg(F.count("*").alias("n"), F.count_distinct("source_system").alias("s"))
    a = x.agg(F.count("*").alias("source_records"), *[F.count_if(F.col("method") == m).alias(f"{m}_records") for m in ("deterministic", "probabilistic", "singleton")])
    b = per.agg(F.count("*").alias("unified"), F.max("n").alias("largest_cluster"), F.count_if(F.col("s") > 1).alias("multi_source"))
    return a.crossJoin(b).withColumn("records_per_fan", F.round(F.col("source_records") / F.nullif("unified", F.lit(0)), 2))


def cluster_size_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _T(spark, d, "fan_xref").groupBy("fan_id").agg(F.count("*").alias("cluster_size")).groupBy("cluster_size").agg(F.count("*").alias("n_clusters"))


def dim_date_span(spark: SparkSession, d: str) -> DataFrame:
    """A row per day from a week before to a week after all activity."""
    spans = [_T(spark, d, t).agg(F.min(c).cast("date").alias("lo"), F.max(c).cast("date").alias("hi")) for t, c in (("ticketing_orders", "purchased_at"), ("email_events", "occurred_at"), ("fixtures", "kickoff_at"), ("identity_records", "observed_at"))]
    all_spans = spans[0]
    for s in spans[1:]:
        all_spans = all_spans.unionByName(s)
    b = all_spans.agg(F.date_sub(F.min("lo"), 7).alias("lo"), F.date_add(F.max("hi"), 7).alias("hi"))
    days = b.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("day"))
    dow = F.weekday("day") + 1
    return days.select(
        F.date_format("day", "yyyyMMdd").cast("int").alias("date_key"), "day", F.year("day").alias("year"), F.quarter("day").alias("quarter"), F.month("day").alias("month"),
        F.date_format("day", "MMM").alias("month_name"), F.dayofmonth("day").alias("day_of_month"), dow.alias("iso_dow"), (dow >= 6).alias("is_weekend"),
    )


def dim_product_category(spark: SparkSession, d: str) -> DataFrame:
    """Products with a category out of the name and a surrogate in key order, numbered band by band."""
    p = _T(spark, d, "part").groupBy("p_name").agg(F.max("p_retailprice").alias("top_price"), F.min("p_brand").alias("brand"))
    cat = F.when(F.col("p_name").like("%ring%"), "jewellery").when(F.col("p_name").like("%widget%"), "hardware").when(F.col("brand").isin("Brand#1", "Brand#2"), "house").otherwise("other")
    return number_rows(p.select("p_name", "top_price", cat.alias("category")), "p_name", "product_key", Cut(spark, "product"))


def dim_match(spark: SparkSession, d: str) -> DataFrame:
    """The last announcement of each match with a surrogate in match order; fixtures are a fixed, small table."""
    f = last_of(_T(spark, d, "fixtures"), ["match_id"], F.col("loaded_at").desc_nulls_first())
    return f.select(F.row_number().over(Window.orderBy("match_id")).cast("bigint").alias("match_key"), "match_id", F.col("kickoff_at").cast("timestamp_ntz").alias("kickoff_at"), "home_team", "away_team", "competition")


def fact_star_join(spark: SparkSession, d: str) -> DataFrame:
    """Lines with order, customer and part keys: inner joins, with a constant predicate on one side."""
    li, o, c, p = (_T(spark, d, t) for t in ("lineitem", "orders", "customer", "part"))
    j = li.join(o.filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("c_mktsegment", "p_brand").agg(F.count("*").alias("n_lines"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("revenue"))


def fact_left_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Ticket orders with their match's key, null where the match is unknown."""
    o = last_of(_T(spark, d, "ticketing_orders"), ["order_id"], F.col("loaded_at").desc_nulls_first())
    m = dim_match(spark, d).select(F.col("match_id").alias("m_id"), "match_key")
    return o.join(m, F.col("match_id") == F.col("m_id"), "left").select("order_id", "match_id", "match_key", F.date_format("purchased_at", "yyyyMMdd").cast("int").alias("date_key"), "qty")


def composite_key_join(spark: SparkSession, d: str) -> DataFrame:
    """Resolved records by method and system: an equi-join on two columns."""
    j = _T(spark, d, "identity_records").join(_T(spark, d, "fan_xref"), ["source_system", "source_record_id"])
    return j.groupBy("source_system", "method").agg(F.count("*").alias("n"), F.count("score").alias("n_scored"), F.count_distinct("fan_id").alias("n_fans"))


def anti_join_absent(spark: SparkSession, d: str) -> DataFrame:
    return _T(spark, d, "identity_records").join(_T(spark, d, "fan_xref"), ["source_system", "source_record_id"], "left_anti").select("rec_id", "link_state")


def exists_disjunction(spark: SparkSession, d: str) -> DataFrame:
    """References that miss either of two targets: two left joins and a test on both."""
    o = _T(spark, d, "ticketing_orders").select("order_id", "match_id", F.lower("purchaser_email").alias("mail"))
    m = _T(spark, d, "fixtures").select(F.col("match_id").alias("m")).distinct()
    s = _T(spark, d, "email_subscribers").select(F.lower("email").alias("s")).filter("s is not null").distinct()
    j = o.join(m, F.col("match_id") == F.col("m"), "left").join(s, F.col("mail") == F.col("s"), "left").filter("m is null or s is null")
    return j.select("order_id", F.col("m").isNull().alias("no_match"), F.col("s").isNull().alias("no_subscriber")).distinct()


def latest_version_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The last version of each contact out of JSON payloads, by change stamp and then load time."""
    g = lambda k: F.get_json_object("payload", f"$.{k}")
    c = _T(spark, d, "raw_crm_contacts").select(g("Id").alias("id"), g("LastName").alias("last_name"), g("SystemModstamp").alias("stamp"), "loaded_at", "row_id", "payload").filter("try_parse_json(payload) is not null and payload like '{%}' and id like '003%' and stamp like '20%Z'")
    w = Window.partitionBy("id").orderBy(F.col("stamp").desc_nulls_first(), F.col("loaded_at").desc_nulls_first(), F.col("row_id").desc())
    return c.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("id", "stamp", "row_id")


def latest_by_loaded(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("event_id").orderBy(F.col("loaded_at").desc_nulls_first())
    return _T(spark, d, "email_events").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("event_id", "event_type", "loaded_at")


def distinct_on_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last event per user and kind, as one aggregate instead of a sort."""
    return _T(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", "event_type", F.col("m.event_id").alias("event_id"), F.col("m.ts").alias("ts"))


def qualify_latest(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    return _T(spark, d, "orders").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("o_custkey", "o_orderkey", "o_orderdate")


def order_rollup_min(spark: SparkSession, d: str) -> DataFrame:
    """Lines rolled up to orders, each column's least value on its own."""
    return _T(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"), F.min("l_returnflag").alias("least_flag"), F.min("l_partkey").alias("least_part"), F.count("*").alias("n_lines"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))


def update_from_join(spark: SparkSession, d: str) -> DataFrame:
    """Subscribers with the e-mail of their last CRM-like record where one has the same name: an update as a join."""
    s = last_of(_T(spark, d, "email_subscribers"), ["subscriber_id"], F.col("loaded_at").desc_nulls_first()).select("subscriber_id", "email", F.lower("last_name").alias("ln"), "zip")
    r = _T(spark, d, "identity_records").filter("source_system = 'crm' and zip is not null").groupBy(F.lower("last_name").alias("ln"), F.col("zip").alias("rz")).agg(F.max(F.struct("observed_at", "rec_id", "email")).alias("m"))
    j = s.join(r.withColumnRenamed("ln", "rl"), (F.col("ln") == F.col("rl")) & (F.col("zip") == F.col("rz")), "left")
    return j.select("subscriber_id", F.coalesce("m.email", "email").alias("email"), F.col("m").isNotNull().alias("updated"))


def global_sort_topk(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 by three keys (a top-k report)."""
    return _T(spark, d, "orders").orderBy(F.col("o_totalprice").desc(), F.col("o_orderdate").desc(), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice", "o_orderdate")


def nulls_last_topn(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 records with nulls at the end (a top-k report)."""
    return _T(spark, d, "identity_records").orderBy(F.col("zip").asc_nulls_last(), F.col("rec_id")).limit(50).select("rec_id", "zip")


def scalar_subquery_filter(spark: SparkSession, d: str) -> DataFrame:
    """Events of the last seven days seen: a scalar subquery in the filter."""
    return spark.sql(
        "SELECT event_id, event_type FROM {e} WHERE ts >= (SELECT max(ts) - interval 7 days FROM {e}) AND value > (SELECT avg(value) FROM {e})", e=_T(spark, d, "events")
    )


def tag_pivot(spark: SparkSession, d: str) -> DataFrame:
    x = _T(spark, d, "fan_xref")
    return x.groupBy("source_system").pivot("method", ["deterministic", "probabilistic", "singleton"]).agg(F.count("fan_id")).fillna(0)


def metric_unpivot(spark: SparkSession, d: str) -> DataFrame:
    one = linkage_summary(spark, d).select("deterministic_records", "probabilistic_records", "singleton_records")
    return one.unpivot([], ["deterministic_records", "probabilistic_records", "singleton_records"], "metric", "n")


def tag_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Counts of single tags out of a list column."""
    s = _T(spark, d, "fan_snapshots").select(F.explode(F.array_distinct(F.split("sources", ","))).alias("tag"))
    return s.groupBy("tag").agg(F.count("*").alias("n"))


def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Pairs in both, only the first and only the second of two pair sets."""
    p = _T(spark, d, "match_pairs").filter("rec_l <> rec_r")
    key = [F.least("rec_l", "rec_r").alias("a"), F.greatest("rec_l", "rec_r").alias("b")]
    x, y = p.filter("method = 'model'").select(*key).distinct(), p.filter("method = 'email'").select(*key).distinct()
    n = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n")
    return n(x.intersect(y), "both").unionByName(n(x.subtract(y), "first")).unionByName(n(y.subtract(x), "second"))


QUERIES = {
    f.__name__: f
    for f in (
        crossover_90d, person_360, revenue_by_part, campaign_engagement, monthly_activity, linkage_summary, cluster_size_histogram, dim_date_span, dim_product_category, dim_match,
        fact_star_join, fact_left_lookup, composite_key_join, anti_join_absent, exists_disjunction, latest_version_dedupe, latest_by_loaded, distinct_on_latest, qualify_latest,
        order_rollup_min, update_from_join, global_sort_topk, nulls_last_topn, scalar_subquery_filter, tag_pivot, metric_unpivot, tag_histogram, set_algebra,
    )
}

_SUMMARY = """(SELECT count(*) FILTER (WHERE method='deterministic') AS deterministic_records, count(*) FILTER (WHERE method='probabilistic') AS probabilistic_records,
  count(*) FILTER (WHERE method='singleton') AS singleton_records, count(*) AS source_records FROM fan_xref)"""
_MATCHES = "(SELECT * FROM fixtures QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY loaded_at DESC) = 1)"

ORACLES = {
    "crossover_90d": """WITH first AS (SELECT o_custkey, min(o_orderdate) AS first_at FROM orders GROUP BY 1),
 ships AS (SELECT o_custkey AS ck, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 conv AS (SELECT o_custkey, date_trunc('month', first_at)::DATE AS cohort_month, count(ck) > 0 AS converted FROM first LEFT JOIN ships ON ck = o_custkey AND l_shipdate >= first_at AND l_shipdate < first_at + INTERVAL 90 DAY
          WHERE first_at + INTERVAL 90 DAY <= (SELECT max(l_shipdate) FROM ships) GROUP BY 1, 2)
 SELECT cohort_month, count(*) AS n_new, sum(CASE WHEN converted THEN 1 ELSE 0 END)::BIGINT AS n_converted, round(100.0 * sum(CASE WHEN converted THEN 1 ELSE 0 END) / count(*), 1)::DOUBLE AS conversion_pct FROM conv GROUP BY 1""",
    "person_360": """WITH o AS (SELECT o_custkey, count(*) n, sum(o_totalprice::DECIMAL(18,2)) spent, max(o_orderdate) last_order FROM orders GROUP BY 1),
 lines AS (SELECT o_custkey ck, l.* FROM lineitem l JOIN orders ON l_orderkey = o_orderkey),
 li AS (SELECT ck, count(DISTINCT l_orderkey) n, sum(l_extendedprice::DECIMAL(18,2)) goods, max(l_shipdate) last_ship, count(DISTINCT l_suppkey) sup FROM lines GROUP BY 1),
 e AS (SELECT user_id, sum(CASE WHEN event_type='view' THEN 1 ELSE 0 END) v, sum(CASE WHEN event_type='click' THEN 1 ELSE 0 END) c FROM events GROUP BY 1)
 SELECT c_custkey, c_mktsegment, coalesce(o.n,0)::BIGINT AS n_orders, coalesce(spent,0)::DOUBLE AS spent, coalesce(li.n,0)::BIGINT AS n_shipped, coalesce(goods,0)::DOUBLE AS goods, coalesce(v,0)::BIGINT AS n_view, coalesce(c,0)::BIGINT AS n_click,
  coalesce(sup,0)::BIGINT AS n_suppliers, CASE WHEN coalesce(v,0) > 0 THEN round(100.0*c/v,1)::DOUBLE END AS click_pct, greatest(last_order, last_ship)::DATE AS last_activity
 FROM customer LEFT JOIN o ON c_custkey=o.o_custkey LEFT JOIN li ON c_custkey=li.ck LEFT JOIN e ON c_custkey=e.user_id""",
    "revenue_by_part": "SELECT p_partkey, count(l_orderkey) AS n_lines, coalesce(sum(l_extendedprice::DECIMAL(18,2)),0)::DOUBLE AS revenue, count(DISTINCT l_orderkey) AS n_orders FROM part LEFT JOIN lineitem ON p_partkey=l_partkey GROUP BY 1",
    "campaign_engagement": """WITH e AS (SELECT * FROM email_events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY loaded_at DESC) = 1), n AS (SELECT campaign_id, count(*) FILTER (WHERE event_type='send') s, count(*) FILTER (WHERE event_type='open') o, count(*) FILTER (WHERE event_type='click') c FROM e GROUP BY 1)
 SELECT campaign_id, s::BIGINT AS sends, o::BIGINT AS opens, c::BIGINT AS clicks, round(100.0*o/nullif(s,0),1)::DOUBLE AS open_rate_pct, round(100.0*c/nullif(s,0),1)::DOUBLE AS click_rate_pct FROM n""",
    "monthly_activity": """WITH u AS (SELECT date_trunc('month',o_orderdate)::DATE AS month,'orders' AS kind,o_totalprice::DECIMAL(18,2) a FROM orders UNION ALL SELECT date_trunc('month',l_shipdate)::DATE, CASE WHEN l_returnflag='R' THEN 'returns' ELSE 'goods' END, l_extendedprice::DECIMAL(18,2) FROM lineitem
 UNION ALL SELECT date_trunc('month',purchased_at)::DATE,'tickets',total::DECIMAL(18,2) FROM ticketing_orders) SELECT month, kind, sum(a)::DOUBLE AS amount, count(*) AS n FROM u GROUP BY 1,2""",
    "linkage_summary": f"SELECT s.*, unified, largest_cluster, multi_source, round(source_records/nullif(unified,0),2) AS records_per_fan FROM {_SUMMARY} s, (SELECT count(*) AS unified, max(n) AS largest_cluster, count(*) FILTER (WHERE k>1) AS multi_source FROM (SELECT fan_id, count(*) n, count(DISTINCT source_system) k FROM fan_xref GROUP BY 1))",
    "cluster_size_histogram": "SELECT n AS cluster_size, count(*) AS n_clusters FROM (SELECT fan_id, count(*) n FROM fan_xref GROUP BY 1) GROUP BY 1",
    "dim_date_span": """WITH b AS (SELECT least((SELECT min(purchased_at)::DATE FROM ticketing_orders),(SELECT min(occurred_at)::DATE FROM email_events),(SELECT min(kickoff_at)::DATE FROM fixtures),(SELECT min(observed_at)::DATE FROM identity_records))-7 lo,
 greatest((SELECT max(purchased_at)::DATE FROM ticketing_orders),(SELECT max(occurred_at)::DATE FROM email_events),(SELECT max(kickoff_at)::DATE FROM fixtures),(SELECT max(observed_at)::DATE FROM identity_records))+7 hi),
 days AS (SELECT unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY)) t FROM b)
 SELECT strftime(t,'%Y%m%d')::INT AS date_key, t::DATE AS day, year(t)::INT AS year, quarter(t)::INT AS quarter, month(t)::INT AS month, strftime(t,'%b') AS month_name, day(t)::INT AS day_of_month, isodow(t)::INT AS iso_dow, isodow(t)>=6 AS is_weekend FROM days""",
    "dim_product_category": """WITH p AS (SELECT p_name, max(p_retailprice) top_price, min(p_brand) brand FROM part GROUP BY 1) SELECT p_name, top_price, CASE WHEN p_name LIKE '%ring%' THEN 'jewellery' WHEN p_name LIKE '%widget%' THEN 'hardware' WHEN brand IN ('Brand#1','Brand#2') THEN 'house' ELSE 'other' END AS category, row_number() OVER (ORDER BY p_name) AS product_key FROM p""",
    "dim_match": f"SELECT row_number() OVER (ORDER BY match_id) AS match_key, match_id, kickoff_at, home_team, away_team, competition FROM {_MATCHES}",
    "fact_star_join": "SELECT c_mktsegment, p_brand, count(*) AS n_lines, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS revenue FROM lineitem JOIN orders ON l_orderkey=o_orderkey AND o_orderstatus='F' JOIN customer ON o_custkey=c_custkey JOIN part ON l_partkey=p_partkey GROUP BY 1,2",
    "fact_left_lookup": f"""WITH o AS (SELECT * FROM ticketing_orders QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY loaded_at DESC)=1), m AS (SELECT row_number() OVER (ORDER BY match_id) AS match_key, match_id FROM {_MATCHES})
 SELECT order_id, o.match_id, match_key, strftime(purchased_at,'%Y%m%d')::INT AS date_key, qty FROM o LEFT JOIN m ON o.match_id=m.match_id""",
    "composite_key_join": "SELECT source_system, method, count(*) AS n, count(score) AS n_scored, count(DISTINCT fan_id) AS n_fans FROM identity_records JOIN fan_xref USING (source_system, source_record_id) GROUP BY 1,2",
    "anti_join_absent": "SELECT rec_id, link_state FROM identity_records r WHERE NOT EXISTS (SELECT 1 FROM fan_xref x WHERE x.source_system=r.source_system AND x.source_record_id=r.source_record_id)",
    "exists_disjunction": """SELECT DISTINCT order_id, m.match_id IS NULL AS no_match, s.e IS NULL AS no_subscriber FROM ticketing_orders o LEFT JOIN (SELECT DISTINCT match_id FROM fixtures) m ON m.match_id=o.match_id
 LEFT JOIN (SELECT DISTINCT lower(email) e FROM email_subscribers WHERE email IS NOT NULL) s ON s.e=lower(o.purchaser_email) WHERE m.match_id IS NULL OR s.e IS NULL""",
    "latest_version_dedupe": r"""SELECT json_extract_string(payload,'$.Id') AS id, json_extract_string(payload,'$.SystemModstamp') AS stamp, row_id FROM (SELECT * FROM raw_crm_contacts WHERE json_valid(payload) AND NOT regexp_matches(payload, ',\s*[}\]]') AND NOT regexp_matches(payload, ':\s*-?(NaN|Infinity)') AND payload LIKE '{%}')
 WHERE json_extract_string(payload,'$.Id') LIKE '003%' AND json_extract_string(payload,'$.SystemModstamp') LIKE '20%Z' QUALIFY row_number() OVER (PARTITION BY json_extract_string(payload,'$.Id') ORDER BY json_extract_string(payload,'$.SystemModstamp') DESC, loaded_at DESC, row_id DESC) = 1""",
    "latest_by_loaded": "SELECT event_id, event_type, loaded_at FROM email_events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY loaded_at DESC)=1",
    "distinct_on_latest": "SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id, ts FROM events ORDER BY user_id, event_type, ts DESC, event_id DESC",
    "qualify_latest": "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)=1",
    "order_rollup_min": "SELECT l_orderkey, min(l_shipdate) AS first_ship, min(l_returnflag) AS least_flag, min(l_partkey) AS least_part, count(*) AS n_lines, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total FROM lineitem GROUP BY 1",
    "update_from_join": """WITH s AS (SELECT * FROM email_subscribers QUALIFY row_number() OVER (PARTITION BY subscriber_id ORDER BY loaded_at DESC)=1),
 r AS (SELECT lower(last_name) ln, zip, arg_max(coalesce(email, chr(1)), row(observed_at, rec_id)) email FROM identity_records WHERE source_system='crm' AND zip IS NOT NULL GROUP BY 1,2)
 SELECT subscriber_id, coalesce(nullif(r.email, chr(1)), s.email) AS email, r.ln IS NOT NULL AS updated FROM s LEFT JOIN r ON lower(s.last_name)=r.ln AND s.zip=r.zip""",
    "global_sort_topk": "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey LIMIT 20",
    "nulls_last_topn": "SELECT rec_id, zip FROM identity_records ORDER BY zip ASC NULLS LAST, rec_id LIMIT 50",
    "scalar_subquery_filter": "SELECT event_id, event_type FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM events) AND value > (SELECT avg(value) FROM events)",
    "tag_pivot": "SELECT source_system, count(*) FILTER (WHERE method='deterministic') AS deterministic, count(*) FILTER (WHERE method='probabilistic') AS probabilistic, count(*) FILTER (WHERE method='singleton') AS singleton FROM fan_xref GROUP BY 1",
    "metric_unpivot": "SELECT method || '_records' AS metric, count(x.method) AS n FROM (VALUES ('deterministic'),('probabilistic'),('singleton')) v(method) LEFT JOIN fan_xref x USING (method) GROUP BY 1",
    "tag_histogram": "SELECT tag, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(sources, ','))) AS tag FROM fan_snapshots) GROUP BY 1",
    "set_algebra": """WITH p AS (SELECT least(rec_l,rec_r) a, greatest(rec_l,rec_r) b, method FROM match_pairs WHERE rec_l <> rec_r), x AS (SELECT DISTINCT a,b FROM p WHERE method='model'), y AS (SELECT DISTINCT a,b FROM p WHERE method='email')
 SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM x INTERSECT SELECT * FROM y) UNION ALL SELECT 'first', count(*) FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT 'second', count(*) FROM (SELECT * FROM y EXCEPT SELECT * FROM x)""",
}
