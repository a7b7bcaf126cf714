"""Record linkage, golden records and their evaluation over the identity records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordspark.functions.text import SHORT_FORMS
from recordspark.operators import clusters as C
from recordspark.operators import evaluation as E
from recordspark.operators import scored_linkage as S
from recordspark.runtime import Cut, table

_T = table


def _people(spark: SparkSession, d: str) -> DataFrame:
    return C.identity_input(_T(spark, d, "identity_records"))


def exact_edges(spark: SparkSession, d: str) -> DataFrame:
    return C.exact_edges(_people(spark, d))


def exact_clusters(spark: SparkSession, d: str) -> DataFrame:
    return C.exact_clusters(_people(spark, d), Cut(spark, "exact"))


def xref(spark: SparkSession, d: str) -> DataFrame:
    people = _people(spark, d)
    return C.crosswalk(people, C.exact_clusters(people, Cut(spark, "xref")))


def _truth(spark: SparkSession, d: str) -> DataFrame:
    """ref and root of the given crosswalk: each fan's least reference."""
    x = _T(spark, d, "fan_xref").select(F.concat_ws(":", "source_system", "source_record_id").alias("ref"), "fan_id")
    return x.join(x.groupBy("fan_id").agg(F.min("ref").alias("root")), "fan_id").select("ref", "root")


def golden_records(spark: SparkSession, d: str) -> DataFrame:
    """Survivorship over the given crosswalk."""
    return C.golden_records(_people(spark, d), _truth(spark, d)).withColumn("dob", F.col("dob").cast("date"))


def blocked_pairs(spark: SparkSession, d: str) -> DataFrame:
    prof = S.profiles(S.match_ready(_people(spark, d)))
    return S.blocked_pairs(prof).select(F.col("l.ref").alias("ref_l"), F.col("r.ref").alias("ref_r"))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    cut = Cut(spark, "levels")
    return S.agreement(S.blocked_pairs(cut.table(S.profiles(S.match_ready(_people(spark, d))))))


def gamma_patterns(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).groupBy(*S.LEVELS).agg(F.count("*").alias("n"))


def scored_pairs_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs with weights from fixed parameters."""
    s = S.score(_levels(spark, d), S.FIXED_M, S.FIXED_U, S.FIXED_PRIOR)
    return s.select("ref_l", "ref_r", F.round("weight", 6).alias("weight"))


def band_split(spark: SparkSession, d: str) -> DataFrame:
    s = S.score(_levels(spark, d), S.FIXED_M, S.FIXED_U, S.FIXED_PRIOR)
    return s.groupBy("band").agg(F.count("*").alias("n"))


def em_parameters(spark: SparkSession, d: str) -> DataFrame:
    """m and u by comparison and level, and the prior, as trained."""
    cut = Cut(spark, "em")
    ready = cut.table(S.match_ready(_people(spark, d)))
    m, u, prior = S.train(ready, S.pair_levels(ready, cut)[1])
    rows = [(g, i + 1, float(m[g][i]), float(u[g][i]), prior) for g in S.LEVELS for i in range(S.LEVELS[g])]
    return spark.createDataFrame(rows, "comparison string, level int, m double, u double, prior double")


def unify_full(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of all records from exact rules and trained scores, with method and score."""
    cut = Cut(spark, "full")
    return cut.finish(S.linkage(_people(spark, d), cut))


def unify_fixed(spark: SparkSession, d: str) -> DataFrame:
    """The same with fixed parameters."""
    cut = Cut(spark, "fixed")
    return cut.finish(S.linkage(_people(spark, d), cut, fixed=True).withColumn("score", F.round("score", 6)))


def _known(spark: SparkSession, d: str) -> DataFrame:
    """Resolved records alone under the exact rules (as the SQL has it; see `_known_of_all`) beside the entities of the given crosswalk, with tags of what is odd about them."""
    people = _people(spark, d)
    truth = _truth(spark, d).withColumnRenamed("root", "entity")
    found = C.exact_clusters(people.join(truth.select("ref"), "ref"), Cut(spark, "known")).withColumnRenamed("root", "cluster")
    tags = F.array_compact(F.array(F.when(F.col("first_name") == F.upper("first_name"), "upper"), F.when(F.col("email").isNull(), "no_mail"), F.when(F.length("first_name") <= 2, "initial")))
    return found.join(truth, "ref").join(people.select("ref", tags.alias("tags")), "ref")


def _known_of_all(spark: SparkSession, d: str, mode: str, cut: Cut) -> DataFrame:
    """Like `_known`, but all records are clustered and only then restricted to the known ones; with the method of the clusters."""
    people = _people(spark, d)
    tags = F.array_compact(F.array(F.when(F.col("first_name") == F.upper("first_name"), "upper"), F.when(F.col("email").isNull(), "no_mail"), F.when(F.length("first_name") <= 2, "initial")))
    truth = _truth(spark, d).withColumnRenamed("root", "entity")
    return S.linkage(people, cut, mode).withColumnRenamed("root", "cluster").join(truth, "ref").join(people.select("ref", "email", tags.alias("tags")), "ref")


def pair_metrics_all(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of the exact rules over all records, on the known ones."""
    return E.pair_metrics(_known_of_all(spark, d, "deterministic", Cut(spark, "known_all")))


def tag_breakdown_all(spark: SparkSession, d: str) -> DataFrame:
    return E.tag_breakdown(_known_of_all(spark, d, "deterministic", Cut(spark, "known_all")))


def cluster_truth_all(spark: SparkSession, d: str) -> DataFrame:
    """Known members of the clusters of exact rules and trained scores over all records."""
    return E.cluster_truth(_known_of_all(spark, d, "full", Cut(spark, "known_all")))


def threshold_sweep_all(spark: SparkSession, d: str) -> DataFrame:
    """One scoring pass over all records; at each threshold the records are clustered again and measured on the known ones."""
    return _sweep(spark, d, S.scored_pairs)


def threshold_sweep_fixed(spark: SparkSession, d: str) -> DataFrame:
    """The same with fixed parameters."""
    return _sweep(spark, d, lambda ready, cut: S.scored_pairs(ready, cut, fixed=True))


def _sweep(spark: SparkSession, d: str, scored: Callable[[DataFrame, Cut], DataFrame]) -> DataFrame:
    cut, people, truth = Cut(spark, "sweep_all"), _people(spark, d), _truth(spark, d).withColumnRenamed("root", "entity")
    exact = cut.table(C.exact_clusters(people, cut))
    edges = cut.table(scored(cut.table(S.match_ready(people)), cut).filter("probability >= 0.5").select("ref_l", "ref_r", "probability"))

    def measure(e: DataFrame) -> DataFrame:
        star = exact.filter("ref <> root").select(F.col("root").alias("anchor"), "ref")
        found = C.components(people, star.unionByName(e.select(F.col("ref_l").alias("anchor"), F.col("ref_r").alias("ref"))), cut).withColumnRenamed("root", "cluster")
        return E.pair_metrics(found.join(truth, "ref")).crossJoin(e.agg(F.count("*").alias("merged_edges")))  # single rows

    return E.threshold_sweep(edges, [0.9, 0.95, 0.99, 0.999, 0.9999], measure)


def pair_metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.pair_metrics(_known(spark, d))


def tag_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return E.tag_breakdown(_known(spark, d))


def cluster_truth(spark: SparkSession, d: str) -> DataFrame:
    return E.cluster_truth(_known(spark, d).withColumn("method", F.lit("deterministic")))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Given match pairs at five thresholds: edges, distinct left ends and least score; `threshold_sweep_all` clusters and measures."""
    cut = Cut(spark, "sweep")
    p = _T(spark, d, "match_pairs").filter("rec_l is not null and rec_r is not null and score is not null")
    edges = cut.table(p.groupBy(F.least("rec_l", "rec_r").alias("a"), F.greatest("rec_l", "rec_r").alias("b")).agg(F.max("score").alias("probability")))
    return E.threshold_sweep(edges, [0.5, 0.8, 0.9, 0.93, 0.95], lambda e: e.agg(F.count("*").alias("n_edges"), F.count_distinct("a").alias("n_left"), F.round(F.min("probability"), 4).alias("least")))


def review_export(spark: SparkSession, d: str) -> DataFrame:
    """Pairs under review beside both records, as a clerk would see them."""
    p = C.last_of(_T(spark, d, "match_pairs").filter("rec_l is not null and rec_r is not null"), ["rec_l", "rec_r"], F.col("scored_at").desc_nulls_last(), F.col("pair_id").desc())
    r = _T(spark, d, "identity_records").select("rec_id", "source_system", "first_name", "last_name", "email", "phone")
    side = lambda s: r.select(*[F.col(c).alias(f"{c}_{s}") for c in r.columns])
    j = p.filter("lower(trim(verdict)) = 'review'").join(side("l"), F.col("rec_l") == F.col("rec_id_l"), "left").join(side("r"), F.col("rec_r") == F.col("rec_id_r"), "left")
    cols = [f"{c}_{s}" for s in "lr" for c in ("source_system", "first_name", "last_name", "email", "phone")]
    return j.select("rec_l", "rec_r", F.round("score", 4).alias("probability"), *cols)


def record_trace(spark: SparkSession, d: str) -> DataFrame:
    """Members of the largest fans with the evidence that ties them: equal e-mail, equal phone and surname, or another link.

    Evidence comes from counts per fan and value instead of correlated subqueries.
    """
    x = _T(spark, d, "fan_xref")
    chosen = x.groupBy("fan_id").agg(F.count("*").alias("member_count"), F.bool_or(F.col("method") == "probabilistic").alias("p")).orderBy(F.col("p").desc(), F.col("member_count").desc(), "fan_id").limit(1)
    r = _T(spark, d, "identity_records").join(x, ["source_system", "source_record_id"]).join(F.broadcast(chosen), "fan_id")
    m, f, n = F.lower(F.trim("email")), F.col("phone"), F.lower(F.trim("last_name"))
    by_mail = r.filter("email is not null").groupBy(m.alias("mail")).agg(F.count("*").alias("n_mail"))
    by_phone = r.filter("phone is not null").groupBy(f.alias("tel"), n.alias("surname")).agg(F.count("*").alias("n_phone"))
    j = r.join(by_mail, m == F.col("mail"), "left").join(by_phone, (f == F.col("tel")) & (n == F.col("surname")), "left")
    label = F.when(F.col("method") == "probabilistic", "score").when((F.col("method") == "deterministic") & (F.coalesce("n_mail", F.lit(0)) > 1), "same e-mail").when((F.col("method") == "deterministic") & (F.coalesce("n_phone", F.lit(0)) > 1), "same phone and surname").when(F.col("method") == "deterministic", "another link").otherwise("single")
    return j.select("fan_id", "source_system", "source_record_id", F.concat_ws(" ", "first_name", "last_name").alias("observed_name"), "email", "method", label.alias("evidence"), "member_count")


def false_merge_trace(spark: SparkSession, d: str) -> DataFrame:
    """Members of the cluster under the exact rules that mixes the most fans."""
    return _worst_cluster(spark, d, Cut(spark, "false").table(_known(spark, d).select("ref", "cluster", "entity")))


def false_merge_trace_all(spark: SparkSession, d: str) -> DataFrame:
    """The same where all records are clustered."""
    cut = Cut(spark, "false_all")
    return _worst_cluster(spark, d, cut.table(_known_of_all(spark, d, "deterministic", cut).select("ref", "cluster", "entity")))


def _worst_cluster(spark: SparkSession, d: str, k: DataFrame) -> DataFrame:
    worst = k.groupBy("cluster").agg(F.count("*").alias("member_count"), F.count_distinct("entity").alias("true_entity_count")).filter("true_entity_count > 1").orderBy(F.col("true_entity_count").desc(), F.col("member_count").desc(), "cluster").limit(1)
    people = _people(spark, d).select("ref", "email")
    return k.join(F.broadcast(worst), "cluster").join(people, "ref").select("ref", "email", "member_count", "true_entity_count").orderBy(F.col("email").asc_nulls_last(), "ref")


QUERIES = {
    f.__name__: f
    for f in (exact_edges, exact_clusters, xref, golden_records, blocked_pairs, gamma_patterns, scored_pairs_fixed, band_split, em_parameters, unify_full, pair_metrics, tag_breakdown,
              cluster_truth, threshold_sweep, review_export, record_trace, false_merge_trace, pair_metrics_all, tag_breakdown_all, cluster_truth_all, false_merge_trace_all, threshold_sweep_all, unify_fixed, threshold_sweep_fixed)
}


def _fold_sql(x: str) -> str:
    return f"nullif(trim(lower(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g'))), '')"


def _blank_sql(x: str) -> str:
    return rf"nullif(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '')"


_NICK = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SHORT_FORMS.items())
_PEOPLE = f"""people AS (SELECT source_system || ':' || source_record_id AS ref, source_system, source_record_id, first_name, last_name, lower({_blank_sql('email')}) AS email,
  nullif(right(regexp_replace(phone,'[^0-9]','','g'),10),'') AS phone, {_blank_sql('city')} AS city, {_blank_sql('state')} AS state, {_blank_sql('zip')} AS zip, dob, birth_year, observed_at, {_fold_sql('last_name')} AS surname FROM identity_records)"""


def _edges_sql(people: str) -> str:
    return f"""edges AS (SELECT anchor, ref FROM (SELECT ref, min(ref) OVER (PARTITION BY email) AS anchor FROM {people} WHERE email IS NOT NULL) WHERE ref <> anchor
 UNION SELECT anchor, ref FROM (SELECT ref, min(ref) OVER (PARTITION BY phone, surname) AS anchor FROM {people} WHERE phone IS NOT NULL AND surname IS NOT NULL) WHERE ref <> anchor)"""


# Everything that a vertex reaches, by recursion over distinct rows; fit for the small tables of the comparison.
_REACH = """sym AS (SELECT anchor AS v, ref AS u FROM edges UNION SELECT ref, anchor FROM edges),
walk AS (SELECT v, v AS o FROM sym UNION SELECT w.v, s.u FROM walk w JOIN sym s ON s.v = w.o), roots AS (SELECT v, min(o) AS root FROM walk GROUP BY 1)"""
_CLUSTERS = f"WITH RECURSIVE {_PEOPLE}, {_edges_sql('people')}, {_REACH}, clusters AS (SELECT ref, coalesce(root, ref) AS root FROM people LEFT JOIN roots ON v = ref)"
_KNOWN = f"""WITH RECURSIVE {_PEOPLE}, x AS (SELECT source_system || ':' || source_record_id AS ref, fan_id FROM fan_xref), truth AS (SELECT ref, min(ref) OVER (PARTITION BY fan_id) AS entity FROM x),
 subset AS (SELECT p.* FROM people p JOIN truth USING (ref)), {_edges_sql('subset')}, {_REACH},
 known AS (SELECT s.ref, coalesce(root, s.ref) AS cluster, entity, list_filter([CASE WHEN first_name = upper(first_name) THEN 'upper' END, CASE WHEN email IS NULL THEN 'no_mail' END, CASE WHEN length(first_name) <= 2 THEN 'initial' END], lambda t: t IS NOT NULL) AS tags, email
   FROM subset s JOIN truth USING (ref) LEFT JOIN roots ON v = s.ref)"""
_READY = f"""{_PEOPLE}, ready0 AS (SELECT ref, CASE {_fold_sql('first_name')} {_NICK} ELSE {_fold_sql('first_name')} END AS first_name_c, surname AS last_name_f, email, phone, zip, birth_year::VARCHAR AS birth_year FROM people),
 bad_e AS (SELECT email FROM ready0 WHERE email IS NOT NULL GROUP BY 1 HAVING count(DISTINCT last_name_f) >= 8 AND count(DISTINCT last_name_f) > 0.5*count(*)), bad_p AS (SELECT phone FROM ready0 WHERE phone IS NOT NULL GROUP BY 1 HAVING count(DISTINCT last_name_f) >= 8 AND count(DISTINCT last_name_f) > 0.5*count(*)),
 ready AS (SELECT ref, first_name_c, last_name_f, CASE WHEN email NOT IN (SELECT email FROM bad_e) THEN email END AS email, CASE WHEN phone NOT IN (SELECT phone FROM bad_p) THEN phone END AS phone, zip, birth_year FROM ready0),
 prof AS (SELECT first_name_c, last_name_f, email, phone, zip, birth_year, min(ref) AS ref, count(*) AS n FROM ready GROUP BY ALL)"""
_RULES = ["l.email = r.email", "l.phone = r.phone", "l.last_name_f = r.last_name_f AND l.zip = r.zip", "l.first_name_c = r.first_name_c AND l.last_name_f = r.last_name_f", "l.birth_year = r.birth_year AND l.zip = r.zip"]
_PAIRS = f"WITH {_READY}, pairs AS (" + " UNION ".join(f"SELECT l.ref AS ref_l, r.ref AS ref_r FROM prof l JOIN prof r ON {rule} AND l.ref < r.ref" for rule in _RULES) + ")"
_jw = lambda k: f"CASE WHEN l.{k} IS NULL OR r.{k} IS NULL THEN 0 WHEN l.{k} = r.{k} THEN 4 WHEN jaro_winkler_similarity(l.{k}, r.{k}) >= 0.92 THEN 3 WHEN jaro_winkler_similarity(l.{k}, r.{k}) >= 0.8 THEN 2 ELSE 1 END"
_eq = lambda k: f"CASE WHEN l.{k} IS NULL OR r.{k} IS NULL THEN 0 WHEN l.{k} = r.{k} THEN 2 ELSE 1 END"
_GAMMA = _PAIRS + f""", gamma AS (SELECT ref_l, ref_r, {_jw('first_name_c')} AS g_first, {_jw('last_name_f')} AS g_last, CASE WHEN l.email IS NULL OR r.email IS NULL THEN 0 WHEN l.email = r.email THEN 3 WHEN levenshtein(l.email, r.email) <= 2 THEN 2 ELSE 1 END AS g_email,
 {_eq('phone')} AS g_phone, {_eq('zip')} AS g_zip, {_eq('birth_year')} AS g_birth FROM pairs JOIN prof l ON l.ref = ref_l JOIN prof r ON r.ref = ref_r)"""
_WEIGHT = f"ln({S.FIXED_PRIOR}/(1-{S.FIXED_PRIOR})) + " + " + ".join("CASE " + g + " " + " ".join(f"WHEN {i} THEN ln({a}::DOUBLE/{b}::DOUBLE)" for i, (a, b) in enumerate(zip(S.FIXED_M[g], S.FIXED_U[g]), 1)) + " ELSE 0 END" for g in S.LEVELS)

# All records are clustered, then restricted to the known ones.
_ALL = _KNOWN.replace(f"subset AS (SELECT p.* FROM people p JOIN truth USING (ref)), {_edges_sql('subset')}", _edges_sql("people")).replace("FROM subset s JOIN truth", "FROM people s JOIN truth")
_SELF = f"ln({S.FIXED_PRIOR}/(1-{S.FIXED_PRIOR})) + " + " + ".join(f"CASE WHEN r.{c} IS NULL THEN 0 ELSE ln({S.FIXED_M[g][-1]}::DOUBLE/{S.FIXED_U[g][-1]}::DOUBLE) END" for g, c in zip(S.LEVELS, S.ATTRIBUTES))
_SCORED = _GAMMA.replace("WITH people", "WITH RECURSIVE people", 1) + f""", scored AS (SELECT ref_l, ref_r, {_WEIGHT} AS w FROM gamma
 UNION ALL SELECT p.ref, r.ref, {_SELF} FROM ready r JOIN prof p ON {' AND '.join(f'r.{c} IS NOT DISTINCT FROM p.{c}' for c in S.ATTRIBUTES)} AND r.ref <> p.ref),
 prob AS (SELECT ref_l, ref_r, w, 1/(1+exp(-w)) AS p FROM scored), {_edges_sql('people')}, x AS (SELECT source_system || ':' || source_record_id AS ref, fan_id FROM fan_xref), truth AS (SELECT ref, min(ref) OVER (PARTITION BY fan_id) AS entity FROM x)"""
_UNIFY = _SCORED + """, hit AS (SELECT * FROM prob WHERE w >= ln(0.9999/(1-0.9999))), tie AS (SELECT anchor AS v, ref AS u FROM edges UNION SELECT ref, anchor FROM edges UNION SELECT ref_l, ref_r FROM hit UNION SELECT ref_r, ref_l FROM hit),
 walk AS (SELECT v, v AS o FROM tie UNION SELECT w.v, s.u FROM walk w JOIN tie s ON s.v = w.o), roots AS (SELECT v, min(o) AS root FROM walk GROUP BY 1),
 exact AS (SELECT DISTINCT ref FROM (SELECT ref FROM edges UNION ALL SELECT anchor FROM edges)), best AS (SELECT ref, max(p) AS best FROM (SELECT ref_l AS ref, p FROM hit UNION ALL SELECT ref_r, p FROM hit) GROUP BY 1)
 SELECT ref, coalesce(root, ref) AS root, CASE WHEN e.ref IS NOT NULL THEN 'deterministic' WHEN best IS NOT NULL THEN 'probabilistic' ELSE 'singleton' END AS method, CASE WHEN e.ref IS NULL THEN round(best, 6) END AS score
 FROM people LEFT JOIN roots ON v = people.ref LEFT JOIN exact e USING (ref) LEFT JOIN best USING (ref)"""
_SWEEP = _SCORED + """, t AS (SELECT unnest([0.9,0.95,0.99,0.999,0.9999])::DOUBLE AS threshold), hit AS (SELECT threshold, ref_l, ref_r FROM t JOIN prob ON p >= threshold),
 tie AS (SELECT threshold, anchor AS v, ref AS u FROM edges, t UNION SELECT threshold, ref, anchor FROM edges, t UNION SELECT threshold, ref_l, ref_r FROM hit UNION SELECT threshold, ref_r, ref_l FROM hit),
 walk AS (SELECT threshold, v, v AS o FROM tie UNION SELECT w.threshold, w.v, s.u FROM walk w JOIN tie s ON s.v = w.o AND s.threshold = w.threshold), roots AS (SELECT threshold, v, min(o) AS root FROM walk GROUP BY 1, 2),
 known AS (SELECT t.threshold, ref, entity, coalesce(root, ref) AS cluster FROM truth JOIN people USING (ref) CROSS JOIN t LEFT JOIN roots ON roots.v = ref AND roots.threshold = t.threshold),
 pc AS (SELECT threshold, sum(n*(n-1)/2)::BIGINT AS c, count(*) AS k FROM (SELECT threshold, cluster, count(*) AS n FROM known GROUP BY 1,2) GROUP BY 1), pe AS (SELECT threshold, sum(n*(n-1)/2)::BIGINT AS c, count(*) AS k FROM (SELECT threshold, entity, count(*) AS n FROM known GROUP BY 1,2) GROUP BY 1),
 pb AS (SELECT threshold, sum(n*(n-1)/2)::BIGINT AS tp FROM (SELECT threshold, cluster, entity, count(*) AS n FROM known GROUP BY 1,2,3) GROUP BY 1), nh AS (SELECT threshold, count(*) AS merged_edges FROM hit GROUP BY 1)
 SELECT threshold, tp, pc.c - tp AS fp, pe.c - tp AS fn, round(tp/pc.c,4) AS precision, round(tp/pe.c,4) AS recall, round(2*(tp/pc.c)*(tp/pe.c)/((tp/pc.c)+(tp/pe.c)),4) AS f1, pc.k AS predicted_clusters, pe.k AS true_clusters, merged_edges
 FROM pb JOIN pc USING (threshold) JOIN pe USING (threshold) JOIN nh USING (threshold)"""

_modal = lambda c: f"""m_{c} AS (SELECT fan_id, arg_max(v, row(n, f)) AS {c} FROM (SELECT fan_id, f, count(*) AS n, arg_max(v, row(length(v), v)) AS v FROM (SELECT fan_id, {_fold_sql(c)} AS f, {c} AS v FROM mem) WHERE f IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""
_MODAL = ["first_name", "last_name", "phone", "city", "state", "zip"]

ORACLES = {
    "unify_fixed": _UNIFY,
    "threshold_sweep_fixed": _SWEEP,
    "exact_edges": f"WITH {_PEOPLE}, {_edges_sql('people')} SELECT anchor, ref FROM edges",
    "exact_clusters": _CLUSTERS + " SELECT ref, root FROM clusters",
    "xref": _CLUSTERS + " SELECT source_system, source_record_id, 'FAN-' || left(sha1(root),12) AS fan_id, CASE WHEN count(*) OVER (PARTITION BY root) > 1 THEN 'deterministic' ELSE 'singleton' END AS method FROM clusters JOIN people USING (ref)",
    "golden_records": f"""WITH {_PEOPLE}, x AS (SELECT source_system || ':' || source_record_id AS ref, fan_id AS g FROM fan_xref), k AS (SELECT ref, min(ref) OVER (PARTITION BY g) AS fan_id FROM x), mem AS (SELECT * FROM people JOIN k USING (ref)),
 {', '.join(_modal(c) for c in _MODAL)}, mail AS (SELECT fan_id, email FROM mem WHERE email IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fan_id ORDER BY observed_at DESC NULLS LAST, ref) = 1), born AS (SELECT fan_id, arg_min(dob, ref) AS dob FROM mem WHERE dob IS NOT NULL GROUP BY 1),
 base AS (SELECT fan_id, string_agg(DISTINCT source_system, ',' ORDER BY source_system) AS sources, count(*) AS record_count FROM mem GROUP BY 1)
 SELECT 'FAN-' || left(sha1(fan_id),12) AS fan_id, first_name, last_name, email, phone, city, state, zip, dob, sources, record_count FROM base LEFT JOIN mail USING (fan_id) LEFT JOIN born USING (fan_id) {' '.join(f'LEFT JOIN m_{c} USING (fan_id)' for c in _MODAL)}""",
    "blocked_pairs": _PAIRS + " SELECT ref_l, ref_r FROM pairs",
    "gamma_patterns": _GAMMA + " SELECT g_first, g_last, g_email, g_phone, g_zip, g_birth, count(*) AS n FROM gamma GROUP BY ALL",
    "scored_pairs_fixed": _GAMMA + f" SELECT ref_l, ref_r, round({_WEIGHT}, 6) AS weight FROM gamma",
    "band_split": _GAMMA + f", w AS (SELECT {_WEIGHT} AS w FROM gamma) SELECT CASE WHEN w >= ln(0.9999/(1-0.9999)) THEN 'auto_merge' WHEN w >= ln(0.999/(1-0.999)) THEN 'review' ELSE 'non_match' END AS band, count(*) AS n FROM w GROUP BY 1",
    "pair_metrics": _KNOWN + """, prs AS (SELECT a.cluster = b.cluster AS p, a.entity = b.entity AS t FROM known a JOIN known b ON a.ref < b.ref AND (a.cluster = b.cluster OR a.entity = b.entity)),
 c AS (SELECT count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn FROM prs)
 SELECT tp, fp, fn, round(tp/(tp+fp),4) AS precision, round(tp/(tp+fn),4) AS recall, round(2*(tp/(tp+fp))*(tp/(tp+fn))/((tp/(tp+fp))+(tp/(tp+fn))),4) AS f1, (SELECT count(DISTINCT cluster) FROM known) AS predicted_clusters, (SELECT count(DISTINCT entity) FROM known) AS true_clusters FROM c""",
    "tag_breakdown": _KNOWN + """, prs AS (SELECT a.cluster = b.cluster AS p, a.entity = b.entity AS t, list_distinct(list_concat(a.tags, b.tags)) AS tags FROM known a JOIN known b ON a.ref < b.ref AND (a.cluster = b.cluster OR a.entity = b.entity)),
 e AS (SELECT unnest(tags) AS tag, p, t FROM prs), n AS (SELECT tag, count(*) FILTER (WHERE t) AS tt, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp FROM e GROUP BY 1)
 SELECT tag, coalesce(tt,0) AS true_pairs, round(tp/nullif(tt,0),4) AS pair_recall, coalesce(fp,0) AS fp_pairs FROM (SELECT DISTINCT unnest(tags) AS tag FROM known) LEFT JOIN n USING (tag)""",
    "cluster_truth": _KNOWN + " SELECT cluster, count(*) AS member_count, count(DISTINCT entity) AS true_entity_count, count(DISTINCT entity) = 1 AS is_pure, false AS has_probabilistic FROM known GROUP BY 1",
    "threshold_sweep": """WITH e AS (SELECT least(rec_l,rec_r) AS a, greatest(rec_l,rec_r) AS b, max(score) AS p FROM match_pairs WHERE rec_l IS NOT NULL AND rec_r IS NOT NULL AND score IS NOT NULL GROUP BY 1,2), t AS (SELECT unnest([0.5,0.8,0.9,0.93,0.95])::DOUBLE AS threshold)
 SELECT threshold, count(*) AS n_edges, count(DISTINCT a) AS n_left, round(min(p),4) AS least FROM t JOIN e ON p >= threshold GROUP BY 1""",
    "review_export": """WITH p AS (SELECT * FROM match_pairs WHERE rec_l IS NOT NULL AND rec_r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rec_l, rec_r ORDER BY scored_at DESC NULLS LAST, pair_id DESC) = 1)
 SELECT rec_l, rec_r, round(score,4) AS probability, l.source_system AS source_system_l, l.first_name AS first_name_l, l.last_name AS last_name_l, l.email AS email_l, l.phone AS phone_l, r.source_system AS source_system_r, r.first_name AS first_name_r, r.last_name AS last_name_r, r.email AS email_r, r.phone AS phone_r
 FROM p LEFT JOIN identity_records l ON l.rec_id = rec_l LEFT JOIN identity_records r ON r.rec_id = rec_r WHERE lower(trim(verdict)) = 'review'""",
    "record_trace": """WITH chosen AS (SELECT fan_id, count(*) AS member_count FROM fan_xref GROUP BY 1 ORDER BY bool_or(method='probabilistic') DESC, count(*) DESC, fan_id LIMIT 1),
 r AS (SELECT i.*, x.fan_id, x.method, member_count FROM identity_records i JOIN fan_xref x USING (source_system, source_record_id) JOIN chosen USING (fan_id))
 SELECT fan_id, source_system, source_record_id, concat_ws(' ', first_name, last_name) AS observed_name, email, method, CASE WHEN method='probabilistic' THEN 'score'
  WHEN method='deterministic' AND EXISTS (SELECT 1 FROM r o WHERE (o.source_system,o.source_record_id)<>(r.source_system,r.source_record_id) AND r.email IS NOT NULL AND lower(trim(o.email))=lower(trim(r.email))) THEN 'same e-mail'
  WHEN method='deterministic' AND EXISTS (SELECT 1 FROM r o WHERE (o.source_system,o.source_record_id)<>(r.source_system,r.source_record_id) AND r.phone IS NOT NULL AND o.phone=r.phone AND lower(trim(o.last_name))=lower(trim(r.last_name))) THEN 'same phone and surname'
  WHEN method='deterministic' THEN 'another link' ELSE 'single' END AS evidence, member_count FROM r""",
    "false_merge_trace": _KNOWN + """, worst AS (SELECT cluster, count(*) AS member_count, count(DISTINCT entity) AS true_entity_count FROM known GROUP BY 1 HAVING count(DISTINCT entity) > 1 ORDER BY 3 DESC, 2 DESC, 1 LIMIT 1)
 SELECT ref, email, member_count, true_entity_count FROM known JOIN worst USING (cluster)""",
}
for _name in ("pair_metrics", "tag_breakdown", "false_merge_trace"):
    ORACLES[f"{_name}_all"] = ORACLES[_name].replace(_KNOWN, _ALL)
