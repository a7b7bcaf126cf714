"""Queries of the data problems whose operators are in this subpackage, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordspark.llm import groups, linking, mixing, packing, subjects, survivorship
from recordspark.llm.tokens import document_sizes
from recordspark.runtime import Cut, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    cut = Cut(spark, "p2")
    return cut.finish(survivorship.golden_values(table(spark, d, "identity_records"), table(spark, d, "fan_xref"), cut).select("fan_id", "field_name", "rec_id"))


def p2_golden_fans(spark: SparkSession, d: str) -> DataFrame:
    cut = Cut(spark, "p2")
    return cut.finish(survivorship.golden_fans(table(spark, d, "identity_records"), table(spark, d, "fan_xref"), cut))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pairs(spark, d).selectExpr("a as rec_a", "b as rec_b")


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    cut = Cut(spark, "p3", dense=True)
    return cut.finish(linking.linked_pairs(table(spark, d, "identity_records"), table(spark, d, "fan_xref"), cut))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    cut = Cut(spark, "p4")
    return cut.finish(groups.match_groups(table(spark, d, "match_pairs"), cut))


def p4_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    cut = Cut(spark, "p4")
    return cut.finish(groups.crosswalk(table(spark, d, "identity_records"), table(spark, d, "match_pairs"), cut))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    cut = Cut(spark, "p8")
    return cut.finish(packing.pack(table(spark, d, "documents"), table(spark, d, "pack_limits"), cut))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_pack(spark, d), table(spark, d, "pack_limits"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    cut = Cut(spark, "p9")
    return cut.finish(mixing.draw(table(spark, d, "documents"), table(spark, d, "mix_targets"), cut))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    cut = Cut(spark, "p9")
    drawn = cut.table(mixing.draw(table(spark, d, "documents"), table(spark, d, "mix_targets"), cut))
    return cut.finish(mixing.share_report(drawn, table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.found_subjects(table(spark, d, "documents"), table(spark, d, "doc_labels"), table(spark, d, "subjects"))


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and tokens by subject; a document with several subjects counts for each."""
    cut = Cut(spark, "p10")
    found = p10_found(spark, d)
    sizes = document_sizes(table(spark, d, "documents"))
    both = sizes.join(found, "doc_id", "left").fillna("none", ["subject"])
    return cut.table(both.groupBy("subject").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens")))


QUERIES = {f.__name__: f for f in (p2_found, p2_golden_fans, p3_found, p3_pairs, p4_found, p4_crosswalk, p8_pack, p8_fill, p9_mix, p9_shares, p10_found, p10_composition)}

_P4 = """
WITH RECURSIVE last AS (
  SELECT least(rec_l, rec_r) AS a, greatest(rec_l, rec_r) AS b, lower(trim(verdict)) AS v FROM match_pairs
  WHERE rec_l IS NOT NULL AND rec_r IS NOT NULL AND rec_l <> rec_r
  QUALIFY row_number() OVER (PARTITION BY least(rec_l, rec_r), greatest(rec_l, rec_r) ORDER BY scored_at DESC NULLS LAST, pair_id DESC) = 1),
links AS (SELECT a, b FROM last WHERE v = 'match' UNION ALL SELECT b, a FROM last WHERE v = 'match'),
reach AS (SELECT a AS rec_id, a AS other FROM links UNION SELECT r.rec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
grp AS (SELECT rec_id, min(other) AS group_id FROM reach GROUP BY rec_id)
"""

ORACLES = {"p4_found": _P4 + "SELECT rec_id, group_id FROM grp", "p4_crosswalk": _P4 + """
SELECT r.rec_id, r.source_system, r.source_record_id, coalesce(g.group_id, r.rec_id) AS group_id,
       'FAN-' || left(sha1(m.source_system || ':' || m.source_record_id), 12) AS fan_id
FROM identity_records r LEFT JOIN grp g USING (rec_id) JOIN identity_records m ON m.rec_id = coalesce(g.group_id, r.rec_id) WHERE r.link_state = 'scored'"""}
