"""Consolidating pairwise matches into groups by hash-to-min.

Each vertex v keeps a cluster set C(v), held as rows (v, u) and never gathered: first itself and its neighbours.
In a round with m = min C(v), v sends C(v) to m and m to every other member; rounds end when no set changes.
Every round is written to the shared folder, so lineage stays short and a lost executor costs one round.

The minimum per vertex is aggregated before its shuffle, and the join that brings it back to the rows of a vertex
may be split by the adaptive plan, so a hub that holds a third of all rows is neither gathered nor one task.

Defined results: pairs with a null record, or the same record twice, link nothing; a pair counts in either order;
of several rows for a pair the one scored last decides (ties: the greatest pair_id; null times are the earliest);
a null verdict is no match; extra columns are not read; no links give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspark.runtime import Cut

MAX_ROUNDS = 60  # far beyond what any input needs: rounds grow as the logarithm of a group's diameter


def current_links(pairs: DataFrame) -> DataFrame:
    """a < b of every pair whose latest verdict is match."""
    clean = pairs.filter("rec_l is not null and rec_r is not null and rec_l <> rec_r")
    known = F.col("scored_at").isNotNull()
    last = clean.groupBy(F.least("rec_l", "rec_r").alias("a"), F.greatest("rec_l", "rec_r").alias("b")).agg(
        F.max(F.struct(known.alias("k"), F.col("scored_at").alias("t"), F.col("pair_id").alias("p"), F.lower(F.regexp_replace("verdict", r"^\s+|\s+$", "")).alias("v")))["v"].alias("verdict")
    )
    return last.filter("verdict = 'match'").select("a", "b")


def hash_to_min(links: DataFrame, cut: Cut) -> DataFrame:
    """v and root, the least vertex linked to it directly or indirectly, for every vertex of `links` (a, b)."""
    both = F.array(*[F.struct(F.col(x).alias("v"), F.col(y).alias("u")) for x, y in (("a", "b"), ("b", "a"), ("a", "a"), ("b", "b"))])
    rows = cut.table(links.select(F.inline(both)).distinct(), ["v", "u"])
    for _ in range(MAX_ROUNDS):
        least = rows.groupBy("v").agg(F.min("u").alias("m"))
        sent = F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))
        after = cut.table(rows.join(least, "v").select(F.inline(sent)).distinct(), ["v", "u"])
        settled = after.mark == rows.mark
        cut.drop(rows)
        rows = after
        if settled:
            return rows.groupBy("v").agg(F.min("u").alias("root"))
    raise RuntimeError("hash-to-min did not settle")


def match_groups(pairs: DataFrame, cut: Cut) -> DataFrame:
    """rec_id and group_id, the least rec_id of its group, for every linked record."""
    return hash_to_min(current_links(pairs), cut).select(F.col("v").alias("rec_id"), F.col("root").alias("group_id"))


def crosswalk(records: DataFrame, pairs: DataFrame, cut: Cut) -> DataFrame:
    """One fan_id for every scored source record, from the reference of its group's least record; unlinked ones stand alone."""
    rec = records.filter("link_state = 'scored' and rec_id is not null").select("rec_id", "source_system", "source_record_id")
    groups = match_groups(pairs, cut)
    rooted = rec.join(groups, "rec_id", "left").withColumn("group_id", F.coalesce("group_id", "rec_id"))
    ref = rec.select(F.col("rec_id").alias("group_id"), F.concat_ws(":", "source_system", "source_record_id").alias("ref"))
    fan = F.concat(F.lit("FAN-"), F.substring(F.sha1(F.coalesce("ref", F.col("group_id").cast("string"))), 1, 12))
    return rooted.join(ref, "group_id", "left").select("rec_id", "source_system", "source_record_id", "group_id", fan.alias("fan_id"))
