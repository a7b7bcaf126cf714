"""Exact linkage rules, connected components and survivorship by modal values.

Rules link each record to the least reference that shares its value (a star, not all pairs). Components come
from alternating large and small stars (Kiveris et al. 2014), which turn every component into a star around its least
reference; each round is a written table. Minima are aggregated before their shuffles and joined
back on the key, which the adaptive plan may split, so a value that a third of all records share is no single task.

Null and blank values link nothing; records without links are clusters of their own; repeated records count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordspark.functions.text import fold, person_id, phone10
from recordspark.runtime import Cut, blank_to_null

MAX_ROUNDS = 60


def identity_input(records: DataFrame) -> DataFrame:
    """ref and the attributes of the exact rules and survivorship; blank values other than names are null."""
    return records.filter("source_system is not null and source_record_id is not null").select(
        F.concat_ws(":", "source_system", "source_record_id").alias("ref"), "source_system", "source_record_id", "first_name", "last_name",
        F.lower(blank_to_null(F.col("email"))).alias("email"), phone10(F.col("phone")).alias("phone"), blank_to_null(F.col("city")).alias("city"),
        blank_to_null(F.col("state")).alias("state"), blank_to_null(F.col("zip")).alias("zip"), "dob", "birth_year", "observed_at",
    )


def _star(people: DataFrame, *keys: str) -> DataFrame:
    known = people.select("ref", *keys)
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    anchors = known.groupBy(*keys).agg(F.min("ref").alias("anchor"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return known.join(anchors, list(keys)).filter("ref <> anchor").select("anchor", "ref")


def exact_edges(people: DataFrame) -> DataFrame:
    """anchor, ref: the same e-mail, or the same phone and folded surname."""
    named = people.withColumn("surname", fold(F.col("last_name")))
    return _star(named, "email").unionByName(_star(named, "phone", "surname")).distinct()


def components(vertices: DataFrame, edges: DataFrame, cut: Cut) -> DataFrame:
    """ref and root, the least ref of its component, for every ref of `vertices`; edges have anchor and ref."""
    low, high = F.least("anchor", "ref"), F.greatest("anchor", "ref")
    e = cut.table(edges.filter("anchor <> ref").select(high.alias("u"), low.alias("v")).distinct(), ["u", "v"])  # u > v
    for _ in range(MAX_ROUNDS):
        # large star: every vertex ties its greater neighbours to the least of its neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every vertex ties itself and its lesser neighbours to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = large.join(least, "u").select(F.inline(tied)).filter("u <> v").distinct()
        after = cut.table(small, ["u", "v"])
        settled = after.mark == e.mark
        cut.drop(e)
        e = after
        if settled:
            roots = e.groupBy("u").agg(F.min("v").alias("root"))
            return vertices.select("ref").join(roots.withColumnRenamed("u", "ref"), "ref", "left").select("ref", F.coalesce("root", "ref").alias("root"))
    raise RuntimeError("components did not settle")


def exact_clusters(people: DataFrame, cut: Cut) -> DataFrame:
    return components(people, exact_edges(people), cut)


def modal_value(members: DataFrame, column: str) -> DataFrame:
    """Per cluster the value most often given, compared folded: the greatest fold of the most frequent, of its spellings the longest, then the greatest."""
    seen = members.withColumn("_f", fold(F.col(column))).filter("_f is not null")
    kinds = seen.groupBy("root", "_f").agg(F.count("*").alias("n"), F.max(F.struct(F.length(column).alias("l"), F.col(column).alias("v")))["v"].alias("v"))
    return kinds.groupBy("root").agg(F.max(F.struct("n", "_f", "v"))["v"].alias(column))


def golden_records(people: DataFrame, clusters: DataFrame) -> DataFrame:
    """One record per cluster: the latest e-mail, modal names and places, the first date of birth in order of reference, sources and count."""
    m = people.join(clusters, "ref")
    mail = m.filter("email is not null").groupBy("root").agg(F.min(F.struct((-F.unix_micros(F.coalesce(F.col("observed_at"), F.lit("0001-01-01")).cast("timestamp"))).alias("t"), F.col("ref"), F.col("email")))["email"].alias("email"))
    born = m.filter("dob is not null").groupBy("root").agg(F.min(F.struct("ref", "dob"))["dob"].alias("dob"))
    out = m.groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("source_system")), ",").alias("sources"), F.count("*").alias("record_count"))
    for part in (mail, *[modal_value(m, c) for c in ("first_name", "last_name", "phone", "city", "state", "zip")], born):
        out = out.join(part, "root", "left")
    return out.select(person_id(F.col("root")).alias("fan_id"), "first_name", "last_name", "email", "phone", "city", "state", "zip", "dob", "sources", "record_count")


def crosswalk(people: DataFrame, clusters: DataFrame) -> DataFrame:
    """source_system, source_record_id, fan_id and method of every record under the exact rules."""
    sizes = clusters.groupBy("root").agg(F.count("*").alias("n"))
    method = F.when(F.col("n") > 1, "deterministic").otherwise("singleton")
    return people.select("ref", "source_system", "source_record_id").join(clusters, "ref").join(sizes, "root").select("source_system", "source_record_id", person_id(F.col("root")).alias("fan_id"), method.alias("method"))


def combined_clusters(people: DataFrame, exact: DataFrame, scored: DataFrame, cut: Cut) -> DataFrame:
    """ref, root, method and score after exact clusters are joined with scored edges (ref_l, ref_r, probability)."""
    star = exact.filter("ref <> root").select(F.col("root").alias("anchor"), "ref")
    roots = components(people, star.unionByName(scored.select(F.col("ref_l").alias("anchor"), F.col("ref_r").alias("ref"))), cut)
    multi = exact.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("root").alias("exact_root"))
    ends = scored.select(F.inline(F.array(*[F.struct(F.col(c).alias("ref"), "probability") for c in ("ref_l", "ref_r")])))
    best = ends.groupBy("ref").agg(F.max("probability").alias("best"))
    both = roots.join(exact.withColumnRenamed("root", "exact_root"), "ref").join(multi.withColumn("is_exact", F.lit(True)), "exact_root", "left").join(best, "ref", "left")
    method = F.when(F.col("is_exact"), "deterministic").when(F.col("best").isNotNull(), "probabilistic").otherwise("singleton")
    return both.select("ref", "root", method.alias("method"), F.when(method == "probabilistic", F.col("best")).alias("score"))


def last_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the order given; ties fall to the greatest text of the row."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order, F.to_json(F.struct(*df.columns)).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
