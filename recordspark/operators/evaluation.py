"""Accuracy of a clustering against known entities, by counting pairs rather than listing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs_of(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")


def pair_metrics(known: DataFrame) -> DataFrame:
    """known: ref, cluster, entity of references that both sides know. One row: tp, fp, fn, precision, recall, f1 and counts.

    Without predicted pairs precision is 1, without true pairs recall is 1, and f1 is 0 where both are 0.
    """
    total = lambda *keys: known.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(pairs_of(F.col("n"))), F.lit(0)).alias("c"), F.count("*").alias("k"))
    a = total("cluster").select(F.col("c").alias("predicted"), F.col("k").alias("predicted_clusters"))
    b = total("entity").select(F.col("c").alias("true_pairs"), F.col("k").alias("true_clusters"))
    c = total("cluster", "entity").select(F.col("c").alias("tp"))
    one = a.crossJoin(b).crossJoin(c)  # three single rows
    p = F.when(F.col("predicted") == 0, 1.0).otherwise(F.col("tp") / F.nullif("predicted", F.lit(0)))
    r = F.when(F.col("true_pairs") == 0, 1.0).otherwise(F.col("tp") / F.nullif("true_pairs", F.lit(0)))
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0)))
    return one.select("tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("true_pairs") - F.col("tp")).alias("fn"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"), "predicted_clusters", "true_clusters")


def tag_breakdown(known: DataFrame) -> DataFrame:
    """known: ref, cluster, entity, tags (array). Per tag: true pairs with a tagged side, their recall, false pairs with a tagged side."""
    tags = known.select(F.explode("tags").alias("tag")).filter("tag <> ''").distinct()
    marked = known.select("ref", "cluster", "entity", F.explode(F.array_distinct("tags")).alias("tag")).filter("tag <> ''")

    def touched(*keys: str) -> DataFrame:
        """Per tag the pairs within groups of these keys with at least one tagged side: C(n,2) - C(n-t,2)."""
        all_n = known.groupBy(*keys).agg(F.count("*").alias("n"))
        t = marked.groupBy("tag", *keys).agg(F.count("*").alias("t")).join(all_n, list(keys))
        return t.groupBy("tag").agg(F.sum(pairs_of(F.col("n")) - pairs_of(F.col("n") - F.col("t"))).alias("c"))

    e, c, b = (touched(*k).withColumnRenamed("c", f"c_{i}") for i, k in enumerate((("entity",), ("cluster",), ("cluster", "entity"))))
    out = tags.join(e, "tag", "left").join(c, "tag", "left").join(b, "tag", "left").fillna(0)
    return out.select("tag", F.col("c_0").alias("true_pairs"), F.round(F.col("c_2") / F.nullif("c_0", F.lit(0)), 4).alias("pair_recall"), (F.col("c_1") - F.col("c_2")).alias("fp_pairs"))


def cluster_truth(members: DataFrame) -> DataFrame:
    """members: cluster, entity (null: unknown, an entity of its own), ref, method. Per cluster: size, entities, purity, scored members."""
    e = F.coalesce("entity", F.concat(F.lit("?"), "ref"))
    return members.groupBy("cluster").agg(
        F.count("*").alias("member_count"), F.count_distinct(e).alias("true_entity_count"), (F.count_distinct(e) == 1).alias("is_pure"), F.bool_or(F.coalesce(F.col("method") == "probabilistic", F.lit(False))).alias("has_probabilistic")
    )


def threshold_sweep(edges: DataFrame, thresholds: list[float], measure) -> DataFrame:
    """Slices one scored edge table (probability) at each threshold and measures the outcome; `measure` maps edges to one row."""
    out = None
    for t in thresholds:
        row = measure(edges.filter(F.col("probability") >= t)).select(F.lit(t).alias("threshold"), "*")
        out = row if out is None else out.unionByName(row)
    return out
