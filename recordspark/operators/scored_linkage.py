"""Fellegi–Sunter linkage: blocking, agreement patterns, parameters by expectation-maximisation, scores and bands.

Records with equal comparison attributes are one profile (its least ref and a count); candidate pairs are pairs of
profiles that meet one of the blocking rules, a later rule only where no earlier one holds, so no distinct step is
needed over the rules. Placeholders (an e-mail or phone that many different surnames share, nearly one a record) are
no evidence and form no block. Pairs become agreement patterns of at most PATTERNS kinds; training and scores work on
pattern counts, so what the driver sees is bounded whatever the number of pairs.

Null values agree with nothing and carry no weight. Jaro–Winkler runs in Arrow batches over distinct name pairs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordspark.functions.text import canonical_first_name, fold, jaro_winkler
from recordspark.runtime import Cut

ATTRIBUTES = ["first_name_c", "last_name_f", "email", "phone", "zip", "birth_year"]
LEVELS = {"g_first": 4, "g_last": 4, "g_email": 3, "g_phone": 2, "g_zip": 2, "g_birth": 2}  # without the null level 0
PATTERNS = math.prod(n + 1 for n in LEVELS.values())
BLOCKS = [["email"], ["phone"], ["last_name_f", "zip"], ["first_name_c", "last_name_f"], ["birth_year", "zip"]]
AUTO_MERGE, REVIEW, RECALL_OF_RULES, U_PAIRS, U_RECORDS = 0.9999, 0.999, 0.8, 500_000, 200_000
PLACEHOLDER_NAMES = 8
# Parameters for scoring without training (m and u by level from 1 = no agreement up to exact).
FIXED_M = {"g_first": [0.05, 0.05, 0.1, 0.8], "g_last": [0.05, 0.05, 0.1, 0.8], "g_email": [0.2, 0.1, 0.7], "g_phone": [0.2, 0.8], "g_zip": [0.15, 0.85], "g_birth": [0.1, 0.9]}
FIXED_U = {"g_first": [0.9, 0.05, 0.03, 0.02], "g_last": [0.93, 0.04, 0.02, 0.01], "g_email": [0.995, 0.004, 0.001], "g_phone": [0.999, 0.001], "g_zip": [0.97, 0.03], "g_birth": [0.98, 0.02]}
FIXED_PRIOR = 0.0005


def _no_placeholders(people: DataFrame, column: str) -> DataFrame:
    seen = people.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"), F.count_distinct("last_name_f").alias("names"))
    bad = seen.filter(f"names >= {PLACEHOLDER_NAMES} and names > 0.5 * n").select(F.col(column).alias("_b"), F.lit(True).alias("_is"))
    return people.join(bad, F.col(column) == F.col("_b"), "left").withColumn(column, F.when(F.col("_is").isNull(), F.col(column))).drop("_b", "_is")


def match_ready(people: DataFrame) -> DataFrame:
    """ref and the six comparison attributes; birth year as text."""
    ready = people.select("ref", canonical_first_name(fold(F.col("first_name"))).alias("first_name_c"), fold(F.col("last_name")).alias("last_name_f"), "email", "phone", "zip", F.col("birth_year").cast("string").alias("birth_year"))
    return _no_placeholders(_no_placeholders(ready, "email"), "phone")


def profiles(ready: DataFrame) -> DataFrame:
    """One row per distinct combination of attributes: its least ref and the number of records."""
    return ready.groupBy(*ATTRIBUTES).agg(F.min("ref").alias("ref"), F.count("*").alias("n"))


def blocked_pairs(prof: DataFrame, rules: list[list[str]] | None = None) -> DataFrame:
    """l.* and r.* structs of profile pairs, ref_l < ref_r, each met by its first rule."""
    a, b = prof.select(F.struct(*prof.columns).alias("l")), prof.select(F.struct(*prof.columns).alias("r"))
    out, earlier = None, []
    for rule in rules or BLOCKS:
        met = F.lit(True)
        for k in rule:
            met = met & (F.col(f"l.{k}") == F.col(f"r.{k}"))
        fresh = met & (F.col("l.ref") < F.col("r.ref"))
        for e in earlier:
            fresh = fresh & ~F.coalesce(e, F.lit(False))
        part = a.join(b, fresh)
        out = part if out is None else out.unionByName(part)
        earlier.append(met)
    return out


def _levels(pairs: DataFrame) -> DataFrame:
    """Adds the agreement levels; 0 where a side is null."""
    l, r = (lambda k: F.col(f"l.{k}")), (lambda k: F.col(f"r.{k}"))  # noqa: E741
    null = lambda k: l(k).isNull() | r(k).isNull()
    jw = lambda k, s: F.when(null(k), 0).when(l(k) == r(k), 4).when(F.col(s) >= 0.92, 3).when(F.col(s) >= 0.8, 2).otherwise(1)
    exact = lambda k: F.when(null(k), 0).when(l(k) == r(k), 2).otherwise(1)
    mail = F.when(null("email"), 0).when(l("email") == r("email"), 3).when(F.levenshtein(l("email"), r("email"), 2) >= 0, 2).otherwise(1)
    return pairs.select(
        F.col("l.ref").alias("ref_l"), F.col("r.ref").alias("ref_r"), F.col("l.n").alias("n_l"), F.col("r.n").alias("n_r"), jw("first_name_c", "s_first").alias("g_first"), jw("last_name_f", "s_last").alias("g_last"),
        mail.alias("g_email"), exact("phone").alias("g_phone"), exact("zip").alias("g_zip"), exact("birth_year").alias("g_birth"),
    )


def _similar(pairs: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the Jaro–Winkler similarity of both sides' `key`, computed once per distinct pair of different values."""
    a, b = F.least(f"l.{key}", f"r.{key}"), F.greatest(f"l.{key}", f"r.{key}")
    keyed = pairs.withColumn("_a", F.when(F.col(f"l.{key}") != F.col(f"r.{key}"), a)).withColumn("_b", F.when(F.col(f"l.{key}") != F.col(f"r.{key}"), b))
    kinds = keyed.filter("_a is not null").select("_a", "_b").distinct()
    scored = kinds.select("_a", "_b", jaro_winkler(F.col("_a"), F.col("_b")).alias(name))
    return keyed.join(scored, ["_a", "_b"], "left").drop("_a", "_b")


def agreement(pairs: DataFrame) -> DataFrame:
    return _levels(_similar(_similar(pairs, "first_name_c", "s_first"), "last_name_f", "s_last"))


def _weights(m: dict, u: dict, prior: float) -> Column:
    """Log odds of a match for a row with agreement levels."""
    w = F.lit(math.log(prior / (1 - prior)))
    for g in LEVELS:
        part = F.lit(0.0)
        for i, (a, b) in enumerate(zip(m[g], u[g]), 1):
            part = F.when(F.col(g) == i, math.log(a / b)).otherwise(part)
        w = w + part
    return w


def score(levels: DataFrame, m: dict, u: dict, prior: float) -> DataFrame:
    """Adds weight (log odds), probability and band: auto_merge, review or non_match; bands are cut in log odds."""
    w = _weights(m, u, prior)
    cut = lambda p: math.log(p / (1 - p))
    band = F.when(F.col("weight") >= cut(AUTO_MERGE), "auto_merge").when(F.col("weight") >= cut(REVIEW), "review").otherwise("non_match")
    return levels.withColumn("weight", w).withColumn("probability", 1 / (1 + F.exp(-F.col("weight")))).withColumn("band", band)


def pattern_counts(levels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, counts): at most PATTERNS rows reach the driver."""
    rows = levels.groupBy(*LEVELS).agg(F.sum(F.col("n_l") * F.col("n_r")).alias("n")).collect()
    return np.array([[r[g] for g in LEVELS] for r in rows], dtype=int).reshape(-1, len(LEVELS)), np.array([r["n"] for r in rows], dtype=float)


def em_session(patterns: np.ndarray, counts: np.ndarray, u: dict, held: list[str], rounds: int = 25) -> tuple[dict, list[float]]:
    """m of the attributes not held out, with u fixed; also the log-likelihood per round, which never falls."""
    live = [g for g in LEVELS if g not in held]
    m = {g: np.linspace(0.1, 1.0, LEVELS[g]) / np.linspace(0.1, 1.0, LEVELS[g]).sum() for g in live}
    share, trace = 0.3, []
    for _ in range(rounds):
        lm, lu = np.full(len(patterns), math.log(share)), np.full(len(patterns), math.log(1 - share))
        for g in live:
            col = patterns[:, list(LEVELS).index(g)]
            lm += np.log(np.concatenate([[1.0], m[g]]))[col]
            lu += np.log(np.concatenate([[1.0], u[g]]))[col]
        top = np.maximum(lm, lu)
        trace.append(float((counts * (top + np.log(np.exp(lm - top) + np.exp(lu - top)))).sum()))
        r = counts * np.exp(lm - top) / (np.exp(lm - top) + np.exp(lu - top))
        share = min(0.999, max(1e-6, r.sum() / max(1.0, counts.sum())))
        move = 0.0
        for g in live:
            col = patterns[:, list(LEVELS).index(g)]
            new = np.array([r[col == i].sum() for i in range(1, LEVELS[g] + 1)]) + 1e-6
            new /= new.sum()
            move, m[g] = max(move, float(np.abs(new - m[g]).max())), new
        if move < 1e-4:
            break
    return m, trace


def train(ready: DataFrame, levels: DataFrame, seed: int = 42) -> tuple[dict, dict, float]:
    """(m, u, prior). u from random pairs (about U_PAIRS among at most U_RECORDS records, documented bounds), prior from the exact rules.

    m comes from the candidate pairs' pattern counts: the pairs of equal e-mail and those of equal names are told by their levels.
    """
    n = ready.count()
    each = ready.withColumn("n", F.lit(1))
    sample = each.sample(fraction=min(1.0, U_RECORDS / max(1, n)), seed=seed) if n > U_RECORDS else each
    drawn = min(n, U_RECORDS)
    buckets = max(1, drawn * drawn // U_PAIRS)  # two unrelated hashes meet in a bucket by chance: pairs at random, by an equi-join
    side = lambda k: sample.select(F.struct(*each.columns).alias("lr"[k]), F.pmod(F.xxhash64(F.lit(seed + k), "ref"), F.lit(buckets)).alias("bucket"))
    random = side(0).join(side(1), "bucket").filter("l.ref <> r.ref")
    p, c = pattern_counts(agreement(random))
    u = {}
    for i, g in enumerate(LEVELS):
        freq = np.array([c[p[:, i] == j].sum() for j in range(1, LEVELS[g] + 1)]) if len(c) else np.zeros(LEVELS[g])
        u[g] = np.maximum(1e-9, (freq + 0.5) / (freq.sum() + 0.5 * LEVELS[g]))
    pairs = lambda keys: ready.dropna(subset=keys).groupBy(*keys).agg((F.count("*") * (F.count("*") - 1) / 2).alias("c")).agg(F.sum("c")).first()[0] or 0.0
    rules = pairs(["email"]) + pairs(["phone", "last_name_f"]) - pairs(["email", "phone", "last_name_f"])
    prior = min(0.5, max(1e-9, rules / RECALL_OF_RULES / max(1.0, n * (n - 1) / 2)))
    p, c = pattern_counts(levels)
    at = list(LEVELS).index
    mail, name = p[:, at("g_email")] == LEVELS["g_email"], (p[:, at("g_first")] == LEVELS["g_first"]) & (p[:, at("g_last")] == LEVELS["g_last"])
    by_mail, _ = em_session(p[mail], c[mail], u, ["g_email"])
    by_name, _ = em_session(p[name], c[name], u, ["g_first", "g_last"])
    m = {g: (by_mail[g] + by_name[g]) / 2 if g in by_mail and g in by_name else by_mail.get(g, by_name.get(g)) for g in LEVELS}
    return m, u, prior


def linkage(people: DataFrame, cut: Cut, mode: str = "full", fixed: bool = False) -> DataFrame:
    """ref, root, method and score of every record; mode `deterministic` or `full`, the latter with trained or fixed parameters."""
    from recordspark.operators.clusters import combined_clusters, exact_clusters

    if mode not in ("deterministic", "full"):
        raise ValueError(f"unknown mode: {mode}")
    exact = cut.table(exact_clusters(people, cut))
    none = exact.limit(0).select(F.col("ref").alias("ref_l"), F.col("root").alias("ref_r"), F.lit(0.0).alias("probability"))
    if mode == "deterministic":
        return combined_clusters(people, exact, none, cut)
    ready = cut.table(match_ready(people))
    scored = cut.table(scored_pairs(ready, cut, fixed).filter("band = 'auto_merge'").select("ref_l", "ref_r", "probability"))
    return combined_clusters(people, exact, scored, cut)


def pair_levels(ready: DataFrame, cut: Cut) -> tuple[DataFrame, DataFrame]:
    """(profiles, agreement levels of all their candidate pairs), each written once; training and scores read the same pairs."""
    prof = cut.table(profiles(ready))
    return prof, cut.table(agreement(blocked_pairs(prof)))


def scored_pairs(ready: DataFrame, cut: Cut, fixed: bool = False) -> DataFrame:
    """All candidate pairs of profiles with trained (or the fixed) parameters' scores, and for profiles of several records the pairs that tie these to the least ref."""
    prof, levels = pair_levels(ready, cut)
    m, u, prior = (FIXED_M, FIXED_U, FIXED_PRIOR) if fixed else train(ready, levels)
    pairs = score(levels, m, u, prior).select("ref_l", "ref_r", "weight", "probability", "band")
    one = F.col("n") > 1
    copies = ready.join(prof.filter(one).select(*[F.col(a).alias(f"p_{a}") for a in ATTRIBUTES], F.col("ref").alias("ref_l")), [ready[a].eqNullSafe(F.col(f"p_{a}")) for a in ATTRIBUTES])
    own = copies.filter("ref <> ref_l").withColumn("l", F.struct(F.col("ref_l").alias("ref"), *[F.col(a) for a in ATTRIBUTES], F.lit(1).alias("n"))).withColumn("r", F.struct(F.col("ref"), *[F.col(a) for a in ATTRIBUTES], F.lit(1).alias("n")))
    same = score(_levels(own.select("l", "r", F.lit(1.0).alias("s_first"), F.lit(1.0).alias("s_last"))), m, u, prior).select("ref_l", "ref_r", "weight", "probability", "band")
    return pairs.unionByName(same)
