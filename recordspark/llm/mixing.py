"""Mixing sources to target weights.

Method: soft-membership mixing. A stated source is certain; for documents that state none a classifier, trained on
the labelled ones (naive Bayes on hashed words, at most MAX_LABELLED documents with the least hash), gives posteriors.
Projected gradient least squares fits a nonnegative rate per document, at most the repeats its sources allow, whose
expected source totals meet the targets. A document's rate is the projection of the step sizes that its sources have
gathered, so the state of the fit is one number per mix and source, and a round is one aggregate over the documents:
known ones enter as token sums by source, made once. The squared error falls from round to round (a step that would raise
it is taken back and halved) until it settles; a fit that does not settle is an error.

Rates become whole copies: the whole part for all, one more for documents in hash buckets (BUCKETS per mix and source)
that are taken in order while their tokens fit, so drawn totals meet fitted ones to within a part of a bucket.

The total of a mix is the largest at which every available source can give its share. A source of the mix that the
corpus lacks keeps its row with nothing drawn; the others share in proportion. Sources outside the mix are not drawn.

Defined results: sources are compared without case, surrounding blanks and with blanks as underscores; null and blank
sources are unknown; empty texts weigh nothing and are not drawn, nor are rows without a doc_id; repeated doc_ids count once; null mixes, sources or
shares are left out; repeats below 1 forbid a source; extra columns are not read; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordspark.llm.subjects import Hasher, sentences
from recordspark.llm.tokens import FOLDER, token_count
from recordspark.runtime import Cut, spread

MAX_LABELLED = 4000
BUCKETS = 1024
MAX_TARGETS = 10_000
MAX_ROUNDS, SETTLED = 200, 1e-4
BITS = 16


def plain_source(c: Column) -> Column:
    """Null for null and blank."""
    t = F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s-]+", "_")
    return F.when(t != "", t)


class SourceModel:
    """Multinomial naive Bayes over hashed words, tempered by length."""

    def __init__(self, names: list[str], logs: np.ndarray, prior: np.ndarray) -> None:
        self.names, self.logs, self.prior = names, logs.astype(np.float32), prior.astype(np.float32)

    @staticmethod
    def fit(texts: list[str], sources: list[str], names: list[str]) -> SourceModel:
        n, hasher = np.full((1 << BITS, len(names)), 0.05), Hasher()
        for t, s in zip(texts, sources):
            ids, _ = hasher(sentences(t))
            np.add.at(n[:, names.index(s)], ids, 1.0)
        share = np.array([sources.count(s) + 1.0 for s in names])
        return SourceModel(names, np.log(n / n.sum(axis=0)), np.log(share / share.sum()))

    def posteriors(self, texts: list[str | None], hasher: Hasher) -> np.ndarray:
        out = np.zeros((len(texts), len(self.names)))
        for i, t in enumerate(texts):
            ids, _ = hasher(sentences(t))
            z = self.logs[ids].sum(axis=0) / np.sqrt(max(1, len(ids))) + self.prior
            z = np.exp(z - z.max())
            out[i] = z / z.sum()
        return out


def train_sources(documents: DataFrame, most: int = MAX_LABELLED) -> SourceModel | None:
    rows = documents.filter("src is not null and text is not null").select("doc_id", "text", "src").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    names = sorted({r["src"] for r in rows})
    return SourceModel.fit([r["text"] for r in rows], [r["src"] for r in rows], names) if names else None


def soft_members(documents: DataFrame, model: SourceModel) -> DataFrame:
    """doc_id and posterior (a map by source) of documents that state no source."""
    shared = documents.sparkSession.sparkContext.broadcast((model.names, model.logs, model.prior))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, hasher = SourceModel(*shared.value), Hasher()
        for pdf in batches:
            p = m.posteriors(pdf["text"].tolist(), hasher)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": pdf["n_tokens"], "post": [list(map(float, r)) for r in p]})

    return documents.filter("src is null").select("doc_id", "n_tokens", "text").mapInPandas(score, f"doc_id {kind}, n_tokens long, post array<double>")


def read_targets(targets: DataFrame) -> dict[str, dict[str, tuple[float, int]]]:
    """mix -> source -> (share, repeats). The table of mixes is a parameter of the job; more than MAX_TARGETS rows are an error."""
    t = targets.filter("mix_id is not null and target_share > 0").select("mix_id", plain_source(F.col("source")).alias("src"), "target_share", F.coalesce("max_repeat", F.lit(1)).alias("most")).filter("src is not null")
    rows = t.groupBy("mix_id", "src").agg(F.sum("target_share").alias("share"), F.max("most").alias("most")).orderBy("mix_id", "src").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    out: dict[str, dict[str, tuple[float, int]]] = {}
    for r in rows:
        out.setdefault(r["mix_id"], {})[r["src"]] = (r["share"], max(0, r["most"]))
    return out


def _soft_rate(step: dict[str, float], most: dict[str, int], names: list[str]) -> Column:
    """Rate of a document with posterior `post`: its sources' gathered steps, between 0 and the repeats of its likeliest source."""
    at = {s: j + 1 for j, s in enumerate(names)}
    gathered = sum((F.element_at("post", at[s]) * float(v) for s, v in step.items() if s in at), F.lit(0.0))
    likely = F.array_position("post", F.array_max("post"))
    cap = F.lit(0.0)
    for s in step:
        if s in at:
            cap = F.when(likely == at[s], float(most[s])).otherwise(cap)
    return F.greatest(F.lit(0.0), F.least(gathered, cap))


def fit_rates(mixes: dict[str, dict[str, tuple[float, int]]], known: dict[str, int], soft: DataFrame | None, names: list[str]) -> dict[str, dict[str, float]]:
    """mix -> source -> gathered step, at which expected totals by source are in proportion to the targets."""
    at = {s: j + 1 for j, s in enumerate(names)}
    expected = dict.fromkeys(names, 0.0)
    if soft is not None:
        r = soft.agg(*[F.sum(F.col("n_tokens") * F.element_at("post", j)).alias(f"s{j}") for j in at.values()]).first()
        expected = {s: float(r[f"s{j}"] or 0) for s, j in at.items()}
    steps: dict[str, dict[str, float]] = {}
    goal: dict[str, dict[str, float]] = {}
    size: dict[str, dict[str, float]] = {}
    for mix, want in mixes.items():
        have = {s: known.get(s, 0) + expected.get(s, 0.0) for s in want}
        live = {s: w for s, (w, most) in want.items() if have[s] > 0 and most > 0}
        total = min((want[s][1] * known.get(s, 0) * sum(live.values()) / w for s, w in live.items() if known.get(s, 0) > 0), default=0.0)
        goal[mix] = {s: total * w / sum(live.values()) for s, w in live.items()}
        size[mix] = have
        steps[mix] = {s: goal[mix][s] / have[s] for s in live}
    if soft is None:
        return steps
    pace, least, best = dict.fromkeys(steps, 1.0), dict.fromkeys(steps, float("inf")), {mix: dict(step) for mix, step in steps.items()}
    open_mixes = [mix for mix, step in steps.items() if any(s in at for s in step)]
    for _ in range(MAX_ROUNDS):
        if not open_mixes:
            return best
        sums = []
        for mix in open_mixes:
            i, step = list(steps).index(mix), steps[mix]
            rate = _soft_rate(step, {s: mixes[mix][s][1] for s in step}, names)
            sums += [F.sum(F.col("n_tokens") * rate * F.element_at("post", at[s])).alias(f"m{i}_{at[s]}") for s in step if s in at]
        r = soft.agg(*sums).first()
        for mix in list(open_mixes):
            i, step, whole = list(steps).index(mix), steps[mix], max(1.0, sum(goal[mix].values()))
            got = {s: min(step[s], mixes[mix][s][1]) * known.get(s, 0) + float((r[f"m{i}_{at[s]}"] or 0.0) if s in at else 0.0) for s in step}
            miss = {s: goal[mix][s] - got[s] for s in step}
            error = sum((m / whole) ** 2 for m in miss.values())
            if error > least[mix]:  # too long a step: back to the best rates and on with half the pace
                pace[mix] /= 2
                steps[mix] = dict(best[mix])
            elif error >= (1 - SETTLED) * least[mix] or max(map(abs, miss.values()), default=0.0) < SETTLED * whole:
                best[mix], least[mix] = dict(step), error
                open_mixes.remove(mix)
                continue
            else:
                least[mix], best[mix] = error, dict(step)
                steps[mix] = {s: min(max(0.0, step[s] + pace[mix] * miss[s] / max(1.0, size[mix][s])), float(mixes[mix][s][1])) for s in step}
            if pace[mix] < 1e-6:
                open_mixes.remove(mix)  # no step falls any more: the projected optimum
    raise RuntimeError("the rates did not settle")


def _prepared(documents: DataFrame, cut: Cut, folder: str) -> tuple[DataFrame, DataFrame | None, list[str]]:
    docs = documents.filter("doc_id is not null").select("doc_id", "text", plain_source(F.col("source")).alias("src"))
    model = train_sources(docs)
    sized = spread(docs).withColumn("n_tokens", token_count(F.col("text"), folder)).filter("n_tokens > 0")
    known = cut.table(sized.filter("src is not null").groupBy("doc_id").agg(F.max(F.struct("n_tokens", "src")).alias("r")).select("doc_id", "r.*"))
    if model is None:
        return known, None, []
    soft = soft_members(sized, model).groupBy("doc_id").agg(F.max(F.struct("n_tokens", "post")).alias("r")).select("doc_id", "r.*")
    return known, cut.table(soft.join(known.select("doc_id"), "doc_id", "left_anti")), model.names


def rated(documents: DataFrame, targets: DataFrame, cut: Cut, folder: str = FOLDER) -> tuple[DataFrame, dict, dict[str, int]]:
    """(mix_id, doc_id, source, n_tokens, rate, u, unstated), the mixes, and token sums of known sources in any mix."""
    spark = documents.sparkSession
    mixes = read_targets(targets)
    known, soft, names = _prepared(documents, cut, folder)
    wanted = sorted({s for want in mixes.values() for s in want})
    sums = {r["src"]: r["t"] for r in known.filter(F.col("src").isin(wanted)).groupBy("src").agg(F.sum("n_tokens").alias("t")).collect()} if wanted else {}
    steps = fit_rates(mixes, sums, soft, names)
    flat = [(mix, s, min(v, float(mixes[mix][s][1]))) for mix, step in steps.items() for s, v in step.items()]
    rates = F.broadcast(spark.createDataFrame(flat, "mix_id string, src string, rate double"))  # a row per mix and source
    u = (F.pmod(F.xxhash64("mix_id", "doc_id"), F.lit(1 << 30)) / float(1 << 30)).alias("u")
    rows = known.join(rates, "src").select("mix_id", "doc_id", F.col("src").alias("source"), "n_tokens", "rate", u, F.lit(False).alias("unstated"))
    if soft is not None:
        likely = F.element_at(F.array(*[F.lit(s) for s in names]), F.array_position("post", F.array_max("post")).cast("int"))
        for mix, step in steps.items():
            most = {s: mixes[mix][s][1] for s in step}
            part = soft.select(F.lit(mix).alias("mix_id"), "doc_id", likely.alias("source"), "n_tokens", _soft_rate(step, most, names).alias("rate"))
            rows = rows.unionByName(part.filter(F.col("source").isin(list(step))).select("*", u, F.lit(True).alias("unstated")))
    return rows, mixes, sums


def _filling(buckets: list[tuple[int, float]], goal: float) -> list[int]:
    """Buckets, taken in order where they still fit, whose tokens come closest to the goal; the last gap takes one more if that is closer."""
    run, taken, rest = 0.0, [], []
    for b, t in sorted(buckets):
        if run + t <= goal:
            run += t
            taken.append(b)
        else:
            rest.append((abs(run + t - goal), b, t))
    best = min(((abs(run + t - goal), b) for _, b, t in rest), default=(float("inf"), -1))
    return taken + [best[1]] if best[0] < goal - run else taken


def draw(documents: DataFrame, targets: DataFrame, cut: Cut, folder: str = FOLDER) -> DataFrame:
    """mix_id, doc_id, source, copies, n_tokens (of one copy) and unstated of every document drawn at least once."""
    rows, _, _ = rated(documents, targets, cut, folder)
    whole, frac = F.floor("rate"), F.col("rate") - F.floor("rate")
    bucket = F.floor(F.col("u") * BUCKETS).cast("int")
    parts = rows.withColumn("bucket", bucket)
    got = parts.groupBy("mix_id", "source", "bucket").agg(F.sum(frac * F.col("n_tokens")).alias("goal"), F.sum("n_tokens").alias("t")).collect()
    by: dict[tuple[str, str], list] = {}
    for r in got:  # at most BUCKETS rows a mix and source
        by.setdefault((r["mix_id"], r["source"]), []).append(r)
    marks = [(mix, s, b) for (mix, s), rs in by.items() for b in _filling([(r["bucket"], r["t"]) for r in rs], sum(r["goal"] for r in rs))]
    extra = F.broadcast(documents.sparkSession.createDataFrame(marks, "mix_id string, source string, bucket int").withColumn("extra", F.lit(1)))
    copies = (whole + F.when(frac > 0, F.coalesce("extra", F.lit(0))).otherwise(0)).cast("int")
    return parts.join(extra, ["mix_id", "source", "bucket"], "left").withColumn("copies", copies).filter("copies > 0").select("mix_id", "doc_id", "source", "copies", "n_tokens", "unstated")


def share_report(drawn: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Shares wanted and reached: mix_id, source, target_share, max_repeat, drawn_tokens, documents, actual_share, most_copies."""
    want = targets.filter("mix_id is not null and target_share > 0").select("mix_id", plain_source(F.col("source")).alias("source"), "target_share", "max_repeat")
    got = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("drawn_tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    total = got.groupBy("mix_id").agg(F.sum("drawn_tokens").alias("all_tokens"))
    both = want.join(got, ["mix_id", "source"], "left").join(total, "mix_id", "left").fillna(0, ["drawn_tokens", "documents", "most_copies"])
    return both.select("mix_id", "source", "target_share", "max_repeat", "drawn_tokens", "documents", "most_copies", F.round(F.coalesce(F.col("drawn_tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"))
