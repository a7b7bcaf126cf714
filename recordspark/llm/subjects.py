"""Subject areas of documents.

Method: one-versus-rest linear classifiers on hashed word n-grams. The labels are weak: they say of a whole document
which subjects it has, and only part of its sentences are about them. So sentences are the examples; which of a
document's subjects a sentence speaks of is found by expectation-maximisation over the labelled documents, the
classifiers are fitted to that, and the margin of each subject, from which a sentence counts as about it, is calibrated
on held-out labelled documents; a sentence may be about several subjects. A document has the subjects that at least SHARE of its subject sentences are about.

The fit uses at most MAX_LABELLED documents with labels (those with the least hash); scoring covers whole texts of
all documents in Arrow batches, with the weight matrix, of fixed size, as a broadcast.

Defined results: null, empty and blank texts, and rows without a doc_id, have no subject; repeated texts get equal subjects; very long texts are
read whole; labels with null or unknown values are left out; without labels the result is empty; extra columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspark.runtime import spread

BITS = 16
SHARE = 0.25
MAX_LABELLED, MAX_SUBJECTS = 8000, 1000
EM_ROUNDS = 6
FIT_STEPS = 40
MARGINS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)

_TAG = re.compile(r"<[^<>]*>|&[a-z]+;|[*_#`>]+")
_END = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+|[\r\n]+|[☀-➿\U0001f300-\U0001faff]+")
_WRAP = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")  # a word divided at the end of a line
_MIXED = re.compile(r"(?<=[^\W\d_])[01](?=[^\W_]|\b)|(?<!\w)[01](?=[^\W\d_]{2})")  # a digit read for a letter
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence, in lower case; pieces without words are dropped."""
    if not text:
        return []
    plain = _MIXED.sub(lambda m: "l" if m[0] == "1" else "o", _WRAP.sub("", _TAG.sub(" ", text)))
    out = (_WORD.findall(s.lower()) for s in _END.split(plain))
    return [w for w in out if w]


class Hasher:
    """Buckets of words and of pairs of neighbouring words; the cache of word buckets is bounded."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, sents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of all sentences, first position of each sentence)."""
        if len(self.seen) > 500_000:
            self.seen.clear()
        seen, ids, starts = self.seen, [], []
        size = 0
        for words in sents:
            starts.append(size)
            one = []
            for w in words:
                h = seen.get(w)
                if h is None:
                    h = seen[w] = zlib.crc32(w.encode("utf-8", "replace")) & 0xFFFFFFFF
                one.append(h)
            a = np.array(one, dtype=np.uint64)
            pairs = (a[:-1] * np.uint64(0x9E3779B1) + a[1:] * np.uint64(0x85EBCA77) + np.uint64(1)) >> np.uint64(7)
            both = np.concatenate([a, pairs]) & np.uint64((1 << BITS) - 1)
            ids.append(both.astype(np.int64))
            size += len(both)
        return (np.concatenate(ids) if ids else np.zeros(0, np.int64)), np.array(starts, dtype=np.int64)


class SubjectModel:
    """Weights (buckets x subjects), intercepts, the names of the subjects and a margin for each."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: np.ndarray, margin: float | np.ndarray) -> None:
        self.names, self.weights, self.bias = names, weights.astype(np.float32), bias.astype(np.float32)
        self.margin = np.broadcast_to(np.asarray(margin, dtype=float), (len(names),)).copy()

    def probabilities(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros((0, len(self.names)))
        n = np.diff(np.append(starts, len(ids)))
        z = np.add.reduceat(self.weights[ids], starts, axis=0) / np.sqrt(n)[:, None] + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def about(self, p: np.ndarray) -> np.ndarray:
        """sentences x subjects: whether the sentence is about the subject; it may be about several."""
        return p >= self.margin

    def subjects(self, about: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """docs x subjects: whether at least SHARE of the document's subject sentences are about the subject."""
        row, label = np.nonzero(about)
        n = np.bincount(doc[row] * len(self.names) + label, minlength=docs * len(self.names)).reshape(docs, len(self.names))
        total = np.bincount(doc[about.any(axis=1)], minlength=docs)
        return (n > 0) & (n >= SHARE * total[:, None] - 1e-9)


def _fit(ids: np.ndarray, row: np.ndarray, rows: int, resp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ridge logistic regressions, one a subject, by accelerated gradient steps on all sentences."""
    k, width = resp.shape[1], 1 << BITS
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=rows)))
    weights, bias = np.zeros((width, k)), np.zeros(k)
    seen = np.maximum(1.0, np.bincount(ids, minlength=width))
    step = 4.0 / np.sqrt(seen)
    val = scale[row]
    for j in range(k):
        w, b, look = np.zeros(width), -2.0, np.zeros(width)
        y = resp[:, j]
        for t in range(FIT_STEPS):
            z = np.bincount(row, weights=look[ids] * val, minlength=rows) + b
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            grad = np.bincount(ids, weights=err[row] * val, minlength=width) + 0.02 * look
            new = look - step * grad / np.sqrt(seen)
            look = new + t / (t + 3) * (new - w)
            w = new
            b -= 1.0 * err.mean()
        weights[:, j], bias[j] = w, b
    return weights, bias


def fit_subjects(texts: list[str], labels: list[set[str]], names: list[str], seeds: list[tuple[str, str]], margin: float | np.ndarray | None = None) -> SubjectModel:
    """Fits on documents with label sets (empty: no subject). With no margin given they are calibrated on every fifth document."""
    if margin is None:
        held = [i for i in range(len(texts)) if i % 5 == 0]
        if len(texts) >= 50:
            rest = [i for i in range(len(texts)) if i % 5]
            trial = fit_subjects([texts[i] for i in rest], [labels[i] for i in rest], names, seeds, 0.5)
            margin = best_margins(trial, [texts[i] for i in held], [labels[i] for i in held])
        else:
            margin = 0.4
    place = {s: j for j, s in enumerate(names)}
    sents, doc = [], []
    for i, t in enumerate(texts):
        own = sentences(t)
        sents += own
        doc += [i] * len(own)
    given = np.zeros((len(texts), len(names) + 1))
    for i, s in enumerate(labels):
        for x in s:
            given[i, place[x]] = 1
    given[:, -1] = 0.4  # no subject
    others = np.where(given[:, :-1].any(axis=1), 0.04, 0.01)  # a label may be wrong or the subject too rare in the document to be named
    given[:, :-1] = np.maximum(given[:, :-1], others[:, None])
    prior = given[np.array(doc, dtype=int)] if doc else np.zeros((0, len(names) + 1))
    for s, text in seeds:
        own = sentences(text)
        sents += own
        one = np.full((len(own), len(names) + 1), 0.001)
        one[:, place[s]] = 1
        prior = np.vstack([prior, one])
    ids, starts = Hasher()(sents)
    rows, width = len(sents), 1 << BITS
    if not rows:
        return SubjectModel(names, np.zeros((width, len(names))), np.full(len(names), -9.0), 0.5)
    row = np.repeat(np.arange(rows), np.diff(np.append(starts, len(ids))))
    common = np.bincount(ids, minlength=width)
    keep = common[ids] > 1
    ids, row = ids[keep], row[keep]
    resp = prior / prior.sum(axis=1, keepdims=True)
    for _ in range(EM_ROUNDS):
        logs = np.zeros((rows, resp.shape[1]))
        for j in range(resp.shape[1]):
            n = np.bincount(ids, weights=resp[row, j], minlength=width)
            logs[:, j] = np.bincount(row, weights=np.log((n + 0.05) / (n.sum() + 0.05 * width))[ids], minlength=rows)
        n_row = np.maximum(1, np.bincount(row, minlength=rows))
        logs = logs / np.sqrt(n_row)[:, None] + np.log(prior)  # tempered: neighbouring words are far from independent
        logs -= logs.max(axis=1, keepdims=True)
        resp = np.exp(logs)
        resp /= resp.sum(axis=1, keepdims=True)
    weights, bias = _fit(ids, row, rows, resp[:, :-1])
    return SubjectModel(names, weights, bias, margin)


def document_subjects(model: SubjectModel, texts: list[str | None], hasher: Hasher) -> np.ndarray:
    sents, doc = [], []
    for i, t in enumerate(texts):
        own = sentences(t)
        sents += own
        doc += [i] * len(own)
    p = model.probabilities(*hasher(sents))
    return model.subjects(model.about(p), np.array(doc, dtype=int), len(texts))


def best_margins(model: SubjectModel, texts: list[str], labels: list[set[str]]) -> np.ndarray:
    """A margin per subject: the common one with the best F1 of document subjects on these documents, then for each subject
    in turn another one where that mends at least two decisions."""
    want = np.array([[s in own for s in model.names] for own in labels]).reshape(len(labels), len(model.names))
    sents = [sentences(t) for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(x) for x in sents])
    p = model.probabilities(*Hasher()([s for own in sents for s in own]))

    def wrong(margin: np.ndarray) -> tuple[float, int]:
        model.margin = margin
        got = model.subjects(model.about(p), doc, len(texts))
        return 2 * (got & want).sum() / max(1, got.sum() + want.sum()), int((got != want).sum())

    margin = max((np.full(len(model.names), m) for m in MARGINS), key=lambda m: (wrong(m)[0], m[0]))
    for j in range(len(model.names)):
        errors = wrong(margin)[1]
        for m in MARGINS:
            other = margin.copy()
            other[j] = m
            if wrong(other)[1] <= errors - 2:
                errors, margin = wrong(other)[1], other
    return margin


def train(documents: DataFrame, labels: DataFrame, subjects: DataFrame, most: int = MAX_LABELLED) -> SubjectModel:
    """A model from at most `most` labelled documents, in order of a hash of their id."""
    known = subjects.filter("subject is not null").select("subject", F.concat_ws(". ", "title", "description").alias("about")).limit(MAX_SUBJECTS + 1).collect()
    if len(known) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    names = sorted({r["subject"] for r in known})
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("subject").isin([*names, "none"]))
    by_doc = usable.groupBy("doc_id").agg(F.collect_set("subject").alias("own"))
    rows = documents.select("doc_id", "text").join(by_doc, "doc_id").filter("text is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    return fit_subjects([r["text"] for r in rows], [set(r["own"]) - {"none"} for r in rows], names, [(r["subject"], r["about"]) for r in known])


def subjects_of(documents: DataFrame, model: SubjectModel) -> DataFrame:
    """doc_id and subject, a row for every subject of every document."""
    shared = documents.sparkSession.sparkContext.broadcast((model.names, model.weights, model.bias, model.margin))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, hasher = SubjectModel(*shared.value), Hasher()
        for pdf in batches:
            d, s = np.nonzero(document_subjects(m, pdf["text"].tolist(), hasher))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[d], "subject": np.array(m.names, dtype=object)[s]})

    return documents.select("doc_id", "text").filter("doc_id is not null and text is not null").mapInPandas(score, f"doc_id {kind}, subject string")


def found_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    return subjects_of(spread(documents), train(documents, labels, subjects))
