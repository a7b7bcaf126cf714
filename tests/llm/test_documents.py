import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordspark.llm import mixing, packing, subjects
from recordspark.llm.tokens import encoder
from recordspark.runtime import Cut, table

DOC = "doc_id long, text string, lang string, source string, n_chars long, match_id string, size long, rate double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, None, 1, 1.0) for i, t, s in rows], DOC)


def decreasing(items, cap):
    rooms = []
    for s in sorted(items, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= s]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= s
        else:
            rooms.append(cap - s)
    return len(rooms)


def test_best_fit_needs_hardly_more_than_the_sequential_one(spark, cut):
    """Twenty limits at once, each with its own items."""
    rows, caps, least = [], {}, {}
    for seed in range(20):
        rng = np.random.default_rng(seed)
        caps[seed] = int(rng.integers(3, 60))
        items = rng.integers(1, caps[seed] + 1, int(rng.integers(1, 150)))
        rows += [(seed, i, 0, 0, int(x)) for i, x in enumerate(items)]
        least[seed] = decreasing(items, caps[seed])
    got = packing.best_fit(spark.createDataFrame(rows, "limit_id int, doc_id long, piece int, start long, size long"), caps, cut).collect()
    assert sorted((r.limit_id, r.doc_id, r.size) for r in got) == sorted((a, b, e) for a, b, _, _, e in rows)
    load, used = {}, dict.fromkeys(caps, 0)
    for r in got:
        used[r.limit_id] += (r.limit_id, r.gap_id) not in load
        load[r.limit_id, r.gap_id] = load.get((r.limit_id, r.gap_id), 0) + r.size
    assert all(n <= caps[i] for (i, _), n in load.items())
    assert sum(used.values()) <= 1.01 * sum(least.values()) and all(used[i] <= least[i] + 1 for i in caps)


def test_a_sweep_gives_the_tightest_gap_to_the_largest_item(spark):
    items = spark.createDataFrame([(1, i, 0, 0, s) for i, s in enumerate([5, 5, 4, 3, 9])], "limit_id int, doc_id long, piece int, start long, size long")
    gaps = spark.createDataFrame([(1, 10, 5), (1, 11, 7), (1, 12, 4), (1, 13, 8)], "limit_id int, gap_id long, room long")
    got = packing.sweep(items, gaps, {1: 2}, {1: 9}).collect()
    assert sorted((r["size"], r.gap_id) for r in got if r["size"] != 5) == [(3, 13), (4, 12), (9, None)] and {r.gap_id for r in got if r["size"] == 5} == {10, 11}


def test_a_million_documents_send_only_counts_to_the_driver(spark, cut, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    most, plain = [0], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: (lambda rows: (most.append(len(rows)), rows)[1])(plain(self)))
    # a third of all documents have one size
    size = F.when(F.col("id") % 3 == 0, 37).otherwise(F.greatest(F.lit(1), F.least(F.lit(511), F.exp(F.lit(3.2) + 1.1 * F.randn(7)).cast("long"))))
    items = cut.table(spark.range(1_000_000).select(F.lit(1).alias("limit_id"), F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), size.cast("long").alias("size")))
    placed = packing.best_fit(items, {1: 512}, cut)
    load = placed.groupBy("gap_id").agg(F.sum("size").alias("t"), F.count("*").alias("n")).agg(F.max("t"), F.sum("t"), F.count("*"), F.sum("n")).first()
    assert load[0] <= 512 and load[3] == 1_000_000 and load[1] > 0.999 * 512 * load[2]
    assert max(most) <= 20


def test_a_sweep_is_one_query(spark, cut, monkeypatch):
    """What the driver holds of plans, classes and threads grows with the queries."""
    plain, sweeps = packing.sweep, []
    monkeypatch.setattr(packing, "sweep", lambda *a: (sweeps.append(1), plain(*a))[1])
    rows = [(1, k, 0, 0, int(x)) for k, x in enumerate(np.random.default_rng(5).integers(1, 20, 300))]
    got = packing.best_fit(spark.createDataFrame(rows, "limit_id int, doc_id long, piece int, start long, size long"), {1: 20}, cut).collect()
    load = {}
    for r in got:
        load[r.gap_id] = load.get(r.gap_id, 0) + r.size
    assert sorted((r.doc_id, r.size) for r in got) == [(k, x) for _, k, _, _, x in rows] and max(load.values()) <= 20
    assert cut.n <= len(sweeps) * 7 / 6 + 2


def test_a_sweep_opens_containers_where_it_is_complete(spark):
    items = spark.createDataFrame([(i, k, 0, 0, s) for i in (1, 2) for k, s in enumerate([5, 5, 4, 3, 3])], "limit_id int, doc_id long, piece int, start long, size long")
    gaps = spark.createDataFrame([(1, 10, 2), (2, 11, 5)], "limit_id int, gap_id long, room long")
    got = packing.sweep(items, gaps, {1: 1, 2: 1}, {1: 5, 2: 5}, {1: 2, 2: 2}, {1: 20, 2: 30}).collect()
    by = {i: sorted(((r["size"], r.gap_id) for r in got if r.limit_id == i), key=str) for i in (1, 2)}
    assert by[1] == [(3, 21), (3, 22), (4, 21), (5, 20), (5, 20)]  # no gap takes any
    assert [g for _, g in by[2] if g is not None] == [11] and len(by[2]) == 5  # one was taken: another sweep is to come


def test_packing_is_whole(spark, cut):
    long = " ".join(f"word{i}" for i in range(3000))
    d = docs(spark, [(1, long, None), (2, "", None), (3, None, None), (4, "a short one", None), (4, "a short one", None), (5, "a short one", None)])
    limits = spark.createDataFrame([(1, 128), (2, 100_000), (3, None), (4, 0)], "limit_id int, capacity_tokens int")
    p = packing.pack(d, limits, cut).collect()
    enc = encoder()
    for limit, cap in ((1, 128), (2, 100_000)):
        own = [r for r in p if r.limit_id == limit]
        want = {1: len(enc.encode_ordinary(long)), 2: 0, 3: 0, 4: 3, 5: 3}
        for k, n in want.items():
            parts = sorted((r.start_token, r.n_tokens) for r in own if r.doc_id == k)
            assert sum(n for _, n in parts) == n and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
            assert len(parts) == max(1, -(-n // cap))  # only what is longer than a container is split
        load = {}
        for r in own:
            assert (r.container_id is None) == (r.n_tokens == 0)
            load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        assert max(load.values()) <= cap
    assert {r.limit_id for r in p} == {1, 2}
    assert packing.pack(d.limit(0), limits, Cut(spark, "t")).count() == 0


def test_fill(spark, cut):
    d = "/root/testdata/sf0.01"
    limits = table(spark, d, "pack_limits")
    f = packing.fill_report(packing.pack(table(spark, d, "documents"), limits, cut), limits).collect()
    assert len(f) == 4 and all(r.fullest <= r.capacity_tokens and r.filled > 0.99 for r in f)


def test_shares(spark, cut):
    d = "/root/testdata/sf0.1"
    doc, goal = table(spark, d, "documents"), table(spark, d, "mix_targets")
    drawn = cut.table(mixing.draw(doc, goal, cut))
    r = mixing.share_report(drawn, doc, goal).collect()
    for mix in {x.mix_id for x in r}:
        own = [x for x in r if x.mix_id == mix]
        there = sum(x.target_share for x in own if x.drawn_tokens)
        assert all(abs(x.actual_share - x.target_share / there) < 0.003 for x in own if x.drawn_tokens)
        assert all(x.most_copies <= x.max_repeat for x in own)
    assert [x.source for x in r if not x.drawn_tokens] == ["letters"]


def test_mixing_edges(spark, cut):
    goal = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "B c", 0.5, 2), (None, "a", 0.5, 1), ("n", "zzz", 1.0, 1)], "mix_id string, source string, target_share double, max_repeat int")
    rows = [(i, f"text number {i} about things", " A ") for i in range(200)] + [(1000 + i, "other words here", "b_C") for i in range(50)] + [(2000, "", "a"), (2001, None, "a"), (1, "text number 1 about things", "a")]
    got = mixing.draw(docs(spark, rows), goal, cut).collect()
    by = {s: sum(r.copies * r.n_tokens for r in got if r.source == s) for s in ("a", "b_c")}
    assert {r.mix_id for r in got} == {"m"} and max(r.copies for r in got if r.source == "b_c") == 2 and abs(by["a"] / by["b_c"] - 1) < 0.05
    assert mixing.draw(docs(spark, []), goal, Cut(spark, "t")).count() == 0
    assert mixing.draw(docs(spark, rows), goal.limit(0), Cut(spark, "t")).count() == 0


def test_sentences():
    got = subjects.sentences("<p>One two. Three-\nfour! 1. Five\n\nsix ⚽ seven</p>")
    assert got == [["one", "two"], ["threefour"], ["1"], ["five"], ["six"], ["seven"]]
    assert subjects.sentences(None) == subjects.sentences(" \n ") == []


def test_subjects_held_out(spark):
    d = "/root/testdata/sf0.1"
    rows = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "doc_labels").groupBy("doc_id").agg(F.collect_set("subject").alias("s")), "doc_id").orderBy("doc_id").collect()
    known = table(spark, d, "subjects").collect()
    names = sorted(r.subject for r in known)
    random.Random(1).shuffle(rows)
    cut = len(rows) * 3 // 4
    fit = lambda rs: ([r.text for r in rs], [set(r.s) - {"none"} for r in rs])
    model = subjects.fit_subjects(*fit(rows[:cut]), names, [(r.subject, r.title + ". " + r.description) for r in known])
    texts, labels = fit(rows[cut:])
    got = subjects.document_subjects(model, texts, subjects.Hasher())
    want = np.array([[n in s for n in names] for s in labels])
    assert 2 * (got & want).sum() / (got.sum() + want.sum()) > 0.88  # a few of the labels themselves are wrong


def test_subject_edges(spark):
    d = "/root/testdata/sf0.01"
    labels, known = table(spark, d, "doc_labels"), table(spark, d, "subjects")
    long = "The referee gave the penalty after the goal. " * 5_000
    one = table(spark, d, "documents").join(labels.filter("subject = 'sport'"), "doc_id").first().text
    extra = docs(spark, [(10**9, None, None), (10**9 + 1, "", None), (10**9 + 2, " \n", None), (10**9 + 3, long, None), (10**9 + 4, one, None), (10**9 + 5, one, None)])
    both = table(spark, d, "documents").select("doc_id", "text").unionByName(extra.select("doc_id", "text"))
    got = [(r.doc_id, r.subject) for r in subjects.found_subjects(both, labels, known).filter("doc_id >= 1000000000").collect()]
    assert all(k > 10**9 + 2 for k, _ in got) and {s for k, s in got if k == 10**9 + 4} == {s for k, s in got if k == 10**9 + 5}
    assert subjects.found_subjects(both, labels.limit(0), known).count() >= 0
    assert subjects.found_subjects(both.limit(0), labels, known).count() == 0


def test_null_ids(spark, cut):
    d = docs(spark, [(None, "some words here " * 50, "a"), (None, None, None), (2**60 + 1, "some words", "a")])
    goal = spark.createDataFrame([("m", "a", 1.0, 1)], "mix_id string, source string, target_share double, max_repeat int")
    p = packing.pack(d, spark.createDataFrame([(1, 20)], "limit_id int, capacity_tokens int"), cut).collect()
    assert max(sum(r.n_tokens for r in p if r.container_id == c) for c in {r.container_id for r in p if r.container_id}) <= 20
    assert [r.doc_id for r in mixing.draw(d, goal, Cut(spark, "t")).collect()] == [2**60 + 1]
    model = subjects.fit_subjects(["some words", "other text"] * 5, [{"a"}, {"b"}] * 5, ["a", "b"], [("a", "some words"), ("b", "other text")])
    assert {r.doc_id for r in subjects.subjects_of(d, model).collect()} <= {2**60 + 1}
