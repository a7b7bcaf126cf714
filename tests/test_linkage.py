import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordspark.functions.text import fold, initcap_alnum, jaro_winkler_one, parsed_first_name, parsed_last_name, person_id, phone10, SHORT_FORMS, spell_plain
from recordspark.operators import clusters as C
from recordspark.operators import evaluation as E
from recordspark.operators import scored_linkage as S
from recordspark.plans import linkage_queries as Q
from recordspark.runtime import Cut

RECORD = "rec_id long, source_system string, source_record_id string, first_name string, last_name string, email string, phone string, city string, state string, zip string, dob date, birth_year int, observed_at timestamp, root string, anchor string"


def record(i, first="Ann", last="Bee", email=None, phone=None, **more):
    return dict.fromkeys([f.split()[0] for f in RECORD.split(", ")]) | {"rec_id": i, "source_system": "crm", "source_record_id": f"{i:03d}", "first_name": first, "last_name": last, "email": email, "phone": phone} | more


def test_text_functions(spark):
    rows = [("o'BRIEN mary-jane garcía", "Weiß Ærø", "SMITH, anna maria", "+1 (012) 345-6789"), (None, "", "Zoë M. de Vo", "n/a")]
    r = spark.createDataFrame(rows, "a string, b string, c string, d string").select(initcap_alnum(F.col("a")), fold(F.col("b")), spell_plain(F.col("b")), parsed_first_name(F.col("c")), parsed_last_name(F.col("c")), phone10(F.col("d"))).collect()
    assert tuple(r[0]) == ("O'Brien Mary-Jane García", "wei r", "weiss aero", "Anna Maria", "Smith", "0123456789")
    assert tuple(r[1]) == (None, None, None, "Zoë", "Vo", None)
    assert SHORT_FORMS["bill"] == "william" and not set(SHORT_FORMS) & set(SHORT_FORMS.values())
    assert jaro_winkler_one("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and jaro_winkler_one("", "a") == 0 and jaro_winkler_one(None, "a") is None


def test_transitive_clusters_and_stable_roots(spark, cut):
    rows = [record(1, email="a@b.c", phone="0123456789"), record(2, last="Cee", email=" A@b.c "), record(3, phone="(012) 345 6789"), record(4, last="Dee", phone="0123456789"), record(5, email=""), record(6, first=None, last=None)]
    rows += [record(7, email="x@y.z"), record(8, email="x@y.z", last="B"), record(8, email="x@y.z", last="B")]
    for order in (rows, rows[::-1]):
        people = C.identity_input(spark.createDataFrame(order, RECORD))
        got = {r.ref: r.root for r in C.exact_clusters(people.dropDuplicates(["ref"]), Cut(spark, "t")).collect()}
        assert got == {"crm:001": "crm:001", "crm:002": "crm:001", "crm:003": "crm:001", "crm:004": "crm:004", "crm:005": "crm:005", "crm:006": "crm:006", "crm:007": "crm:007", "crm:008": "crm:007"}


def test_long_chain(spark, cut):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(f"v{a:04d}", f"v{b:04d}") for a, b in zip(order, order[1:])], "anchor string, ref string")
    v = spark.createDataFrame([(f"v{i:04d}",) for i in range(n + 1)], "ref string")
    got = {r.ref: r.root for r in C.components(v, edges, cut).collect()}
    assert set(got.values()) == {"v0000", f"v{n:04d}"} and len(got) == n + 1


def test_golden_ties(spark, cut):
    import datetime as dt

    t = lambda d: dt.datetime(2025, 1, d)
    rows = [record(1, "ann", "Bee", "old@b.c", observed_at=t(1), city="X"), record(2, "Ánn", "Bee", "new@b.c", observed_at=t(2), city="Y", dob=dt.date(1990, 1, 1)), record(3, "Bea", "Bee", "new2@b.c", observed_at=t(2), city=" "), record(4, "Bea", "Bee", None, observed_at=t(9))]
    people = C.identity_input(spark.createDataFrame(rows, RECORD))
    g = C.golden_records(people, people.select("ref", F.lit("crm:001").alias("root"))).first()
    assert (g.first_name, g.email, g.city, g.record_count, g.sources, str(g.dob)) == ("Bea", "new@b.c", "Y", 4, "crm", "1990-01-01")
    assert g.fan_id == spark.range(1).select(person_id(F.lit("crm:001"))).first()[0]


def test_pair_counts_as_by_listing(spark):
    rng = random.Random(3)
    rows = [(f"r{i}", f"c{rng.randrange(25)}", f"e{rng.randrange(25)}", [t for t in ("a", "b") if rng.random() < 0.3]) for i in range(120)]
    known = spark.createDataFrame(rows, "ref string, cluster string, entity string, tags array<string>")
    pred = {(i, j) for i in range(120) for j in range(i) if rows[i][1] == rows[j][1]}
    true = {(i, j) for i in range(120) for j in range(i) if rows[i][2] == rows[j][2]}
    m = E.pair_metrics(known).first()
    assert (m.tp, m.fp, m.fn) == (len(pred & true), len(pred - true), len(true - pred))
    for r in E.tag_breakdown(known).collect():
        t = {(i, j) for i, j in pred | true if r.tag in rows[i][3] or r.tag in rows[j][3]}
        assert (r.true_pairs, r.fp_pairs) == (len(t & true), len(t & (pred - true))) and r.pair_recall == pytest.approx(len(t & pred & true) / len(t & true), abs=1e-4)
    none = E.pair_metrics(known.limit(0)).first()
    assert (none.precision, none.recall) == (1.0, 1.0)


def test_em_likelihood_rises_and_recovers():
    rng, n = np.random.default_rng(4), 40_000
    u = {g: np.array([0.9] + [0.1 / (k - 1)] * (k - 1)) for g, k in S.LEVELS.items()}
    m = {g: np.array([0.1] + [0.9 / (k - 1)] * (k - 1)) for g, k in S.LEVELS.items()}
    match = rng.random(n) < 0.2
    cols = [np.where(match, rng.choice(k, n, p=m[g]), rng.choice(k, n, p=u[g])) + 1 for g, k in S.LEVELS.items()]
    patterns, counts = np.unique(np.stack(cols, 1), axis=0, return_counts=True)
    got, trace = S.em_session(patterns, counts.astype(float), u, [], rounds=60)
    assert all(b >= a - 1e-6 for a, b in zip(trace, trace[1:]))
    assert all(np.abs(got[g] - m[g]).max() < 0.05 for g in S.LEVELS)


def test_modes_and_methods(spark, cut, small):
    people = C.identity_input(spark.read.parquet(f"{small}/identity_records.parquet"))
    det = S.linkage(people, cut, "deterministic")
    full = S.linkage(people, Cut(spark, "t"), "full")
    assert det.count() == full.count() == people.count()
    assert full.select("root").distinct().count() <= det.select("root").distinct().count()
    assert {r.method for r in full.select("method").distinct().collect()} <= {"deterministic", "probabilistic", "singleton"}
    assert full.filter("(score is not null) <> (method = 'probabilistic')").count() == 0
    with pytest.raises(ValueError):
        S.linkage(people, cut, "other")


@pytest.fixture
def bridged(spark, tmp_path):
    """Two known records of one fan that only an unresolved third record ties together."""
    rows = [record(1, email="a@b.example"), record(2, email="a@b.example", phone="2125550100"), record(3, phone="2125550100")]
    spark.createDataFrame([tuple(r.values()) for r in rows], RECORD).write.parquet(f"{tmp_path}/identity_records.parquet")
    spark.createDataFrame([("crm", "001", "F1"), ("crm", "003", "F1")], "source_system string, source_record_id string, fan_id string").write.parquet(f"{tmp_path}/fan_xref.parquet")
    return str(tmp_path)


def test_links_through_unknown_records_count(spark, bridged):
    r = Q.pair_metrics_all(spark, bridged).first()
    assert (r.tp, r.fp, r.fn) == (1, 0, 0) and Q.pair_metrics(spark, bridged).first().tp == 0


def test_sweep_measures_clusters(spark, bridged, monkeypatch):
    scored = spark.createDataFrame([("crm:001", "crm:003", 0.97)], "ref_l string, ref_r string, probability double")
    monkeypatch.setattr(S, "scored_pairs", lambda ready, cut: scored)
    monkeypatch.setattr(C, "exact_edges", lambda people: people.select(F.col("ref").alias("anchor"), "ref").limit(0))
    got = {r.threshold: (r.tp, r.fn, r.merged_edges) for r in Q.threshold_sweep_all(spark, bridged).collect()}
    assert got == {0.9: (1, 0, 1), 0.95: (1, 0, 1), 0.99: (0, 1, 0), 0.999: (0, 1, 0), 0.9999: (0, 1, 0)}
