import datetime as dt
import random

from pyspark.sql import functions as F

from recordspark.llm import survivorship as V
from recordspark.runtime import Cut, table

RECORD = "rec_id long, source_system string, source_record_id string, first_name string, last_name string, email string, phone string, city string, state string, zip string, dob date, birth_year int, observed_at timestamp, link_state string, value string, head string"
XREF = "source_system string, source_record_id string, fan_id string, method string, score double"


def person(fan, start, rows):
    """rows: (system, month, email, phone, dob)."""
    rec, xref = [], []
    for i, (system, month, email, phone, dob) in enumerate(rows):
        n = start + i
        rec.append((n, system, f"{n}", "Flora", "Molarez", email, phone, None, None, None, dob, None, dt.datetime(2024 + month // 12, month % 12 + 1, 1), "resolved", "clash", "clash"))
        xref.append((system, f"{n}", fan, None, None))
    return rec, xref


def fans(*people):
    rec, xref = [], []
    for fan, start, rows in people:
        a, b = person(fan, start, rows)
        rec, xref = rec + a, xref + b
    return rec, xref


def among(spark, rec, xref):
    """The given records within a population from which the model learns what kinds of claims and systems are worth."""
    d = "/root/testdata/sf0.01"
    r = table(spark, d, "identity_records").unionByName(spark.createDataFrame(rec, RECORD).dropDuplicates(["rec_id"]), allowMissingColumns=True)
    return r, table(spark, d, "fan_xref").unionByName(spark.createDataFrame(xref, XREF))


def test_scenarios(spark, cut):
    d = dt.date
    base = 10**7
    rec, xref = fans(
        ("moved", base + 100, [("crm", 0, "old.molarez@post.example", "0123456789", d(1980, 5, 17)), ("merch", 1, "old.molarez@post.example", None, None), ("ticketing", 5, " NEW.molarez@kite.example", "+1 012-345-6789", None), ("merch", 6, "new.molarez@kite.example", None, None)]),
        ("typo", base + 200, [("crm", 0, "flora.molarez.77@post.example", "0123456788", d(1900, 1, 1)), ("merch", 1, "flora.molarez.77@post.example", None, None), ("ticketing", 2, "flora.mloarez.77@post.example", "n/a", None)]),
        ("family", base + 300, [("crm", 0, "molarez.f-1@post.example", None, d(1981, 2, 3)), ("ticketing", 4, "molarez.family.9@post.example", "01234", None)]),
        ("shape", base + 400, [("email", 0, "fmolarez at post.example", None, None), ("ticketing", 4, "fmolarez@post", "555", None)]),
        ("single", base + 500, [("crm", 0, "alone@post.example", "0123456787", d(1982, 2, 3))]),
        ("blank", base + 600, [("crm", 0, "", None, None), ("crm", 1, None, " ", None)]),
    )
    r, x = among(spark, rec + rec[:1], xref + xref[:2])
    got = {(g.fan_id, g.field_name): g.rec_id - base for g in V.golden_values(r, x, cut).filter(f"rec_id >= {base}").collect()}
    assert got == {("moved", "email"): 102, ("moved", "phone"): 100, ("moved", "dob"): 100, ("typo", "email"): 200, ("typo", "phone"): 200, ("family", "email"): 300, ("family", "dob"): 300}
    kept = {t.value for t in V.true_values(r, x, Cut(spark, "t")).filter("fan_id = 'moved' and field_name = 'email'").collect()}
    assert kept == {"old.molarez@post.example", "new.molarez@kite.example"}  # a field keeps every value judged true


def often_wrong(n=240):
    """Fans whose address every system gives, but the shop a made-up one in two records of five, the last ones among them."""
    rng, people = random.Random(4), []
    for i in range(n):
        own = f"{'abcdefghij'[i % 10] * 3}{i:05d}q@post.example"
        made_up = lambda: f"{rng.randrange(10**9):09d}{rng.choice('xyz')}@kite.example"
        shop = lambda: made_up() if rng.random() < 0.4 else own
        rows = [("crm", 0, own, None, None), ("merch", 2, shop(), None, None), ("ticketing", 4, own, None, None), ("merch", 6, shop(), None, None), ("crm", 8, own, None, None), ("merch", 10, made_up() if i % 3 == 0 else own, None, None)]
        people.append((f"fan{i}", 1000 * (i + 1), rows))
    return fans(*people)


def test_a_system_that_is_often_wrong_loses_by_the_model_alone(spark, cut, monkeypatch):
    rec, xref = often_wrong()
    r, x = spark.createDataFrame(rec, RECORD), spark.createDataFrame(xref, XREF)
    right = lambda c: sum(g.rec_id == 1000 * (int(g.fan_id[3:]) + 1) for g in V.golden_values(r, x, c).filter("field_name = 'email'").collect())
    assert right(cut) == 240
    monkeypatch.setattr(V.Quality, "posterior", lambda self, single=None: F.lit(0.999) + 0 * F.col("p_crm"))
    assert right(Cut(spark, "t")) < 200  # without the model the last ones win


def test_quality_is_two_sided(spark, cut):
    rec, xref = often_wrong()
    r, x = spark.createDataFrame(rec, RECORD), spark.createDataFrame(xref, XREF)
    q = V.fit_quality(cut.table(V.observed_claims(V.claims(r, x, cut), V.plain_names(V.members(r, x)), cut)), cut)
    assert q.sens["email", "crm"] > 0.9 > q.sens["email", "merch"]
    share = {by: [t for (f, k, s), t in q.true.items() if f == "email" and s == by] for by in ("crm", "merch")}
    assert min(share["crm"]) > 0.9 and max(share["merch"]) < 0.3


def test_golden_fans_and_empty(spark, cut, small):
    r, x = table(spark, small, "identity_records"), table(spark, small, "fan_xref")
    g = V.golden_fans(r, x, cut)
    assert g.select("fan_id").distinct().count() == g.count() and g.filter("record_count < 2").count() == 0
    assert V.golden_values(r.limit(0), x, Cut(spark, "t")).count() == 0 and V.golden_values(r, x.limit(0), Cut(spark, "t")).count() == 0
