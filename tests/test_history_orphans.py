import datetime as dt
import random

from pyspark.sql import functions as F

from recordspark.operators import attribute_history as H
from recordspark.operators import orphans as O

SNAP = "snapshot_date date, fan_key long, fan_id string, first_name string, last_name string, email string, phone string, city string, state string, zip string, dob date, sources string, record_count int, is_current boolean, loaded_at timestamp, attribute string, day string"


def plain(r):
    t = lambda x: " ".join((x or "").lower().split()) or None
    digits = "".join(c for c in r["phone"] or "" if c.isdigit())[-10:] or None
    return (*(t(r[k]) for k in ("first_name", "last_name", "email", "city", "state")), digits, (r["zip"] or "").strip()[:5] or None, r["dob"])


def brute(rows):
    days = sorted({r["snapshot_date"] for r in rows if r["snapshot_date"]})
    fans = {r["fan_id"] for r in rows if r["fan_id"]}
    out = set()
    for f in fans:
        run = None
        for i, d in enumerate([*days, None]):
            own = [r for r in rows if r["fan_id"] == f and r["snapshot_date"] == d and d]
            top = max(own, key=lambda r: r["loaded_at"], default=None)
            v = plain(top) if top and top["is_current"] else None
            if run and v != run[1]:
                out.add((f, str(days[run[0]]), str(d) if d else "9999-12-31"))
                run = None
            if v is not None and run is None:
                run = (i, v)
    return out


def test_versions_as_by_brute_force(spark):
    rng = random.Random(5)
    base, rows = dt.date(2025, 1, 1), []
    for fan in range(40):
        for s in range(8):
            for copy in range(rng.choice([0, 1, 1, 1, 2])):
                rows.append({
                    "snapshot_date": base + dt.timedelta(days=30 * s), "fan_key": rng.randrange(10**6), "fan_id": f"F{fan}" if fan else None, "first_name": rng.choice(["Ann", " ANN ", "Ann", "Bea"]), "last_name": rng.choice(["de  Vo", "De Vo"]),
                    "email": rng.choice([None, "", "a@b.c"]), "phone": rng.choice(["+1 012-345-6789", "0123456789", "x", None]), "city": "Y", "state": rng.choice(["A", "A", "B"]), "zip": rng.choice(["01234", "01234-99"]), "dob": rng.choice([None, base]),
                    "sources": None, "record_count": s, "is_current": rng.random() > 0.1, "loaded_at": dt.datetime(2025, 1, 1) + dt.timedelta(days=31 * s, hours=copy), "attribute": "clash", "day": "clash",
                })
    df = spark.createDataFrame(rows, SNAP)
    got = {(r.fan_id, str(r.valid_from), str(r.valid_to)) for r in H.fan_history(df).collect()}
    assert got == brute(rows)
    h = H.fan_history(df)
    assert h.select("fan_key").distinct().count() == h.count()


def test_change_log_has_an_interval_per_value(spark):
    d = lambda m: dt.date(2025, m, 1)
    rows = [(d(m), "F", v, dt.datetime(2025, m, 2)) for m, v in ((1, "a"), (2, "a"), (3, "b"), (5, "b"))] + [(d(4), "G", "x", dt.datetime(2025, 4, 2))]
    df = spark.createDataFrame(rows, "day date, who string, v string, loaded timestamp")
    log = {(r.attribute, r.value, str(r.valid_from), str(r.valid_to)) for r in H.change_log(df, "who", "day", "loaded", {"v": F.col("v")}).filter("who = 'F'").collect()}
    assert log == {("v", "a", "2025-01-01", "2025-03-01"), ("v", "b", "2025-03-01", "2025-04-01"), ("v", "b", "2025-05-01", "None"), (H.PRESENT, None, "2025-01-01", "2025-04-01"), (H.PRESENT, None, "2025-05-01", "None")}


def test_history_of_nothing(spark):
    assert H.fan_history(spark.createDataFrame([], SNAP)).count() == 0


CHILD = "event_id string, subscriber_id string, occurred_at timestamp, loaded_at timestamp, num long, absent boolean"
PARENT = "subscriber_id string, deleted_at timestamp, loaded_at timestamp, prefix string"


def test_orphans_as_by_brute_force(spark):
    import re

    rng, t = random.Random(2), lambda n: dt.datetime(2025, 1, 1) + dt.timedelta(hours=n)
    parents = [(f"S-{rng.choice([1, 2, 3, 5, 8, 9, 65535, 65536, 65537, 10**17]):09d}", t(rng.randrange(60)) if rng.random() < 0.3 else None, t(rng.randrange(60)), "x") for _ in range(12)]
    refs = ["S-1", " s-000002 ", "S-4", "S-65536", "S-000065538", None, " ", "S-", "UNKNOWN", "X-1", "S-5", "S-" + "0" * 30 + "9", "S-" + "9" * 40, "S-100000000000000000"]
    children = [(f"E{rng.randrange(60)}", rng.choice(refs), t(rng.randrange(60)), t(rng.randrange(60) + i / 1000), 1, True) for i in range(200)]
    got = {(r.child_key, r.orphan_kind) for r in O.orphan_references(spark.createDataFrame(children, CHILD), "c", "event_id", "subscriber_id", "occurred_at", "loaded_at", spark.createDataFrame(parents, PARENT), "subscriber_id", "loaded_at", "deleted_at").collect()}

    def norm(k):
        m = re.fullmatch(r"\s*([A-Za-z]+)-0*([0-9]+)\s*", k)
        return (m[1].upper(), m[2]) if m else None

    known = {}
    for k, gone, loaded, _ in parents:
        a, b = known.get(norm(k), (loaded, gone))
        known[norm(k)] = (min(a, loaded), min((x for x in (b, gone) if x), default=None))
    want, seen = set(), {}
    for key, ref, at, loaded, *_ in children:
        if key not in seen or loaded < seen[key][2]:
            seen[key] = (ref, at, loaded)
    for key, (ref, at, loaded) in seen.items():
        if ref and ref.strip():
            p = known.get(norm(ref)) if norm(ref) else None
            kind = "missing" if p is None else "deleted" if p[1] and p[1] <= at else "late" if p[0] > loaded else None
            if kind:
                want.add((key, kind))
    assert got == want


def test_runs_and_empty(spark):
    keys = spark.createDataFrame([("S", 1), ("S", 2), ("S", 3), ("S", 7), ("S", 65535), ("S", 65536), ("M", 2)], "prefix string, num long")
    assert {(r.prefix, r.run_start, r.run_end) for r in O.key_runs(keys).collect()} == {("S", 1, 3), ("S", 7, 7), ("S", 65535, 65535), ("S", 65536, 65536), ("M", 2, 2)}
    none = O.orphan_references(spark.createDataFrame([], CHILD), "c", "event_id", "subscriber_id", "occurred_at", "loaded_at", spark.createDataFrame([], PARENT), "subscriber_id", "loaded_at", "deleted_at")
    assert none.count() == 0
    one = spark.createDataFrame([("E", "S-1", dt.datetime(2025, 1, 1), None, 1, True)], CHILD)
    assert [r.orphan_kind for r in O.orphan_references(one, "c", "event_id", "subscriber_id", "occurred_at", "loaded_at", spark.createDataFrame([], PARENT), "subscriber_id", "loaded_at", "deleted_at").collect()] == ["missing"]


def test_the_runs_decide_what_is_missing(spark, monkeypatch):
    """Without runs every reference is missing, with a run over everything none is."""
    t = dt.datetime(2025, 1, 1)
    kids = spark.createDataFrame([(f"E{i}", f"S-{i}", t, t, 1, True) for i in range(1, 7)], CHILD)
    parents = spark.createDataFrame([(f"S-{i}", None, t, "x") for i in (1, 2, 5)], PARENT)
    found = lambda: {r.child_key for r in O.orphan_references(kids, "c", "event_id", "subscriber_id", "occurred_at", "loaded_at", parents, "subscriber_id", "loaded_at", "deleted_at").filter("orphan_kind = 'missing'").collect()}
    assert found() == {"E3", "E4", "E6"}
    runs = "prefix string, block long, run_start long, run_end long"
    monkeypatch.setattr(O, "key_runs", lambda keys: spark.createDataFrame([], runs))
    assert found() == {f"E{i}" for i in range(1, 7)}
    monkeypatch.setattr(O, "key_runs", lambda keys: spark.createDataFrame([("S", 0, 1, 9)], runs))
    assert found() == set()
