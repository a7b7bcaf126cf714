import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from recordspark.operators import parse_failures as P
from recordspark.operators import schema_drift as S
from recordspark.operators.delimited import name_similarity
from recordspark.runtime import Cut, table

LINE = "row_id long, payload string, source_file string, line_no int, extra string"


def split_by_state(line, d):
    """One character at a time: the fields, or None where a quotation mark stands wrong."""
    out, cur, i, quoted, n = [], "", 0, False, len(line)
    start = True
    while i <= n:
        ch = line[i] if i < n else None
        if quoted:
            if ch is None:
                return None
            if ch == '"':
                if i + 1 < n and line[i + 1] == '"':
                    cur += '"'
                    i += 1
                elif i + 1 == n or line[i + 1] == d:
                    quoted = False
                else:
                    return None
            else:
                cur += ch
        elif ch is None or ch == d:
            out.append(cur)
            cur, start = "", True
            i += 1
            continue
        elif ch == '"':
            if not start:
                return None
            quoted = True
        else:
            cur += ch
        start = False
        i += 1
    return out


SYNONYMS = {
    "order_number": "order_number order_no reference ordernumber", "created_at": "created_at order_time ordered_at ts_created createdat", "customer_email": "customer_email email buyer_email contact customeremail",
    "billing_name": "billing_name name_on_order buyer billingname", "sku": "sku", "item_name": "item_name article product_name description_short item name", "quantity": "quantity qty pieces units",
    "unit_price": "unit_price price_each unit_amount unitprice", "line_total": "line_total line_amount total linetotal",
}
PART = {w: k for k, v in SYNONYMS.items() for w in v.split()} | {"item name": "item_name"}


def real(v):
    try:
        return bool(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", v, re.A)) and bool(dt.datetime.strptime(v, "%Y-%m-%dT%H:%M:%SZ"))
    except ValueError:
        return False


def bad_lines(rows):
    heads, by_file = {}, {}
    for r in rows:
        if r.line_no == 1:
            h = r.payload.removesuffix("\r").lstrip("\ufeff")
            d = max(",;|\t", key=h.count)
            heads[r.source_file] = (d, [x.strip().strip('"').strip().lower() for x in h.split(d)])
        else:
            by_file.setdefault(r.source_file, []).append(r)
    out = set()
    for f, rs in by_file.items():
        d, names = heads[f]
        cells = {r.row_id: split_by_state(r.payload.removesuffix("\r"), d) for r in rs}
        good = {k: dict(zip([PART.get(n) for n in names], v)) for k, v in cells.items() if v is not None and len(v) == len(names)}
        epoch = sum(v.get("created_at", "").isdigit() for v in good.values()) > len(good) / 2
        number = re.compile(r"[0-9]+(\.[0-9]+)?")
        for k in cells:
            v = good.get(k)
            ok = v is not None and v.get("order_number", "M-").startswith("M-") and all(v.get(c, "x") for c in ("billing_name", "sku", "item_name"))
            ok = ok and all(number.fullmatch(v[c]) for c in ("quantity", "unit_price", "line_total") if c in v)
            ok = ok and ("customer_email" not in v or bool(re.search(r"@[^@]*\.[^@]*$", v["customer_email"])))
            ok = ok and ("created_at" not in v or (v["created_at"].isdigit() if epoch else real(v["created_at"])))
            if not ok:
                out.add(k)
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_lines_fail_as_by_brute_force(spark, cut, sf):
    raw = table(spark, f"/root/testdata/{sf}", "raw_merch_order_items")
    lines = P.judged_lines(raw, cut)[0]
    assert {r.row_id for r in lines.filter("reason is not null").collect()} == bad_lines(raw.collect())


def test_payloads_fail_as_by_brute_force(spark, cut):
    def loads(text):
        def no(_):
            raise ValueError

        try:
            doc = json.loads(text or "", parse_constant=no)
        except ValueError:
            return False
        if not isinstance(doc, dict):
            return False
        text_of = lambda k: doc.get(k) if isinstance(doc.get(k), str) else None
        given = lambda k: doc.get(k) not in (None, "")
        try:
            day = not given("Birthdate") or bool(re.fullmatch(r"\d{4}-\d\d-\d\d", text_of("Birthdate") or "", re.A)) and bool(dt.date.fromisoformat(text_of("Birthdate")))
        except ValueError:
            day = False
        return (text_of("Id") or "").startswith("003") and bool((text_of("LastName") or "").strip()) and (not given("Email") or bool(re.search(r"@[^@]*\.[^@]*$", text_of("Email") or ""))) and real(text_of("SystemModstamp") or "") and day

    raw = table(spark, "/root/testdata/sf0.01", "raw_crm_contacts")
    judged = P.judged_contacts(raw, cut)
    assert {r.row_id for r in judged.filter("reason is not null").select("row_id").collect()} == {r.row_id for r in raw.collect() if not loads(r.payload)}
    assert P.contact_rows(judged).count() == judged.filter("reason is null").count()


HEAD = "order_number,created_at,customer_email,billing_name,sku,quantity"
GOOD = "M-1,2025-01-01T00:00:00Z,a@b.example,Ann Bee,ABC-CAP-01,1"


def lines(spark, texts, file="merch_x_2025-01.csv"):
    return spark.createDataFrame([(i, t, file, i, "clash") for i, t in enumerate(texts, 1)], LINE)


def test_edge_lines(spark, cut):
    long_name = "x" * 200_000 + '""' * 5_000
    raw = lines(spark, ["\ufeff" + HEAD + "\r", GOOD, GOOD, None, "", GOOD + "\r", GOOD.replace("Ann Bee", f'"{long_name}"'), GOOD.replace("Ann Bee", '"Bee, Ann"'), GOOD.replace("Ann Bee", 'Ann "B" Bee'), GOOD + ",9", GOOD.replace("Ann Bee", '""'), GOOD.replace("01-01T", "02-30T")])
    got = {r.row_id: r.reason for r in P.judged_lines(raw, cut)[0].select("row_id", "reason").collect()}
    assert [k for k, v in got.items() if v is None].sort() == [2, 3, 6, 7, 8].sort()
    assert {k for k, v in got.items() if v is None} == {2, 3, 6, 7, 8}
    assert got[9] == "broken_quoting" and got[10] == "too_many_fields" and got[4] == "too_few_fields" and got[11] == "billing_name: empty" and got[12] == "created_at: no instant"


def test_no_header_and_empty(spark, cut):
    raw = lines(spark, [HEAD, GOOD]).filter("line_no > 1")
    assert [r.reason for r in P.judged_lines(raw, cut)[0].collect()] == ["no_header"]
    assert P.judged_lines(raw.limit(0), Cut(spark, "t"))[0].count() == 0
    assert S.drift_report(raw.limit(0), Cut(spark, "t")).count() == 0
    assert P.judged_contacts(spark.createDataFrame([], "row_id long, payload string, batch_id string, source_file string, loaded_at timestamp"), cut).count() == 0


def test_nested_and_huge_json(spark, cut):
    rows = [(1, "[" * 100_000, None, None, None), (2, '{"Id": "0031", "LastName": "B", "SystemModstamp": "2025-01-01T00:00:00Z", "n": ' + "9" * 10_000 + "}", None, None, None), (3, None, None, None, None), (4, '{"Id": "0031", "LastName": "B\\ud800", "SystemModstamp": "2025-01-01T00:00:00Z"}', None, None, None)]
    raw = spark.createDataFrame(rows, "row_id long, payload string, batch_id string, source_file string, loaded_at timestamp")
    got = {r.row_id: r.reason for r in P.judged_contacts(raw, cut).select("row_id", "reason").collect()}
    assert got == {1: "not_json", 2: None, 3: "not_json", 4: None}


def test_drift_kinds(spark, cut):
    a = lines(spark, ["order_number,created_at,customer_email,billing_zip,quantity,gift_note"] + [f"M-{i},2025-01-0{i}T00:00:00Z,p{i}@b.example,0110{i},{i},wrap it" for i in range(1, 6)])
    b = lines(spark, ['"order_number"|ts_created| customer_email |quantity|billing_postal_code|loyalty_id'] + [f"M-{i}|173800000{i}|p{i}@b.example|{i}.0|0110{i}|778899{i}" for i in range(1, 6)], "merch_x_2025-02.csv")
    c = lines(spark, ["order_number|ts_created|customer_email|quantity|billing_postal_code|loyalty_id"], "merch_x_2025-03.csv")
    got = {tuple(r) for r in S.drift_report(a.unionByName(b).unionByName(c), cut).collect()}
    f = "merch_x_2025-02.csv"
    assert got == {(f, "renamed", "created_at", "ts_created"), (f, "renamed", "billing_zip", "billing_postal_code"), (f, "retyped", "ts_created", "ts_created"), (f, "retyped", "quantity", "quantity"), (f, "removed", "gift_note", ""), (f, "added", "", "loyalty_id")}


def test_unified_types(spark, cut):
    u = S.unified_lines(table(spark, "/root/testdata/sf0.01", "raw_merch_order_items"), cut)
    off = u.filter("abs(unit_price * quantity - line_total) > 0.011 and unit_price is not null and line_total is not null and quantity is not null").count()
    assert off < 0.02 * u.count() and dict(u.dtypes)["created_at"] == "timestamp"


def test_name_similarity():
    assert name_similarity("billingZip", "Billing Zip") == 1 and name_similarity("sku", "currency") < 0.3


def test_nulls_in_any_column(spark, cut):
    raw = lines(spark, [HEAD, GOOD])
    odd = spark.createDataFrame([(None, GOOD, None, None, None), (7, HEAD, None, 1, None), (None, GOOD, "merch_x_2025-01.csv", None, None), (9, GOOD.replace("M-1", "X"), "merch_x_2025-01.csv", None, None)], LINE)
    got = sorted(((r.row_id or 0), r.reason or "") for r in P.judged_lines(raw.unionByName(odd), cut)[0].select("row_id", "reason").collect())
    assert got == [(0, ""), (0, "no_header"), (2, ""), (9, "order_number: does not start with M-")]
    assert S.drift_report(raw.unionByName(odd), Cut(spark, "t")).count() == 0


def test_unlisted_names_are_matched_by_content(spark, cut):
    """Renames to names that no list has keep the column and its part, in the next file too."""
    row = lambda i, s: f"M-{100000 + i},2025-01-0{i % 9 + 1}T00:00:00Z,p{i}@b.example,0{1100 + i % 8},{i % 5 + 1},{s}"
    heads = ["order_number,created_at,customer_email,billing_zip,quantity,gift_note", "order_number,wann,post_an,plz,number_of_items,gift_note", "order_number,wann,post_an,plz,number_of_items,loyalty_id"]
    files = [lines(spark, [h] + [row(i, "wrap it" if "gift" in h else f"77{88000 + i}") for i in range(40)], f"merch_x_2025-0{k}.csv") for k, h in enumerate(heads, 1)]
    bad = lines(spark, [row(7, "1").replace(",3,1", ",many,1")], "merch_x_2025-03.csv").withColumn("line_no", F.lit(99)).withColumn("row_id", F.lit(99).cast("long"))
    raw = files[0].unionByName(files[1]).unionByName(files[2]).unionByName(bad)
    got = {tuple(r) for r in S.drift_report(raw, cut).collect()}
    renamed = {("merch_x_2025-02.csv", "renamed", a, b) for a, b in (("created_at", "wann"), ("customer_email", "post_an"), ("billing_zip", "plz"), ("quantity", "number_of_items"))}
    assert got == renamed | {("merch_x_2025-03.csv", "removed", "gift_note", ""), ("merch_x_2025-03.csv", "added", "", "loyalty_id")}
    assert [(r.row_id, r.reason) for r in P.judged_lines(raw, Cut(spark, "t"))[0].filter("reason is not null").collect()] == [(99, "quantity: not a number")]
    assert S.unified_lines(raw, Cut(spark, "t")).filter("billing_zip is null or quantity is null or created_at is null").count() == 0


SHOP = "order_number,sku,quantity,unit_price,line_total"


def _shop(spark, price, total, file):
    rows = [f"M-{100000 + i},ABC-CAP-{i % 5:02d},{i % 3 + 1},{price(10 + i % 5)},{total((10 + i % 5) * (i % 3 + 1))}" for i in range(30)]
    return lines(spark, [SHOP] + rows, file)


def test_whole_prices_stay_without_evidence_of_hundredths(spark, cut):
    whole = _shop(spark, lambda p: f"{p}", lambda p: f"{p}", "merch_x_2025-01.csv")
    got = S.unified_lines(whole, cut).agg(F.min("unit_price"), F.max("unit_price"), F.max("price_scale"), F.max("total_scale")).first()
    assert tuple(map(float, got)) == (10.0, 14.0, 1.0, 1.0)
    with_point = _shop(spark, lambda p: f"{p}.00", lambda p: f"{p}.00", "merch_y_2025-01.csv")
    both = S.unified_lines(whole.unionByName(with_point), Cut(spark, "t"))
    assert both.filter("price_scale <> 1 or total_scale <> 1 or line_total <> unit_price * quantity").count() == 0


def test_hundredths_are_shown_by_the_same_goods(spark, cut):
    cents = _shop(spark, lambda p: f"{p}00", lambda p: f"{p}00", "merch_x_2025-01.csv")
    with_point = _shop(spark, lambda p: f"{p}.00", lambda p: f"{p}00", "merch_y_2025-01.csv")
    u = S.unified_lines(cents.unionByName(with_point), cut)
    assert u.filter("line_total <> unit_price * quantity or unit_price > 14").count() == 0
    assert {(r.source_file[6], r.price_scale, r.total_scale) for r in u.select("source_file", "price_scale", "total_scale").distinct().collect()} == {("x", 100, 100), ("y", 1, 100)}


def test_matching_decides_the_renames(spark, monkeypatch):
    """With all columns unlike each other the renames become removals and additions, and unnamed columns go unchecked."""
    from recordspark.operators import delimited as D

    row = lambda i, q: f"M-{100000 + i},2025-01-0{i % 9 + 1}T00:00:00Z,{q}"
    files = [lines(spark, [h] + [row(i, i % 5 + 1) for i in range(40)] + [row(41, "many")], f"merch_x_2025-0{k}.csv") for k, h in enumerate(["order_number,created_at,quantity", "order_number,wann,stueck"], 1)]
    raw = files[0].unionByName(files[1])
    _, meta, pools = S.loaded_columns(raw, Cut(spark, "t"))
    columns = meta.toPandas()
    kinds = lambda: sorted(S.feed_changes(columns, pools)["change_kind"])
    parts = lambda: D.matched_files(columns, pools)[1][2]
    assert kinds() == ["renamed", "renamed"] and parts() == ["order_number", "created_at", "quantity"]
    monkeypatch.setattr(D, "likeness", lambda a, b, pools: 0.0)
    monkeypatch.setattr(D, "pooled_share", lambda r, pools: {})
    assert kinds() == ["added", "added", "removed", "removed"] and parts() == ["order_number", None, None]


def test_rows_without_an_id_keep_their_own_reason(spark, cut):
    raw = lines(spark, [HEAD]).unionByName(spark.createDataFrame([(None, GOOD.replace("M-1", "X"), "merch_x_2025-01.csv", 2, None), (None, GOOD, "merch_x_2025-01.csv", 3, None)], LINE))
    assert sorted(r.reason or "" for r in P.judged_lines(raw, cut)[0].collect()) == ["", "order_number: does not start with M-"]
