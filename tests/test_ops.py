import json

import pytest

from recordspark import cli
from recordspark.operators import quality as Q
from recordspark.ops import models as M
from recordspark.ops import runner as R


@pytest.fixture(scope="module")
def ctx(spark, small, tmp_path_factory):
    c = R.Context(spark, small, str(tmp_path_factory.mktemp("wh")))
    R.run(c, M.models("deterministic"))
    return c


def test_pipeline_passes_its_gate_and_reruns_change_nothing(ctx):
    Q.gate(Q.run_checks(M.checks(ctx)))
    before = {t: ctx.table(t).count() for t in ("core.dim_fan", "core.fact_email")}
    again = R.Context(ctx.spark, ctx.source, ctx.warehouse)
    R.run(again, M.models("deterministic"), layers=["core"])
    assert {t: again.table(t).count() for t in before} == before
    assert again.table("core.dim_fan").filter("not is_current").count() == 0


def test_gate_fails_when_data_is_broken(ctx):
    dim = ctx.table("core.dim_fan")
    rows, schema = dim.collect(), dim.schema
    R.swap_in(ctx.spark.createDataFrame(rows + rows[:1], schema), f"{ctx.warehouse}/core/dim_fan")
    with pytest.raises(Q.GateError, match="one_current_version"):
        Q.gate(Q.run_checks(M.checks(ctx)))
    R.swap_in(ctx.spark.createDataFrame(rows, schema), f"{ctx.warehouse}/core/dim_fan")


def test_analysts_see_no_people(ctx):
    assert not {"first_name", "last_name", "email", "phone", "city", "zip", "dob"} & set(M.analyst_view(ctx).columns)


def test_order_and_failures(ctx):
    bad = {"staging.x": lambda c: c.spark.range(1), "core.y": lambda c: c.read("absent")}
    assert R.in_order({"core.b": None, "staging.a": None, "core.c": None}) == ["staging.a", "core.b", "core.c"]
    with pytest.raises(ValueError):
        R.in_order({"nolayer": None})
    with pytest.raises(ValueError):
        R.in_order(bad, select=["z"])
    with pytest.raises(Exception, match="absent"):
        R.run(ctx, bad)
    last = {r.name: r.status for r in R.latest_runs(ctx).collect()}
    assert last["core.y"] == "failed" and last["staging.x"] == "done"
    with pytest.raises(ValueError, match="b"):
        R.require_rows({"a": 1, "b": 0})


def test_reports_and_secrets(tmp_path, capsys):
    R.report_json(str(tmp_path / "r.json"), [{"a": 1}])
    R.report_markdown(str(tmp_path / "r.md"), "T", [{"a": 1, "b": None}])
    assert json.loads((tmp_path / "r.json").read_text()) == [{"a": 1}] and "| 1 |  |" in (tmp_path / "r.md").read_text()
    assert R.masked({"api_token": "x", "host": "h", "password": ""}) == {"api_token": "***", "host": "h", "password": ""}
    assert cli.main(["info"]) == 0 and "source" in capsys.readouterr().out



def test_ingest_files(spark, tmp_path):
    from recordspark.ops.ingest import ingest

    zone, wh = tmp_path / "zone", str(tmp_path / "wh")
    (zone / "ticketing").mkdir(parents=True)
    (zone / "email").mkdir()
    line = lambda i, total=5: json.dumps({"order_id": f"T-{i}", "match_id": "MTCH-1", "purchased_at": "2025-01-01T00:00:00Z", "qty": 1, "total": total, "purchaser_name": "Ann", "purchaser_email": "a@b.c"})
    jan = zone / "ticketing" / "orders_2025-01.jsonl"
    jan.write_text("\n".join([line(1), line(2, -1)]) + "\n")
    (zone / "ticketing" / "orders_2025-03.jsonl").write_text(line(3) + "\n")
    (zone / "email" / "subscribers.csv").write_text("subscriber_id,email,signup_date,status\nS-1,a@b.c,2025-01-01,subscribed\nS-2,,2025-01-01,subscribed\n")
    run = lambda **k: ingest(R.Context(spark, str(zone), wh), str(zone), **k)
    assert run(first="2025-01", last="2025-02") == [("ticketing_orders", 1, 1), ("email_subscribers", 1, 1)]
    assert run() == [("ticketing_orders", 1, 0)] and run() == []  # the rest of the months, then nothing new
    jan.write_text("\n".join([line(1), line(2)]) + "\n")
    assert run() == [("ticketing_orders", 2, 0)]  # a corrected file replaces its rows and leaves quarantine
    raw = spark.read.parquet(f"{wh}/raw/ticketing_orders")
    assert raw.count() == 3 and spark.read.schema("payload string, reason string, source_file string").parquet(f"{wh}/quarantine/ticketing_orders").count() == 0
    assert run(sources=["email_subscribers"], force=True) == [("email_subscribers", 1, 1)]


def test_object_service(spark):
    import threading
    import urllib.parse
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from recordspark.sources import objects as O

    rows = [{"Id": f"{i:03d}", "SystemModstamp": f"2025-01-{i:02d}"} for i in range(1, 29)]

    class Service(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def answer(self, doc, code=200):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(doc).encode())

        def do_POST(self):
            form = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())
            self.answer({"access_token": "t"} if form["client_secret"] == ["s"] else {}, 200 if form["client_secret"] == ["s"] else 401)

        def do_GET(self):
            q = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)
            _, after, _ = O.parse_query(q["q"][0])
            own, start = [r for r in rows if not after or r["SystemModstamp"] > after], int(q.get("from", ["0"])[0])
            done = start + 10 >= len(own)
            nxt = f"/services/data/v60.0/query?{urllib.parse.urlencode({'q': q['q'][0], 'from': start + 10})}"
            self.answer({"records": own[start : start + 10], "done": done} | ({} if done else {"nextRecordsUrl": nxt}), 200 if self.headers["Authorization"] == "Bearer t" else 401)

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        O.register(spark)
        df = spark.read.format("objects").option("url", f"http://127.0.0.1:{server.server_port}").option("kind", "Contact").option("client", "c").option("secret", "s").load()
        assert df.count() == 28 and df.filter("modified_at > '2025-01-20'").count() == 8
    finally:
        server.shutdown()
