import datetime as dt
import json
import socket
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from parcelflow import cli
from parcelflow.sources import config as settings
from parcelflow.sources import files, http, paged, snapshot, standin


class Service(BaseHTTPRequestHandler):
    rows: list = []
    asked: list = []
    secure_status = 200

    def log_message(self, *args):
        pass

    def _send(self, status, body):
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_POST(self):
        self.rfile.read(int(self.headers.get("Content-Length", 0)))
        if self.path.startswith(settings.SECURE_TOKEN_PATH):
            return self._send(self.secure_status, {"access_token": "secure"} if self.secure_status == 200 else {"why": "no"})
        self._send(200, {"access_token": "oauth"})

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        type(self).asked.append((self.headers["Authorization"], q))
        if "broken" in self.path:
            return self._send(503, {"why": "down"})
        at, n = int(q["offset"]), int(q["limit"])
        rows = self.rows
        for test in q.get("filter", "").split(" AND "):
            if test.startswith("instance_date>="):
                rows = [r for r in rows if r["instance_date"] >= test[16:-1]]
        self._send(200, {"result": {"records": rows[at : at + n]}})


@pytest.fixture
def service():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.asked, Service.secure_status = [], 200
    Service.rows = [{"transaction_id": i, "instance_date": f"2026-03-0{i + 1}", "trans_group_en": "Sales", "reg_type_en": "Ready", "area_name_en": "a", "property_sub_type_en": "Flat", "actual_worth": "1,000.5", "actual_area": 10, "rooms_en": "1"} for i in range(5)]
    yield settings.ServiceConfig(f"http://127.0.0.1:{server.server_port}", "id", "me", "secret", "e", "d")
    server.shutdown()


def test_unwrap():
    for payload, want in (([{"a": 1}, 2], [{"a": 1}]), ({"results": [{"a": 1}]}, [{"a": 1}]), ({"result": {"records": [{"b": 1}]}}, [{"b": 1}]), ({"data": []}, []), ({"data": [1, {"a": 2}]}, [{"a": 2}]), ({"x": 1}, []), ("text", []), ({"result": {}, "data": [{"c": 1}]}, [{"c": 1}])):
        assert paged.unwrap(payload) == want


@pytest.mark.parametrize("rows,size,most,start,want,requests", [(5, 2, None, 0, 5, 3), (4, 2, None, 0, 4, 3), (5, 2, 3, 0, 3, 2), (5, 2, None, 3, 2, 2), (0, 2, None, 0, 0, 1)])
def test_pages(service, rows, size, most, start, want, requests):
    Service.rows = Service.rows[:rows]
    got = [r for p in paged.pages(service, {"offset": start, "limit": 99}, size, most) for r in p]
    assert len(got) == want and len(Service.asked) == requests


def test_tokens(service):
    assert http.access_token(service) == "secure"
    Service.secure_status = 403
    assert http.access_token(service) == "oauth"
    assert http.access_token(settings.ServiceConfig(**(vars(service) | {"oauth_only": True}))) == "oauth"
    with pytest.raises(settings.ServiceError, match="missing settings: client_secret"):
        http.access_token(settings.ServiceConfig(**(vars(service) | {"client_secret": ""})))
    with pytest.raises(settings.ServiceError, match="503"):
        list(paged.pages(settings.ServiceConfig(**(vars(service) | {"dataset": "broken"})), {}))


def test_query():
    d = dt.date(2026, 1, 2)
    assert paged.query(d, d)["filter"] == "property_sub_type_en='Flat' AND instance_date>='2026-01-02' AND instance_date<='2026-01-02'"
    assert paged.query(flat_only=False, newest_first=True) == {"order_by": "instance_date", "order_dir": "desc"}


def test_scan_pushes_filters(spark, service):
    df = paged.scan(spark, service, paged.query(), page_size=2)
    assert df.filter("instance_date >= '2026-03-03'").count() == 3
    assert "instance_date>='2026-03-03'" in Service.asked[-1][1]["filter"]
    assert paged.scan(spark, service, page_size=2, max_records=3).count() == 3
    ranges = [(dt.date(2026, 3, 1), dt.date(2026, 3, 2)), (dt.date(2026, 3, 4), dt.date(2026, 3, 5))]
    assert paged.scan(spark, service, dates=ranges).rdd.getNumPartitions() == 2


def test_scan_where_nothing_is_pushed(spark, service):
    name = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(name, "false")
    try:
        assert paged.scan(spark, service, paged.query(), page_size=2).filter("instance_date >= '2026-03-03'").count() == 3
        assert ">=" not in Service.asked[-1][1]["filter"]
    finally:
        spark.conf.set(name, "true")


def test_legacy_scan(spark, service):
    got = paged.scan_legacy(spark, service, dt.date(2026, 3, 2))
    assert got.count() == 4 and {"TRANSACTION_NUMBER", "TRANS_VALUE", "ACTUAL_AREA"} <= set(got.columns)
    asked = Service.asked[-1][1]
    assert asked["limit"] == "500" and asked["filter"] == "property_sub_type_en='Flat' AND instance_date>='2026-03-02' AND trans_group_en='Sales'"


def test_connecting_and_reading_wait_differently(service, monkeypatch):
    waits = []
    class Socket(socket.socket):
        def settimeout(self, seconds):
            waits.append(seconds)
            super().settimeout(seconds)

    monkeypatch.setattr(socket, "socket", Socket)
    assert http.access_token(service) == "secure"
    assert waits[0] == http.CONNECT_S == 10 and http.READ_S == 60 and 60 in waits


def test_standin():
    server = standin.Standin([{"a": str(i), "b": i} for i in range(7)]).start()
    got = [r["b"] for p in paged.pages(server.config, {"filter": "a>='2' AND a<='5'", "order_by": "a", "order_dir": "desc"}, 3) for r in p]
    assert got == [5, 4, 3, 2] and [q["offset"] for q in server.asked] == ["0", "3"]
    server.shutdown()


def test_snapshot(spark, service):
    got = snapshot.load(spark, service, as_of=dt.date(2026, 3, 19))
    assert got.transactions.count() == 5 and got.bounds == (dt.date(2026, 3, 1), dt.date(2026, 3, 5)) and got.window[0] == dt.date(2025, 11, 19)
    assert got.transactions.first()["TRANS_VALUE"] == 1000.5 and got.mapping["ROOMS_EN"] == ["rooms_en"]
    assert snapshot.picker_bounds(got) == got.bounds and snapshot.picker_bounds(None, dt.date(2026, 3, 19))[0] == dt.date(2025, 11, 19)
    assert snapshot.transactions(None, spark).count() == 0
    Service.rows = [{"instance_date": "2026-03-01"}]
    with pytest.raises(settings.ServiceError, match="AREA_EN"):
        snapshot.load(spark, service, as_of=dt.date(2026, 3, 19))
    Service.rows = []
    with pytest.raises(settings.ServiceError, match="no records"):
        snapshot.load(spark, service)


def test_probe_and_store(spark, service):
    from parcelflow.plans import market

    rows, mapping = snapshot.probe(spark, service, 2)
    assert rows.count() == 2 and mapping["TRANS_VALUE"] == ["actual_worth"] and Service.asked[-1][1]["order_dir"] == "desc"
    store = snapshot.Store(spark, service, as_of=dt.date(2026, 3, 19))
    first = store.result(market.daily_market, "Sale")
    asked = len(Service.asked)
    assert first.count() == 5 and store.result(market.daily_market, "Sale") is first and store.result(market.daily_market, "All") is not first
    assert len(Service.asked) == asked
    store.keep = dt.timedelta(0)
    assert store.result(market.daily_market, "Sale") is not first and len(Service.asked) > asked


def test_config(tmp_path):
    (tmp_path / "s.toml").write_text('client_id = "file"\n[market]\nclient_secret = "s"\nverify_ssl = "no"\n')
    c = settings.load({"MARKET_ENTITY": "e", "client_id": ""}, tmp_path / "s.toml", environment={"MARKET_BASE_URL": "http://x/"})
    assert (c.base_url, c.entity, c.client_id, c.client_secret, c.verify_ssl) == ("http://x/", "e", "file", "s", False)
    assert c.missing() == ["security_application_identifier", "dataset"] and "secret" not in repr(c).replace("client_secret", "")
    assert settings.load(environment={}, path=tmp_path / "none.toml").base_url == ""


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data":[1,{"actual_worth": 2.50}]}')
    (tmp_path / "b.json").write_text('[{"actual_worth": "AED 1", "z": 1}]')
    got = files.read_envelopes(spark, str(tmp_path))
    assert sorted(r["actual_worth"] for r in got.collect()) == ["2.5", "AED 1"]
    (tmp_path / "c.csv").write_text('rooms_en,x\n2,"a,b"\n')
    assert files.read(spark, f"{tmp_path}/c.csv", "csv").first()[:] == ("2", "a,b")
    assert files.from_records(spark, [{"a": 1}, {"b": None, "a": "x"}]).collect()[0][:] == ("1", None)
    assert files.rename_legacy(files.from_records(spark, [{"procedure_area": 1, "q": 2}])).columns == ["ACTUAL_AREA", "q"]


def test_cli(spark, service, monkeypatch, capsys, tmp_path):
    assert cli.main(["--prefix", "NOPE"], spark) == 2
    for k, v in vars(service).items():
        monkeypatch.setenv(f"TESTING_{k}".upper(), str(v))
    assert cli.main(["--prefix", "TESTING", "--limit", "3", "--start", "2026-01-01"], spark) == 0
    assert "raw dates: 2026-03-01 to 2026-03-03" in capsys.readouterr().out
    assert cli.main(["--prefix", "TESTING", "--start", "2026-01-01", "--dataset", "broken"], spark) == 1
    Service.rows = []
    assert cli.main(["--prefix", "TESTING", "--require-records"], spark) == 1
    assert cli.main(["--prefix", "TESTING"], spark) == 0
