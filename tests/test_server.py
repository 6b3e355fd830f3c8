"""Sessions, upkeep of views, and the engine over HTTP and WebSocket."""

import base64
import json
import os
import socket
import threading
import time
import urllib.error
import urllib.request
from datetime import datetime, timedelta

import pytest

from vistaframe.engine import Engine
from vistaframe.server import Server, frame, read_frame
from vistaframe.session import DONE, Reporter, Session
from vistaframe.upkeep import Upkeep

SCHEMA = {"typeName": "t", "dimension": [{"name": "id", "datatype": "Number"}, {"name": "at", "datatype": "Time"}], "measurement": [{"name": "text", "datatype": "Text"}], "primaryKey": ["id"], "timeField": "at"}
COUNT = {"field": "*", "apply": {"name": "count"}, "as": "n"}
T0 = datetime(2024, 1, 1)
BY_ID = {"dataset": "d", "group": {"by": [{"field": "id", "apply": {"name": "bin", "args": {"scale": 1000}}, "as": "b"}], "aggregate": [COUNT]}, "filter": [{"field": "at", "relation": "inRange", "values": ["2024-01-01", "2024-01-21"]}]}


def rows(spark, n=200):
    return spark.createDataFrame([(i, T0 + timedelta(hours=i), "red fox" if i % 4 == 0 else "red") for i in range(n)], "id long, at timestamp_ntz, text string")


@pytest.fixture
def engine(spark, tmp_path):
    now = [datetime(2024, 1, 6)]
    e = Engine(spark, str(tmp_path), clock=lambda: now[0])
    e.now = now
    rows(spark).write.parquet(str(tmp_path / "rows"))
    e.register({"dataset": "d", "schema": SCHEMA}, str(tmp_path / "rows"))
    return e


def test_reporter_keeps_pace():
    for every, want in ((False, [0, 5]), (True, [0, 1, 2, 3, 4, 5])):
        out = []
        r = Reporter(out.append, 30.0, every)
        t = threading.Thread(target=r.run, args=(threading.Event(),))
        t.start()
        r.put(0)
        time.sleep(0.5)  # hungry: handed on at once
        assert out == [0]
        for i in range(1, 6):
            r.put(i)
        r.close()
        t.join(10)
        assert out == [*want, DONE]


def test_session(engine):
    got = []
    Session(engine).submit(BY_ID | {"option": {"sliceMillis": 50}, "transform": {"wrap": {"id": "1", "category": "c"}}}, got.append).join(120)
    assert got[-1] == DONE and all(a["id"] == "1" and a["category"] == "c" for a in got[:-1])
    assert sum(r["n"] for r in got[-2]["value"]["value"]) == 200 and got[-2]["value"]["progress"] == 1
    got = []
    Session(engine).submit({"dataset": "nope"}, got.append).join(60)
    Session(engine).submit({"dataset": "d", "group": 3}, got.append).join(60)
    assert "nope" in got[0]["error"] and "error" in got[1]


def test_a_newer_request_of_a_category_cancels(engine):
    """The first, in endless slices, ends without {"key": "done"}; one of another category goes on."""
    slow, other, new = [], [], []
    held = threading.Event()
    plain = engine.progressive

    def endless(r, **options):
        while True:
            yield from plain(r, **options)
            held.set()
            if options["cancelled"]():
                return

    engine.progressive = endless
    s = Session(engine)
    wrap = lambda c: {"option": {"sliceMillis": 1}, "transform": {"wrap": {"id": c, "category": c}}}
    first = s.submit(BY_ID | wrap("a"), slow.append)
    assert held.wait(60)
    engine.progressive = plain
    beside = s.submit(BY_ID | wrap("b"), other.append)
    second = s.submit(BY_ID | wrap("a"), new.append)
    for t in (first, beside, second):
        t.join(120)
        assert not t.is_alive()
    assert DONE not in slow and not any("error" in a for a in slow) and other[-1] == new[-1] == DONE
    assert s.cancel("a") is False


def test_standing_query(engine, spark):
    got = []
    s = Session(engine)
    s.submit({"dataset": "d", "global": {"globalAggregate": COUNT}, "option": {"continueSeconds": 1}, "transform": {"wrap": {"id": "1", "category": "live"}}}, got.append)
    end = time.time() + 60
    while not got and time.time() < end:
        time.sleep(0.1)
    engine.upsert("d", rows(spark, 201).where("id = 200"))
    while len(got) < 2 and time.time() < end:
        time.sleep(0.1)
    assert s.cancel("live")
    assert [a["value"][0]["n"] for a in got] == [200, 201]


def test_upkeep(engine, spark):
    asked = {"dataset": "d", "filter": [{"field": "text", "relation": "contains", "values": ["fox"]}], "global": {"globalAggregate": COUNT}}
    keep = Upkeep(engine, timedelta(minutes=30), timedelta(hours=2))
    (made,) = keep.after(asked)
    assert keep.after(asked) == [] and engine.is_solvable_by_view(asked) == [True]
    assert made.stats.cardinality == 30 and engine.run(asked) == [{"n": 50}]
    assert keep.tick() == []
    engine.now[0] += timedelta(hours=1)
    assert keep.tick() == [made.name] and engine.registry.info(made.name).stats.cardinality == 31
    rows(spark, 1000).where("id >= 200").write.mode("append").parquet(engine.registry.info("d").path)
    engine.registry.tables.pop("d")
    engine.now[0] += timedelta(hours=2)
    assert sorted(keep.tick()) == sorted([made.name, "d"])
    stats = engine.registry.info("d").stats
    assert stats.cardinality == 1000 and stats.rate == 800 // (3 * 3600)
    keep.start(0.05)
    engine.now[0] += timedelta(hours=1)
    end = time.time() + 60
    while engine.registry.info(made.name).stats.modified < engine.now[0] and time.time() < end:
        time.sleep(0.1)
    keep.stop()
    assert engine.registry.info(made.name).stats.modified == engine.now[0]


def test_views_follow_changes(engine, spark):
    asked = {"dataset": "d", "filter": [{"field": "text", "relation": "contains", "values": ["fox"]}], "global": {"globalAggregate": COUNT}}
    Upkeep(engine).after(asked)
    engine.delete("d", [{"field": "id", "relation": "<", "values": [100]}])
    assert engine.is_solvable_by_view(asked) == [True] and engine.run(asked) == [{"n": 25}]
    assert engine.registry.info("d").stats.cardinality == 100
    engine.upsert("d", rows(spark).where("id = 104").selectExpr("id", "at", "'blue' as text"))
    assert engine.run(asked) == [{"n": 24}]
    # a later session sees the changes
    again = Engine(spark, engine.root, clock=engine.clock)
    assert again.run(asked) == [{"n": 24}] and again.query({"dataset": "d"}).count() == 100 and again.query({"dataset": "d"}).columns == ["id", "at", "text"]


def _post(server, path, body):
    data = body if isinstance(body, bytes) else json.dumps(body).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.address[1]}{path}", data), timeout=120) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


def test_http(engine, spark, tmp_path):
    server = Server(engine, upkeep=Upkeep(engine)).start()
    try:
        asked = {"dataset": "d", "filter": [{"field": "text", "relation": "contains", "values": ["fox"]}], "global": {"globalAggregate": COUNT}}
        assert json.loads(_post(server, "/checkQuerySolvableByView", asked)[1]) == [False]
        status, body = _post(server, "/berry", asked | {"transform": {"wrap": {"id": "7", "category": "x"}}})
        assert status == 200 and json.loads(body) == {"id": "7", "category": "x", "value": [{"n": 50}]}
        end = time.time() + 60
        while json.loads(_post(server, "/checkQuerySolvableByView", asked)[1]) != [True] and time.time() < end:
            time.sleep(0.2)
        assert json.loads(_post(server, "/berry", asked)[1]) == [{"n": 50}]
        status, body = _post(server, "/berry", BY_ID | {"option": {"sliceMillis": 50}})
        lines = [json.loads(x) for x in body.splitlines()]
        assert status == 200 and lines[-1] == DONE and sum(r["n"] for r in lines[-2]["value"]) == 200
        assert _post(server, "/berry", b"{")[0] == _post(server, "/berry", {"dataset": 3})[0] == _post(server, "/berry", [])[0] == 400 and _post(server, "/nope", {})[0] == 404
        rows(spark, 5).write.parquet(str(tmp_path / "more"))
        new = {"dataset": "e", "schema": SCHEMA, "path": str(tmp_path / "more")}
        assert json.loads(_post(server, "/admin/register", new)[1]) == {"dataset": "e", "rows": 5} and _post(server, "/admin/register", new)[0] == 400
        assert json.loads(_post(server, "/admin/deregister", {"dataset": "e"})[1]) == {"dropped": ["e"]} and _post(server, "/admin/deregister", {"dataset": "e"})[0] == 400
    finally:
        server.stop()


def test_websocket(engine):
    server = Server(engine).start()
    try:
        with socket.create_connection(server.address, timeout=120) as s:
            key = base64.b64encode(b"0123456789abcdef").decode()
            s.sendall(f"GET /ws HTTP/1.1\r\nHost: x\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {key}\r\nSec-WebSocket-Version: 13\r\n\r\n".encode())
            stream = s.makefile("rb")
            assert b"101" in stream.readline()
            while stream.readline().strip():
                pass

            def send(data: bytes, opcode=1):
                mask, plain = os.urandom(4), frame(data, opcode)
                at = len(plain) - len(data)
                head = bytearray(plain[:at])
                head[1] |= 128
                s.sendall(bytes(head) + mask + bytes(b ^ mask[i % 4] for i, b in enumerate(data)))

            send(json.dumps(BY_ID | {"option": {"sliceMillis": 20}, "transform": {"wrap": {"id": "q" * 300, "category": "c"}}}).encode())
            answers = []
            while not answers or answers[-1] != DONE:
                opcode, data = read_frame(stream)
                assert opcode == 1
                answers.append(json.loads(data))
            assert sum(r["n"] for r in answers[-2]["value"]["value"]) == 200
            send(b"{")
            assert "error" in json.loads(read_frame(stream)[1])
            send(b"hello", 9)
            assert read_frame(stream) == (10, b"hello")
            send(b"", 8)
            assert read_frame(stream) is None
    finally:
        server.stop()
