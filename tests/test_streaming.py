"""Feeds that end, replayed as streams."""

import json
import socket
import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vistaframe.streaming import ingest

T0 = datetime(2024, 1, 1)
ROWS = "id long, at timestamp_ntz, v double"


def test_file_feed_in_order_and_late_rows(spark, tmp_path):
    """Each file is a batch. Rows later than the watermark of the batch before allows are left out, bins are given when they can't change any more."""
    src = tmp_path / "in"
    batches = [[(1, T0 + timedelta(minutes=5), 1.0), (2, T0 + timedelta(minutes=50), 2.0)], [(3, T0 + timedelta(hours=5), 4.0)], [(8, T0 + timedelta(hours=5, minutes=30), 0.0)], [(4, T0 + timedelta(minutes=30), 100.0), (5, T0 + timedelta(hours=5, minutes=1), 8.0), (6, None, 1.0)], [(7, T0 + timedelta(hours=9), 16.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(str(src / f"b{i}"))
        time.sleep(0.02)
    files = sorted(src.glob("*/*.parquet"))
    for i, f in enumerate(files):
        f.rename(src / f"part{i}.parquet")
        time.sleep(1.1)  # the feed goes by the files' times
        (src / f"part{i}.parquet").touch()
    schema = spark.createDataFrame([], ROWS).schema
    bins = ingest.tumbling(ingest.file_feed(spark, str(src), schema, pattern="part*.parquet"), "at", "1 hour", [], {"n": F.count(F.lit(1)), "total": F.sum("v")}, "1 hour")
    seen = []
    ingest.drain(bins, lambda batch, nth: seen.extend((r["bin"], r["n"], r["total"]) for r in batch.collect()), str(tmp_path / "ck"))
    assert (T0, 2, 3.0) in seen and (T0 + timedelta(hours=5), 3, 12.0) in seen
    assert not any(total >= 100 for *_, total in seen)


def test_into_table(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], ROWS).schema
    assert ingest.current(spark, out) is None
    for nth, rows in enumerate(([(1, T0, 1.0), (2, T0, 2.0)], [(2, T0, 5.0), (3, None, None)])):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(src)
        ingest.into_table(ingest.file_feed(spark, src, schema), out, ["id"], str(tmp_path / "ck"))
        assert ingest.current(spark, out).count() == 2 + nth and ingest.current(spark, out).columns == ["id", "at", "v"]
    assert {r["id"]: r["v"] for r in ingest.current(spark, out).collect()} == {1: 1.0, 2: 5.0, 3: None}
    # only the buckets of the second batch's keys were written again
    assert len(list((tmp_path / "out" / "version=1").glob("__b=*"))) == 2


def test_socket_feed(spark, tmp_path):
    server = socket.create_server(("127.0.0.1", 0))
    port = server.getsockname()[1]

    def serve():
        conn, _ = server.accept()
        for i in range(5):
            conn.sendall((json.dumps({"id": i, "v": i / 2}) + "\n").encode())
        conn.sendall(b"not json\n")
        time.sleep(8)
        conn.close()

    threading.Thread(target=serve, daemon=True).start()
    schema = spark.createDataFrame([], "id long, v double").schema
    got = []
    q = ingest.socket_feed(spark, "127.0.0.1", port, schema).writeStream.foreachBatch(lambda batch, nth: got.extend(tuple(r) for r in batch.collect())).option("checkpointLocation", str(tmp_path / "ck")).start()
    end = time.time() + 30
    while len(got) < 6 and time.time() < end:
        time.sleep(0.2)
    q.stop()
    server.close()
    assert sorted(got, key=str) == sorted([(i, i / 2) for i in range(5)] + [(None, None)], key=str)


def test_kafka_needs_its_connector(spark):
    """The connector isn't part of Spark's own jars; without it both ends say so."""
    schema = spark.createDataFrame([], ROWS).schema
    with pytest.raises(Exception, match="(?i)kafka"):
        ingest.kafka_feed(spark, "127.0.0.1:1", "t", schema)
