"""Continuous ingest and aggregation with Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vistaframe.operators.dml import upsert
from vistaframe.registry import _File


def file_feed(spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet", files_per_trigger: int = 1, pattern: str | None = None) -> DataFrame:
    """The files of a folder as a stream, those there and those to come; with a pattern only those whose name it fits."""
    reader = spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def socket_feed(spark: SparkSession, host: str, port: int, schema: T.StructType) -> DataFrame:
    """JSON lines from a socket; lines that aren't JSON give null fields."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load().select(F.from_json("value", schema).alias("r")).select("r.*")


def kafka_feed(spark: SparkSession, servers: str, topic: str, schema: T.StructType) -> DataFrame:
    """JSON messages of a topic. The connector must be on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")


def kafka_sink(df: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    return df.select(F.to_json(F.struct("*")).alias("value")).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def tumbling(rows: DataFrame, time: str, width: str, keys: list[str], aggregates: dict[str, F.Column], late: str = "1 hour") -> DataFrame:
    """Aggregates of event-time bins anchored at the epoch; rows later than ``late`` are left out, those without a time too."""
    timed = rows.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    grouped = timed.groupBy(F.window("__t", width).alias("__w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return grouped.select(F.col("__w.start").alias("bin"), *keys, *aggregates)


def drain(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now and waits for it."""
    df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start().awaitTermination()


def into_table(df: DataFrame, path: str, keys: list[str], checkpoint: str, buckets: int = 64) -> None:
    """Upserts a stream into a table by key; ``current`` reads it.

    Rows lie in buckets by a hash of their key. A batch writes new versions of the buckets that it touches, and then a
    manifest that names the version of each. A batch that is run again starts from the same manifest and gives the same
    one; versions that the last but one manifest retired are removed. Of several rows of a key in a batch the largest counts.
    """
    spark = df.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        before = [m for m in _manifests(spark, path) if m["number"] < number]
        old = before[-1] if before else {"at": {}, "retired": []}
        placed = batch.withColumn("__b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        try:
            touched = sorted(r["__b"] for r in placed.select("__b").distinct().collect())
            if not touched:
                return
            there = [_bucket(path, old["at"][str(b)], b) for b in touched if str(b) in old["at"]]
            table = spark.read.schema(placed.schema).option("basePath", path).parquet(*there).select(*placed.columns) if there else placed.limit(0)
            merged = upsert(table, placed, [*keys, "__b"])
            merged.repartition("__b").write.mode("overwrite").partitionBy("__b").parquet(f"{path}/version={number}")
        finally:
            placed.unpersist()
        retired = [[old["at"][str(b)], b] for b in touched if str(b) in old["at"]]
        now = {"number": number, "at": old["at"] | {str(b): number for b in touched}, "retired": retired}
        _File(spark, f"{path}/_manifest/{number:012d}.json").write(json.dumps(now))
        for v, b in old["retired"]:
            _File(spark, _bucket(path, v, b)).delete()

    drain(df, write, checkpoint)


def _bucket(path: str, version: int, bucket: int) -> str:
    return f"{path}/version={version}/__b={bucket}"


def _manifests(spark: SparkSession, path: str) -> list[dict]:
    return sorted(map(json.loads, _File(spark, f"{path}/_manifest").texts(".json")), key=lambda m: m["number"])


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a table that ``into_table`` keeps, as of its last complete batch."""
    found = _manifests(spark, path)
    if not found:
        return None
    at = [_bucket(path, v, int(b)) for b, v in found[-1]["at"].items()]
    return spark.read.option("basePath", path).parquet(*at).drop("version", "__b")
