"""Datasets and views: their schemas, where their rows are, and what is known about them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaframe.errors import RegistryError, UnknownDataset
from vistaframe.ir import Query
from vistaframe.plans.lower import Scope
from vistaframe.plans.parser import parse, to_json
from vistaframe.storage import read_files
from vistaframe.types import Schema

LOOKUP_ROWS, LOOKUP_START, LOOKUP_END = 1000, datetime(1970, 1, 1), datetime(2048, 1, 1)


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


@dataclass(frozen=True)
class Stats:
    created: datetime
    modified: datetime
    read: datetime
    cardinality: int
    rate: float = 0.0


@dataclass(frozen=True)
class Info:
    """A dataset, or, with the query that makes it, a view. ``start`` and ``end`` bound the times it holds."""

    name: str
    schema: Schema
    start: datetime | None
    end: datetime | None
    stats: Stats
    query: Query | None = None
    path: str | None = None


def measure(df: DataFrame, schema: Schema) -> tuple[datetime | None, datetime | None, int]:
    """Smallest and largest time, and the rows, in one pass."""
    scope = Scope.of(df, schema)
    t = scope.columns[schema.time_field]
    r = scope.df.agg(F.min(t).alias("a"), F.max(t).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return r["a"], r["b"], r["n"]


class Registry:
    """With ``root`` the registry is a folder of JSON files, one for each entry, that a later session can load."""

    def __init__(self, spark: SparkSession, root: str | None = None, clock: Callable[[], datetime] = utc_now) -> None:
        self.spark, self.root, self.clock = spark, root, clock
        self.infos: dict[str, Info] = {}
        self.tables: dict[str, DataFrame] = {}
        if root:
            self._load()

    def info(self, name: str) -> Info:
        if name not in self.infos:
            raise UnknownDataset(name)
        return self.infos[name]

    def schema(self, name: str) -> Schema:
        return self.info(name).schema

    def table(self, name: str) -> DataFrame:
        info = self.info(name)
        if name not in self.tables:
            self.tables[name] = read_files(self.spark, info.path, info.schema.struct())
        return self.tables[name]

    def register(self, name: str, schema: Schema, source: DataFrame | str) -> Info:
        if name in self.infos:
            raise RegistryError(f"register denied: dataset {name} exists already")
        df = self.spark.read.parquet(source) if isinstance(source, str) else source
        now = self.clock()
        if schema.time_field:
            try:
                start, end, n = measure(df, schema)
            except Exception as e:
                raise RegistryError(f"register denied: statistics of {name} can't be taken: {e}") from e
        else:
            start, end, n = LOOKUP_START, LOOKUP_END, LOOKUP_ROWS
        self.tables[name] = df
        self.put(Info(name, schema, start, end, Stats(now, now, now, n), path=source if isinstance(source, str) else None))
        return self.infos[name]

    def deregister(self, name: str) -> list[str]:
        """Removes a dataset and the views on it; what it returns names all of them."""
        if name not in self.infos:
            raise RegistryError(f"deregister denied: dataset {name} does not exist")
        gone = [name, *(v.name for v in self.views(name))]
        for n in gone:
            self.drop(n)
        return gone

    def put(self, info: Info) -> None:
        self.infos[info.name] = info
        if self.root and info.path:
            self._file(info.name).write(json.dumps(self._encode(info)))

    def drop(self, name: str) -> None:
        info = self.infos.pop(name)
        self.tables.pop(name, None)
        if self.root:
            self._file(name).delete()
        if info.query is not None and info.path:
            _File(self.spark, info.path).delete()

    def remove(self, path: str) -> None:
        """Deletes a folder of files, if it is there."""
        _File(self.spark, path).delete()

    def views(self, dataset: str) -> list[Info]:
        return [i for i in self.infos.values() if i.query is not None and i.query.dataset == dataset]

    def datasets(self) -> list[Info]:
        return [i for i in self.infos.values() if i.query is None]

    def refresh_stats(self, name: str) -> Info:
        """Counts again; the rate is what has come since the last count, per second."""
        info, now = self.info(name), self.clock()
        start, end, n = measure(self.table(name), info.schema)
        seconds = (now - info.stats.modified).total_seconds()
        rate = max(0, n - info.stats.cardinality) // seconds if seconds >= 1 else info.stats.rate
        self.put(replace(info, start=start, end=end, stats=replace(info.stats, modified=now, cardinality=n, rate=rate)))
        return self.infos[name]

    def _file(self, name: str) -> _File:
        return _File(self.spark, f"{self.root}/{name}.json")

    def _encode(self, i: Info) -> dict:
        t = lambda x: x.isoformat() if x else None
        s = i.stats
        return {
            "name": i.name, "schema": i.schema.to_json(), "dataInterval": {"start": t(i.start), "end": t(i.end)}, "path": i.path, "createQuery": to_json(i.query) if i.query else None,
            "stats": {"createTime": t(s.created), "lastModifyTime": t(s.modified), "lastReadTime": t(s.read), "cardinality": s.cardinality, "rate": s.rate},
        }

    def _load(self) -> None:
        t = lambda x: datetime.fromisoformat(x) if x else None
        entries = [json.loads(x) for x in _File(self.spark, self.root).texts(".json")]
        for j in sorted(entries, key=lambda j: j["stats"]["createTime"]):
            s = j["stats"]
            stats = Stats(t(s["createTime"]), t(s["lastModifyTime"]), t(s["lastReadTime"]), s["cardinality"], s["rate"])
            query = parse(j["createQuery"]).queries[0] if j["createQuery"] else None
            self.infos[j["name"]] = Info(j["name"], Schema.from_json(j["schema"]), t(j["dataInterval"]["start"]), t(j["dataInterval"]["end"]), stats, query, j["path"])


class _File:
    """A file of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, text: str) -> None:
        out = self.fs.create(self.path, True)
        out.write(bytearray(text.encode()))
        out.close()

    def delete(self) -> None:
        self.fs.delete(self.path, True)

    def texts(self, suffix: str) -> list[str]:
        if not self.fs.exists(self.path):
            return []
        out = []
        for s in self.fs.listStatus(self.path):
            if s.getPath().getName().endswith(suffix):
                stream = self.fs.open(s.getPath())
                out.append(bytes(stream.readAllBytes()).decode())
                stream.close()
        return out
