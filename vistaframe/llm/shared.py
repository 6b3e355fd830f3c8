"""Places that outlive an executor, and totals along an order without a single-task sort."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir. Unset, a session in one process gets a folder of its own; all others must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        folder = tempfile.mkdtemp(prefix="vistaframe-")
        atexit.register(shutil.rmtree, folder, True)
        _own[app] = f"file://{folder}"
    return _own[app]


def cut(df: DataFrame) -> DataFrame:
    """The rows computed once and kept in the shared folder until nothing refers to them."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return df.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint where the counted rows are few; else Spark's shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def hex_range(hex_col, digits: int = 3):
    """The first hexadecimal digits of a hash as a small number, for sub-ordering."""
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("int")


def running_start(df: DataFrame, group: list[str], sub: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group that come before, in the order (sub, *order).

    Two levels keep the sorts small: totals of (group, sub) give each such slice its offset, and only
    within a slice are rows sorted, so a hot group is spread over all its slices. ``df`` is read twice;
    hand over something that is cheap or cut.
    """
    totals = df.groupBy(*group, sub).agg(F.sum(value).alias("_t"))
    by_sub = Window.partitionBy(*group).orderBy(sub)
    offsets = totals.select(*group, sub, (F.sum("_t").over(by_sub) - F.col("_t")).alias("_o"))
    within = Window.partitionBy(*group, sub).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = df.withColumn("_r", F.sum(value).over(within) - F.col(value))
    same = [inside[c].eqNullSafe(offsets[c]) for c in [*group, sub]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    keep = [inside[c] for c in df.columns]
    return inside.join(offsets, cond).select(*keep, (F.col("_r") + F.col("_o")).alias(out))


def _plain_scan(df: DataFrame) -> bool:
    """Whether each reading gives the same rows to the same tasks: files, and at most columns and rows left out."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() not in ("Project", "Filter", "LogicalRelation", "Union"):
            return False
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return True


@contextmanager
def steady_splits(spark):
    """Scan tasks that don't depend on how many executors there are just now."""
    name = "spark.sql.files.minPartitionNum"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, old) if old else spark.conf.unset(name)


def steady(df: DataFrame) -> DataFrame:
    """The rows as a plain scan of files, so that every reading, a retried task's too, gives the same rows in the same order."""
    if _plain_scan(df):
        return df
    path = fresh_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


BUCKET_BYTES = 6 << 20


def input_bytes(df: DataFrame) -> int:
    """The size of the files that a plain scan reads; only the driver's list of files is looked at."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def bucket_bits(df: DataFrame) -> int:
    """Binary digits of the number of buckets: one for each BUCKET_BYTES that a plain scan reads, so that a bucket's share stays the same until 2**20 of them."""
    return max(4, min(20, (-(-input_bytes(df) // BUCKET_BYTES)).bit_length()))


def slot_count(df: DataFrame) -> int:
    """Number of folders for what the pieces of a plain scan are told: about one for each of its tasks."""
    return max(16, min(1 << 16, df._jdf.queryExecution().toRdd().getNumPartitions()))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column of unique numbers that aren't null, and its name: the doc_ids, if they are such themselves.

    Else a copy with numbers in the order of doc_id (nulls first) and a hash of the text goes to the shared folder.
    """
    name = free_name(docs, "_key")
    n = docs.agg(F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("ids"), F.count_distinct("doc_id").alias("d")).first()
    if n["rows"] == n["ids"] == n["d"]:
        return docs.withColumn(name, F.col("doc_id").cast("long")), name
    path = fresh_path(docs.sparkSession, "keyed")
    docs.orderBy("doc_id", F.xxhash64("text")).withColumn(name, F.monotonically_increasing_id()).write.parquet(path)
    return docs.sparkSession.read.parquet(path), name
