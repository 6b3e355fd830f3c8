"""The folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistaframe.errors import EngineError

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names, also set as the place of checkpoints. Unset, a session in one process gets one of its own; all others must set it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise EngineError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _own:
            path = tempfile.mkdtemp(prefix="vistaframe-")
            atexit.register(shutil.rmtree, path, True)
            _own[context.applicationId] = f"file://{path}"
        folder = _own[context.applicationId]
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


#: The column of folders that ``write_by_time`` makes.
DAY = "__day"


def write_by_time(df: DataFrame, path: str, time: Column) -> None:
    """Writes rows in folders by day, and in order of time within each file, so that a slice of time opens the folders and row groups it needs.

    Ranges of time are spread evenly over tasks, so that a day with many rows is written by several.
    """
    days = df.withColumn(DAY, F.to_date(time)).repartitionByRange(time)
    days.sortWithinPartitions(DAY, time).write.mode("overwrite").partitionBy(DAY).parquet(path)


def read_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table; one without rows may have no files to take a schema from, and has the one given."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return spark.createDataFrame([], schema)
