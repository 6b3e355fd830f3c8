"""Fewer points of a series for drawing."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistaframe.storage import shared_folder


def decimate(rows: DataFrame, order: list[str], most: int = 2000) -> DataFrame:
    """Every k-th row in the given order, k = rows / most rounded down, counting from the first; all rows if there are no more than ``most``.

    Positions come from range partitions and their sizes, so no task sorts the whole series. The partitions are kept in
    the shared folder, as both readings must see the same ones. Rows that are equal in the order may take any of their places.
    """
    n = rows.count()
    step = n // most
    if n <= most or step < 2:
        return rows
    shared_folder(rows.sparkSession)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).checkpoint()
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    start = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return ranged.join(F.broadcast(start), "__part").where((F.col("__at") + F.col("__start")) % step == 0).drop("__part", "__at", "__start")


def random_sample(rows: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """``size`` rows picked by the hash md5(seed:key), the same ones whenever the rows are the same. Null keys hash as the empty text."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), key).limit(size)


def time_means(rows: DataFrame, time: str, value: str, millis: int) -> DataFrame:
    """(bucket, mean): the mean of a value in time buckets of ``millis`` milliseconds from the epoch on."""
    at = F.unix_millis(F.col(time).cast("timestamp"))
    return rows.groupBy(F.timestamp_millis(at - F.pmod(at, F.lit(millis))).alias("bucket")).agg(F.avg(value).alias("mean"))


RATIOS = (0.025, 0.05, 0.1, 0.2, 0.4, 0.6)


def sample_ratios(rows: DataFrame, key: str, order: str, value: str, ratios: tuple[float, ...] = RATIOS, most: float = 1.0, segments: int = 16, letters: int = 8) -> DataFrame:
    """(key, ratio): for each series the smallest ratio whose even sample, interpolated again, is within ``most`` of the series; the largest if none is.

    The distance is that of symbols: z-normalised means of ``segments`` stretches between Gaussian breakpoints, neighbouring
    symbols being equal. Series shorter than ``segments`` rows get the largest ratio. Rows with a null order or value are left
    out; ties of the order are broken by value. A series is sorted by one task, which spills if it must, and never collected.
    """
    ratios = tuple(sorted(ratios))
    by = Window.partitionBy(key)
    line = by.orderBy("o", "v")
    base = rows.select(F.col(key), F.col(order).alias("o"), F.col(value).cast("double").alias("v")).where("o is not null and v is not null")
    placed = base.withColumn("p", F.row_number().over(line).cast("long") - 1).withColumn("n", F.count(F.lit(1)).over(by))
    before, after = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(0, Window.unboundedFollowing)
    p, n = F.col("p"), F.col("n")
    for i, r in enumerate(ratios):
        # position p is among floor(j (n - 1) / (m - 1)) for j below m
        m = F.greatest(F.lit(2), F.round(n * r).cast("long"))
        j = -F.floor(-(p * (m - 1)) / F.greatest(n - 1, F.lit(1)))
        kept = F.floor(j * (n - 1) / (m - 1)) == p
        spot = F.when(kept, F.struct("p", "v"))
        left, right = F.last(spot, True).over(before), F.first(spot, True).over(after)
        placed = placed.withColumns({f"__l{i}": left, f"__r{i}": right})
        gap = F.col(f"__r{i}.p") - F.col(f"__l{i}.p")
        drawn = F.col(f"__l{i}.v") + F.when(gap > 0, (p - F.col(f"__l{i}.p")) * (F.col(f"__r{i}.v") - F.col(f"__l{i}.v")) / gap).otherwise(0.0)
        placed = placed.withColumn(f"d{i}", drawn).drop(f"__l{i}", f"__r{i}")
    series = ["v", *(f"d{i}" for i in range(len(ratios)))]
    whole = placed.groupBy(key).agg(F.first("n").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in series], *[F.stddev_pop(c).alias(f"s_{c}") for c in series])
    part = F.floor(((p + 1) * segments - 1) / n)
    means = placed.groupBy(key, part.alias("part")).agg(*[F.avg(c).alias(c) for c in series]).join(whole, key)
    breaks = [NormalDist().inv_cdf(i / letters) for i in range(1, letters)]
    above = lambda z: sum((F.when(z > b, 1).otherwise(0) for b in breaks), F.lit(0))
    spread = lambda c: F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0)
    marked = means.select(key, "n", *[above((F.col(c) - F.col(f"m_{c}")) / spread(c)).alias(c) for c in series])
    at = F.array(*map(F.lit, breaks))

    def gap2(c: str) -> Column:
        lo, hi = F.least("v", c), F.greatest("v", c)
        return F.when(hi - lo > 1, F.pow(F.get(at, hi - 1) - F.get(at, lo), F.lit(2.0))).otherwise(0.0)

    far = marked.groupBy(key).agg(F.first("n").alias("n"), *[F.sum(gap2(c)).alias(c) for c in series[1:]])
    fits = [F.when((n >= segments) & (F.sqrt(n / segments * F.col(f"d{i}")) <= most), r) for i, r in enumerate(ratios)]
    return far.select(key, F.coalesce(*fits, F.lit(ratios[-1])).alias("ratio"))
