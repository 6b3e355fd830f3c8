"""What a client that draws maps and series keeps between requests, by region."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaframe.storage import shared_folder


class SeriesCache:
    """Daily counts (region, day, count) of the regions asked for so far, for one choice of words and one level.

    Only regions that aren't held need to be asked for. Other words or another level, a longer range of days, or more
    than ``most`` regions empty it. Rows live in the shared folder; the driver holds the names of the regions.
    """

    def __init__(self, most: int = 3222) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.about: tuple | None = None
        self.start: date | None = None
        self.end: date | None = None
        self.known: set = set()
        self.rows: DataFrame | None = None

    def missing(self, words: Iterable[str], level: str, start: date, end: date, regions: Iterable) -> list:
        """The regions that must be asked for, all of them where nothing that is held serves."""
        regions, about = list(regions), (tuple(words), level)
        if self.about != about or self.start is None or start < self.start or end > self.end:
            self.clear()
            self.about = about
            return regions
        found = [r for r in regions if r not in self.known]
        if len(self.known) + len(found) > self.most:
            self.clear()
            self.about = about
            return regions
        return found

    def put(self, regions: Iterable, rows: DataFrame, start: date, end: date) -> None:
        """Keeps the answer for regions; those without a row are known to have none. A range shorter than what is held isn't kept."""
        if self.start is not None and (start > self.start or end < self.end):
            return
        shared_folder(rows.sparkSession)
        new = rows.select("region", F.to_date("day").alias("day"), F.col("count").cast("long").alias("count"))
        self.rows = (new if self.rows is None else self.rows.unionByName(new)).checkpoint()
        self.known |= set(regions)
        self.start, self.end = start, end

    def series(self, regions: Iterable, start: date, end: date) -> DataFrame:
        """(region, day, count) of regions that are held, from ``start`` to ``end``, both included."""
        if self.rows is None:
            raise KeyError("nothing is held")
        return self.rows.where(F.col("region").isin(*regions) & F.col("day").between(F.lit(start), F.lit(end)))

    def histogram(self, regions: Iterable, start: date, end: date) -> DataFrame:
        """(day, count) over all the regions."""
        return self.series(regions, start, end).groupBy("day").agg(F.sum("count").alias("count"))

    def count_map(self, regions: Iterable, start: date, end: date, population: DataFrame) -> DataFrame:
        """(region, count, population) of each region that has any row, from the series alone."""
        if self.rows is None:
            raise KeyError("nothing is held")
        inside = F.when(F.col("day").between(F.lit(start), F.lit(end)), F.col("count")).otherwise(0)
        sums = self.rows.where(F.col("region").isin(*regions)).groupBy("region").agg(F.sum(inside).alias("count"))
        known = population.groupBy("region").agg(F.max("population").alias("population"))
        return sums.join(known, "region", "left").select("region", "count", "population")


class RegionCache:
    """Rows by region, as of map results or populations: asked for once, kept in the shared folder, emptied beyond ``most`` regions or when what they are about changes."""

    def __init__(self, most: int = 100_000) -> None:
        self.most, self.about, self.known, self.rows = most, None, set(), None

    def missing(self, about: object, regions: Iterable) -> list:
        regions = list(regions)
        found = [r for r in regions if r not in self.known]
        if about != self.about or len(self.known) + len(found) > self.most:
            self.about, self.known, self.rows = about, set(), None
            return regions
        return found

    def put(self, regions: Iterable, rows: DataFrame) -> None:
        shared_folder(rows.sparkSession)
        self.rows = (rows if self.rows is None else self.rows.unionByName(rows)).checkpoint()
        self.known |= set(regions)

    def get(self, regions: Iterable) -> DataFrame:
        if self.rows is None:
            raise KeyError("nothing is held")
        return self.rows.where(F.col("region").isin(*regions))
