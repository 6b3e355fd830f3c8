"""Group keys and predicates as Spark column expressions."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

ANCHOR = datetime(1990, 1, 1, tzinfo=timezone.utc)
MICROS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
CELLS = {"geoCellTenth": 10, "geoCellHundredth": 100, "geoCellThousandth": 1000}


def interval(c: Column, unit: str, x: int = 1, ntz: bool = False) -> Column:
    """Start of the bin of width ``x`` units that holds an instant; bins are counted from 1990-01-01T00:00Z, a Monday.

    The session's time zone must be UTC. The type of the instant, with or without zone, is kept.
    """
    t = c.cast("timestamp")
    if unit in MICROS:
        anchor, width = int(ANCHOR.timestamp()) * 1_000_000, MICROS[unit] * x
        at = F.unix_micros(t)
        start = F.timestamp_micros(at - F.pmod(at - F.lit(anchor), F.lit(width)))
    else:
        width = x * (12 if unit == "year" else 1)
        months = (F.year(t) - 1990) * 12 + F.month(t) - 1
        start = F.add_months(F.lit("1990-01-01").cast("date"), months - F.pmod(months, F.lit(width))).cast("timestamp")
    return start.cast("timestamp_ntz") if ntz else start


def component(c: Column, unit: str) -> Column:
    """The unit's part of an instant: hour of the day, month of the year and so on; for a day its date."""
    part = {"second": F.second, "minute": F.minute, "hour": F.hour, "week": F.weekofyear, "month": F.month, "year": F.year}
    return c.cast("date") if unit == "day" else part[unit](c)


def interval_text(c: Column, unit: str) -> Column:
    """An instant as text, cut off after the unit; for a week its number within the year."""
    form = {"second": "yyyy-MM-dd HH:mm:ss", "minute": "yyyy-MM-dd HH:mm", "hour": "yyyy-MM-dd HH", "day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}
    return F.weekofyear(c).cast("string") if unit == "week" else F.date_format(c, form[unit])


def word_tokens(c: Column) -> Column:
    """The words of a text in lower case: its runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def similarity_jaccard(a: Column, b: Column) -> Column:
    """The share of the different elements of two arrays that both have; 0 where both are empty."""
    every = F.size(F.array_union(a, b))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(every > 0, F.size(F.array_intersect(a, b)) / every).otherwise(0.0))


def bin_number(c: Column, scale: float) -> Column:
    """The nearest multiple of ``scale``, halves away from zero."""
    return F.round(c.cast("double") / F.lit(float(scale))) * F.lit(float(scale))


def geo_cell(c: Column, func: str, truncate: bool = False) -> Column:
    """Lower left corner of a point's grid cell; with ``truncate`` the corner nearer to (0, 0). Null for a null point."""
    n = F.lit(float(CELLS[func]))

    def snap(v: Column) -> Column:
        scaled = v.cast("double") * n
        return (F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)) if truncate else F.floor(scaled)).cast("double") / n

    return F.when(c.isNotNull(), F.struct(snap(c["x"]).alias("x"), snap(c["y"]).alias("y")))


def all_words(c: Column, words: tuple[str, ...], mode: str = "substring") -> Column:
    """Whether a text has all the words, whatever their case: anywhere in it, or (mode token) as whole words."""
    low = F.lower(c)
    out = F.lit(True)
    for w in (p for v in words for p in v.lower().split()):
        out = out & (low.contains(w) if mode == "substring" else F.array_contains(F.split(low, r"[^\p{L}\p{N}]+"), w))
    return out


def time_literal(t: datetime, ntz: bool) -> Column:
    """A literal of the column's own type, so that the comparison reaches the scan."""
    text = t.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp_ntz") if ntz else F.lit(text + "Z").cast("timestamp")
