"""Progressive answers: the time range in slices, the newest first, each as long as the pace allows."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from statistics import NormalDist

HOUR = timedelta(hours=1)


@dataclass
class SliceModel:
    """How many hours the next slice may take, from how long earlier ones took.

    With three observations or more a straight line is fitted; its spread, weighed by ``alpha``, tells how much
    risk of being late pays.
    """

    total: int
    alpha: float
    least: int
    seen: list[tuple[int, float, float]] = field(default_factory=list)

    def learn(self, hours: int, estimate: float, actual: float) -> None:
        self.seen.append((hours, estimate, actual))

    def _clamp(self, hours: float) -> int:
        return math.ceil(max(self.least, min(math.trunc(hours), 2 * self.seen[-1][0])))

    def _line(self) -> tuple[float, float]:
        xs, ys = [s[0] for s in self.seen], [s[2] for s in self.seen]
        mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
        spread = sum((x - mx) ** 2 for x in xs)
        slope = sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / spread if spread else 0.0
        start = my - slope * mx
        tiny = 5e-324
        return (start, slope) if slope > tiny and start > tiny else (tiny, self.seen[-1][2] / self.seen[-1][0])

    def estimate(self, limit: float) -> tuple[int, float]:
        """(hours, milliseconds that they are expected to take)."""
        if not self.seen:
            return self.least, math.inf
        last_hours, _, last_actual = self.seen[-1]
        if len(self.seen) < 3:
            return self._clamp(last_hours * limit / max(last_actual, 1e-9)), math.inf
        a0, a1 = self._line()
        a1 = max(a1, 1e-9)
        if len(self.seen) <= 3:
            gaps = [(a0 + a1 * h - t) for h, _, t in self.seen]
        else:
            gaps = [e - t for _, e, t in self.seen if math.isfinite(e)]
        sigma = math.sqrt(sum(g * g for g in gaps) / len(gaps)) if gaps else 0.0
        linear = (limit - a0) / a1
        z = 2 * limit / (a1 * self.total * self.alpha) - 1
        if z < -1:
            raw = 0.0
        elif z > 0:
            raw = linear
        else:
            inverse = NormalDist().inv_cdf((z + 1) / 2) / math.sqrt(2) if z > -1 else -math.inf
            raw = min(linear, max(0.0, (math.sqrt(2) * sigma * inverse + limit - a0) / a1))
        hours = self._clamp(raw)
        return hours, float(math.trunc(hours * a1 + a0))


def slices(start: datetime, end: datetime, pace_ms: float, work: Callable[[datetime, datetime], bool], first: timedelta = timedelta(days=2), least_hours: int = 24, alpha: float = 0.00001, clock: Callable[[], float] = time.monotonic) -> Iterator[tuple[datetime, datetime, float]]:
    """Yields (slice start, slice end, share done) after ``work`` has handled each slice; it returns True to stop early."""
    model = SliceModel(max(1, math.ceil((end - start) / HOUR)), alpha, least_hours)
    limit, upper, lower, expected = float(pace_ms), end, max(start, end - first), math.inf
    while lower < upper:
        began = clock()
        stop = work(lower, upper)
        spent = (clock() - began) * 1000
        yield lower, upper, (end - lower) / (end - start)
        if stop or lower <= start:
            return
        model.learn(max(1, math.ceil((upper - lower) / HOUR)), expected, spent)
        limit = pace_ms + max(0.0, limit - spent)
        hours, expected = model.estimate(limit)
        upper, lower = lower, max(start, lower - hours * HOUR)


def paced(answers: Iterator[dict], pace_ms: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """At most one answer for each ``pace_ms``; ends with {"key": "done"}."""
    due = None
    for a in answers:
        now = clock()
        if due is not None and now < due:
            sleep(due - now)
        due = max(now, due or now) + pace_ms / 1000
        yield a
    yield {"key": "done"}
