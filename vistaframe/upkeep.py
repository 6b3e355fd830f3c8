"""Views made for what clients ask, and kept up to date."""

from __future__ import annotations

import threading
from collections.abc import Callable
from datetime import timedelta

from vistaframe.engine import Engine
from vistaframe.plans import planner
from vistaframe.registry import Info


class Upkeep:
    """Makes views after queries that none answered, appends to views what has come since, and counts datasets again."""

    def __init__(self, engine: Engine, view_age: timedelta = timedelta(minutes=30), count_age: timedelta = timedelta(minutes=30), overlap: timedelta = timedelta(0), on_error: Callable[[Exception], None] = lambda e: None) -> None:
        self.engine, self.view_age, self.count_age, self.overlap, self.on_error = engine, view_age, count_age, overlap, on_error
        self.timer: threading.Timer | None = None
        self.lock = threading.Lock()

    def after(self, request: dict) -> list[Info]:
        """What a finished request suggests is made, unless another has made it meanwhile."""
        with self.lock:
            return [self.engine.create_view(v) for v in self.engine.suggest_views(request) if planner.view_name(v) not in self.engine.registry.infos]

    def tick(self) -> list[str]:
        """The names of the views appended to and of the datasets counted again, as they were older than they may be."""
        now, done = self.engine.clock(), []
        with self.lock:
            for info in list(self.engine.registry.infos.values()):
                if info.schema.time_field is None:
                    continue
                old = now - info.stats.modified
                if info.query is not None and old >= self.view_age:
                    self.engine.refresh_view(info.name, now, self.overlap)
                elif info.query is None and old >= self.count_age:
                    self.engine.registry.refresh_stats(info.name)
                else:
                    continue
                done.append(info.name)
        return done

    def start(self, every: float = 60.0) -> None:
        """Ticks each ``every`` seconds until ``stop``."""

        def again() -> None:
            try:
                self.tick()
            except Exception as e:
                self.on_error(e)
            if self.timer is not None:
                self.start(every)

        self.timer = threading.Timer(every, again)
        self.timer.daemon = True
        self.timer.start()

    def stop(self) -> None:
        timer, self.timer = self.timer, None
        if timer is not None:
            timer.cancel()
