"""A client's running requests: answers as they come at the requested pace, standing queries, and cancelling."""

from __future__ import annotations

import queue
import threading
import time
import uuid
from collections.abc import Callable

from pyspark import InheritableThread

from vistaframe.engine import Engine, _wrapped
from vistaframe.plans.parser import parse

DONE = {"key": "done"}


class Reporter:
    """Hands answers on at one for each ``pace`` seconds.

    Answers that come faster wait; with ``every`` all of them are handed on, else only the newest of those waiting. When
    one is due and none is there, the reporter is hungry: the next is handed on as soon as it comes. After the last
    answer nothing is held back any longer, and {"key": "done"} follows.
    """

    def __init__(self, out: Callable[[object], None], pace: float, every: bool = False, clock: Callable[[], float] = time.monotonic) -> None:
        self.out, self.pace, self.every, self.clock = out, pace, every, clock
        self.waiting: queue.Queue = queue.Queue()

    def put(self, answer: object) -> None:
        self.waiting.put((answer, False))

    def close(self) -> None:
        self.waiting.put((None, True))

    def run(self, stopped: threading.Event) -> None:
        held: list[object] = []
        due, ended = self.clock(), False
        while not stopped.is_set() and not ended:
            left = due - self.clock()
            try:
                # hungry without an answer, else until the next one is due
                answer, ended = self.waiting.get(timeout=max(0.0, left) if held else 0.2)
                if not ended:
                    held = [*held, answer] if self.every else [answer]
            except queue.Empty:
                pass
            if held and not ended and self.clock() >= due:
                self.out(held.pop(0))
                due = self.clock() + self.pace
        if not stopped.is_set():
            for answer in held:
                self.out(answer)
            self.out(DONE)


class Session:
    """Requests of one client. A new request of a category cancels the one that runs in it, its Spark jobs too."""

    def __init__(self, engine: Engine, after: Callable[[dict], None] | None = None) -> None:
        self.engine, self.after = engine, after
        self.running: dict[str, tuple[threading.Event, str, threading.Thread]] = {}
        self.lock = threading.Lock()

    def cancel(self, category: str) -> bool:
        with self.lock:
            found = self.running.pop(category, None)
        if found is None:
            return False
        found[0].set()
        self.engine.spark.sparkContext.cancelJobsWithTag(found[1])
        return True

    def close(self) -> None:
        for category in list(self.running):
            self.cancel(category)

    def submit(self, request: dict, out: Callable[[object], None]) -> threading.Thread:
        """Runs a request in the background. Answers, wrapped as asked, go to ``out``; errors as {"error": text}.

        A sliced request reports as its slices come. With ``continueSeconds`` the request stays: it is answered again
        each so many seconds, and reported when the answer has changed, until it is cancelled.
        """
        category = ((request.get("transform") or {}).get("wrap") or {}).get("category", uuid.uuid4().hex)
        self.cancel(category)
        stopped, tag = threading.Event(), f"vistaframe-{uuid.uuid4().hex}"
        thread = InheritableThread(target=self._run, args=(request, out, stopped, tag, category), daemon=True)
        with self.lock:
            self.running[category] = stopped, tag, thread
        thread.start()
        return thread

    def _run(self, request: dict, out: Callable[[object], None], stopped: threading.Event, tag: str, category: str) -> None:
        context = self.engine.spark.sparkContext
        context.addJobTag(tag)
        transform = request.get("transform")
        try:
            r = parse(request)
            last = self._sliced(r, out, stopped, transform) if r.option.slice_millis > 0 else self._once(request, out, stopped)
            while r.option.continue_seconds > 0 and not stopped.wait(r.option.continue_seconds):
                now = self._answer(request)
                if now != last and not stopped.is_set():
                    out(now)
                last = now
            if self.after and not stopped.is_set():
                self.after({k: v for k, v in request.items() if k not in ("option", "transform")})
        except Exception as e:
            if not stopped.is_set():
                out({"error": str(e).split("\n")[0]})
        finally:
            context.removeJobTag(tag)
            with self.lock:
                if self.running.get(category, (None,))[0] is stopped:
                    del self.running[category]

    def _answer(self, request: dict) -> object:
        return self.engine.run({k: v for k, v in request.items() if k != "option"})

    def _once(self, request: dict, out: Callable[[object], None], stopped: threading.Event) -> object:
        found = self._answer(request)
        if not stopped.is_set():
            out(found)
        return found

    def _sliced(self, r, out: Callable[[object], None], stopped: threading.Event, transform: dict | None) -> object:
        reporter = Reporter(lambda a: out(a if a is DONE else _wrapped(a, transform)), r.option.slice_millis / 1000, r.option.return_delta)
        reporting = threading.Thread(target=reporter.run, args=(stopped,), daemon=True)
        reporting.start()
        last = None
        try:
            for answer in self.engine.progressive(r, cancelled=stopped.is_set):
                last = answer
                reporter.put(answer)
        finally:
            reporter.close()
            reporting.join()
        return last
