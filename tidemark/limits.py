"""Limits on queries: how many run and wait at once, and how long one may take."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


class Busy(RuntimeError):
    """No place was free; reason is "queue full" or "wait timeout"."""

    def __init__(self, reason: str, waited: float):
        super().__init__(f"{reason} after {waited:.3f} s")
        self.reason, self.waited = reason, waited


class QueryTimeout(TimeoutError):
    pass


class Admission:
    """At most `active` queries run and at most `queue` more wait, each for `wait` seconds at most.

    counts: how many were admitted and how many turned away, by reason. With active = 0 nothing is limited.
    """

    def __init__(self, active: int, queue: int = 0, wait: float = 1.0):
        self.active, self.queue, self.wait = active, queue, wait
        self.running = self.waiting = 0
        self.counts = {"admitted": 0, "queue full": 0, "wait timeout": 0}
        self._turn = threading.Condition()

    @contextmanager
    def place(self):
        """Holds a place while the block runs."""
        if not self.active:
            yield
            return
        began = time.monotonic()
        with self._turn:
            if self.running >= self.active:
                if self.waiting >= self.queue:
                    self.counts["queue full"] += 1
                    raise Busy("queue full", 0.0)
                self.waiting += 1
                try:
                    free = self._turn.wait_for(lambda: self.running < self.active, self.wait)
                finally:
                    self.waiting -= 1
                if not free:
                    self.counts["wait timeout"] += 1
                    raise Busy("wait timeout", time.monotonic() - began)
            self.running += 1
            self.counts["admitted"] += 1
        try:
            yield
        finally:
            with self._turn:
                self.running -= 1
                self._turn.notify()


def within_time(spark: SparkSession, work: Callable[[], T], seconds: float | None) -> T:
    """work(), whose jobs are cancelled after so many seconds; then QueryTimeout. None: no limit."""
    if seconds is None:
        return work()
    tag, late = f"limit-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        out = work()
    except Exception as e:
        if late.is_set():
            raise QueryTimeout(f"stopped after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
    if late.is_set():
        raise QueryTimeout(f"stopped after {seconds} s")
    return out
