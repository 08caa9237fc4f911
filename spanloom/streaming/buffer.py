"""Collects small deliveries and writes them together."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import Any


class Buffer:
    """Items (with how many spans each holds) wait here until there are max_spans or
    interval_s has passed since the first of them; then `write` gets them all. One
    write runs at a time. Who adds to a full buffer writes it, so that deliveries
    slow down to what the store takes. A failed write keeps its items for the next one
    and is raised to who asked for it; the timer tells it to `failed`."""

    def __init__(self, write: Callable[[list], Any], max_spans: int, interval_s: float, failed: Callable[[Exception], None] | None = None):
        self._write, self._max, self._interval, self._failed = write, max_spans, interval_s, failed
        self._items: list = []
        self._spans = 0
        self._lock, self._writing = threading.Lock(), threading.Lock()
        self._timer: threading.Timer | None = None

    def add(self, item: Any, spans: int) -> None:
        with self._lock:
            self._items.append(item)
            self._spans += spans
            full = self._spans >= self._max
            if not full and self._timer is None:
                self._timer = threading.Timer(self._interval, self._tick)
                self._timer.daemon = True
                self._timer.start()
        if full:
            self.flush()

    def _tick(self) -> None:
        try:
            self.flush()
        except Exception as e:
            if self._failed:
                self._failed(e)

    def flush(self) -> None:
        """Returns when everything that was added before is written."""
        with self._writing:
            with self._lock:
                items, spans = self._items, self._spans
                self._items, self._spans = [], 0
                if self._timer is not None:
                    self._timer.cancel()
                    self._timer = None
            if not items:
                return
            try:
                self._write(items)
            except Exception:
                with self._lock:
                    self._items, self._spans = items + self._items, spans + self._spans
                raise
