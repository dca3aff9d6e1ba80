"""Periodic sync: counters made durable, a step of collection between full syncs."""

from __future__ import annotations

import logging
import threading

from ..plans.collection import Collection
from .writes import WriteService

log = logging.getLogger(__name__)


class SyncService:
    """Runs sync cycles over a collection's store; ``counters`` are the session's, such as the active pack or read errors.

    Applied writes and commits are durable when they return, so a cycle has only counters to write.
    """

    def __init__(self, store: Collection, writes: WriteService | None = None):
        self.store, self.writes = store, writes
        self.counters: dict[str, int] = {}
        self.idle, self.errors = True, 0
        self._lock, self._stop, self._worker = threading.Lock(), threading.Event(), None

    def cycle(self, full: bool) -> str:
        """Commits the counters that changed; unless it is a full sync, one step of collection follows."""
        with self._lock:
            state = self.store.state()
            changed = {f"counter.{k}": str(v) for k, v in self.counters.items() if state.get(f"counter.{k}") != str(v)}
            if changed:
                self.store.commit({}, **changed)
            return "synced" if full else self.store.step(self.idle)

    def fsync(self, data_only: bool = False) -> str:
        """All writes put in before are applied, then a cycle; a full one unless only data are asked for."""
        if self.writes is not None:
            self.writes.drain()
        return self.cycle(full=not data_only)

    def start(self, seconds: float) -> None:
        """Cycles in the background at once and then every ``seconds``; an error is logged and doesn't end them."""

        def run() -> None:
            while not self._stop.is_set():
                try:
                    self.cycle(full=False)
                except Exception:
                    self.errors += 1
                    log.warning("background sync cycle failed", exc_info=True)
                self._stop.wait(seconds)

        self._worker = threading.Thread(target=run, daemon=True)
        self._worker.start()

    def shutdown(self) -> None:
        """Ends the background cycles and the write service, then a last full sync, whose error is raised."""
        self._stop.set()
        if self._worker is not None:
            self._worker.join()
        if self.writes is not None:
            self.writes.shutdown()
        self.cycle(full=True)
