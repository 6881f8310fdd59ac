"""What keeps cycles apart and people in charge (CYC-05, CYC-09, CYC-11, CYC-13, GOV-07, DAT-08): small state of the driver and of tables."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager, suppress
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.maintain import upserted

_lock = threading.Lock()


@contextmanager
def single_cycle():
    """One cycle at a time in this process. (CYC-11)"""
    if not _lock.acquire(blocking=False):
        raise RuntimeError("a cycle is running")
    try:
        yield
    finally:
        _lock.release()


class Marker:
    """A heartbeat file that says which driver is at work; a stale one is taken over. (CYC-09)"""

    def __init__(self, path: str, stale_s: float = 900, clock: Callable[[], float] = time.time):
        self.path, self.stale_s, self.clock, self.owner = path, stale_s, clock, f"{os.getpid()}-{uuid.uuid4().hex}"

    def read(self) -> dict | None:
        try:
            with open(self.path, encoding="utf-8") as f:
                return json.load(f)
        except (OSError, ValueError):
            return None

    def beat(self) -> None:
        temporary = f"{self.path}.{self.owner}"
        with open(temporary, "w", encoding="utf-8") as f:
            json.dump({"owner": self.owner, "at": self.clock()}, f)
        os.replace(temporary, self.path)

    def acquire(self) -> str:
        """acquired, skipped (another is alive) or taken_over (another was, and is stale)."""
        try:
            with open(self.path, "x", encoding="utf-8") as f:
                json.dump({"owner": self.owner, "at": self.clock()}, f)
            return "acquired"
        except FileExistsError:
            now = self.read()
        if now is not None and now.get("owner") == self.owner:
            self.beat()
            return "acquired"
        if not self._stale(now):
            return "skipped"
        return "taken_over" if self._take_over(now) else "skipped"

    def _stale(self, now: dict | None) -> bool:
        if now is not None:
            return self.clock() - now.get("at", 0) >= self.stale_s
        try:
            return time.time() - os.stat(self.path).st_mtime >= self.stale_s  # broken, or not yet written by the one that made it
        except OSError:
            return True

    def _take_over(self, found: dict | None) -> bool:
        """Replace a stale marker: of several drivers that found it, one holds the claim, and it looks again before it writes."""
        claim = f"{self.path}.claim"
        try:
            open(claim, "x").close()
        except FileExistsError:
            with suppress(OSError):
                if time.time() - os.stat(claim).st_mtime >= self.stale_s:  # whoever held it is gone; the next call may have it
                    os.remove(claim)
            return False
        try:
            if self.read() != found:
                return False
            self.beat()
            return True
        finally:
            os.remove(claim)

    def release(self) -> None:
        now = self.read()
        if now is not None and now.get("owner") == self.owner:
            os.remove(self.path)


def deadline(text: str | None) -> datetime | None:
    """A point in time; without a zone it is UTC. (DAT-08)"""
    if not text:
        return None
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def queued(items: DataFrame) -> DataFrame:
    """Review items, pending. (GOV-07)"""
    return items.withColumn("status", F.lit("pending")).withColumn("resolution", F.lit(None).cast("string"))


def pending(queue: DataFrame) -> DataFrame:
    return queue.where("status = 'pending'")


def resolved(queue: DataFrame, decisions: DataFrame, key: str = "item_id") -> DataFrame:
    """The queue after decisions(key, resolution, ordinal); the last decision of an item counts. (GOV-07)"""
    last = decisions.groupBy(key).agg(F.max_by("resolution", "ordinal").alias("_r"))
    met = queue.join(last, key, "left")
    return met.withColumn("status", F.when(F.col("_r").isNotNull(), "resolved").otherwise(F.col("status"))).withColumn("resolution", F.coalesce("_r", "resolution")).drop("_r").select(*queue.columns)


def walk(nodes: list[tuple[str, Callable[[dict], dict]]], state: dict, allowed: Callable[[str], bool]) -> tuple[dict, list[str]]:
    """Run stages in order on a state of tables; a stage that policy does not allow ends the run. (CYC-05)"""
    done: list[str] = []
    for name, work in nodes:
        if not allowed(name):
            return state | {"halted_at": name}, done
        state = state | work(state)
        done.append(name)
    return state, done


def refreshed(old: DataFrame, changed: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Derived rows after a release: only those of changed keys are new. (CYC-13)"""
    return upserted(old, changed, key, ordinal)
