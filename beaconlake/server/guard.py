"""What keeps queries from crowding each other out: slots, time limits and keys."""

from __future__ import annotations

import contextlib
import hmac
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

from pyspark.sql import SparkSession

from beaconlake.plans.model import ApiError
from beaconlake.server.metrics import Metrics

R = TypeVar("R")
CHEAP, HEAVY = "cheap", "heavy"


class Admission:
    """Slots of two classes, so that heavy queries never take the last cheap slot."""

    def __init__(self, concurrency: int, cheap: int, wait_seconds: float, metrics: Metrics) -> None:
        cheap = max(1, min(cheap, concurrency - 1))
        self.capacity = {CHEAP: cheap, HEAVY: max(1, concurrency - cheap)}
        self.in_use = {CHEAP: 0, HEAVY: 0}
        self.rejections = 0
        self.wait, self.metrics = wait_seconds, metrics
        self._free = threading.Condition()

    @contextlib.contextmanager
    def slot(self, kind: str) -> Iterator[None]:
        with self._free:
            if not self._free.wait_for(lambda: self.in_use[kind] < self.capacity[kind], self.wait):
                self.rejections += 1
                reason = f"{kind}_query_admission_full"
                self.metrics.count("admission_rejections_total", admission=kind, reason=reason)
                raise ApiError(429, reason, f"all {self.capacity[kind]} {kind} query slots are taken", retry_after=1)
            self.in_use[kind] += 1
        try:
            yield
        finally:
            with self._free:
                self.in_use[kind] -= 1
                self._free.notify_all()

    def snapshot(self) -> dict:
        with self._free:
            kinds = {k: {"capacity": self.capacity[k], "in_use": self.in_use[k]} for k in (CHEAP, HEAVY)}
            return kinds | {"rejections_total": self.rejections}

    def record(self) -> None:
        for kind in (CHEAP, HEAVY):
            self.metrics.gauge("admission_capacity", self.capacity[kind], admission=kind)
            self.metrics.gauge("admission_in_use", self.in_use[kind], admission=kind)


def timed(spark: SparkSession, seconds: float, run: Callable[[], R]) -> R:
    """run(), whose jobs are cancelled when time is up. A query that ends just after its time has failed, too."""
    sc, tag = spark.sparkContext, f"query-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    began = time.monotonic()
    try:
        value = run()
    except ApiError:
        raise
    except Exception as error:
        if late.is_set():
            raise ApiError(503, "query_timeout", f"the query took more than {seconds:g} s") from error
        raise ApiError(503, "query_storage_unavailable", f"the query failed: {str(error).splitlines()[0]}") from error
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
    if late.is_set() or time.monotonic() - began > seconds:
        raise ApiError(503, "query_timeout", f"the query took more than {seconds:g} s")
    return value


def check_key(headers: dict[str, str], expected: str) -> None:
    """A bearer token or x-api-key; compared in constant time, and an empty key never fits."""
    scheme, _, token = headers.get("authorization", "").partition(" ")
    given = token.strip() if scheme.lower() == "bearer" and token.strip() else headers.get("x-api-key", "").strip()
    if not given:
        raise ApiError(401, "missing_api_key", "send a bearer token or x-api-key")
    if not expected or not hmac.compare_digest(given.encode(), expected.encode()):
        raise ApiError(403, "bad_api_key", "the key is not valid here")
