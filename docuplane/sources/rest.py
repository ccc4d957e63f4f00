"""Paged REST search as a batch source: one partition a day, with retries, a call budget and a rate.

The transport is given, so that tests and offline runs need no network: it takes a
path and parameters and returns (status, headers, body)."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docuplane.session import ship_package

Transport = Callable[[str, dict], tuple[int, dict, dict | None]]


class BudgetSpent(RuntimeError):
    """No call may be made any more."""


class RequestFailed(RuntimeError):
    """A request was refused, or still failed after all tries."""


@dataclass
class CallBudget:
    """Calls allowed: a hard ceiling, a reserve kept back, and, until the service has told
    what remains, a number of calls made blind."""

    ceiling: int
    reserve: int = 0
    blind: int = 25
    used: int = 0
    remaining: int | None = None

    def stop_reason(self) -> str | None:
        if self.used >= self.ceiling:
            return "ceiling"
        if self.remaining is None:
            return "blind" if self.used >= self.blind else None
        return "reserve" if self.remaining <= self.reserve else None

    def take(self) -> None:
        if reason := self.stop_reason():
            raise BudgetSpent(reason)
        self.used += 1
        if self.remaining is not None:
            self.remaining -= 1

    def heard(self, headers: dict) -> None:
        left = headers.get("x-ratelimit-remaining")
        if left is not None and str(left).isdigit():
            self.remaining = int(left)


@dataclass
class TokenBucket:
    """``rate`` calls a second on the average, ``burst`` at once. A cluster divides its rate
    by the number of tasks that call."""

    rate: float
    burst: int = 1
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _have: float = field(default=-1.0, repr=False)
    _at: float = field(default=0.0, repr=False)

    def acquire(self, n: int = 1) -> None:
        if self._have < 0:
            self._have, self._at = float(self.burst), self.clock()
        while True:
            now = self.clock()
            self._have = min(float(self.burst), self._have + (now - self._at) * self.rate)
            self._at = now
            if self._have >= n - 1e-9:
                self._have -= n
                return
            self.sleep((n - self._have) / self.rate)


@dataclass
class RestClient:
    """One call after another: 429, server and transport errors are tried again, up to
    ``tries``, after what Retry-After says (300 s at most) or a doubling wait with
    jitter; every try is counted and logged. 402 and other refusals are final."""

    transport: Transport
    budget: CallBudget
    bucket: TokenBucket | None = None
    tries: int = 6
    sleep: Callable[[float], None] = time.sleep
    log: list[tuple[str, int]] = field(default_factory=list)

    def get(self, path: str, **params) -> dict:
        for k in range(self.tries):
            self.budget.take()
            if self.bucket:
                self.bucket.acquire()
            try:
                status, headers, body = self.transport(path, params)
            except OSError:
                status, headers, body = 0, {}, None
            headers = {h.lower(): v for h, v in headers.items()}
            self.log.append((path, status))
            self.budget.heard(headers)
            if status == 200:
                return body or {}
            if status not in (0, 429) and status < 500:
                raise RequestFailed(f"{path}: {status}")
            if k + 1 < self.tries:
                told = str(headers.get("retry-after", ""))
                self.sleep(min(float(told), 300.0) if told.replace(".", "", 1).isdigit() else min(2.0**k, 60.0) * (0.5 + random.random() / 2))
        raise RequestFailed(f"{path}: no answer after {self.tries} tries")

    def pages(self, path: str, limit: int = 100, **params) -> Iterator[list[dict]]:
        """Pages until one says there is none after it, or is empty."""
        page = 1
        while True:
            got = self.get(path, page=page, limit=limit, **params)
            rows = got.get("data") or []
            if rows:
                yield rows
            if not rows or not (got.get("pagination") or {}).get("has_next"):
                return
            page += 1


def days_between(first: str, last: str) -> list[str]:
    a, b = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    return [(a + dt.timedelta(days=i)).isoformat() for i in range((b - a).days + 1)]


def search_days(spark: SparkSession, days: list[str], client: Callable[[], RestClient], path: str = "/search") -> DataFrame:
    """``day, record`` (JSON) of all records of the days; a task asks for whole days.

    ``client`` makes a task's client, with its part of the budget and rate."""
    ship_package(spark)

    def fetch(batches):
        import pandas as pd

        ask = client()
        for pdf in batches:
            rows = [(d, json.dumps(r, sort_keys=True)) for d in pdf["day"] for page in ask.pages(path, day=d) for r in page]
            yield pd.DataFrame(rows, columns=["day", "record"])

    wanted = spark.createDataFrame([(d,) for d in days], "day string").repartition(max(1, min(len(days), 64)), "day")
    return wanted.mapInPandas(fetch, "day string, record string")


def missing_days(wanted: list[str], stored: DataFrame) -> DataFrame:
    spark = stored.sparkSession
    return spark.createDataFrame([(d,) for d in wanted], "day string").join(stored.select(F.col("day").cast("string").alias("day")).distinct(), "day", "left_anti")


def request_key(endpoint: str, params: dict) -> str:
    """The name a cached answer is stored under."""
    return hashlib.sha256((endpoint + json.dumps(params, sort_keys=True)).encode()).hexdigest()[:24]


def capped_windows(first: str, last: str, count: Callable[[str, str], list], cap: int = 1000) -> list:
    """All records of a span of days from a service that returns ``cap`` at most: a window
    that comes back full is halved; a full day is kept as it is. Repeats are dropped."""
    stack, out = [(dt.date.fromisoformat(first), dt.date.fromisoformat(last))], {}
    while stack:
        a, b = stack.pop()
        rows = count(a.isoformat(), b.isoformat())
        if len(rows) >= cap and a < b:
            middle = a + (b - a) // 2
            stack += [(middle + dt.timedelta(days=1), b), (a, middle)]
        else:
            out.update((json.dumps(r, sort_keys=True), r) for r in rows)
    return list(out.values())


# What the first bytes of a kept file are.
_KINDS = ((b"%PDF-", ".pdf"), (b"PK\x03\x04", ".docx"), (bytes.fromhex("D0CF11E0A1B11AE1"), ".doc"))


def stored_name(content: bytes, max_bytes: int) -> tuple[str | None, str | None]:
    """(name under its content's hash, reason it is not kept): ``too_large``, ``empty``,
    ``bad_zip`` or ``not_a_kept_type``. Equal contents have one name, so storing is idempotent."""
    if not content:
        return None, "empty"
    if len(content) > max_bytes:
        return None, "too_large"
    ext = next((e for head, e in _KINDS if content.startswith(head)), ".txt" if b"\x00" not in content[:2048] else None)
    if ext is None:
        return None, "not_a_kept_type"
    if ext == ".docx" and not re.search(rb"word/", content):
        return None, "bad_zip"
    return hashlib.sha256(content).hexdigest() + ext, None
