"""Sliding-window limiter whose budget only admitted requests consume."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig


class Limiter:
    """State of one key: times of admitted requests and of failures, and a lock."""

    def __init__(self, config: EngineConfig = DEFAULT):
        self.c = config
        self.admitted: deque[float] = deque()
        self.failed: deque[float] = deque()
        self.locked_until = float("-inf")

    def request(self, at: float, failure: bool = False) -> bool:
        for times, width in ((self.admitted, self.c.request_window_s), (self.failed, self.c.failure_window_s)):
            while times and times[0] <= at - width:
                times.popleft()
        if at < self.locked_until or len(self.admitted) >= self.c.requests_per_window:
            return False
        self.admitted.append(at)
        if failure:
            self.failed.append(at)
            if len(self.failed) >= self.c.failures_per_window:
                self.locked_until = at + self.c.lock_s
                self.failed.clear()
        return True


def limit(events: DataFrame, key: str, time_s: str, failure: str, order: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """``key``, ``order`` and ``admitted`` of each event.

    The fold is sequential within a key but streams: rows are sorted within partitions and each
    key holds one window of times, so a key with a third of all rows needs no more memory than
    any other.
    """
    source = events.select(F.col(key).alias("k"), F.col(time_s).cast("double").alias("s"), F.col(failure).cast("boolean").alias("f"), F.col(order).alias("o"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, current = Limiter(config), object()
        for batch in batches:
            out = []
            for k, s, f in zip(batch["k"], batch["s"], batch["f"]):
                if k != current:
                    state, current = Limiter(config), k
                out.append(state.request(s, bool(f)))
            yield pd.DataFrame({"k": batch["k"], "o": batch["o"], "admitted": out})

    types = {f.name: f.dataType.simpleString() for f in source.schema}
    return source.repartition("k").sortWithinPartitions("k", "s", "o").mapInPandas(run, f"k {types['k']}, o {types['o']}, admitted boolean").select(F.col("k").alias(key), F.col("o").alias(order), "admitted")


class LoginLimiter:
    """Requests by address, failures by (account, address), and locks of both after too many."""

    def __init__(self, state: dict | None = None, config: EngineConfig = DEFAULT):
        self.c = config
        self.requests: dict[str, list[float]] = (state or {}).get("requests", {})
        self.failures: dict[str, list[float]] = (state or {}).get("failures", {})
        self.locks: dict[str, float] = (state or {}).get("locks", {})

    def attempt(self, at: float, address: str, account: str, ok: bool) -> str:
        """"throttled", "locked", "failed" or "in"; only admitted requests use up the budget."""
        recent = [t for t in self.requests.get(address, []) if at - t < self.c.request_window_s]
        self.requests[address] = recent
        if len(recent) >= self.c.requests_per_window:
            return "throttled"
        recent.append(at)
        own, pair = ("ip " + address, "user " + account), f"{account} {address}"
        if any(self.locks.get(k, at) > at for k in own):
            return "locked"
        if ok:
            self.failures.pop(pair, None)
            self.locks.pop(own[1], None)
            return "in"
        failed = [t for t in self.failures.get(pair, []) if at - t < self.c.failure_window_s] + [at]
        if len(failed) >= self.c.failures_per_window:
            self.locks.update(dict.fromkeys(own, at + self.c.lock_s))
            failed = []
        self.failures[pair] = failed
        return "failed"

    def state(self) -> dict:
        return {"requests": self.requests, "failures": self.failures, "locks": self.locks}


def login_outcomes(attempts: DataFrame, group: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """``group``, ``attempt_id`` and ``outcome`` of a stream (or, by ``applyInPandas``, a table) of attempts
    (``attempt_id``, ``at`` in seconds, ``address``, ``account``, ``ok``).

    A group (say, a tenant) holds accounts and addresses that no other group has; its state outlives
    restarts of the stream.
    """
    kind = attempts.schema[group].dataType.simpleString()
    schema = f"{group} {kind}, attempt_id bigint, outcome string"

    def told(key, rows: pd.DataFrame, limiter: LoginLimiter) -> pd.DataFrame:
        ordered = rows.sort_values(["at", "attempt_id"])
        outcomes = [limiter.attempt(*x) for x in zip(ordered["at"], ordered["address"], ordered["account"], ordered["ok"])]
        return pd.DataFrame({group: key[0], "attempt_id": ordered["attempt_id"], "outcome": outcomes})

    if not attempts.isStreaming:
        return attempts.groupBy(group).applyInPandas(lambda key, rows: told(key, rows, LoginLimiter(config=config)), schema)

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        limiter = LoginLimiter(json.loads(state.get[0]) if state.exists else None, config)
        yield told(key, pd.concat(list(batches)), limiter)
        state.update((json.dumps(limiter.state()),))

    return attempts.groupBy(group).applyInPandasWithState(step, schema, "state string", "append", "NoTimeout")
