"""Named leases as a stateful stream: acquire, heartbeat, release, takeover, and expiry by a timer.

Requests are keyed by the lease's name. State is the lease's owner and times, one row
of a name in the state store; a request is answered from it. A lease whose last heartbeat is
older than ``stale_after`` is taken by the next one that asks for it. A timer set at
that time by the watermark ends a lease that nobody asks for, and reports it.

Requests of a name are answered in order of time, then of number, within what a batch brings; batches are
taken in the order in which they come. A name that a third of the requests have is one
task's, for each answer depends on the one before; its rows stream through, and the
state does not grow.

Defined cases: a request without name or time is refused and changes nothing; an
unknown operation is refused; a heartbeat or release by another than the owner is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps keyed values and timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: ``granted``, and the lease's owner afterwards; an expiry has no number and the owner that it ends.
ANSWERS = "number long, name string, op string, granted boolean, owner string"


def decide(lease: tuple | None, owner: str, op: str, at: int, stale_after: int) -> tuple[bool, tuple | None]:
    """Whether a request is granted, and the lease (owner, acquired, heartbeat) afterwards; times in milliseconds."""
    if op == "acquire":
        free = lease is None or at - lease[2] > stale_after
        return free, (owner, at, at) if free else lease
    if op == "takeover":
        return True, (owner, at, at)
    own = lease is not None and lease[0] == owner
    if op == "heartbeat":
        return own, (lease[0], lease[1], at) if own else lease
    if op == "release":
        return own, None if own else lease
    return False, lease


class LeaseProcessor(StatefulProcessor):
    def __init__(self, stale_after: int):
        self.stale_after = stale_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "owner string, acquired long, heartbeat long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["millis", "number"], kind="stable")
        lease = tuple(self.lease.get()) if self.lease.exists() else None
        out = []
        for number, owner, op, at in zip(asked["number"], asked["owner"], asked["op"], asked["millis"]):
            granted, lease = decide(lease, owner, op, int(at), self.stale_after)
            out.append((number, key[0], op, granted, lease[0] if lease else None))
        if lease is None:
            self.lease.clear()
        else:
            self.lease.update(lease)
            due = lease[2] + self.stale_after + 1
            if due > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(due)
        yield pd.DataFrame(out, columns=["number", "name", "op", "granted", "owner"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.lease.exists():
            owner, _, heartbeat = self.lease.get()
            if heartbeat + self.stale_after < expiredTimerInfo.getExpiryTimeInMs():
                self.lease.clear()
                yield pd.DataFrame([(None, key[0], "expire", True, owner)], columns=["number", "name", "op", "granted", "owner"]).astype({"number": "Int64"})

    def close(self) -> None:
        pass


def lease_stream(requests: DataFrame, stale_after: int, late: str = "10 seconds") -> DataFrame:
    """Answers to a stream of requests (number, name, owner, op, at as a timestamp); ``stale_after`` in milliseconds."""
    good = requests.where("name is not null and at is not null").withWatermark("at", late)
    asked = good.select(F.col("number").cast("long").alias("number"), "name", "owner", "op", "at", F.unix_millis("at").alias("millis"))
    return asked.groupBy("name").transformWithStateInPandas(LeaseProcessor(stale_after), outputStructType=ANSWERS, outputMode="append", timeMode="eventTime")
