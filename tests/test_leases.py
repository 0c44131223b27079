"""The lease stream against a replay in order."""

import datetime as dt
import random

import pytest

from lodestone.session import scratch_path
from lodestone.streaming import leases
from lodestone.streaming.incremental import drain, read_stream

SCHEMA = "number long, name string, owner string, op string, at timestamp"
START = dt.datetime(2024, 1, 1)


def millis(at):
    return int((at - START).total_seconds() * 1000)


def replay(batches, stale_after):
    held, out = {}, []
    for rows in batches:
        answer(rows, stale_after, held, out)
        # At the end of a cycle the watermark is ten seconds behind the last request, and timers up to it have gone off.
        watermark = max(millis(r[4]) for r in rows) - 10_000
        held = {k: v for k, v in held.items() if v[1] + stale_after + 1 > watermark}
    return sorted(out)


def answer(rows, stale_after, held, out):
    for number, name, owner, op, at in sorted(rows, key=lambda r: (r[4], r[0])):
        now = held.get(name)
        free = now is None or millis(at) - now[1] > stale_after
        granted = {"acquire": free, "takeover": True}.get(op, op in ("heartbeat", "release") and now is not None and now[0] == owner)
        if granted:
            if op == "release":
                held.pop(name)
            else:
                held[name] = (owner, millis(at))
        out.append((number, name, op, granted, held[name][0] if name in held else None))


@pytest.fixture
def requests():
    rng = random.Random(6)
    rows = []
    for k in range(300):
        at = START + dt.timedelta(seconds=k * 7 + rng.choice([0, 0, 3]))
        rows.append((k, rng.choice(["a", "a", "b", "c"]), rng.choice(["x", "y"]), rng.choice(["acquire", "acquire", "heartbeat", "release", "takeover", "other"]), at))
    return rows


def run(spark, batches, stale_after):
    folder, out, log = (scratch_path(spark, n) for n in ("requests", "answers", "log"))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = leases.lease_stream(read_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema), stale_after)
        drain(spark, stream, "append", f"{out}/{k}", log)
    return [tuple(r) for k in range(len(batches)) for r in spark.read.schema(stream.schema).parquet(*[f"{out}/{k}"]).select("number", "name", "op", "granted", "owner").collect()]


def test_answers_equal_a_replay(spark, requests):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", leases.PROVIDER)
    odd = [(900, None, "x", "acquire", START), (901, "a", "x", "acquire", None)]
    got = run(spark, [requests[:150] + odd, requests[150:]], 30_000)
    answered = sorted(r for r in got if r[0] is not None)
    assert answered == replay([requests[:150], requests[150:]], 30_000)
    assert {r[3] for r in answered} == {True, False}


def test_a_lease_that_nobody_asks_for_expires(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", leases.PROVIDER)
    first = [(1, "old", "x", "acquire", START), (2, "new", "y", "acquire", START + dt.timedelta(minutes=30))]
    more = [(3, "new", "y", "heartbeat", START + dt.timedelta(minutes=30, seconds=1))]
    got = run(spark, [first, more], 60_000)
    assert (None, "old", "expire", True, "x") in got and not any(r[1] == "new" and r[2] == "expire" for r in got)
