"""Layout by day and late rows against plain Python over the files themselves."""

import datetime as dt
import glob
import hashlib
import math
import random
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import late_layout
from lodestone.session import scratch_path

START, CUTOFF = dt.datetime(1970, 1, 1), dt.datetime(2024, 3, 1)
SCHEMA = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def us(x):
    return None if x is None else (x - START) // dt.timedelta(microseconds=1)


def day(r):
    return -1 if r["sold_at"] is None else us(r["sold_at"]) // 86_400_000_000


def copies(rows):
    out = list(rows)
    for r in rows:
        if r["sale_id"] is None:
            continue
        h = zlib.crc32(str(r["sale_id"]).encode())
        if h % 3 == 0 and day(r) % 10 == 0:
            later = lambda x, n: None if x is None else x + dt.timedelta(days=n)
            out.append(r | {"total": None if r["total"] is None else r["total"] + 1, "sold_at": later(r["sold_at"], h % 2), "arrived_at": later(r["arrived_at"], 1 + h % 97)})
    return out


def rank(r):
    """Larger for the row that stays."""
    return [(x is not None, x) for x in (r["arrived_at"], r["sold_at"], *(v for k, v in r.items() if k not in ("sale_id", "sold_at", "arrived_at")))]


def last(rows):
    best = {}
    for r in rows:
        if r["sale_id"] not in best or rank(r) > rank(best[r["sale_id"]]):
            best[r["sale_id"]] = r
    return best


def cut(kept, per_file):
    days = {}
    for r in kept.values():
        days.setdefault(day(r), []).append(r)
    for d, rs in days.items():
        rs.sort(key=lambda r: ((r["sold_at"] is not None, r["sold_at"]), (r["sale_id"] is not None, r["sale_id"])))
        yield from (((d, k // per_file), rs[k : k + per_file]) for k in range(0, len(rs), per_file))


def brute(rows, per_file):
    every = copies(rows)
    early = [r for r in every if r["arrived_at"] is not None and r["arrived_at"] < CUTOFF]
    late = [r for r in every if not (r["arrived_at"] is not None and r["arrived_at"] < CUTOFF)]
    old, new = last(early), last(late)
    dirty = {day(r) for r in new.values()} | {day(old[i]) for i in new if i in old}
    out = {}
    for at, rs in cut(old | new, per_file):
        text = lambda x: "" if x is None else str(x)
        out[at] = (
            len(rs),
            sum(math.floor(100 * r["total"] + 0.5) for r in rs if r["total"] is not None),
            sum(zlib.crc32(f"{text(r['sale_id'])}:{text(us(r['sold_at']))}:{text(us(r['arrived_at']))}".encode()) for r in rs),
            hashlib.sha256(",".join(text(r["sale_id"]) for r in rs).encode()).hexdigest(),
            at[0] in dirty,
        )
    return out, dirty


def make(n, seed, hot=0):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        i = rng.choice([k, k, k, max(0, k - 7), 5 if hot else k])
        sold = dt.datetime(2024, 2, rng.randint(10, 28), rng.randint(0, 23)) + dt.timedelta(days=rng.choice([0, 0, 0, 30]), microseconds=rng.choice([0, 0, 1, 999_999]))
        came = sold + dt.timedelta(hours=rng.choice([0, 1, 5, 900]))
        total = round(rng.random() * 500, 2)
        rows.append([i, rng.randint(0, 9), rng.choice(["done", "open"]), total, sold, came, 3])
    rows += [[n + k, 1, None, None, None, dt.datetime(2024, 1, 5 + 60 * (k % 2 == 0) // 30), None] for k in range(9)]  # no time of sale
    rows += [[None, 1, "x", 2.0, dt.datetime(2024, 2, 12), dt.datetime(2024, 2, 12 + k), 1] for k in range(3)]  # no id
    rows += [[n + 20, 1, "x", 2.0, dt.datetime(2024, 2, 13), None, 1], [n + 20, 1, "y", 3.0, dt.datetime(2024, 2, 14), dt.datetime(2024, 2, 14), 1]]  # no arrival: late
    rows += [[n + 21, 1, "x", 2.0, dt.datetime(1969, 12, 1, 3), dt.datetime(2024, 2, 14), 1], rows[3], rows[4], [rows[6][0], 1, "tie", 1.5, rows[6][4], rows[6][5], 4]]
    # The only sale of a day moves to another one.
    rows += [[n + 22, 1, "a", 1.0, dt.datetime(2023, 5, 5), dt.datetime(2023, 5, 5), 1], [n + 22, 1, "b", 1.0, dt.datetime(2024, 3, 20), dt.datetime(2024, 3, 21), 1]]
    return [dict(zip(NAMES, r)) for r in rows]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(3)


def held(report):
    return {(r["day"], r["file_no"]): (r["n_rows"], r["cents"], r["rows_crc"], r["ids_sha256"], r["rewritten"]) for r in report}


def parquet_files(report):
    root = report[0]["path"].removeprefix("file://").rpartition("/")[0].rpartition("/")[0]
    return {"file://" + f for f in glob.glob(f"{root}/**/*.parquet", recursive=True)}


@pytest.mark.parametrize("n,hot,files", [(700, 0, 90), (700, 1, 900), (300, 0, 20)])
def test_files_equal_brute_force(spark, n, hot, files):
    rows = make(n, n + hot, hot)
    got = late_layout.overwrite_late(frame(spark, rows), files=files).collect()
    want, dirty = brute(rows, 1 + len(rows) // files)
    assert held(got) == want and len(got) == len(want)
    assert {r["day"] for r in got if r["rewritten"]} <= dirty
    assert {r["columns"] for r in got} == {",".join(NAMES)}
    assert parquet_files(got) == {r["path"] for r in got}
    for r in got[:5]:
        table = pq.read_table(r["path"].removeprefix("file://"), partitioning=None)
        assert table.column_names == NAMES and str(table.schema.field("sold_at").type) == "timestamp[us]"
        assert hashlib.sha256(",".join("" if x is None else str(x) for x in table["sale_id"].to_pylist()).encode()).hexdigest() == r["ids_sha256"]


def test_clean_days_keep_their_files_byte_for_byte(spark):
    rows = [r for r in make(400, 3) if r["sale_id"] is not None and r["arrived_at"] is not None]
    table = frame(spark, rows)
    layout = late_layout.DayLayout(spark, scratch_path(spark, "test"), table.schema, 7)
    root = layout.uri.removeprefix("file://")
    early, late = table.where(F.col("arrived_at") < F.lit(CUTOFF)), table.where(F.col("arrived_at") >= F.lit(CUTOFF))
    layout.write(late_layout.latest(early, late_layout.SALES))
    bytes_of = lambda: {f: open(f, "rb").read() for f in glob.glob(f"{root}/**/*.parquet", recursive=True)}
    before = bytes_of()
    dirty = layout.apply(late)
    after = bytes_of()
    day_of = lambda f: int(f.rpartition("/day=")[2].partition("/")[0])
    clean = {f for f in before if day_of(f) not in dirty}
    assert clean and {f: before[f] for f in clean} == {f: after[f] for f in after if day_of(f) not in dirty}
    assert not any(f in before for f in after if day_of(f) in dirty)
    # The day whose only sale moved away has no folder left.
    gone = (dt.datetime(2023, 5, 5) - START).days
    assert gone in dirty and not glob.glob(f"{root}/day={gone}*")


def test_columns_with_clashing_names_and_other_types(spark):
    """Helper names, a ``day`` column, a map; times with a zone in a session of another zone."""
    rows = make(120, 8)
    schema = SCHEMA.replace("timestamp_ntz", "timestamp") + ", Day string, n int, part int, place int, file int, shift int, row int, late int, bag map<string,int>"
    zone = spark.conf.get("spark.sql.session.timeZone")
    utc = lambda x: x.replace(tzinfo=dt.timezone.utc) if isinstance(x, dt.datetime) else x
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        wide = spark.createDataFrame([(*map(utc, r.values()), "d", 1, 2, 3, 4, 5, 6, 7, {"a": 1}) for r in rows], schema)
        got = late_layout.overwrite_late(wide, files=30).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert held(got) == brute(rows, 1 + len(rows) // 30)[0]
    assert "/_day=" in got[0]["path"] and got[0]["columns"].startswith(",".join(NAMES) + ",Day,n,part")


def test_no_rows_and_no_late_rows(spark):
    assert late_layout.overwrite_late(frame(spark, [])).collect() == []
    rows = [r for r in make(60, 2) if r["arrived_at"] is not None and r["arrived_at"] < dt.datetime(2024, 2, 1)]
    got = late_layout.overwrite_late(frame(spark, rows), files=9).collect()
    assert held(got) == brute(rows, 1 + len(rows) // 9)[0] and not any(r["rewritten"] for r in got)


def test_one_row_of_a_key_leaves_each_task(spark):
    plan = late_layout.latest(frame(spark, make(50, 1)), late_layout.SALES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
