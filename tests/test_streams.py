"""Streams give what the batch twins give."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docketry.operators import context
from docketry.sources import tables as table_
from docketry.streaming import jobs
from tests.conftest import rows


def until(q, done, seconds=90):
    """Stops a stream that never ends by itself (its timers go by the machine's clock), once done() holds."""
    end = time.time() + seconds
    while time.time() < end and q.isActive and not done():
        time.sleep(0.2)
    q.stop()


def read_rows(q):
    return sum(p["numInputRows"] for p in q.recentProgress)


def run(writer, spark, name, tmp_path, rows_in=None):
    q = writer.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp"))
    if rows_in:
        q = q.start()
        until(q, lambda: read_rows(q) >= rows_in)
    else:
        q.trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name)


def test_rate_windows(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select((F.col("user_id") % 5).alias("user_id"), F.col("ts").cast("timestamp").alias("ts"))
    e.repartition(2).write.parquet(str(tmp_path / "in"))
    s = jobs.rate_windows(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), 1)
    got = run(s.writeStream.outputMode("complete"), spark, "rates", tmp_path)
    assert rows(got) == rows(context.rate_limit(e, 1))


def test_job_states(spark, tmp_path):
    log = spark.createDataFrame([("a", "pending", "2024-01-01 00:00:00"), ("a", "completed", "2024-01-01 00:05:00"), ("b", "processing", "2024-01-01 00:01:00")], "job_id string, status string, t string")
    log = log.select("job_id", "status", F.col("t").cast("timestamp").alias("updated_at"))
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = jobs.job_states(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")))
    got = run(s.writeStream.outputMode("update"), spark, "jobs", tmp_path, 3)
    assert rows(got.select("job_id", "status")) == [("a", "completed"), ("b", "processing")]


def test_dedupe(spark, tmp_path):
    n = spark.createDataFrame([("k1", "2024-01-01 00:00:00"), ("k1", "2024-01-01 00:00:05"), ("k2", "2024-01-01 00:00:09")], "dedup_key string, t string").select("dedup_key", F.col("t").cast("timestamp").alias("ts"))
    n.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run(jobs.dedupe_stream(spark.readStream.schema(n.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append"), spark, "dedup", tmp_path)
    assert sorted(r.dedup_key for r in got.collect()) == ["k1", "k2"]


DAY = "list_id string, listing_date date, page int, text string"


def day_pages(spark):
    """Two days of lists; a list without a date; a number seen twice; two rows that one stored row answers to."""
    import datetime as dt

    d1, d2 = dt.date(2026, 1, 5), dt.date(2026, 1, 6)
    first = [("l1", d1, 1, "Court No-2\n   4 Ravi   VS   State\nWRIA/123/2026\n   5 x\nCRLA/77/2026"), ("l2", d2, 1, "Court No-3\n   1 y\nBAIL/900/2026"), ("l0", None, 1, "WRIA/1/2026")]
    second = [("l1", d1, 1, "Court No-2\n   4 Ravi   VS   State\nWRIA/124/2026\n   6 x\nWRIA/123/2026"), ("l1", d1, 2, "   9 z\nSPLA/5/2026\n   9 z\nSPLA/5/2026")]
    make = lambda rows: spark.createDataFrame(rows, DAY)
    choices = spark.createDataFrame([("c1", "WRIA-123-2026"), ("c2", "crla/77/2026"), ("c3", "SPLA/5/2026"), ("c4", "WRIA/124/2026")], "case_id string, number string")
    cases_ = spark.createDataFrame([("c1", "u1"), ("c2", "u2"), ("c3", "u3"), ("c4", "u1")], "id string, lawyer_id string")
    return make(first), make(second), choices, cases_


def state(spark, root):
    t = jobs.cause_list_tables(spark, root)
    return rows(t["listings"]), rows(t["notes"]), rows(t["stats"])


def test_cause_list_batches(spark, tmp_path):
    """Matched, put over the stored rows and notified once; a replayed batch changes nothing; days that are not touched keep their files."""
    first, second, choices, cases_ = day_pages(spark)
    root = f"file://{tmp_path}/store"
    jobs.cause_list_batch(first, 0, choices, cases_, root)
    t = jobs.cause_list_tables(spark, root)
    assert {(r.case_number, r.matched_case_id, str(r.listing_date)) for r in t["listings"].collect()} == {("WRIA/123/2026", "c1", "2026-01-05"), ("CRLA/77/2026", "c2", "2026-01-05"), ("BAIL/900/2026", None, "2026-01-06")}
    assert [tuple(r) for r in t["stats"].collect()] == [(3, 3, 0, 2, 0)]
    notes = {r.dedup_key: (r.user_id, r.message) for r in t["notes"].collect()}
    assert notes == {"cause_list_match:2026-01-05:c1": ("u1", "WRIA/123/2026 is listed in Court 2, Serial 4 on 05 Jan 2026."), "cause_list_match:2026-01-05:c2": ("u2", "CRLA/77/2026 is listed in Court 2, Serial 5 on 05 Jan 2026.")}
    files = sorted(p for p in (tmp_path / "store/listings/listing_date=2026-01-06").iterdir())
    times = [p.stat().st_mtime_ns for p in files]
    jobs.cause_list_batch(second, 1, choices, cases_, root)
    assert [p.stat().st_mtime_ns for p in sorted((tmp_path / "store/listings/listing_date=2026-01-06").iterdir())] == times
    t = jobs.cause_list_tables(spark, root)
    # WRIA/124 has the place of the stored WRIA/123, which comes later with a place of its own: the last one counts.
    got = {(r.case_number, r.court_number, r.serial_number, r.matched_case_id, r.batch) for r in t["listings"].where("listing_date = '2026-01-05'").collect()}
    assert got == {("WRIA/123/2026", "2", 6, "c1", 1), ("CRLA/77/2026", "2", 5, "c2", 0), ("SPLA/5/2026", "2", 9, "c3", 1)}
    assert sorted(tuple(r) for r in t["stats"].collect()) == [(3, 1, 2, 3, 1), (3, 3, 0, 2, 0)]
    assert sorted(r.dedup_key[-2:] for r in t["notes"].where("batch_id = 1").collect()) == ["c3", "c4"]  # c1 has its note of that day
    before = state(spark, root)
    jobs.cause_list_batch(second, 1, choices, cases_, root)
    jobs.cause_list_batch(first, 0, choices.limit(0), cases_, root)
    # The first batch's own days come back as it left them only if it is really replayed out of turn; decisions and notes stay.
    assert state(spark, root)[1:] == before[1:]


@pytest.fixture(scope="module")
def plain_store(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('plain')}/store"
    first, second, choices, cases_ = day_pages(spark)
    jobs.cause_list_batch(first, 0, choices, cases_, root)
    one = f"{root}-one"
    import shutil

    shutil.copytree(root.removeprefix("file://"), one.removeprefix("file://"))
    jobs.cause_list_batch(second, 1, choices, cases_, root)
    return one, state(spark, root)


@pytest.mark.parametrize("step", ["matched", "merged", "listings"])
def test_cause_list_killed(spark, tmp_path, monkeypatch, plain_store, step):
    """A batch that dies in one of its steps, and runs again, leaves what one that never died leaves."""
    import shutil

    _, second, choices, cases_ = day_pages(spark)
    shutil.copytree(plain_store[0].removeprefix("file://"), tmp_path / "store")
    root = f"file://{tmp_path}/store"
    real_once, real_over = jobs.once, jobs.overwrite_parts

    class Killed(Exception):
        pass

    def dying(make, path, spark_):
        out = real_once(make, path, spark_)
        if f"/{step}/" in path or step == "matched" and "/merged/" in path:
            raise Killed
        return out

    def half(df, path):
        real_over(df.limit(1), path)  # a folder that was left short
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(jobs, "once", dying)
        if step == "listings":
            m.setattr(jobs, "overwrite_parts", half)
        with pytest.raises(Killed):
            jobs.cause_list_batch(second, 1, choices, cases_, root)
    if step == "matched":  # died while the merged rows were being written
        (tmp_path / "store/merged/batch_id=1/_SUCCESS").unlink()
    jobs.cause_list_batch(second, 1, choices, cases_, root)
    assert state(spark, root) == plain_store[1]


def test_cause_list_stream(spark, tmp_path):
    """The stream: a batch fails after its listings were replaced, and comes again with its number when the query is started again."""
    first, second, choices, cases_ = day_pages(spark)
    root, calls = f"file://{tmp_path}/store", []
    first.coalesce(1).write.parquet(str(tmp_path / "in"))

    def start(load):
        s = spark.readStream.schema(DAY).parquet(str(tmp_path / "in"))
        q = jobs.cause_list_stream(s, load, root).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.awaitTermination(180)
        return q

    def load():
        calls.append(1)
        return choices, cases_

    start(load)
    one = state(spark, root)
    second.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def broken():
        jobs.cause_list_batch(second, 1, choices, cases_, root)  # all of batch 1 is done, and yet the stream does not know
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        start(broken)
    two = state(spark, root)
    start(load)
    start(load)
    assert state(spark, root) == two != one and len(calls) == 2 and len(two[2]) == 2


def test_write_upsert(spark, tmp_path):
    """Only touched folders are read and written; keys, order and kept columns as in upsert; the first write makes the table."""
    import os

    kind = "listing_date date, id string, v int, made string, seq int"
    row = lambda d, i, v, made, seq=0: (__import__("datetime").date(2026, 1, d), i, v, made, seq)
    path = str(tmp_path / "t")
    table_.write_upsert(spark.createDataFrame([row(1, "a", 1, "x"), row(2, "a", 2, "x"), row(3, "b", 3, "x")], kind), ["listing_date", "id"], path)
    keep = {d: sorted(os.listdir(f"{path}/listing_date=2026-01-0{d}")) for d in (1, 2, 3)}
    new = spark.createDataFrame([row(2, "a", 7, "y", 2), row(2, "a", 6, "z", 1), row(2, "c", 8, "y"), (None, "n", 0, "", 0)], kind)
    days = table_.write_upsert(new, ["listing_date", "id"], path, order="seq", keep=["made"])
    assert [str(d) for d in days] == ["2026-01-02"]
    now = {d: sorted(os.listdir(f"{path}/listing_date=2026-01-0{d}")) for d in (1, 2, 3)}
    assert now[1] == keep[1] and now[3] == keep[3] and now[2] != keep[2]
    table_.append_rows(spark.createDataFrame([row(3, "z", 9, "w")], kind), path)
    got = table_.read_parts(spark, path, kind)
    assert rows(got.select("id", "v", "made")) == sorted([("a", 1, "x"), ("a", 7, "x"), ("c", 8, "y"), ("b", 3, "x"), ("z", 9, "w")], key=repr)
    plan = table_.read_parts(spark, path, kind, days)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(listing_date" in plan or "PartitionFilters: [listing_date" in plan
    assert table_.read_parts(spark, str(tmp_path / "none"), kind).count() == 0
    with pytest.raises(ValueError):
        table_.write_upsert(new, ["id"], path)


LOG = "doc_id long, seq long, event string, ts timestamp"


def document_log(spark, seed=1):
    import datetime as dt

    r, t0, out = random.Random(seed), dt.datetime(2024, 1, 1), []
    for doc in range(12):
        at = 0
        for seq in range(r.randrange(1, 9)):
            at += r.randrange(1, 200)
            out.append((doc, seq, r.choice(["start", "start", "complete", "fail", "skip"]), t0 + dt.timedelta(seconds=at)))
    return [*out, (99, 0, "skip", t0 + dt.timedelta(hours=9))]  # its time moves the watermark past all timers


def states_of(spark, parts, tmp_path, clock="EventTime", stale_ms=120_000, late="1 day"):
    """What each run of the stream puts out, one run for each part of the input; by the machine's clock the last one waits for a timer."""
    for i, part in enumerate(parts):
        out = []
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = jobs.document_states(spark.readStream.schema(LOG).parquet(str(tmp_path / "in")), stale_ms, clock, late)
        w = s.writeStream.foreachBatch(lambda df, n, out=out: out.extend(map(tuple, df.collect()))).outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
        if clock == "EventTime":
            w.trigger(availableNow=True).start().awaitTermination(120)
        else:
            q = w.start()
            until(q, lambda q=q, part=part, out=out, i=i: read_rows(q) >= len(part) and (i < len(parts) - 1 or any(r[1] == "failed" for r in out)))
        yield out


def test_document_states(spark, tmp_path):
    """Shuffled, split input gives what the batch gives; timers go off for what was never finished, and for nothing else."""
    log = document_log(spark)
    want = {r.doc_id: tuple(r) for r in context.document_states(spark.createDataFrame(log, LOG), "2024-01-01 09:00:00").collect()}
    assert {w[1] for w in want.values()} == {"failed", "completed", "skipped"} and any(w[4] for w in want.values())
    mixed = log[:-1]
    random.Random(2).shuffle(mixed)
    got, fired = {}, 0
    for part in states_of(spark, [mixed[::3], mixed[1::3], mixed[2::3], [log[-1]]], tmp_path, late="8 hours"):
        for r in part:
            fired += r[4] is not None
            got[r[0]] = r
    assert got == want and fired == sum(w[4] is not None for w in want.values())


def test_completion_cancels_the_timer(spark, tmp_path):
    """By the machine's clock: one document is completed before its time, the other is not; only that one fails, with no event to wake it."""
    import datetime as dt

    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    parts = [[(1, 0, "start", now), (2, 0, "start", now)], [(1, 1, "complete", now)]]
    seen = [r for part in states_of(spark, parts, tmp_path, "ProcessingTime", 15_000) for r in part]
    last = {r[0]: r for r in seen}
    assert last[1][1:4] == ("completed", 1, 0) and last[2][1:] == ("failed", 0, 1, "did not finish in time")
    assert sum(r[1] == "failed" for r in seen) == 1


def _writes(n=6, each=25):
    r, log = random.Random(9), []
    for case in [*range(n), None]:
        for seq in range(each):
            c = None if r.random() < 0.1 else {"_case": "k", "d": str(r.randint(0, 2))}
            log.append((case, seq, c, r.random() < 0.15))
    return log


WRITES = "case_id int, seq int, context map<string,string>, cleared boolean"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_context_batches(spark, tmp_path, seed):
    """Any cut of the log, a batch that comes again and an empty one included, leaves the versions of the full run."""
    r, log, root = random.Random(seed), _writes(), str(tmp_path / "c")
    cuts = {c: sorted(r.randint(0, 25) for _ in range(2)) for c in {w[0] for w in log}}
    batches = [[w for w in log if sum(w[1] >= x for x in cuts[w[0]]) == i] for i in range(3)]
    for number in (0, 1, 1, 2, 0, 3):
        jobs.context_batch(spark.createDataFrame(batches[number] if number < 3 else [], WRITES), number, root, parts=4)
    cols = ["case_id", "seq", "version", "hash", "is_current"]
    full = context.context_versions(spark.createDataFrame(log, WRITES))
    assert rows(jobs.context_timeline(spark, root).select(cols)) == rows(full.select(cols))


@pytest.mark.parametrize("step", ["versions", "merged", "heads"])
def test_context_batch_killed(spark, tmp_path, monkeypatch, step):
    """A batch that fails at a step and comes again ends as if it had not failed; folders of other cases keep their files."""
    log, root = _writes(), str(tmp_path / "c")
    first, second = [w for w in log if w[1] < 12], [w for w in log if w[1] >= 12 and w[0] in (0, 1)]
    jobs.context_batch(spark.createDataFrame(first, WRITES), 0, root, parts=16)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "c" / "heads").rglob("*.parquet")}
    plain_once, plain_over = jobs.once, jobs.overwrite_parts

    def failing_once(df, path, spark):
        if f"/{step}/" in path:
            raise RuntimeError("lost")
        return plain_once(df, path, spark)

    def failing_over(df, path, by):
        plain_over(df.where("part % 2 = 0"), path, by)
        raise RuntimeError("lost")

    monkeypatch.setattr(jobs, *(("overwrite_parts", failing_over) if step == "heads" else ("once", failing_once)))
    with pytest.raises(RuntimeError):
        jobs.context_batch(spark.createDataFrame(second, WRITES), 1, root, parts=16)
    monkeypatch.undo()
    jobs.context_batch(spark.createDataFrame(second, WRITES), 1, root, parts=16)
    cols = ["case_id", "seq", "version", "hash", "is_current"]
    full = context.context_versions(spark.createDataFrame(first + second, WRITES))
    assert rows(jobs.context_timeline(spark, root).select(cols)) == rows(full.select(cols))
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "c" / "heads").rglob("*.parquet")}
    assert 0 < len(before.items() & after.items()) < len(before)


def test_context_stream(spark, tmp_path):
    """The stream ends in the same versions."""
    log, root = _writes(3, 12), str(tmp_path / "c")
    for i in range(3):
        spark.createDataFrame([w for w in log if w[1] // 4 == i], WRITES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = jobs.context_stream(spark.readStream.schema(WRITES).parquet(str(tmp_path / "in")), root)
        q.option("checkpointLocation", str(tmp_path / "ck")).start().awaitTermination()
    cols = ["case_id", "seq", "version", "hash", "is_current"]
    full = context.context_versions(spark.createDataFrame(log, WRITES))
    assert rows(jobs.context_timeline(spark, root).select(cols)) == rows(full.select(cols))
