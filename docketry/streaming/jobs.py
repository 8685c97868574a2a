"""Streaming jobs: rate windows, job states with a time to live, document states with timers, duplicates, court-list batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docketry.operators import context, listings
from docketry.operators.cases import upsert
from docketry.sources.tables import exists, once, overwrite_parts, read_parts, touched


def rate_windows(calls: DataFrame, limit: int = 30, late: str = "1 hour") -> DataFrame:
    """Stream of calls(user_id, ts) -> counts by user and hour, with calls above the limit."""
    w = calls.withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("calls"))
    return w.select("user_id", F.floor(F.unix_timestamp("window.start") / 3600).cast("long").alias("bucket"), "calls", F.greatest(F.lit(0), F.col("calls") - limit).alias("rejected"))


class LatestStatus(StatefulProcessor):
    """Keeps the latest status of a job, for as long as its time to live."""

    def __init__(self, ttl_ms: int = 24 * 3600 * 1000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "status string, updated_at timestamp", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        old = self.state.get()
        best = tuple(old) if old else None
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if best is None or r.updated_at >= pd.Timestamp(best[1]):
                    best = (r.status, r.updated_at.to_pydatetime())
        self.state.update(best)
        yield pd.DataFrame({"job_id": [key[0]], "status": [best[0]], "updated_at": [best[1]]})

    def close(self) -> None:
        pass


class DocumentState(StatefulProcessor):
    """The state of a document from its events, in whatever order they come: what the event with the largest seq says, and the starts
    since the last completion or skip. A start sets a timer; any later event takes it back; if it goes off, the document has failed."""

    def __init__(self, stale_ms: int = 120_000):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("document", "seq long, state string, done long, starts array<long>, deadline long, error string")

    def _row(self, key, s: dict) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": [key[0]], "state": [s["state"]], "seq": [s["seq"]], "attempts": [len(s["starts"])], "error": [s["error"]]})

    def _keep(self, s: dict, deadline: int | None) -> None:
        """Puts the timer where it belongs, and the state away."""
        if s["deadline"] is not None and s["deadline"] != deadline:
            self.handle.deleteTimer(s["deadline"])
        if deadline is not None and s["deadline"] != deadline:
            self.handle.registerTimer(deadline)
        s["deadline"] = deadline
        self.state.update(tuple(s[k] for k in ("seq", "state", "done", "starts", "deadline", "error")))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        old = self.state.get()
        s = dict(zip(("seq", "state", "done", "starts", "deadline", "error"), old, strict=True)) if old else {"seq": -1, "state": None, "done": -1, "starts": [], "deadline": None, "error": None}
        s["starts"], deadline = list(s["starts"]), s["deadline"]
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if r.event in ("complete", "skip"):
                    s["done"] = max(s["done"], int(r.seq))
                elif r.event == "start":
                    s["starts"].append(int(r.seq))
                if r.seq > s["seq"]:
                    s |= {"seq": int(r.seq), "state": STATES[r.event], "error": None}
                    deadline = int(r.ts.timestamp() * 1000) + self.stale_ms if r.event == "start" else None
        s["starts"] = [x for x in s["starts"] if x > s["done"]]
        self._keep(s, deadline)
        yield self._row(key, s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s = dict(zip(("seq", "state", "done", "starts", "deadline", "error"), self.state.get(), strict=True))
        s |= {"state": "failed", "error": STALE, "deadline": None}
        self.state.update(tuple(s[k] for k in ("seq", "state", "done", "starts", "deadline", "error")))
        yield self._row(key, s)

    def close(self) -> None:
        pass


#: What an event makes of a document, and what is said of one that did not finish.
STATES, STALE = {"start": "processing", "complete": "completed", "fail": "failed", "skip": "skipped"}, "did not finish in time"


def document_states(log: DataFrame, stale_ms: int = 120_000, clock: str = "EventTime", late: str = "1 hour") -> DataFrame:
    """Stream of log(doc_id, seq, event, ts) -> the document's row at each change: state, seq, attempts, error (see DocumentState).

    clock: timers go by the watermark of ts ("EventTime": the same for every run), or by the machine's ("ProcessingTime": also while
    no events come). Needs the RocksDB state store."""
    kept = log.withWatermark("ts", late) if clock == "EventTime" else log
    return kept.groupBy("doc_id").transformWithStateInPandas(DocumentState(stale_ms), "doc_id long, state string, seq long, attempts int, error string", "Update", clock)


def job_states(log: DataFrame, ttl_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Stream of log(job_id, status, updated_at) -> the latest status at each change. Needs the RocksDB state store."""
    return log.groupBy("job_id").transformWithStateInPandas(LatestStatus(ttl_ms), "job_id string, status string, updated_at timestamp", "Update", "ProcessingTime")


def dedupe_stream(notes: DataFrame, key: str = "dedup_key", late: str = "1 hour") -> DataFrame:
    return notes.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


LISTING = "listing_id string, court_number string, serial_number int, case_number string, case_title string, petitioner string, respondent string, case_type_raw string, matched_case_id string, page int, at int, batch long, listing_date date"


def _matched_batch(rows: DataFrame, number: int, choices: DataFrame, root: str) -> DataFrame:
    """Parsed rows matched to active cases, and joined to the rows stored for their days, with what those were matched to."""
    best = listings.fuzzy_match(rows.select("row_id", F.col("case_number").alias("number")), choices)
    rows = rows.join(best.select("row_id", F.col("case_id").alias("matched_case_id")), "row_id", "left")
    stored = read_parts(rows.sparkSession, f"{root}/listings", LISTING, touched(rows))
    existing = stored.select(F.col("listing_id").alias("existing_id"), "listing_date", "court_number", "serial_number", "case_number", F.struct("batch", "page", "at").alias("seq"), F.col("matched_case_id").alias("_stored"))
    x = listings.match_existing(rows, existing).join(existing.select("existing_id", "listing_date", "_stored"), ["existing_id", "listing_date"], "left")
    # Of rows that update one stored row, each follows the one before it.
    same = Window.partitionBy("listing_date", F.coalesce("existing_id", F.to_json("row_id"))).orderBy("row_id")
    x = x.withColumn("previous_case_id", F.when(F.row_number().over(same) > 1, F.lag("matched_case_id").over(same)).otherwise(F.col("_stored")))
    new_id = F.sha2(F.concat_ws(":", F.lit(number), F.to_json(F.struct("listing_date", "row_id"))), 256)
    return x.withColumn("listing_id", F.coalesce("existing_id", new_id)).withColumn("batch", F.lit(number).cast("long")).drop("_stored")


def cause_list_batch(pages: DataFrame, number: int, choices: DataFrame, cases: DataFrame, root: str) -> None:
    """One batch of pages(list_id, listing_date, page, text), to its end: matched rows, the listings table, notes and counts.

    choices(case_id, number): numbers of active cases; cases(id, lawyer_id). Under root each step has a folder of the batch, and a
    step that was written to its end is never decided anew: `parsed`, `matched` (what the batch saw before it changed anything),
    `merged` (all rows of the touched days as they will be), `notes` and `stats`. The days in `listings` are then replaced from
    `merged`. So a batch that is cut off anywhere, or comes again, ends in the same tables. Pages without a date are passed over."""
    spark = pages.sparkSession
    at = lambda step: f"{root}/{step}/batch_id={number}"
    counts: dict[str, int] = {}

    def parsed() -> DataFrame:
        days = pages.select("list_id", "listing_date").where("listing_date IS NOT NULL").distinct()
        return listings.parse_listings(pages).join(days, "list_id").withColumn("row_id", F.struct("list_id", "page", "at"))

    if not exists(spark, f"{at('matched')}/_SUCCESS"):
        seen_rows, seen = listings.observed_run(_matched_batch(once(parsed, at("parsed"), spark), number, choices, root))
        seen_rows.write.mode("overwrite").parquet(at("matched"))
        counts = seen.get
    matched = spark.read.parquet(at("matched"))
    days = touched(matched)

    def merged() -> DataFrame:
        new = matched.select(*[F.col(c.split()[0]) for c in LISTING.split(", ")], F.struct("page", "at").alias("_order"))
        base = read_parts(spark, f"{root}/listings", LISTING, days)
        return upsert(base.withColumn("_order", F.lit(None).cast("struct<page:int,at:int>")), new, ["listing_date", "listing_id"], order="_order").drop("_order")

    def notes() -> DataFrame:
        sent = read_parts(spark, f"{root}/notes", NOTE).where(F.col("batch_id") != number)
        return listings.new_notifications(matched, cases, sent.select("dedup_key", "user_id"))

    def stats() -> DataFrame:
        return spark.createDataFrame([tuple(counts[c] for c in RUN)], ", ".join(f"{c} long" for c in RUN)) if counts else listings.list_run_stats(matched).select(*RUN)

    whole = once(merged, at("merged"), spark)
    once(notes, at("notes"), spark)
    once(stats, at("stats"), spark)
    overwrite_parts(whole, f"{root}/listings")


NOTE = "user_id string, dedup_key string, title string, message string, batch_id long"
RUN = ["total", "inserted", "updated", "matched"]


def cause_list_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """listings, notes and stats as all batches so far have left them."""
    return {"listings": read_parts(spark, f"{root}/listings", LISTING), "notes": read_parts(spark, f"{root}/notes", NOTE), "stats": read_parts(spark, f"{root}/stats", ", ".join(f"{c} long" for c in [*RUN, "batch_id"]))}


def cause_list_stream(pages: DataFrame, load: Callable[[], tuple[DataFrame, DataFrame]], root: str) -> DataStreamWriter:
    """Each micro-batch of pages(list_id, listing_date, page, text) by cause_list_batch, under the number that the stream's checkpoint
    gives it: a batch that failed comes again with its number and its rows. load() gives (choices, cases) as they are then."""

    def batch(df: DataFrame, number: int) -> None:
        cause_list_batch(df, number, *load(), root)

    return pages.writeStream.foreachBatch(batch).trigger(availableNow=True)


#: Folders that the last versions of cases are kept in: a batch reads and replaces those of its cases alone.
HEAD_PARTS = 256
HEADS = "case_id {0}, version long, hash string, part int"


def context_batch(log: DataFrame, number: int, root: str, parts: int = HEAD_PARTS) -> None:
    """One batch of context writes log(case_id, seq, context, cleared) put after those before it, without reading the history.

    Under root each batch has a folder in `versions` with the changes it made, decided once; then the last version of its cases is
    put into `heads`, in folders by a hash of the case. What a batch decides depends on the heads before it: a batch cut off
    before its `versions` were written has changed none, one cut off later is not decided anew, and heads only move forward. So a
    batch that is cut off anywhere, or comes again, ends in the same tables. Writes of a case must come in order, batch by batch;
    `parts` must stay as it was for a root."""
    spark, kind = log.sparkSession, log.schema["case_id"].dataType.simpleString()
    part = F.pmod(F.xxhash64("case_id"), F.lit(parts)).cast("int")

    def heads(of: DataFrame) -> DataFrame:
        return read_parts(spark, f"{root}/heads", HEADS.format(kind), touched(of.select(part.alias("part")), "part"), "part")

    new = once(lambda: context.next_versions(log, heads(log)), f"{root}/versions/batch_id={number}", spark)
    # All rows of the touched folders as they will be, written before any of them is replaced.
    whole = once(lambda: context.heads_of(heads(new).select("case_id", "version", "hash").unionByName(new.select("case_id", "version", "hash"))).withColumn("part", part), f"{root}/merged/batch_id={number}", spark)
    if not exists(spark, f"{root}/done/batch_id={number}/_SUCCESS"):
        overwrite_parts(whole.repartition("part"), f"{root}/heads", "part")  # a folder is one file
        spark.range(0).write.mode("overwrite").parquet(f"{root}/done/batch_id={number}")


def context_timeline(spark: SparkSession, root: str) -> DataFrame:
    """The rows of context.context_versions as all batches so far have left them, with their batch_id."""
    versions = spark.read.parquet(f"{root}/versions")
    last = spark.read.parquet(f"{root}/heads").select(F.col("case_id").alias("_id"), F.col("version").alias("_v"))
    x = versions.join(last, F.col("case_id").eqNullSafe(F.col("_id")), "left")
    return x.withColumn("is_current", F.coalesce(F.col("version") == F.col("_v"), F.lit(False))).drop("_id", "_v")


def context_stream(log: DataFrame, root: str) -> DataStreamWriter:
    """Each micro-batch of log by context_batch, under the number that the stream's checkpoint gives it."""
    return log.writeStream.foreachBatch(lambda df, number: context_batch(df, number, root)).trigger(availableNow=True)
