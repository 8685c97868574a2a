"""Case context: versions, staleness, pushes and budgets; document readiness; session messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.jsonx import context_hash
from docketry.functions.text import tokens_estimate

#: Token budgets, message limits.
CASE_BUDGET, PUSH_BUDGET = 80_000, 12_000
KEPT_MESSAGES, TURN_CAP, MESSAGE_CHARS = 50, 100, 5000
OK_REVIEW = ["edited", "accepted"]


def document_readiness(docs: DataFrame, typed: DataFrame, extractions: DataFrame) -> DataFrame:
    """Each document with its missing steps: OCR, then a reviewed typed version, then (if it ran) a reviewed extraction."""
    x = docs.join(typed.select("doc_id", F.col("status").alias("_t")), "doc_id", "left").join(extractions.select("doc_id", F.col("review_status").alias("_e")), "doc_id", "left")
    ocr = F.col("ocr_status").isin("completed", "not_required")
    typed_ok = (F.col("processing_route") == "digital_extract") | (ocr & F.coalesce(F.col("_t").isin(*OK_REVIEW), F.lit(False)))
    ex_ok = ~typed_ok | F.col("_e").isNull() | F.col("_e").isin(*OK_REVIEW)
    steps = F.array(F.when(~ocr, F.lit("ocr")), F.when(ocr & ~typed_ok, F.lit("typed_content")), F.when(~ex_ok, F.lit("extraction_review")))
    return x.select("doc_id", "case_id", (ocr & typed_ok & ex_ok).alias("is_ready"), F.filter(steps, lambda s: s.isNotNull()).alias("missing_steps"))


def readiness_summary(ready: DataFrame) -> DataFrame:
    has = lambda s: F.count_if(F.array_contains("missing_steps", s))
    g = ready.groupBy("case_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_ready").alias("ready"), has("ocr").alias("pending_ocr"), has("typed_content").alias("pending_typed"), has("extraction_review").alias("pending_extraction"))
    return g.withColumn("all_ready", (F.col("total") > 0) & (F.col("ready") == F.col("total")))


def _hashed(log: DataFrame) -> DataFrame:
    """Writes with the hash of what they leave: a clearing keeps `_case`, a null context is an empty one."""
    context = F.coalesce("context", F.create_map().cast(log.schema["context"].dataType))
    kept = F.map_filter(context, lambda k, v: k == "_case")
    return log.withColumn("context", F.when(F.coalesce("cleared", F.lit(False)), kept).otherwise(context)).withColumn("hash", context_hash(F.col("context")))


def context_versions(log: DataFrame) -> DataFrame:
    """log(case_id, seq, context map, cleared) -> one row for each change: version, hash and whether it is the current one. A write with an equal hash is none; a clearing always counts and keeps `_case`."""
    x = next_versions(log, None)
    last = F.max("version").over(Window.partitionBy("case_id"))
    return x.withColumn("is_current", F.col("version") == last)


def next_versions(log: DataFrame, heads: DataFrame | None) -> DataFrame:
    """The changes that log makes to cases whose last version is in heads(case_id, version, hash), or to new ones: the rows of
    context_versions (but is_current) as if the whole history had been read. A case's writes in log must come after its head.

    Only log is sorted; of the history one row for each of its cases is joined. A null case_id is a case like others."""
    w = Window.partitionBy("case_id").orderBy("seq")
    x, cleared = _hashed(log), F.coalesce("cleared", F.lit(False))
    if heads is None:
        before, start = F.lag("hash").over(w), F.lit(0).cast("long")
    else:
        h = heads.select(F.col("case_id").alias("_id"), F.col("version").alias("_v"), F.col("hash").alias("_h"))
        x = x.join(h, F.col("case_id").eqNullSafe(F.col("_id")), "left")
        before, start = F.coalesce(F.lag("hash").over(w), F.col("_h")), F.coalesce("_v", F.lit(0)).cast("long")
    changed = before.isNull() | (before != F.col("hash")) | cleared
    x = x.withColumn("_c", changed.cast("int")).withColumn("version", start + F.sum("_c").over(w)).where("_c = 1")
    return x.select(*log.columns, "hash", "version")


def heads_of(versions: DataFrame) -> DataFrame:
    """(case_id, version, hash) of each case's last version."""
    return versions.groupBy("case_id").agg(F.max("version").alias("version"), F.max_by("hash", "version").alias("hash"))


def stale_summaries(contexts: DataFrame, summaries: DataFrame) -> DataFrame:
    """Summaries whose context (if not empty) has changed since."""
    x = contexts.select("case_id", F.size("context").alias("_n"), context_hash(F.col("context")).alias("_h")).join(summaries, "case_id")
    return x.select("case_id", ((F.col("_n") > 0) & (F.col("_h") != F.col("context_snapshot_hash"))).alias("stale"))


def push_context(entries: DataFrame, budget: int = CASE_BUDGET) -> DataFrame:
    """entries(case_id, doc_id, seq, content): the latest entry of each document, with the case's tokens and whether they fit the budget; an entry replaced is gone."""
    last = entries.groupBy("case_id", "doc_id").agg(F.max_by("content", "seq").alias("content"), F.max("seq").alias("seq"))
    t = F.sum(tokens_estimate(F.col("content"))).over(Window.partitionBy("case_id"))
    return last.withColumn("tokens", tokens_estimate(F.col("content"))).withColumn("case_tokens", t).withColumn("fits", F.col("case_tokens") <= budget)


def context_entries(contexts: DataFrame) -> DataFrame:
    """contexts(case_id, context_json) as one long table (case_id, part, pos, name, entry): both layouts of a context, the list of
    `documents` with their ids (part "documents", in order) and all other keys (part "keys"); entries are JSON texts, keys in order.
    Members of the list that are no objects, and a `documents` that is no list, are passed over."""
    tvf, kind = contexts.sparkSession.tvf, lambda v: F.schema_of_variant(v)
    v = contexts.select("case_id", F.try_parse_json("context_json").alias("v")).where(kind("v").startswith("OBJECT"))
    docs = v.select("case_id", F.try_variant_get("v", "$.documents", "variant").alias("d")).where(kind("d").startswith("ARRAY"))
    docs = docs.lateralJoin(tvf.variant_explode(F.col("d").outer())).where(kind("value").startswith("OBJECT"))
    docs = docs.select("case_id", F.lit("documents").alias("part"), "pos", F.try_variant_get("value", "$.document_id", "string").alias("name"), F.to_json("value").alias("entry"))
    keys = v.lateralJoin(tvf.variant_explode(F.col("v").outer())).where("key <> 'documents'")
    return docs.unionByName(keys.select("case_id", F.lit("keys").alias("part"), "pos", F.col("key").alias("name"), F.to_json("value").alias("entry")))


def push_documents(contexts: DataFrame, pushes: DataFrame, budget: int = CASE_BUDGET) -> DataFrame:
    """contexts(case_id, context_json, pushed_documents map) after pushes(case_id, doc_id, seq, part, entry, meta).

    Of pushes of one document to one part the last by seq counts. In `documents` it takes the place at the end, an entry with its id
    is gone; in `keys` it is set under its id. Its meta goes to pushed_documents. All pushes to a case are one: if the context would
    have more tokens than the budget, the case keeps what it had (accepted is false; null where nothing was pushed). tokens: of the
    context with the pushes. Entries meet by case and document first, so that copies are gone before a case's entries are collected."""
    last = pushes.groupBy("case_id", "part", "doc_id").agg(F.max_by(F.struct("entry", "meta", "seq"), "seq").alias("l"))
    new = last.select("case_id", "part", F.struct(F.lit(1).alias("new"), F.col("l.seq").cast("long").alias("pos")).alias("at"), F.col("doc_id").alias("name"), "l.entry")
    old = context_entries(contexts).join(pushes.select("case_id").distinct(), "case_id", "left_semi")
    old = old.select("case_id", "part", F.struct(F.lit(0).alias("new"), F.col("pos").cast("long").alias("pos")).alias("at"), "name", "entry")
    same = (old["case_id"] == last["case_id"]) & (old["part"] == last["part"]) & (old["name"] == last["doc_id"])
    rows = old.join(last, same, "left_anti").unionByName(new)
    pick = lambda part, by: F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct(by, "name", "entry"))))
    rows = rows.groupBy("case_id").agg(pick("keys", F.col("name").alias("by")).alias("_k"), pick("documents", F.col("at").alias("by")).alias("_d"))
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    body = F.transform("_k", lambda e: F.concat(quoted(e["name"]), F.lit(":"), e["entry"]))
    docs = F.concat(F.lit('"documents":['), F.array_join(F.transform("_d", lambda e: e["entry"]), ","), F.lit("]"))
    text = F.concat(F.lit("{"), F.array_join(F.when(F.size("_d") > 0, F.array_append(body, docs)).otherwise(body), ","), F.lit("}"))
    metas = last.groupBy("case_id", "doc_id").agg(F.max_by("l.meta", "l.seq").alias("meta")).groupBy("case_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc_id", "meta")))).alias("_m"))
    x = contexts.join(rows.select("case_id", text.alias("_new")).join(metas, "case_id"), "case_id", "full").withColumn("tokens", tokens_estimate(F.coalesce("_new", "context_json")))
    ok = F.col("_new").isNotNull() & (F.col("tokens") <= budget)
    before = F.coalesce("pushed_documents", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(before, lambda k, v: ~F.array_contains(F.map_keys("_m"), k)), F.col("_m"))
    return x.select("case_id", F.when(ok, F.col("_new")).otherwise(F.col("context_json")).alias("context_json"), F.when(ok, merged).otherwise(before).alias("pushed_documents"), "tokens", F.when(F.col("_new").isNotNull(), ok).alias("accepted"))


def token_budget(texts: DataFrame, budget: int = CASE_BUDGET) -> DataFrame:
    g = texts.groupBy("case_id").agg(F.sum(tokens_estimate(F.col("text"))).alias("tokens"))
    return g.withColumn("within_budget", F.col("tokens") <= budget)


def trim_messages(sessions: DataFrame, most: int = KEPT_MESSAGES) -> DataFrame:
    m = F.col("messages")
    return sessions.withColumn("messages", F.slice(m, F.greatest(F.lit(1), F.size(m) - most + 1), F.lit(most)))


def transcripts(sessions: DataFrame) -> DataFrame:
    """Messages as text, one `ROLE: content` a paragraph, contents cut to the limit; and whether the session has turns left."""
    role = lambda r: F.when(r == "lawyer", "Advocate").otherwise("Opponent")
    text = F.array_join(F.transform("messages", lambda m: F.concat(role(m["role"]), F.lit(": "), F.left(m["content"], F.lit(MESSAGE_CHARS)))), "\n\n")
    turns = F.size(F.filter("messages", lambda m: m["role"] == "lawyer"))
    return sessions.select("id", text.alias("transcript"), turns.alias("turns"), (turns < TURN_CAP).alias("open"))


def backfill_pushed_map(contexts: DataFrame) -> DataFrame:
    """Where the map is empty and the list of ids is not, a map of ids to the time of the last update (or of creation)."""
    when = F.coalesce("last_updated_at", "created_at").cast("string")
    made = F.map_from_entries(F.transform(F.array_distinct("pushed_ids"), lambda i: F.struct(i, when)))
    fill = (F.coalesce(F.size("pushed_map"), F.lit(0)) <= 0) & (F.size("pushed_ids") > 0)
    return contexts.withColumn("pushed_map", F.when(fill, made).otherwise(F.col("pushed_map")))


def document_state(log: DataFrame) -> DataFrame:
    """log(doc_id, seq, event) -> state after the last event, with the attempts since the last completion or skip."""
    state = F.when(F.col("event") == "start", "processing").when(F.col("event") == "complete", "completed").when(F.col("event") == "fail", "failed").otherwise("skipped")
    done = F.max(F.when(F.col("event").isin("complete", "skip"), F.col("seq")))
    g = log.groupBy("doc_id").agg(F.max_by(state, "seq").alias("state"), done.alias("_d"), F.max("seq").alias("seq"))
    tries = log.join(g.select("doc_id", "_d"), "doc_id").where("event = 'start' AND seq > coalesce(_d, -1)").groupBy("doc_id").agg(F.count(F.lit(1)).alias("attempts"))
    return g.drop("_d").join(tries, "doc_id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))


def job_status(log: DataFrame, now: str, ttl_hours: int = 24) -> DataFrame:
    """The latest status of each job that is younger than the time to live."""
    g = log.groupBy("job_id").agg(F.max_by("status", F.struct("updated_at", "seq")).alias("status"), F.max("updated_at").alias("updated_at"))
    return g.where(F.col("updated_at") > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {ttl_hours} HOURS"))


def document_states(log: DataFrame, now: str, seconds: int = 120) -> DataFrame:
    """document_state of log(doc_id, seq, event, ts), where what has been processing for so many seconds has failed, with the reason."""
    last = log.groupBy("doc_id").agg(F.max_by("ts", "seq").alias("_ts"))
    x = document_state(log).join(last, "doc_id")
    stale = (F.col("state") == "processing") & (F.col("_ts") + F.expr(f"INTERVAL {seconds} SECONDS") <= F.lit(now).cast("timestamp"))
    return x.select("doc_id", F.when(stale, "failed").otherwise(F.col("state")).alias("state"), "seq", "attempts", F.when(stale, "did not finish in time").alias("error"))


def stale_jobs(jobs: DataFrame, now: str, seconds: int = 120) -> DataFrame:
    """Processing for so many seconds or more counts as failed."""
    old = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("updated_at") >= seconds
    return jobs.withColumn("status", F.when((F.col("status") == "processing") & old, "failed").otherwise(F.col("status")))


def rate_limit(calls: DataFrame, limit: int = 30, seconds: int = 3600) -> DataFrame:
    """calls(user_id, ts) by fixed windows: count and calls above the limit."""
    bucket = F.floor(F.unix_timestamp("ts") / seconds).cast("long")
    g = calls.groupBy("user_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("calls"))
    return g.withColumn("rejected", F.greatest(F.lit(0), F.col("calls") - limit))
