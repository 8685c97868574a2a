"""Queries of the case store: access, search, paging, nested records, upserts and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from docketry.sources.tables import checkpointed


def accessible_cases(cases: DataFrame, access: DataFrame, edit: bool = False) -> DataFrame:
    """(user_id, case_id) pairs: owners, and those granted access (to edit, if asked). A union of key sets, no OR-join."""
    granted = access.where("can_edit") if edit else access
    owned = cases.select(F.col("lawyer_id").alias("user_id"), F.col("id").alias("case_id"))
    return owned.union(granted.select("user_id", "case_id")).distinct()


def editable_cases(cases: DataFrame, access: DataFrame) -> DataFrame:
    return accessible_cases(cases, access, edit=True)


def search_cases(cases: DataFrame, numbers: DataFrame, access: DataFrame, user_id: str, status: str | None = None, case_type: str | None = None, search: str | None = None) -> DataFrame:
    """Cases a user may see, by optional filters; the term (with its wildcards) is sought in title, parties or numbers."""
    mine = accessible_cases(cases, access).where(F.col("user_id") == user_id).select(F.col("case_id").alias("id"))
    out = cases.join(mine, "id", "left_semi")
    if status:
        out = out.where(F.col("status") == status)
    if case_type:
        out = out.where(F.col("case_type") == case_type)
    if search:
        term = f"%{search}%"
        hit = numbers.where(F.col("case_number").ilike(term)).select(F.col("case_id").alias("id"), F.lit(True).alias("_hit")).distinct()
        text = F.col("case_title").ilike(term) | F.col("petitioner_name").ilike(term) | F.col("respondent_name").ilike(term)
        out = out.join(hit, "id", "left").where(F.coalesce(text, F.lit(False)) | F.col("_hit").isNotNull()).drop("_hit")
    return out


def paginate(df: DataFrame, order: list[Column], page: int, limit: int) -> DataFrame:
    """A page of rows; order must end in a key, so that pages do not overlap."""
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


#: Column that numbers the ranges of page_ranges.
RANGE = "_range"


def page_ranges(df: DataFrame, order: list[Column], path: str, parts: int | None = None) -> DataFrame:
    """df as a table in folders of consecutive ranges of the order, from which page_at reads pages of any depth.

    One range shuffle and one write, however many pages are asked for. The column `_range` must not be in df. order must end in a
    key, so that pages do not overlap and no range holds more than its share."""
    if RANGE in df.columns:
        raise ValueError(f"{RANGE} is a column of the table already")
    x = df.repartitionByRange(*([parts] if parts else []), *order).withColumn(RANGE, F.spark_partition_id())
    x.write.mode("overwrite").partitionBy(RANGE).parquet(path)
    return df.sparkSession.read.schema(StructType([*df.schema.fields, StructField(RANGE, IntegerType())])).parquet(path)


def range_counts(ranges: DataFrame) -> list[tuple[int, int]]:
    """(range, rows) in order, one for each range; the rows are counted without reading a column."""
    return sorted((r[0], r[1]) for r in ranges.groupBy(RANGE).count().collect())


def page_at(ranges: DataFrame, order: list[Column], page: int, limit: int, counts: list[tuple[int, int]] | None = None) -> DataFrame:
    """A page of a table written by page_ranges, with no rows but its own beyond the tasks that sort: only the ranges that the
    page lies in are read, and in each of them rows are taken by their rank. Pages before the first or after the last are empty.
    counts: of range_counts, where several pages are read."""
    first, end, before, places = (page - 1) * limit, page * limit, 0, {}
    for number, n in range_counts(ranges) if counts is None else counts:
        if before < end and before + n > first and page > 0:
            places[number] = before
        before += n
    x = ranges.where(F.col(RANGE).isin(list(places)) if places else F.lit(False))
    starts = F.create_map(*[F.lit(v) for kv in places.items() for v in kv]) if places else F.create_map().cast("map<int,int>")
    rank = starts[F.col(RANGE)] + F.row_number().over(Window.partitionBy(RANGE).orderBy(*order))
    return x.withColumn("_rank", rank).where((F.col("_rank") > first) & (F.col("_rank") <= end)).drop("_rank", RANGE)


def page_meta(df: DataFrame, limit: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / limit).cast("long"))


def assistants_for_owner(users: DataFrame, cases: DataFrame, access: DataFrame, role: str = "munshi") -> DataFrame:
    """(lawyer_id, user_id): assistants with access to any of an owner's cases."""
    x = access.join(cases.select(F.col("id").alias("case_id"), "lawyer_id"), "case_id").select("lawyer_id", "user_id").distinct()
    return x.join(users.where(F.col("role") == role).select(F.col("id").alias("user_id")), "user_id", "left_semi").select("lawyer_id", "user_id")


def last_of(new: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row a key: the last by `order`, or, where there is no order, the largest row."""
    rest = F.struct(*[F.col(c) for c in new.columns if c not in keys])
    row = F.max_by(rest, F.struct(F.col(order), rest)) if order else F.max(rest)
    return new.groupBy(*keys).agg(row.alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in new.columns])


def upsert(base: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = (), order: str | None = None) -> DataFrame:
    """Rows of base with those of new put over them; columns in keep stay as they are on update (if base has them). Of rows of
    new with one key the last by `order` counts."""
    new = last_of(new, keys, order)
    b, n = base.withColumn("_b", F.lit(True)).alias("b"), new.withColumn("_n", F.lit(True)).alias("n")
    cols = []
    for c in base.columns:
        if c in keys:
            cols.append(F.coalesce(F.col(f"n.{c}"), F.col(f"b.{c}")).alias(c))
        elif c in keep:
            cols.append(F.coalesce(F.col(f"b.{c}"), F.col(f"n.{c}")).alias(c))
        else:
            cols.append(F.when(F.col("n._n"), F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
    on = [F.col(f"b.{k}") == F.col(f"n.{k}") for k in keys]
    return b.join(n, on, "full").select(*cols)


def apply_patch(base: DataFrame, patch: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Only values of patch that are not null overwrite. Of patches with one key the last by `order` counts."""
    patch = last_of(patch, [key], order)
    p = patch.select(F.col(key), *[F.col(c).alias(f"_p_{c}") for c in patch.columns if c != key])
    cols = [F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c) if f"_p_{c}" in p.columns else F.col(c) for c in base.columns]
    return base.join(p, key, "left").select(*cols)


def apply_grants(access: DataFrame, cases: DataFrame, users: DataFrame, grants: DataFrame, revokes: DataFrame) -> DataFrame:
    """Access after grants (by case owners, to assistants or lawyers, never to oneself), then revocations."""
    ok = grants.where(F.col("user_id") != F.col("granted_by"))
    ok = ok.join(users.where(F.col("role").isin("munshi", "lawyer")).select(F.col("id").alias("user_id")), "user_id", "left_semi")
    ok = ok.join(cases.select(F.col("id").alias("case_id"), F.col("lawyer_id").alias("granted_by")), ["case_id", "granted_by"], "left_semi")
    out = upsert(access, ok.select(*access.columns), ["case_id", "user_id"])
    return out.join(revokes.select("case_id", "user_id"), ["case_id", "user_id"], "left_anti").select(*access.columns)


def soft_delete(rows: DataFrame, removals: DataFrame, key: str = "id") -> DataFrame:
    """Marks rows as removed; `rejected` marks removals of rows that were not active."""
    r = removals.select(F.col(key), F.col("removed_by").alias("_by"), F.lit(True).alias("_r")).dropDuplicates([key])
    x = rows.join(r, key, "left")
    now = F.col("_r").isNotNull() & F.col("is_active")
    return x.select(*[(F.col("is_active") & ~now).alias(c) if c == "is_active" else F.col(c) for c in rows.columns], F.when(now, F.col("_by")).alias("removed_by"), (F.col("_r").isNotNull() & ~F.col("is_active")).alias("rejected"))


def mark_read(notes: DataFrame, users: DataFrame) -> DataFrame:
    """All unread notes of the given users become read; a second run changes nothing."""
    u = users.select("user_id", F.lit(True).alias("_u")).distinct()
    x = notes.join(u, "user_id", "left")
    return x.select(*[(F.col("is_read") | F.col("_u").isNotNull()).alias(c) if c == "is_read" else F.col(c) for c in notes.columns], (F.col("_u").isNotNull() & ~F.col("is_read")).alias("changed"))


def unread_counts(notes: DataFrame) -> DataFrame:
    return notes.groupBy("user_id").agg(F.count_if(~F.col("is_read")).alias("unread"))


def profile_complete(users: DataFrame, fields: list[str]) -> DataFrame:
    """True once all fields are filled; never reset."""
    full = F.forall(F.array(*fields), lambda x: F.coalesce(x != "", F.lit(False)))
    return users.withColumn("is_profile_complete", full | F.coalesce("is_profile_complete", F.lit(False)))


def email_conflicts(users: DataFrame) -> DataFrame:
    """Addresses that more than one user has, case and outer blanks aside."""
    return users.groupBy(F.lower(F.trim("email")).alias("email")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def case_documents(cases: DataFrame, numbers: DataFrame, sections: DataFrame, parties: DataFrame) -> DataFrame:
    """One nested record for each case: numbers, active sections and parties, each list in order."""
    n = numbers.groupBy("case_id").agg(F.array_sort(F.collect_list("case_number")).alias("numbers"))
    s = sections.where("is_active").groupBy("case_id").agg(F.array_sort(F.collect_list("section")).alias("sections"))
    p = parties.groupBy("case_id").agg(F.array_sort(F.collect_list("name")).alias("parties"))
    out = cases.select(F.col("id").alias("case_id"), "case_title", "status")
    for child in (n, s, p):
        out = out.join(child, "case_id", "left")
    empty = F.array().cast("array<string>")
    return out.select("case_id", "case_title", "status", *[F.coalesce(c, empty).alias(c) for c in ("numbers", "sections", "parties")])


#: Rules that rows must keep, by name.
RULES: dict[str, str] = {
    "number_length": "length(case_number) BETWEEN 1 AND 100",
    "year_range": "year BETWEEN 1900 AND 2100",
    "date_range": "year(filing_date) >= 2000",
    "size_limit": "file_size BETWEEN 1 AND 52428800",
    "phone_digits": "phone RLIKE '^[0-9]+$'",
    "mime_allowed": "mime_type IN ('application/pdf','image/jpeg','image/png','image/tiff','image/webp')",
}


def validate_rows(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Adds the names of the rules that a row breaks; a null value breaks none."""
    broken = F.array(*[F.when(~F.expr(rule), F.lit(name)) for name, rule in rules.items()])
    return df.withColumn("violations", F.filter(broken, lambda x: x.isNotNull()))


def draft_lineage(drafts: DataFrame, max_rounds: int = 32) -> DataFrame:
    """(id, root, depth): pointer doubling over parents, so a chain of n drafts takes log2(n) joins; each round is checkpointed."""
    x = checkpointed(drafts.select("id", F.coalesce("parent_draft_id", "id").alias("root"), F.when(F.col("parent_draft_id").isNull(), 0).otherwise(1).alias("depth")))
    for _ in range(max_rounds):
        up = x.where("root <> id").select(F.col("id").alias("_i"), F.col("root").alias("_r"), F.col("depth").alias("_d"))
        moved = x.join(up, x["root"] == up["_i"], "left")
        new = checkpointed(moved.select("id", F.coalesce("_r", "root").alias("root"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), F.col("_r").isNotNull().alias("moved")))
        x = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return x
    raise ValueError("drafts form a cycle")


def next_version(drafts: DataFrame) -> DataFrame:
    """For each draft the version that a fork of it gets: after its latest child, or after itself."""
    kids = drafts.where("parent_draft_id IS NOT NULL").groupBy(F.col("parent_draft_id").alias("id")).agg(F.max("version").alias("_v"))
    return drafts.join(kids, "id", "left").select("id", (F.coalesce("_v", "version") + 1).alias("next_version"))


def exports_to_run(requests: DataFrame, exports: DataFrame, drafts: DataFrame) -> DataFrame:
    """Requests by the creator of a ready draft whose (draft, format) has no export yet, each once."""
    d = drafts.where(F.col("status") == "ready").select(F.col("id").alias("draft_id"), F.col("created_by").alias("user_id"))
    return requests.join(d, ["draft_id", "user_id"], "left_semi").join(exports.select("draft_id", "format"), ["draft_id", "format"], "left_anti").select("draft_id", "format").distinct()


def invalid_transitions(log: DataFrame, allowed: dict[str, set[str]], key: str = "id", frozen: str | None = "archived") -> DataFrame:
    """Each step of a state log with the state before it, its revision, and whether the step is allowed."""
    pairs = [(a, b) for a, bs in allowed.items() for b in bs]
    ok = F.broadcast(log.sparkSession.createDataFrame(pairs, "before string, state string").withColumn("_ok", F.lit(True)))
    w = Window.partitionBy(key).orderBy("ts", "seq")
    x = log.withColumn("before", F.lag("state").over(w)).withColumn("revision", F.row_number().over(w))
    x = x.join(ok, ["before", "state"], "left")
    valid = F.col("before").isNull() | F.col("_ok").isNotNull()
    if frozen:
        valid = valid & ((F.col("before") != frozen) | F.col("before").isNull())
    return x.withColumn("valid", valid).drop("_ok")


#: What drafts and extractions may become.
DRAFT_STEPS = {"generating": {"ready", "archived"}, "ready": {"editing", "final", "archived"}, "editing": {"final", "archived"}, "final": set()}
EXTRACTION_STEPS = {"pending": {"processing"}, "processing": {"completed", "failed"}, "failed": {"processing"}, "completed": {"processing"}}
