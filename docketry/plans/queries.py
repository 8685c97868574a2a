"""One query for each operator, over model tables, with the SQL that DuckDB answers it with."""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import jsonx, text
from docketry.operators import cases, context, forms, listings, pages, render, tables
from docketry.plans.adapters import model, with_models
from docketry.sources import tables as src
from docketry.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of m(name) -> DataFrame as a query."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            m = lambda name: model(spark, sf_dir, name)
            m.tables = lambda *names: src.load_tables(spark, sf_dir, *names)
            return f(m)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = with_models(sql)
        return f

    return add


# --- court lists ---

_LCS = """list_last(list_reduce(list_prepend(list_transform(range(length(b) + 1), lambda z: CAST(0 AS BIGINT)), list_transform(string_split(a, ''), lambda ch: [CAST(unicode(ch) AS BIGINT)])),
 lambda prev, ch: list_reduce(list_prepend([CAST(0 AS BIGINT)], list_transform(range(1, length(b) + 1), lambda j: [CAST(j AS BIGINT)])),
   lambda acc, jj: list_append(acc, CASE WHEN unicode(substr(b, CAST(jj[1] AS INT), 1)) = ch[1] THEN prev[jj[1]] + 1 ELSE greatest(prev[jj[1] + 1], acc[jj[1]]) END))))"""

_FUZZY = f"""WITH a AS (SELECT row_id, regexp_replace(lower(trim(case_number)), '[\\s/.-]+', '', 'g') AS a FROM m_listings),
b AS (SELECT min(case_id) AS case_id, b FROM (SELECT case_id, regexp_replace(lower(trim(number)), '[\\s/.-]+', '', 'g') AS b FROM m_choices) GROUP BY b),
ex AS (SELECT row_id, case_id, CAST(100.0 AS DOUBLE) AS score FROM a JOIN b ON a = b),
l AS (SELECT DISTINCT a FROM a WHERE a NOT IN (SELECT b FROM b)),
q AS (SELECT a, b, case_id, levenshtein(a, b) AS v, length(a) + length(b) AS n FROM l JOIN b ON levenshtein(a, b) <= 3 * (length(a) + length(b)) // 20),
p AS (SELECT a, b, case_id FROM q QUALIFY 1 - v / n + 1e-9 >= max(1 - 2 * v / n) OVER (PARTITION BY a)),
s AS (SELECT a, b, case_id, 200.0::DOUBLE * {_LCS} / (length(a) + length(b)) AS score FROM p),
t AS (SELECT a, case_id, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s WHERE score >= 85)
SELECT row_id, case_id, score FROM ex UNION ALL SELECT row_id, case_id, score FROM t JOIN a USING (a) WHERE k = 1"""


@query(_FUZZY)
def match_listings(m):
    return listings.fuzzy_match(m("m_listings").select("row_id", F.col("case_number").alias("number")), m("m_choices"))


@query("SELECT row_id, regexp_replace(lower(trim(case_number)), '[\\s/.-]+', '', 'g') AS norm FROM m_listings")
def normalize_case_numbers(m):
    return m("m_listings").select("row_id", text.norm_case_no(F.col("case_number")).alias("norm"))


@query("SELECT row_id, nullif(upper(regexp_extract(trim(case_number), '(?i)^([A-Z][A-Z0-9.\\-]{1,15})/', 1)), '') AS kind, nullif(trim(regexp_replace(case_title, '\\s+', ' ', 'g')), '') AS title FROM m_listings")
def case_type_and_title(m):
    return m("m_listings").select("row_id", text.case_type_of(F.col("case_number")).alias("kind"), text.clean_space(F.col("case_title")).alias("title"))


@query("""WITH n AS (SELECT case_number, arg_max(existing_id, seq) AS a FROM m_existing WHERE case_number IS NOT NULL GROUP BY 1),
s AS (SELECT court_number, serial_number, arg_max(existing_id, seq) AS b FROM m_existing WHERE serial_number IS NOT NULL GROUP BY 1, 2)
SELECT l.row_id, coalesce(n.a, s.b) AS existing_id, l.serial_number IS NOT NULL AND count(*) OVER (PARTITION BY l.court_number, l.serial_number) > 1 AS key_conflict
FROM m_listings l LEFT JOIN n ON l.case_number = n.case_number LEFT JOIN s ON l.court_number = s.court_number AND l.serial_number = s.serial_number""")
def match_existing(m):
    return listings.match_existing(m("m_listings"), m("m_existing")).select("row_id", "existing_id", "key_conflict")


@query("SELECT count(*) AS total, count(*) FILTER (existing_id IS NULL) AS inserted, count(existing_id) AS updated, count(matched_case_id) AS matched FROM m_matched")
def list_run_stats(m):
    return listings.list_run_stats(m("m_matched"))


@query("""SELECT c.lawyer_id AS user_id, 'cause_list_match:' || CAST(x.listing_date AS STRING) || ':' || x.matched_case_id AS dedup_key, 'Case listed on ' || strftime(x.listing_date, '%d %b %Y') AS title,
x.case_number || ' is listed in Court ' || x.court_number || ', Serial ' || CAST(x.serial_number AS STRING) || ' on ' || strftime(x.listing_date, '%d %b %Y') || '.' AS message
FROM m_matched x JOIN m_cases c ON c.id = x.matched_case_id WHERE x.matched_case_id IS DISTINCT FROM x.previous_case_id
AND NOT EXISTS (SELECT 1 FROM m_sent s WHERE s.dedup_key = 'cause_list_match:' || CAST(x.listing_date AS STRING) || ':' || x.matched_case_id)""")
def new_notifications(m):
    return listings.new_notifications(m("m_matched"), m("m_cases"), m("m_sent"))


@query("SELECT row_id, court_number, serial_number FROM m_listings WHERE listing_date = DATE '1995-03-01' AND court_number ILIKE '%c1%' AND (case_number ILIKE '%wria%' OR case_title ILIKE '%party 1%' OR advocate_name ILIKE '%adv 2%')")
def listings_for_date(m):
    return listings.listings_for_date(m("m_listings"), "1995-03-01", "c1", "adv 2").select("row_id", "court_number", "serial_number").union(listings.listings_for_date(m("m_listings"), "1995-03-01", "c1", "wria").select("row_id", "court_number", "serial_number")).union(listings.listings_for_date(m("m_listings"), "1995-03-01", "c1", "party 1").select("row_id", "court_number", "serial_number")).distinct()


@query("SELECT x.row_id, x.matched_case_id, c.lawyer_id AS user_id FROM m_matched x JOIN m_cases c ON x.matched_case_id = c.id")
def my_matches(m):
    return listings.my_matches(m("m_matched"), m("m_cases")).select("row_id", "matched_case_id", "user_id")


def _asof(m):
    day = F.date_format(F.col("filing_date"), "dd-MM-yyyy")
    avail = m("m_cases").select(F.col("lawyer_id").alias("list_id"), F.col("seq").alias("pos"), F.when(F.col("seq") % 10 == 3, F.lit("bad")).otherwise(day).alias("label"))
    return avail.select("list_id").distinct().withColumn("target", F.lit("1996-06-15").cast("date")), avail


@query("""WITH d AS (SELECT lawyer_id AS list_id, seq AS pos, CASE WHEN seq % 10 = 3 THEN 'bad' ELSE strftime(filing_date, '%d-%m-%Y') END AS label, CASE WHEN seq % 10 = 3 THEN NULL ELSE filing_date END AS d FROM m_cases)
SELECT list_id, '1996-06-15' AS target, coalesce((SELECT label FROM d x WHERE x.list_id = y.list_id AND x.d <= DATE '1996-06-15' ORDER BY x.d DESC, x.pos LIMIT 1), (SELECT label FROM d x WHERE x.list_id = y.list_id ORDER BY pos LIMIT 1)) AS label
FROM (SELECT DISTINCT list_id FROM d) y""")
def asof_date(m):
    return listings.asof_date(*_asof(m)).withColumn("target", F.col("target").cast("string"))


def _pages(m):
    """Pages of lists: each row of a page is a line with a serial and parties, and a case number."""
    rows = F.sort_array(F.collect_list(F.struct("o_orderkey", F.concat("body", "cn").alias("t"))))
    return m("m_lists").groupBy("list_id", "page", "head").agg(F.concat("head", F.array_join(F.transform(rows, lambda r: r["t"]), "\n")).alias("text"))


@query("""WITH first AS (SELECT list_id, page, o_orderkey, body, cn, row_number() OVER (PARTITION BY list_id, cn ORDER BY page, o_orderkey) AS k FROM m_lists),
h AS (SELECT list_id, page, nullif(regexp_extract(any_value(head), 'No-(\\d+)', 1), '') AS c, any_value(head) || string_agg(body || cn, chr(10) ORDER BY o_orderkey) AS text FROM m_lists GROUP BY 1, 2),
c AS (SELECT list_id, page, text, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY list_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'UNKNOWN') AS court FROM h),
x AS (SELECT f.list_id, f.page, court, body, cn, strpos(text, cn) - 1 AS spot, text FROM first f JOIN c ON f.list_id = c.list_id AND f.page = c.page WHERE k = 1),
y AS (SELECT *, substr(text, greatest(1, spot - 299), least(spot, 300)) AS near FROM x),
z AS (SELECT *, regexp_extract(near, '(?s)^(.*?)\\s{2,}VS\\s{2,}', 1) AS l, regexp_extract(near, '(?s)^.*?\\s{2,}VS\\s{2,}(.*)$', 1) AS r, regexp_matches(near, '\\s{2,}VS\\s{2,}') AS has FROM y),
p AS (SELECT *, CASE WHEN has THEN nullif(trim(regexp_replace(string_split(trim(l), chr(10))[-1], '\\s+', ' ', 'g')), '') END AS petitioner, CASE WHEN has THEN nullif(trim(regexp_replace(string_split(ltrim(r), chr(10))[1], '\\s+', ' ', 'g')), '') END AS respondent FROM z)
SELECT list_id, page, CAST(spot AS INT) AS "at", court AS court_number, CAST(trim(regexp_extract(body, '^ +(\\d+)', 1)) AS INT) AS serial_number, cn AS case_number, petitioner, respondent,
CASE WHEN petitioner IS NOT NULL OR respondent IS NOT NULL THEN trim(coalesce(petitioner, '') || ' VS ' || coalesce(respondent, '')) END AS case_title, 'WRIA' AS case_type_raw FROM p""")
def parse_listings(m):
    return listings.parse_listings(_pages(m).select("list_id", "page", "text"))


_NEAREST = _FUZZY.split("ex AS", 1)[1]

_BATCHES = f"""WITH d AS (SELECT *, CAST(substr(list_id, 1, 10) AS DATE) AS day FROM m_lists), n AS (SELECT 0 AS batch, * FROM d WHERE o_orderkey % 4 = 0 UNION ALL SELECT 1, * FROM d),
first AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY batch, list_id, cn ORDER BY page, o_orderkey) = 1),
h AS (SELECT DISTINCT batch, list_id, page, nullif(regexp_extract(head, 'No-(\\d+)', 1), '') AS c FROM n),
c AS (SELECT batch, list_id, page, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY batch, list_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'UNKNOWN') AS court FROM h),
rows AS (SELECT f.batch, day, f.page, o_orderkey AS k, f.batch || ':' || o_orderkey AS row_id, court, CAST(trim(regexp_extract(body, '^ +(\\d+)', 1)) AS INT) AS serial, cn FROM first f JOIN c ON f.list_id = c.list_id AND f.page = c.page AND f.batch = c.batch),
a AS (SELECT row_id, lower(replace(cn, '/', '')) AS a FROM rows),
b AS (SELECT min(case_id) AS case_id, b FROM (SELECT case_id, lower(replace(number, '-', '')) AS b FROM m_listchoices) GROUP BY b),
ex AS {_NEAREST.split("SELECT row_id, case_id, score FROM ex")[0].rstrip()},
best AS (SELECT row_id, case_id FROM ex UNION ALL SELECT row_id, case_id FROM t JOIN a USING (a) WHERE k = 1),
m AS (SELECT rows.*, case_id AS hit FROM rows LEFT JOIN best USING (row_id)),
e AS (SELECT * FROM m WHERE batch = 0),
no AS (SELECT day, cn, arg_max(row_id, (page, k)) AS id FROM e GROUP BY 1, 2), cs AS (SELECT day, court, serial, arg_max(row_id, (page, k)) AS id FROM e GROUP BY 1, 2, 3),
u AS (SELECT m.*, coalesce(no.id, cs.id) AS old FROM m LEFT JOIN no ON m.day = no.day AND m.cn = no.cn LEFT JOIN cs ON m.day = cs.day AND m.court = cs.court AND m.serial = cs.serial WHERE batch = 1),
v AS (SELECT u.*, CASE WHEN old IS NOT NULL AND row_number() OVER w > 1 THEN lag(u.hit) OVER w ELSE e.hit END AS prev, row_number() OVER (PARTITION BY old ORDER BY u.page DESC, u.k DESC) AS back FROM u LEFT JOIN e ON e.row_id = u.old WINDOW w AS (PARTITION BY old ORDER BY u.page, u.k)),
final AS (SELECT batch, day, court, serial, cn, hit FROM v WHERE old IS NULL OR back = 1 UNION ALL SELECT batch, day, court, serial, cn, hit FROM e WHERE row_id NOT IN (SELECT old FROM v WHERE old IS NOT NULL)),
ev AS (SELECT batch, day, page, k, court, serial, cn, hit, NULL AS prev FROM e UNION ALL SELECT batch, day, page, k, court, serial, cn, hit, prev FROM v),
note AS (SELECT *, 'cause_list_match:' || CAST(day AS STRING) || ':' || hit AS dk FROM ev WHERE hit IS NOT NULL AND hit IS DISTINCT FROM prev QUALIFY row_number() OVER (PARTITION BY day, hit ORDER BY batch, page, k) = 1)
"""


@query(_BATCHES + """SELECT 'row' AS kind, batch, CAST(day AS STRING) || ' ' || cn AS what, hit AS who, court || ':' || serial AS text FROM final
UNION ALL SELECT 'note', batch, dk, lawyer_id, 'Case listed on ' || strftime(day, '%d %b %Y') || ': ' || cn || ' is listed in Court ' || court || ', Serial ' || serial || ' on ' || strftime(day, '%d %b %Y') || '.' FROM note JOIN m_cases ON id = hit
UNION ALL SELECT 'stats', 0, NULL, NULL, count(*) || ',' || count(*) || ',0,' || count(hit) FROM e
UNION ALL SELECT 'stats', 1, NULL, NULL, count(*) || ',' || count(*) FILTER (old IS NULL) || ',' || count(old) || ',' || count(hit) FROM v""")
def cause_list_batch(m):
    """Two batches of pages, the second one run twice, as a stream whose driver was lost would do it."""
    p = lambda where: _pages(lambda name: m(name).where(where)).withColumn("listing_date", F.to_date(F.left("list_id", F.lit(10))))
    root = src.shared_path(m("m_lists").sparkSession, "cause_lists")
    for number, where in ((0, "o_orderkey % 4 = 0"), (1, "true"), (1, "true")):
        jobs.cause_list_batch(p(where), number, m("m_listchoices"), m("m_cases"), root)
    t = jobs.cause_list_tables(m("m_lists").sparkSession, root)
    rows = t["listings"].select(F.lit("row").alias("kind"), "batch", F.concat_ws(" ", F.col("listing_date").cast("string"), "case_number").alias("what"), F.col("matched_case_id").alias("who"), F.concat_ws(":", "court_number", "serial_number").alias("text"))
    notes = t["notes"].select(F.lit("note"), "batch_id", "dedup_key", "user_id", F.concat_ws(": ", "title", "message"))
    none = F.lit(None).cast("string")
    return rows.union(notes).union(t["stats"].select(F.lit("stats"), "batch_id", none, none, F.concat_ws(",", *jobs.RUN)))


@query("SELECT CAST(listing_date AS STRING) AS day, row_id, CASE WHEN CAST(row_id AS BIGINT) % 3 = 0 AND month(listing_date) = 3 THEN 'new ' || case_number ELSE case_number END AS case_number FROM m_listings UNION ALL SELECT CAST(listing_date AS STRING), 'x' || row_id, 'added' FROM m_listings WHERE month(listing_date) = 3 AND CAST(row_id AS BIGINT) % 5 = 0 UNION ALL SELECT CAST(listing_date AS STRING), 'y' || row_id, 'appended' FROM m_listings WHERE month(listing_date) = 7")
def write_upsert(m):
    """A table in folders by day; rows of every March put over it, only whose folders are written; and rows appended to every July."""
    x = m("m_listings").select("listing_date", "row_id", "case_number")
    path, n = src.shared_path(x.sparkSession, "listings"), F.col("row_id").cast("long")
    src.append_rows(x, path)
    march = x.where(F.month("listing_date") == 3)
    new = march.where(n % 3 == 0).withColumn("case_number", F.concat(F.lit("new "), "case_number"))
    src.write_upsert(new.unionByName(march.where(n % 5 == 0).select("listing_date", F.concat(F.lit("x"), "row_id").alias("row_id"), F.lit("added").alias("case_number"))), ["listing_date", "row_id"], path)
    src.append_rows(x.where(F.month("listing_date") == 7).select("listing_date", F.concat(F.lit("y"), "row_id").alias("row_id"), F.lit("appended").alias("case_number")), path)
    return src.read_parts(x.sparkSession, path, x.schema).select(F.col("listing_date").cast("string").alias("day"), "row_id", "case_number")


# --- case store ---

_ACCESS = "SELECT lawyer_id AS user_id, id AS case_id FROM m_cases UNION SELECT user_id, case_id FROM m_access"


@query(_ACCESS)
def accessible_cases(m):
    return cases.accessible_cases(m("m_cases"), m("m_access"))


@query(_ACCESS + " WHERE can_edit")
def editable_cases(m):
    return cases.editable_cases(m("m_cases"), m("m_access"))


@query("""SELECT id, status, case_type FROM m_cases WHERE (lawyer_id = 'a3' OR id IN (SELECT case_id FROM m_access WHERE user_id = 'a3')) AND status = 'active'
AND (case_title ILIKE '%party 1%' OR petitioner_name ILIKE '%party 1%' OR respondent_name ILIKE '%party 1%' OR id IN (SELECT case_id FROM m_numbers WHERE case_number ILIKE '%party 1%'))""")
def search_cases(m):
    return cases.search_cases(m("m_cases"), m("m_numbers"), m("m_access"), "a3", status="active", search="party 1").select("id", "status", "case_type")


@query("SELECT id, CAST(filing_date AS STRING) AS filing_date FROM m_cases ORDER BY filing_date DESC NULLS FIRST, id LIMIT 20 OFFSET 40")
def case_page(m):
    return cases.paginate(m("m_cases").select("id", F.col("filing_date").cast("string").alias("filing_date")), [F.col("filing_date").desc_nulls_first(), F.col("id")], 3, 20)


@query("""WITH r AS (SELECT id, CAST(filing_date AS STRING) AS filing_date, row_number() OVER (ORDER BY filing_date DESC NULLS FIRST, id) - 1 AS n, count(*) OVER () AS t FROM m_cases)
SELECT CAST(n // 20 + 1 AS BIGINT) AS page, id, filing_date FROM r WHERE n // 20 IN (0, t // 40, (t - 1) // 20)""")
def deep_pages(m):
    """The first page, one in the middle and the last one."""
    x = m("m_cases").select("id", F.col("filing_date").cast("string").alias("filing_date"))
    order = [F.col("filing_date").desc_nulls_first(), F.col("id")]
    ranges = cases.page_ranges(x, order, src.shared_path(x.sparkSession, "pages"))
    counts = cases.range_counts(ranges)
    total = sum(n for _, n in counts)
    pages_ = sorted({1, total // 40 + 1, max(1, -(-total // 20))})
    at = [cases.page_at(ranges, order, p, 20, counts).select(F.lit(p).cast("long").alias("page"), "id", "filing_date") for p in pages_]
    return functools.reduce(DataFrame.union, at)


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM m_cases WHERE status = 'active'")
def page_meta(m):
    return cases.page_meta(m("m_cases").where("status = 'active'"), 20)


@query("SELECT DISTINCT c.lawyer_id, a.user_id FROM m_access a JOIN m_cases c ON a.case_id = c.id JOIN m_users u ON u.id = a.user_id WHERE u.role = 'munshi'")
def assistants_for_owner(m):
    return cases.assistants_for_owner(m("m_users"), m("m_cases"), m("m_access"))


_GRANTS = "SELECT id AS case_id, 'a' || CAST(seq % 50 + 1 AS STRING) AS user_id, CASE WHEN seq % 5 = 0 THEN 'x' ELSE lawyer_id END AS granted_by, seq % 2 = 0 AS can_edit FROM m_cases WHERE seq % 3 = 0"


@query(f"""WITH g AS (SELECT g.* FROM ({_GRANTS}) g JOIN m_cases c ON c.id = g.case_id AND c.lawyer_id = g.granted_by JOIN m_users u ON u.id = g.user_id AND u.role IN ('munshi', 'lawyer') WHERE g.user_id <> g.granted_by)
SELECT coalesce(g.case_id, a.case_id) AS case_id, coalesce(g.user_id, a.user_id) AS user_id, CASE WHEN g.case_id IS NULL THEN a.granted_by ELSE g.granted_by END AS granted_by, CASE WHEN g.case_id IS NULL THEN a.can_edit ELSE g.can_edit END AS can_edit
FROM m_access a FULL JOIN g ON a.case_id = g.case_id AND a.user_id = g.user_id WHERE NOT (coalesce(g.user_id, a.user_id) = 'a7')""")
def apply_grants(m):
    g = m("m_cases").where("seq % 3 = 0").selectExpr("id AS case_id", "'a' || CAST(seq % 50 + 1 AS STRING) AS user_id", "CASE WHEN seq % 5 = 0 THEN 'x' ELSE lawyer_id END AS granted_by", "seq % 2 = 0 AS can_edit")
    revoked = m("m_access").unionByName(g).where("user_id = 'a7'")
    return cases.apply_grants(m("m_access"), m("m_cases"), m("m_users"), g, revoked)


_RECORDS = "SELECT c.id AS case_id, c.status, coalesce(n.x, '') AS numbers, coalesce(s.x, '') AS sections, coalesce(p.x, '') AS parties FROM m_cases c LEFT JOIN (SELECT case_id, string_agg(case_number, ',' ORDER BY case_number) AS x FROM m_numbers GROUP BY 1) n ON n.case_id = c.id LEFT JOIN (SELECT case_id, string_agg(section, ',' ORDER BY section) AS x FROM m_sections WHERE is_active GROUP BY 1) s ON s.case_id = c.id LEFT JOIN (SELECT case_id, string_agg(name, ',' ORDER BY name) AS x FROM m_parties GROUP BY 1) p ON p.case_id = c.id"


@query(_RECORDS)
def case_documents(m):
    d = cases.case_documents(m("m_cases"), m("m_numbers"), m("m_sections"), m("m_parties"))
    return d.select("case_id", "status", *[F.array_join(c, ",").alias(c) for c in ("numbers", "sections", "parties")])


def _bucketed(df: DataFrame, by: str) -> DataFrame:
    spark = df.sparkSession
    return src.save_bucketed(df, f"docketry_{uuid.uuid4().hex}", by, int(spark.conf.get("spark.sql.shuffle.partitions")), src.shared_path(spark, "buckets"))


@query(_RECORDS)
def bucketed_case_documents(m):
    """case_documents over tables in buckets of the case: joined in place."""
    d = cases.case_documents(_bucketed(m("m_cases"), "id"), *[_bucketed(m(n), "case_id") for n in ("m_numbers", "m_sections", "m_parties")])
    return d.select("case_id", "status", *[F.array_join(c, ",").alias(c) for c in ("numbers", "sections", "parties")])


@query("SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN o.status ELSE n.review_status END AS status FROM m_typed o FULL JOIN m_extract n ON o.doc_id = n.doc_id")
def upsert_rows(m):
    return cases.upsert(m("m_typed"), m("m_extract").withColumnRenamed("review_status", "status"), ["doc_id"])


@query("SELECT d.doc_id, coalesce(p.status, d.ocr_status) AS ocr_status FROM m_docs d LEFT JOIN m_typed p ON p.doc_id = d.doc_id")
def apply_patch(m):
    return cases.apply_patch(m("m_docs").select("doc_id", "ocr_status"), m("m_typed").withColumnRenamed("status", "ocr_status"), "doc_id")


@query("SELECT id, is_active AND NOT x AS is_active, CASE WHEN is_active AND x THEN 'admin' END AS removed_by, x AND NOT is_active AS rejected FROM (SELECT id, is_active, CAST(case_id AS BIGINT) % 4 = 0 AS x FROM m_sections)")
def soft_delete(m):
    gone = m("m_sections").where("CAST(case_id AS BIGINT) % 4 = 0").select("id", F.lit("admin").alias("removed_by"))
    return cases.soft_delete(m("m_sections").select("id", "is_active"), gone)


@query("SELECT id, is_read OR user_id % 2 = 0 AS is_read, user_id % 2 = 0 AND NOT is_read AS changed FROM m_notes")
def mark_read(m):
    return cases.mark_read(m("m_notes"), m("m_notes").where("user_id % 2 = 0").select("user_id")).select("id", "is_read", "changed")


@query("SELECT user_id, count(*) FILTER (NOT is_read) AS unread FROM m_notes GROUP BY 1")
def unread_counts(m):
    return cases.unread_counts(m("m_notes"))


@query("SELECT id, (trim(email) <> '' AND role <> '' AND coalesce(CASE WHEN role = 'lawyer' THEN id END, '') <> '') AS is_profile_complete FROM m_users")
def profile_complete(m):
    u = m("m_users").withColumn("number", F.when(F.col("role") == "lawyer", F.col("id"))).withColumn("is_profile_complete", F.lit(False))
    return cases.profile_complete(u, ["email", "role", "number"]).select("id", "is_profile_complete")


@query("SELECT lower(trim(email)) AS email, count(*) AS n FROM (SELECT * FROM m_users UNION ALL SELECT id, upper(email), role FROM m_users WHERE role = 'lawyer') GROUP BY 1 HAVING count(*) > 1")
def email_conflicts(m):
    u = m("m_users")
    return cases.email_conflicts(u.unionByName(u.where("role = 'lawyer'").withColumn("email", F.upper("email"))))


@query("""SELECT row_id, array_to_string(list_filter([CASE WHEN NOT length(case_number) BETWEEN 1 AND 14 THEN 'number_length' END, CASE WHEN NOT serial_number BETWEEN 1 AND 2 THEN 'serial_range' END], lambda x: x IS NOT NULL), ',') AS violations FROM m_listings""")
def validate_rows(m):
    v = cases.validate_rows(m("m_listings"), {"number_length": "length(case_number) BETWEEN 1 AND 14", "serial_range": "serial_number BETWEEN 1 AND 2"})
    return v.select("row_id", F.array_join("violations", ",").alias("violations"))


_CHECKED = """SELECT doc_id, repeat('9', CAST(doc_id % 104 AS INT)) AS case_number, CAST(1890 + doc_id % 220 AS INT) AS year, CAST(CAST(1990 + doc_id % 30 AS STRING) || '-06-15' AS DATE) AS filing_date, CAST(doc_id % 60 AS BIGINT) * 1048576 AS file_size,
CASE WHEN doc_id % 7 = 0 THEN '12 34' WHEN doc_id % 7 = 1 THEN NULL ELSE '1234' END AS phone, mime AS mime_type FROM {0}"""


@query(f"""SELECT doc_id, concat_ws(',', CASE WHEN NOT length(case_number) BETWEEN 1 AND 100 THEN 'number_length' END, CASE WHEN year < 1900 OR year > 2100 THEN 'year_range' END, CASE WHEN filing_date < DATE '2000-01-01' THEN 'date_range' END,
CASE WHEN file_size = 0 OR file_size > 50 * 1024 * 1024 THEN 'size_limit' END, CASE WHEN NOT regexp_full_match(phone, '[0-9]+') THEN 'phone_digits' END, CASE WHEN mime_type NOT LIKE 'image/%' AND mime_type <> 'application/pdf' THEN 'mime_allowed' END) AS violations FROM ({_CHECKED.format('m_docs')})""")
def validate_documents(m):
    """The rules that come with the library."""
    d = m("m_docs").sparkSession.sql(_CHECKED.format("{d}"), d=m("m_docs"))
    return cases.validate_rows(d, cases.RULES).select("doc_id", F.array_join("violations", ",").alias("violations"))


@query("WITH RECURSIVE t(id, root, depth) AS (SELECT id, id, 0 FROM m_drafts WHERE parent IS NULL OR parent NOT IN (SELECT id FROM m_drafts) UNION ALL SELECT d.id, t.root, t.depth + 1 FROM m_drafts d JOIN t ON d.parent = t.id) SELECT id, root, depth FROM t")
def draft_lineage(m):
    d = m("m_drafts")
    known = d.select(F.col("id").alias("p"))
    d = d.join(known, d["parent"] == known["p"], "left").select("id", F.col("p").alias("parent_draft_id"))
    return cases.draft_lineage(d)


@query("SELECT d.id, coalesce(k.v, d.version) + 1 AS next_version FROM m_drafts d LEFT JOIN (SELECT parent, max(version) AS v FROM m_drafts WHERE parent IS NOT NULL GROUP BY 1) k ON k.parent = d.id")
def next_version(m):
    return cases.next_version(m("m_drafts").withColumnRenamed("parent", "parent_draft_id"))


@query("SELECT DISTINCT d.id AS draft_id, f.format FROM m_drafts d, (VALUES ('pdf'), ('docx')) f(format) WHERE d.status = 'ready' AND NOT (d.id % 4 = 0 AND f.format = 'pdf')")
def exports_to_run(m):
    d = m("m_drafts")
    asked = d.select(F.col("id").alias("draft_id"), F.col("created_by").alias("user_id"), F.explode(F.array(F.lit("pdf"), F.lit("docx"))).alias("format"))
    return cases.exports_to_run(asked, asked.where("draft_id % 4 = 0 AND format = 'pdf'"), d)


def _steps(log: str, allowed: dict[str, set[str]], frozen: str | None) -> str:
    pairs = ", ".join(f"('{a}', '{b}')" for a, bs in sorted(allowed.items()) for b in sorted(bs))
    return f"""WITH w AS (SELECT id, seq, state, lag(state) OVER (PARTITION BY id ORDER BY ts, seq) AS before, row_number() OVER (PARTITION BY id ORDER BY ts, seq) AS revision FROM {log})
SELECT id, seq, revision, before IS NULL OR (before || '>' || state IN (SELECT a || '>' || b FROM (VALUES {pairs}) v(a, b)) AND before <> '{frozen or ""}') AS valid FROM w"""


@query(_steps("m_draftlog", cases.DRAFT_STEPS, "archived"))
def draft_transitions(m):
    return cases.invalid_transitions(m("m_draftlog"), cases.DRAFT_STEPS).select("id", "seq", "revision", "valid")


@query(_steps("m_exlog", cases.EXTRACTION_STEPS, None))
def extraction_transitions(m):
    return cases.invalid_transitions(m("m_exlog"), cases.EXTRACTION_STEPS, frozen=None).select("id", "seq", "revision", "valid")


# --- pages ---


@query("""WITH p AS (SELECT doc_id, page, length(regexp_replace(text, '[^\\p{L}\\p{N}_]+', '', 'g')) >= 40 AS d FROM m_pages)
SELECT doc_id, count(*) AS page_count, CASE WHEN bool_and(d) THEN 'digital' WHEN NOT bool_or(d) THEN 'scanned' ELSE 'hybrid' END AS route, coalesce(string_agg(CAST(page AS STRING), ',' ORDER BY page) FILTER (d), '') AS digital, coalesce(string_agg(CAST(page AS STRING), ',' ORDER BY page) FILTER (NOT d), '') AS scanned FROM p GROUP BY 1""")
def classify_pages(m):
    return pages.classify_pages(m("m_pages")).select("doc_id", "page_count", "route", F.array_join(F.col("digital_pages").cast("array<string>"), ",").alias("digital"), F.array_join(F.col("scanned_pages").cast("array<string>"), ",").alias("scanned"))


@query("""WITH p AS (SELECT doc_id, count(*) AS n, CASE WHEN bool_and(d) THEN 'digital' WHEN NOT bool_or(d) THEN 'scanned' ELSE 'hybrid' END AS r FROM (SELECT doc_id, length(regexp_replace(text, '[^\\p{L}\\p{N}_]+', '', 'g')) >= 40 AS d FROM m_pages) GROUP BY 1)
SELECT d.doc_id, CASE WHEN mime LIKE 'image/%' THEN 'scanned' WHEN mime LIKE '%wordprocessing%' THEN 'digital' WHEN mime = 'application/pdf' THEN r ELSE 'error' END AS route, CAST(CASE WHEN mime LIKE 'image/%' THEN 1 ELSE n END AS BIGINT) AS page_count FROM m_docs d LEFT JOIN p ON p.doc_id = d.doc_id""")
def route_documents(m):
    return pages.route_documents(m("m_docs").select("doc_id", "mime"), pages.classify_pages(m("m_pages"))).select("doc_id", "route", "page_count")


@query("SELECT p.doc_id, p.page, coalesce(o.text, p.text) AS text FROM m_pages p LEFT JOIN m_ocr o ON o.doc_id = p.doc_id AND o.page = p.page")
def merge_pages(m):
    return pages.merge_pages(m("m_pages").select("doc_id", "page", "text"), m("m_ocr"))


@query("SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM m_pages WHERE trim(text) <> '' GROUP BY 1")
def join_pages(m):
    return pages.join_pages(m("m_pages"))


@query("""WITH RECURSIVE s AS (SELECT doc_id, (page - 1) // 15 AS c, min(page) AS a, max(page) AS b, 0 AS r FROM m_pages GROUP BY 1, 2),
t AS (SELECT doc_id, a, b, r FROM s UNION ALL SELECT x.doc_id, y.a, y.b, x.r + 1 FROM t x, LATERAL (SELECT x.a AS a, x.a + (x.b - x.a + 2) // 2 - 1 AS b UNION ALL SELECT x.a + (x.b - x.a + 2) // 2, x.b) y
  WHERE x.r < 4 AND x.b > x.a AND (SELECT sum(bytes) FROM m_pages p WHERE p.doc_id = x.doc_id AND p.page BETWEEN x.a AND x.b) > 41943040),
f AS (SELECT t.doc_id, a, b, r, CAST((SELECT sum(bytes) FROM m_pages p WHERE p.doc_id = t.doc_id AND p.page BETWEEN a AND b) AS BIGINT) AS bytes FROM t)
SELECT doc_id, a AS first_page, b AS last_page, bytes, bytes > 41943040 AS too_large FROM f WHERE bytes <= 41943040 OR a = b OR r = 4""")
def chunk_pages(m):
    return pages.chunk_pages(m("m_pages"))


@query("SELECT doc_id, CAST((page - 1) // 10 AS INT) AS batch, min(page) AS first_page, max(page) AS last_page FROM m_pages GROUP BY 1, 2")
def batch_pages(m):
    return pages.batch_pages(m("m_pages"))


@query("""WITH g AS (SELECT doc_id, lang, sum(confidence) AS c, min(pos) AS p FROM m_langs WHERE lang <> '' GROUP BY 1, 2)
SELECT d.doc_id, coalesce((SELECT lang FROM g WHERE g.doc_id = d.doc_id ORDER BY c DESC, p LIMIT 1), 'und') AS language FROM (SELECT DISTINCT doc_id FROM m_langs) d""")
def dominant_language(m):
    return pages.dominant_language(m("m_langs"))


@query("SELECT doc_id, coalesce(arg_max(lang, pos) FILTER (lang <> 'und'), 'und') AS language FROM m_langs GROUP BY 1")
def chunk_language(m):
    return pages.chunk_language(m("m_langs").withColumnRenamed("pos", "chunk"))


@query("SELECT doc_id, CASE WHEN trim(reviewed) <> '' THEN reviewed WHEN trim(text) <> '' THEN text END AS best_text FROM m_docs")
def best_text(m):
    return pages.best_text(m("m_docs"), ["reviewed", "text"]).select("doc_id", "best_text")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' ', 'g')) <> '' AS has_content FROM pages")
def has_content(m):
    return pages.has_content(m("pages"), "html").select("page_id", "has_content")


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 0 OR regexp_matches(text, '(?i)FIRST\\s+INFORMATION\\s+REPORT|FIR\\s+No\\.') THEN 'fir_ncrb' ELSE 'generic' END AS template, doc_id % 6 <> 0 AND regexp_matches(text, '(?i)FIRST\\s+INFORMATION\\s+REPORT|FIR\\s+No\\.') AS detected FROM (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM m_forms)")
def pick_template(m):
    d = m("documents").select("doc_id", "text").unionByName(m("m_forms"))
    return pages.pick_template(d.withColumn("document_type", F.when(F.col("doc_id") % 6 == 0, "fir").otherwise("other"))).select("doc_id", "template", "detected")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'unsupported' WHEN doc_id % 8 = 4 THEN 'empty' WHEN doc_id % 4 = 0 THEN NULL ELSE 'mismatch' END AS problem FROM documents")
def check_signature(m):
    kind = F.element_at(F.array(F.lit("application/pdf"), F.lit("image/png"), F.lit(pages.DOCX), F.lit("text/plain")), (F.col("doc_id") % 4 + 1).cast("int"))
    body = F.when(F.col("doc_id") % 8 == 4, F.lit("")).otherwise(F.concat(F.lit("%PDF-1.7 "), "text"))
    return pages.check_signature(m("documents").select("doc_id", F.encode(body, "UTF-8").alias("content"), kind.alias("mime"))).select("doc_id", "problem")


# --- scalar functions ---


@query("SELECT doc_id, CASE WHEN length(text) > 0 THEN greatest(1, length(text) // 4) ELSE 0 END AS tokens FROM documents")
def tokens_estimate(m):
    return m("documents").select("doc_id", text.tokens_estimate(F.col("text")).alias("tokens"))


@query("SELECT case_id, CAST(sum(CASE WHEN length(text) > 0 THEN greatest(1, length(text) // 4) ELSE 0 END) AS BIGINT) AS tokens, sum(CASE WHEN length(text) > 0 THEN greatest(1, length(text) // 4) ELSE 0 END) <= 12000 AS within_budget FROM m_docs GROUP BY 1")
def token_budget(m):
    return context.token_budget(m("m_docs"), 12_000)


@query("SELECT doc_id, left(array_to_string(string_split(text, chr(10))[61:180], chr(10)), 8000) AS part FROM documents")
def slice_by_page(m):
    return m("documents").select("doc_id", text.slice_by_page(F.col("text"), 2, 3).alias("part"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM documents")
def normalize_lines(m):
    return m("documents").select("doc_id", text.normalize_lines(F.col("text")).alias("text"))


@query("SELECT doc_id, regexp_replace(replace(text, 'Not stated', ''), '[ \\t]{2,}', ' ', 'g') AS text FROM (SELECT doc_id, text || '  Not stated  end' AS text FROM documents)")
def normalize_scan(m):
    return m("documents").select("doc_id", text.normalize_scan(F.concat("text", F.lit("  Not stated  end"))).alias("text"))


@query("SELECT doc_id, trim(trim(regexp_replace(text, '[\\s]+', ' ', 'g')), ' :;,-') AS text FROM documents")
def compact_text(m):
    return m("documents").select("doc_id", text.compact(F.col("text")).alias("text"))


@query("""WITH x AS (SELECT doc_id, regexp_matches(text, '[\\x{0900}-\\x{097F}]') AS h, regexp_matches(text, '[A-Za-z]') AS e, CAST(regexp_matches(text, '(?i)FIRST\\s+INFORMATION\\s+REPORT') AS INT) + CAST(regexp_matches(text, '(?i)District/Unit') AS INT) + CAST(regexp_matches(text, '(?i)Acts\\s*\\(अधिनियम\\)') AS INT) + CAST(regexp_matches(text, '(?i)Complainant') AS INT) + CAST(regexp_matches(text, '(?i)Action\\s+taken') AS INT) AS n FROM (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 10000000, text FROM m_forms))
SELECT doc_id, round_even(least(1.0::DOUBLE, CASE WHEN h AND e THEN 0.85::DOUBLE WHEN h THEN 0.55::DOUBLE WHEN e THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END + n * 0.02::DOUBLE), 2) AS score, CASE WHEN h AND e THEN 'mixed' WHEN h THEN 'hindi' WHEN e THEN 'english' ELSE 'unknown' END AS language,
array_to_string(list_filter([CASE WHEN NOT h THEN 'no_devanagari' END, CASE WHEN NOT e THEN 'no_english_anchors' END, CASE WHEN n < 2 THEN 'few_section_anchors' END], lambda z: z IS NOT NULL), ',') AS issues FROM x""")
def text_quality(m):
    d = m("documents").select("doc_id", "text").unionByName(m("m_forms").withColumn("doc_id", F.col("doc_id") + 10_000_000))
    q = d.select("doc_id", text.text_quality(F.col("text")).alias("q"))
    return q.select("doc_id", "q.score", "q.language", F.array_join("q.issues", ",").alias("issues"))


@query("SELECT doc_id, nullif(trim(lang), '') AS lang, array_to_string(list_filter(list_transform([source, '', lang, ' '], lambda x: trim(x)), lambda x: x <> ''), ' | ') AS cells FROM documents")
def row_text(m):
    return m("documents").select("doc_id", text.blank_to_null(F.col("lang")).alias("lang"), text.row_text(F.array(F.col("source"), F.lit(""), F.col("lang"), F.lit(" "))).alias("cells"))


# --- JSON ---


@query("""SELECT event_id, coalesce(try_cast(json_extract_string(CASE WHEN json_valid(b) THEN b END, '$.k') AS STRING), '-') AS k, NOT json_valid(b) AS broken FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props || '}' ELSE props END AS b FROM events)""")
def parse_loose_json(m):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.col("props"))
    x = m("events").select("event_id", jsonx.parse_loose_json(raw).alias("j"))
    return x.select("event_id", F.coalesce(F.col("j")["k"], F.lit("-")).alias("k"), F.col("j")["raw_text"].isNotNull().alias("broken"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, 1 AS n FROM events")
def parse_sections_json(m):
    raw = F.concat(F.lit("Here it is:\n```json\n"), F.regexp_replace("props", r"\}$", ', "a": "", "b": null}'), F.lit("\n```\nDone."))
    x = m("events").select("event_id", jsonx.parse_sections_json(raw).alias("j"))
    return x.select("event_id", F.col("j")["k"].alias("k"), F.size("j").alias("n"))


def _fields(m):
    blank = lambda c: F.when(F.col(c) % 3 == 0, F.lit("")).when(F.col(c) % 3 == 1, F.lit("[]")).otherwise(F.col(c).cast("string"))
    return m("lineitem").select("l_orderkey", "l_linenumber", F.create_map(F.lit("accused"), blank("l_partkey"), F.lit("place"), blank("l_suppkey"), F.lit("header"), F.col("l_returnflag"), F.lit("occurrence"), F.when(F.col("l_linenumber") > 2, F.lit("x"))).alias("f"))


_V = "CASE WHEN {0} % 3 IN (0, 1) THEN 0 ELSE 1 END"


@query(f"SELECT l_orderkey, l_linenumber, round_even(({_V.format('l_partkey')} + {_V.format('l_suppkey')} + 1 + CASE WHEN l_linenumber > 2 THEN 1 ELSE 0 END) / 4.0::DOUBLE, 3) AS ratio FROM lineitem")
def fill_ratio(m):
    return _fields(m).select("l_orderkey", "l_linenumber", jsonx.fill_ratio(F.col("f")).alias("ratio"))


@query("SELECT l_orderkey, l_linenumber, round_even((CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE 1 END + 1 + CASE WHEN l_linenumber > 2 THEN 1 ELSE 0 END) / 8.0::DOUBLE, 2) AS form, round_even((CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE 1 END + 1 + CASE WHEN l_linenumber > 2 THEN 1 ELSE 0 END) / 4.0::DOUBLE, 2) AS free FROM lineitem")
def structure_confidence(m):
    return _fields(m).select("l_orderkey", "l_linenumber", jsonx.structure_confidence(F.col("f"), forms.EXPECTED).alias("form"), jsonx.structure_confidence(F.col("f"), None).alias("free"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN NULL WHEN l_returnflag = 'A' THEN 'status' WHEN l_linestatus = 'F' THEN 'flag' ELSE 'flag,status' END AS changed FROM lineitem")
def edit_diff(m):
    new = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus"))
    old = F.create_map(F.lit("flag"), F.lit("A"), F.lit("status"), F.lit("F"), F.lit("gone"), F.lit("x"))
    return m("lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.array_sort(F.map_keys(jsonx.edit_diff(new, old))), ",").alias("changed"))


@query("""SELECT o_orderkey, sha256('{"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS hash FROM orders""")
def context_hash(m):
    return m("orders").select("o_orderkey", jsonx.context_hash(F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))).alias("hash"))


@query("""WITH x AS (SELECT l_orderkey, l_suppkey % 4 AS i, min(CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey) AS p FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, string_agg(CAST(i AS STRING), ',' ORDER BY p) AS ids, CAST(count(*) AS INT) AS n, count(*) <= 3 AS ok FROM x GROUP BY 1""")
def dedupe_ids(m):
    at = F.expr("l_linenumber * 1000000000L + l_partkey * 1000 + l_suppkey")
    x = m("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), (F.col("l_suppkey") % 4).cast("string").alias("id")))).alias("ids"))
    return x.select("l_orderkey", jsonx.dedupe_ids(F.col("ids.id"), 3).alias("d")).select("l_orderkey", F.array_join("d.ids", ",").alias("ids"), F.size("d.ids").alias("n"), "d.ok")


@query("SELECT event_id, CASE WHEN value IS NULL OR value = 0 THEN 0.5 ELSE greatest(0.0, least(1.0, value)) END AS score, CASE WHEN event_type = 'view' THEN 'hindi' ELSE 'unknown' END AS language FROM events")
def coerce_assessment(m):
    c = jsonx.coerce_assessment(F.col("value"), F.when(F.col("event_type") == "view", "HINDI").when(F.col("event_type") == "click", "klingon"))
    return m("events").select("event_id", c.alias("c")).select("event_id", "c.score", "c.language")


# --- context, readiness, sessions ---


@query("""WITH j AS (SELECT d.doc_id, case_id, ocr_status IN ('completed', 'not_required') AS o, processing_route = 'digital_extract' OR (ocr_status IN ('completed', 'not_required') AND coalesce(t.status IN ('edited', 'accepted'), false)) AS t, e.review_status AS e FROM m_docs d LEFT JOIN m_typed t ON t.doc_id = d.doc_id LEFT JOIN m_extract e ON e.doc_id = d.doc_id)
SELECT case_id, count(*) AS total, count(*) FILTER (o AND t AND (e IS NULL OR e IN ('edited', 'accepted'))) AS ready, count(*) FILTER (NOT o) AS pending_ocr, count(*) FILTER (o AND NOT t) AS pending_typed, count(*) FILTER (t AND e NOT IN ('edited', 'accepted')) AS pending_extraction, count(*) = count(*) FILTER (o AND t AND (e IS NULL OR e IN ('edited', 'accepted'))) AS all_ready FROM j GROUP BY 1""")
def readiness_summary(m):
    return context.readiness_summary(context.document_readiness(m("m_docs"), m("m_typed"), m("m_extract")))


@query("""WITH j AS (SELECT d.doc_id, ocr_status IN ('completed', 'not_required') AS o, processing_route = 'digital_extract' OR (ocr_status IN ('completed', 'not_required') AND coalesce(t.status IN ('edited', 'accepted'), false)) AS t, coalesce(e.review_status IN ('edited', 'accepted'), true) AS e FROM m_docs d LEFT JOIN m_typed t ON t.doc_id = d.doc_id LEFT JOIN m_extract e ON e.doc_id = d.doc_id)
SELECT doc_id, o AND t AND e AS is_ready, array_to_string(list_filter([CASE WHEN NOT o THEN 'ocr' END, CASE WHEN o AND NOT t THEN 'typed_content' END, CASE WHEN t AND NOT e THEN 'extraction_review' END], lambda x: x IS NOT NULL), ',') AS missing FROM j""")
def document_readiness(m):
    return context.document_readiness(m("m_docs"), m("m_typed"), m("m_extract")).select("doc_id", "is_ready", F.array_join("missing_steps", ",").alias("missing"))


_VERSIONS = """WITH x AS (SELECT user_id AS case_id, event_id AS seq, event_type = 'error' AS c, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS s FROM events),
y AS (SELECT *, CASE WHEN lag(s) OVER w IS NULL OR lag(s) OVER w <> s OR c THEN 1 ELSE 0 END AS ch FROM x WINDOW w AS (PARTITION BY case_id ORDER BY seq)),
z AS (SELECT case_id, seq, ch, CAST(sum(ch) OVER (PARTITION BY case_id ORDER BY seq) AS BIGINT) AS version FROM y)
SELECT case_id, seq, version, version = max(version) OVER (PARTITION BY case_id) AS is_current FROM z WHERE ch = 1"""


@query(_VERSIONS)
def context_versions(m):
    log = m("events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), F.create_map(F.lit("_case"), F.lit("c"), F.lit("doc"), F.col("event_type")).alias("context"), (F.col("event_type") == "error").alias("cleared"))
    return context.context_versions(log).select("case_id", "seq", "version", "is_current")


@query(_VERSIONS.replace("SELECT case_id, seq, version, version =", "SELECT case_id, seq, CAST(seq > (SELECT max(event_id) // 3 FROM events) AS INT) + CAST(seq > (SELECT max(event_id) // 3 * 2 FROM events) AS INT) AS batch, version, version ="))
def context_timeline(m):
    """The same versions from three batches of writes, the second one run twice."""
    e = m("events")
    third = e.agg(F.max("event_id")).first()[0] // 3
    batch = (F.col("event_id") > third).cast("int") + (F.col("event_id") > 2 * third).cast("int")
    log = e.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), F.create_map(F.lit("_case"), F.lit("c"), F.lit("doc"), F.col("event_type")).alias("context"), (F.col("event_type") == "error").alias("cleared"), batch.alias("n"))
    root = src.shared_path(e.sparkSession, "contexts")
    for n in (0, 1, 1, 2):
        jobs.context_batch(log.where(F.col("n") == n).drop("n"), n, root, parts=int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return jobs.context_timeline(e.sparkSession, root).select("case_id", "seq", F.col("batch_id").alias("batch"), "version", "is_current")


@query("SELECT o_orderkey AS case_id, o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AS stale FROM orders")
def stale_summaries(m):
    body = F.create_map(F.lit("p"), F.col("o_orderpriority"))
    o = m("orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderkey") % 5 == 0, F.create_map().cast("map<string,string>")).otherwise(body).alias("context"), F.when(F.col("o_orderkey") % 3 == 0, jsonx.context_hash(body)).otherwise("old").alias("context_snapshot_hash"))
    return context.stale_summaries(o.select("case_id", "context"), o.select("case_id", "context_snapshot_hash"))


@query("""WITH l AS (SELECT case_id, doc_id, max(seq) AS seq, arg_max(content, seq) AS content FROM m_entries GROUP BY 1, 2), t AS (SELECT *, greatest(1, length(content) // 4) AS tokens FROM l)
SELECT case_id, doc_id, seq, tokens, CAST(sum(tokens) OVER (PARTITION BY case_id) AS BIGINT) AS case_tokens, sum(tokens) OVER (PARTITION BY case_id) <= 12 AS fits FROM t""")
def push_context(m):
    return context.push_context(m("m_entries"), 12).drop("content")


@query("""WITH l AS (SELECT case_id, part, doc_id, max(seq) AS seq, arg_max(entry, seq) AS entry, arg_max(meta, seq) AS meta FROM m_pushes GROUP BY 1, 2, 3),
o AS (SELECT case_id, part, pos, name, entry FROM m_contexts, (VALUES ('documents', 0, '1', '{"content":"old","document_id":"1"}'), ('documents', 2, '8', '{"content":"keep","document_id":"8"}'), ('keys', 0, '9', '{"fields":{"a":[1,2]},"review_status":"edited"}')) v(part, pos, name, entry)
  UNION ALL SELECT case_id, 'keys', 1, '_case', '{"n":' || case_id || '}' FROM m_contexts),
r AS (SELECT case_id, part, 0 AS new, pos, name, entry FROM o WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.case_id = o.case_id AND l.part = o.part AND l.doc_id = o.name) UNION ALL SELECT case_id, part, 1, seq, doc_id, entry FROM l),
k AS (SELECT case_id, string_agg('"' || name || '":' || entry, ',' ORDER BY name) AS t FROM r WHERE part = 'keys' GROUP BY 1), d AS (SELECT case_id, '"documents":[' || string_agg(entry, ',' ORDER BY new, pos) || ']' AS t FROM r WHERE part = 'documents' GROUP BY 1),
c AS (SELECT p.case_id, '{' || concat_ws(',', k.t, d.t) || '}' AS text FROM (SELECT DISTINCT case_id FROM l) p LEFT JOIN k USING (case_id) LEFT JOIN d USING (case_id)),
n AS (SELECT case_id, doc_id, arg_max(meta, seq) AS meta FROM l GROUP BY 1, 2), x AS (SELECT coalesce(c.case_id, m.case_id) AS case_id, text, context_json, m.case_id IS NOT NULL AS had, greatest(1, length(coalesce(text, context_json)) // 4) AS tokens FROM c FULL JOIN m_contexts m ON c.case_id = m.case_id),
y AS (SELECT *, text IS NOT NULL AND tokens <= 78 AS ok FROM x),
w AS (SELECT case_id, string_agg(doc_id || '=' || meta, ';' ORDER BY doc_id) AS t FROM (SELECT case_id, doc_id, meta FROM n UNION ALL SELECT case_id, '1', 'x' FROM y WHERE had AND NOT EXISTS (SELECT 1 FROM n WHERE n.case_id = y.case_id AND doc_id = '1') UNION ALL SELECT case_id, '8', 'y' FROM y WHERE had) GROUP BY 1)
SELECT y.case_id, CASE WHEN ok THEN text ELSE context_json END AS context_json, CASE WHEN ok THEN w.t WHEN had THEN '1=x;8=y' ELSE '' END AS pushed, tokens, CASE WHEN text IS NOT NULL THEN ok END AS accepted FROM y LEFT JOIN w USING (case_id)""")
def push_documents(m):
    c = m("m_contexts").withColumn("pushed_documents", F.create_map(F.lit("8"), F.lit("y"), F.lit("1"), F.lit("x")))
    out = context.push_documents(c, m("m_pushes"), 78)
    return out.withColumn("pushed", F.array_join(F.transform(F.array_sort(F.map_entries("pushed_documents")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")).drop("pushed_documents")


@query("SELECT o_orderkey, 7 AS leaves, true AS same, o_orderstatus = 'P' AS turned, o_orderkey % 3 <> 0 AS changed FROM orders")
def canonical_hashes(m):
    """A nested object, the same with keys in another order, with a list turned round, and with a value changed in every third."""
    text = lambda *parts: F.concat(*[F.lit(x) if i % 2 == 0 else F.col(x) for i, x in enumerate(parts)])
    o = m("orders").select("o_orderkey", "o_orderpriority", F.col("o_orderstatus").alias("s"), F.when(F.col("o_orderkey") % 3 == 0, "1.5").otherwise("1").alias("n"))
    forms_ = {
        "a": text('{"s":"', "s", '","in":{"p":"', "o_orderpriority", '","l":["', "s", '",null,["P"],{}]},"n":1}'),
        "b": text('{ "n": 1, "in": {"l":["', "s", '",null, ["P"], {} ], "p":"', "o_orderpriority", '"}, "s":"', "s", '"}'),
        "c": text('{"s":"', "s", '","in":{"p":"', "o_orderpriority", '","l":["P",null,["', "s", '"],{}]},"n":1}'),
        "d": text('{"s":"', "s", '","in":{"p":"', "o_orderpriority", '","l":["', "s", '",null,["P"],{}]},"n":', "n", "}"),
    }
    x = o.select("o_orderkey", F.explode(F.create_map(*[y for k, v in forms_.items() for y in (F.lit(k), v)])).alias("which", "json"))
    h = jsonx.canonical_hashes(x, ["o_orderkey", "which"], "json").groupBy("o_orderkey").agg(F.max("leaves").alias("leaves"), F.map_from_entries(F.collect_list(F.struct("which", "hash"))).alias("h"))
    return h.select("o_orderkey", "leaves", *[(F.col("h")["a"] == F.col("h")[k]).alias(n) for k, n in (("b", "same"), ("c", "turned"), ("d", "changed"))])


@query("""WITH x AS (SELECT o_custkey AS case_id, o_orderkey % 9 AS i, max(o_orderdate) OVER (PARTITION BY o_custkey) AS t FROM orders)
SELECT case_id, CASE WHEN case_id % 2 = 1 THEN 'z=t' ELSE string_agg(DISTINCT i || '=' || strftime(CASE WHEN case_id % 4 = 0 THEN TIMESTAMP '2020-02-03 04:05:06' ELSE t END, '%Y-%m-%d %H:%M:%S'), ';' ORDER BY i || '=' || strftime(CASE WHEN case_id % 4 = 0 THEN TIMESTAMP '2020-02-03 04:05:06' ELSE t END, '%Y-%m-%d %H:%M:%S')) END AS pushed FROM x GROUP BY 1""")
def backfill_pushed_map(m):
    c = m("orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.collect_list((F.col("o_orderkey") % 9).cast("string")).alias("pushed_ids"), F.max("o_orderdate").cast("timestamp_ntz").alias("created_at"))
    c = c.withColumn("last_updated_at", F.when(F.col("case_id") % 4 == 0, F.lit("2020-02-03 04:05:06").cast("timestamp_ntz"))).withColumn("pushed_map", F.when(F.col("case_id") % 2 == 1, F.create_map(F.lit("z"), F.lit("t"))))
    return context.backfill_pushed_map(c).select("case_id", F.array_join(F.transform(F.array_sort(F.map_entries("pushed_map")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("pushed"))


def _sessions(m):
    role = F.when(F.col("role") == "user", "lawyer").otherwise("ai")
    c = m("conversations").where("role <> 'system'").select("conv_id", F.struct("turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("content")).alias("x"))
    return c.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list("x")).alias("messages"))


_TALK = "WITH c AS (SELECT conv_id AS id, turn, CASE WHEN role = 'user' THEN 'Advocate' ELSE 'Opponent' END AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role <> 'system') "


@query(_TALK + "SELECT id, string_agg(r || ': ' || left(t, 5000), chr(10) || chr(10) ORDER BY turn) AS transcript, CAST(count(*) FILTER (r = 'Advocate') AS INT) AS turns, count(*) FILTER (r = 'Advocate') < 100 AS open FROM c GROUP BY 1")
def transcripts(m):
    return context.transcripts(_sessions(m))


@query(_TALK + "SELECT id, string_agg(CASE r WHEN 'Advocate' THEN 'lawyer' ELSE 'ai' END || turn || ':' || t, chr(10) ORDER BY turn) AS kept FROM c WHERE k <= 3 GROUP BY 1")
def trim_messages(m):
    s = context.trim_messages(_sessions(m), 3)
    return s.select("id", F.array_join(F.transform("messages", lambda x: F.concat(x["role"], x["turn"].cast("string"), F.lit(":"), x["content"])), "\n").alias("kept"))


@query("SELECT n_name, r_name, c.n AS customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey")
def load_tables(m):
    """Tables read by name in one call; the scan sees only the columns that are used."""
    t = m.tables("nation", "region", "customer")
    per = t["customer"].groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    return t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).join(per, "n_nationkey", "left").select("n_name", "r_name", "customers")


@query("""WITH d AS (SELECT *, max(CASE WHEN event IN ('complete', 'skip') THEN seq END) OVER (PARTITION BY doc_id) AS done FROM m_doclog)
SELECT doc_id, CASE arg_max(event, seq) WHEN 'start' THEN 'processing' WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' ELSE 'skipped' END AS state, max(seq) AS seq, count(*) FILTER (event = 'start' AND seq > coalesce(done, -1)) AS attempts FROM d GROUP BY 1""")
def document_state(m):
    return context.document_state(m("m_doclog"))


@query("WITH x AS (SELECT job_id, arg_max(status, (updated_at, seq)) AS status, max(updated_at) AS u FROM m_jobs GROUP BY 1) SELECT job_id, status FROM x WHERE u > (SELECT max(updated_at) FROM m_jobs) - INTERVAL 24 HOURS")
def job_status(m):
    now = m("m_jobs").agg(F.max("updated_at").cast("string")).first()[0]
    return context.job_status(m("m_jobs"), now).select("job_id", "status")


@query("SELECT seq, CASE WHEN status = 'processing' AND epoch(TIMESTAMP '2024-01-15 00:00:00') - floor(epoch(updated_at)) >= 120 THEN 'failed' ELSE status END AS status FROM m_jobs")
def stale_jobs(m):
    return context.stale_jobs(m("m_jobs"), "2024-01-15 00:00:00").select("seq", "status")


@query("SELECT user_id % 50 AS user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS bucket, count(*) AS calls, greatest(0, count(*) - 2) AS rejected FROM m_calls GROUP BY 1, 2")
def rate_limit(m):
    return context.rate_limit(m("m_calls").withColumn("user_id", F.col("user_id") % 50), 2)


# --- sources ---


@query("SELECT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href=[\"'']([^\"'']*)[\"'']', 1)) AS href FROM pages)")
def extract_links(m):
    return src.extract_links(m("pages")).select("page_id", "href")


@query("SELECT page_id, 'list-' || CAST(page_id AS STRING) || '.PDF' AS href FROM pages")
def pdf_links(m):
    return src.pdf_links(m("pages").withColumn("html", F.concat("html", F.lit('<a class="x" href="list-'), F.col("page_id").cast("string"), F.lit('.PDF">x</a><a href="late.pdf">y</a>'))))


@query("SELECT page_id, 'token' AS name, CAST(page_id AS STRING) AS value FROM pages")
def extract_form_inputs(m):
    return src.extract_form_inputs(m("pages").withColumn("html", F.concat("html", F.lit('<input type="hidden" name="token" value="old"><INPUT type="hidden" name="token" value="'), F.col("page_id").cast("string"), F.lit('">'))))


@query("SELECT page_id, CAST(p AS INT) AS pos, CAST(page_id + p AS STRING) AS value FROM pages, (VALUES (0), (1)) v(p)")
def extract_options(m):
    return src.extract_options(m("pages").withColumn("html", F.concat("html", F.lit('<option id=a value="'), F.col("page_id").cast("string"), F.lit('">a</option><option value="'), (F.col("page_id") + 1).cast("string"), F.lit('">b</option>'))))


@query("SELECT doc_id, CASE WHEN upload_status = 'uploaded' OR doc_id % 2 = 0 THEN 'uploaded' ELSE 'failed' END AS upload_status, upload_status <> 'uploaded' AND doc_id % 2 = 0 AS repaired, upload_status <> 'uploaded' AND doc_id % 2 = 1 AS missing FROM m_docs")
def reconcile_uploads(m):
    return src.reconcile_uploads(m("m_docs"), m("m_objects")).drop("storage_key")


def _objects(m) -> str:
    """Texts of documents as objects of up to 50 lines in 64 folders, but for every third folder."""
    d = m("m_docs").select(F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 64).alias("shard")).where("shard % 3 <> 0")
    root = src.shared_path(d.sparkSession, "objects")
    d.repartition("shard").write.partitionBy("shard").option("maxRecordsPerFile", 50).text(root)
    return root


@query("SELECT 'shard=' || doc_id % 64 AS folder, CAST(ceil(count(*) / 50.0) AS BIGINT) AS objects, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS listed, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS bytes FROM m_docs WHERE doc_id % 64 % 3 <> 0 GROUP BY 1")
def object_store(m):
    """Sizes of objects by folder, listed and read."""
    root, spark = _objects(m), m("m_docs").sparkSession
    folder = lambda c: F.regexp_extract(c, r"(shard=\d+)/", 1)
    listed = src.list_objects(spark, root, "*.txt").groupBy(folder(F.col("key")).alias("folder")).agg(F.count(F.lit(1)).alias("objects"), F.sum("length").alias("listed"))
    read = src.read_files(spark, root, "*.txt").groupBy(folder(F.col("path")).alias("folder")).agg(F.sum(F.length("content")).alias("bytes"))
    return listed.join(read, "folder", "full")


@query("SELECT doc_id, CASE WHEN upload_status = 'uploaded' OR doc_id % 64 % 3 <> 0 THEN 'uploaded' ELSE 'failed' END AS upload_status, upload_status <> 'uploaded' AND doc_id % 64 % 3 <> 0 AS repaired, upload_status <> 'uploaded' AND doc_id % 64 % 3 = 0 AS missing FROM m_docs")
def reconcile_objects(m):
    """Documents against a listing of the folder that their objects are in."""
    found = src.list_objects(m("m_docs").sparkSession, _objects(m)).select(F.substring_index("key", "/", 1).alias("key"))
    docs = m("m_docs").withColumn("storage_key", F.concat(F.lit("shard="), (F.col("doc_id") % 64).cast("string")))
    return src.reconcile_uploads(docs, found).drop("storage_key")


# --- tables and headers ---

_HEADS = ["Acts (अधिनियम)", "Section No", "Relative's Name", "Name (नाम)", "Present Address", "S. No.", "Value (Rs)", "Remarks", "क्रम संख्या", "guardian name", "Sectons", "पिता का नाम"]


def _headers(m):
    return m("lineitem").select("l_orderkey", "l_linenumber", F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("l_partkey") % 12 + 1).cast("int")).alias("header"))


@query("SELECT l_orderkey, l_linenumber, ['acts', 'sections', 'relative', 'name', 'present_address', 'serial', 'value', 'remarks', 'serial', 'name', 'sectons', 'relative'][CAST(l_partkey % 12 + 1 AS INT)] AS layout_column FROM lineitem")
def layout_columns(m):
    return tables.layout_columns(_headers(m)).drop("header")


@query("SELECT l_orderkey, l_linenumber, ['acts', 'sections', 'relative', 'name', 'present_address', 'serial', 'value', 'remarks', 'serial', 'relative', 'sections', 'पिता का नाम'][CAST(l_partkey % 12 + 1 AS INT)] AS header_key FROM lineitem")
def normalize_headers(m):
    return tables.normalize_headers(_headers(m)).drop("header")


@query("SELECT l_orderkey, l_linenumber, ['district', 'police_station', 'year', 'fir_no', 'date_from', 'info_date', NULL, 'time_to'][CAST(l_partkey % 8 + 1 AS INT)] AS form_key FROM lineitem")
def form_keys(m):
    names = ["District / Unit (x)", "P.S. (thana)", "Year", "FIR No.", "Date from", "Date (y)", "Other", "Time To"]
    return tables.form_keys(m("lineitem").select("l_orderkey", "l_linenumber", F.element_at(F.array(*map(F.lit, names)), (F.col("l_partkey") % 8 + 1).cast("int")).alias("label"))).drop("label")


@query("WITH x AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey AS p, CASE WHEN l_partkey % 2 = 0 THEN 'Year' ELSE 'FIR No. : 7' END AS label, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_suppkey AS STRING) ELSE '' END AS v FROM lineitem) SELECT l_orderkey AS doc_id, CASE WHEN label = 'Year' THEN 'year' ELSE 'fir_no' END AS form_key, arg_min(CASE WHEN v <> '' THEN v WHEN label <> 'Year' THEN '7' END, p) FILTER (v <> '' OR label <> 'Year') AS value FROM x GROUP BY 1, 2 HAVING count(*) FILTER (v <> '' OR label <> 'Year') > 0")
def form_values(m):
    f = m("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.expr("l_linenumber * 1000000000L + l_partkey * 1000 + l_suppkey").alias("pos"), F.when(F.col("l_partkey") % 2 == 0, "Year").otherwise("FIR No. : 7").alias("label"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey").cast("string")).otherwise("").alias("value"))
    return tables.form_values(f)


@query("SELECT o_orderkey AS doc_id, 1 AS page, 'act|sections' AS headers, '1|' || CAST(o_custkey AS STRING) AS cells, round_even((0.5::DOUBLE + (o_orderkey % 5) / 10.0::DOUBLE + CASE WHEN o_orderkey % 5 = 0 THEN 0.0::DOUBLE ELSE 0 END) / CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 2 END, 4) AS confidence FROM orders")
def explode_tables(m):
    cell = lambda t, c: F.concat(F.lit('{"text":"'), t, F.lit('","confidence":'), c, F.lit("}"))
    zero, k = F.lit("0"), F.concat((F.col("o_orderkey") % 5).cast("string"), F.lit("e-1"))
    js = F.concat(F.lit('{"pages":[{"page_number":1,"tables":[{"header_rows":[],"body_rows":[['), cell(F.lit("act"), zero), F.lit(","), cell(F.lit("sections"), zero), F.lit("],["), cell(F.lit(" 1 :"), F.lit("0.5")), F.lit(","), cell(F.col("o_custkey").cast("string"), k), F.lit('],[{"text":" "}]]}]}]}'))
    t = tables.explode_tables(m("m_keys").select(F.col("o_orderkey").alias("doc_id"), js.alias("artifact")))
    return t.select("doc_id", "page", F.array_join("headers", "|").alias("headers"), F.array_join(F.flatten("rows"), "|").alias("cells"), "confidence")


@query("SELECT l_orderkey, l_linenumber, ['acts_sections', 'accused', 'accused', 'id', 'property', 'inquest', 'physical_features', 'unknown'][CAST(l_partkey % 8 + 1 AS INT)] AS kind FROM lineitem")
def table_type(m):
    keys = [["acts", "sections"], ["name", "relative"], ["name", "present_address"], ["id_type", "id_number"], ["property_type", "description"], ["uidb_number"], ["x"], ["x"]]
    arr = F.array(*[F.array(*map(F.lit, k)) for k in keys])
    i = (F.col("l_partkey") % 8 + 1).cast("int")
    words = F.when(F.col("l_partkey") % 8 == 6, "Height 170").otherwise("plain")
    return m("lineitem").select("l_orderkey", "l_linenumber", tables.table_type(F.element_at(arr, i), words).alias("kind"))


@query("SELECT l_orderkey, l_linenumber, ['Key Identifiers', 'Parties', 'Key Dates', 'Other Details'][CAST(l_partkey % 4 + 1 AS INT)] AS section FROM lineitem")
def classify_fields(m):
    keys = F.element_at(F.array(*map(F.lit, ["FIR_Number", "main_accused", "bail_date_2", "zzz"])), (F.col("l_partkey") % 4 + 1).cast("int"))
    return tables.classify_fields(m("lineitem").select("l_orderkey", "l_linenumber", keys.alias("key")), tables.FIELD_CATALOGUE).drop("key")


# --- forms ---


@query("""SELECT o_orderkey AS doc_id, 'Station ' || CAST(o_custkey AS STRING) AS police_station, CAST(year(o_orderdate) AS STRING) AS year, CAST(o_orderkey AS STRING) AS fir_no, '17/02/' || CAST(year(o_orderdate) AS STRING) || ' 14:21 घंटे' AS fir_datetime, 'District ' || CAST(o_custkey % 75 AS STRING) AS district FROM orders""")
def form_basic(m):
    return forms.form_fields(m("m_forms")).select("doc_id", "police_station", "year", "fir_no", "fir_datetime", "district")


@query("SELECT o_orderkey AS doc_id, 'शनिवार' AS day, '15/02/2025' AS date_from, '16/02/2025' AS date_to, '20:00 बजे' AS time_from, '21:30 बजे' AS time_to, CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE '17/02/2025' END AS info_date, '14:' || CAST(o_orderkey % 50 + 10 AS STRING) || ' बजे' AS info_time, CAST(o_orderkey % 90 + 10 AS STRING) AS gd_entry FROM orders")
def form_occurrence(m):
    return forms.form_fields(m("m_forms")).select("doc_id", "day", "date_from", "date_to", "time_from", "time_to", "info_date", "info_time", "gd_entry")


_PLACE = "CASE WHEN o_orderkey % 5 = 0 THEN 'Village मुरादाबाद ' ELSE 'Village ' END || CAST(o_custkey AS STRING)"


@query(f"SELECT o_orderkey AS doc_id, 'लिखित' AS info_type, 'दक्षिण , 06 कि . मी .' AS direction_distance, '' AS beat_no, {_PLACE} AS address FROM orders")
def form_place(m):
    return forms.form_fields(m("m_forms")).select("doc_id", "info_type", "direction_distance", "beat_no", "address")


@query("SELECT o_orderkey AS doc_id, 'Person ' || CAST(o_custkey AS STRING) AS name, 'Elder ' || CAST(o_custkey % 100 AS STRING) AS father, CAST(1950 + o_custkey % 50 AS STRING) AS dob_year, 'भारत' AS nationality, '91-97197XXXXX' AS mobile FROM orders")
def form_complainant(m):
    return forms.form_fields(m("m_forms")).select("doc_id", "name", "father", "dob_year", "nationality", "mobile")


@query("SELECT o_orderkey AS doc_id, 'Yes' AS registered, 'officer ' || CAST(o_orderkey % 60 AS STRING) AS io_name, 'उपनिरीक्षक' AS io_rank FROM orders")
def form_action(m):
    return forms.form_fields(m("m_forms")).select("doc_id", "registered", "io_name", "io_rank")


@query("SELECT o_orderkey AS doc_id, s AS serial, CASE s WHEN '1' THEN CAST(o_orderkey % 300 + 20 AS STRING) ELSE '115(' || CAST(o_orderkey % 4 + 1 AS STRING) || ')' END AS section FROM orders, (VALUES ('1'), ('2')) v(s)")
def form_acts(m):
    return forms.form_acts(m("m_forms")).select("doc_id", "serial", "section")


_ACCUSED = f"""SELECT o_orderkey AS doc_id, s AS serial, CASE WHEN o_orderkey % 5 = 3 THEN ['राम कुमार', 'मोहन'] ELSE ['योगेश', 'गौरव सिंह'] END[CAST(s AS INT)] AS name, CASE WHEN o_orderkey % 5 = 3 THEN ['श्याम लाल', 'सोहन'] ELSE ['हरि सिंह', 'हरि सिंह'] END[CAST(s AS INT)] AS father,
  CASE WHEN o_orderkey % 5 = 3 AND s = '1' THEN 'ग्राम- नया गांव ' || CAST(o_orderkey AS STRING) ELSE {_PLACE} END AS address, '' AS alias FROM orders, (VALUES ('1'), ('2')) v(s)"""


@query(_ACCUSED)
def form_accused(m):
    return forms.form_accused(m("m_forms"))


@query("SELECT o_orderkey AS doc_id, '1' AS serial, 'Coin and Currency' AS category, 'Indian Currency' AS type, CAST(o_orderkey % 40 AS STRING) || ' notes' AS description, CAST(o_orderkey AS STRING) AS value FROM orders")
def form_properties(m):
    return forms.form_properties(m("m_forms"))


@query("SELECT o_orderkey AS doc_id, '1' AS serial, 'UD/' || CAST(o_orderkey AS STRING) AS uidb_number FROM orders")
def form_inquest(m):
    return forms.form_inquest(m("m_forms"))


@query("SELECT o_orderkey AS doc_id, CAST(o_orderkey AS STRING) AS value FROM orders")
def form_total_value(m):
    return forms.free_text(m("m_forms"), 10)


@query("SELECT o_orderkey AS doc_id, 'वहां पर मौजूद योगेश पुत्र हरि सिंह गौरव सिंह पुत्र हरि सिंह ने report ' || CAST(o_orderkey AS STRING) || chr(10) || chr(10) || 'second part' AS fir_contents FROM orders")
def form_narrative(m):
    return forms.narrative(m("m_forms"))


_ITEM = "chr(10) || CAST({0} AS STRING) || CASE WHEN {0} = 4 AND doc_id % 5 = 1 THEN ' . ' ELSE '. ' END"


@query(f"""WITH x AS (SELECT doc_id, CAST(n AS INT) AS no, chr(10) || text AS t, {_ITEM.format('n')} AS h, {_ITEM.format('n + 1')} AS h2 FROM m_forms, range(1, 16) r(n))
SELECT doc_id, no, trim(substr(t, strpos(t, h) + length(h), CASE WHEN no = 15 THEN length(t) ELSE strpos(t, h2) - strpos(t, h) - length(h) END), ' ' || chr(10)) AS text FROM x""")
def form_sections(m):
    return forms.form_sections(m("m_forms"))


_ANCHORED = """WITH f AS (SELECT doc_id, replace(text, '3. ( a )', '3. ') AS t FROM m_forms),
k AS (SELECT * FROM (VALUES ('header', 'FIRST INFORMATION REPORT'), ('section_4', '4. Type of Information'), ('section_5', '5. Place of Occurrence'), ('section_6', '6. Complainant / Informant'), ('section_7', '7. Details of known'), ('section_8', '8. Reasons for delay'), ('section_9', '9. Particulars of properties'), ('section_10', '10. Total value of property'), ('section_11', '11. Inquest Report'), ('section_12', '12. First Information contents'), ('section_13', '13. Action taken'), ('section_14', '14. Signature'), ('section_15', '15. Date and time of dispatch')) v(key, phrase)),
p AS (SELECT doc_id, t, key, strpos(t, phrase) AS pos FROM f, k WHERE strpos(t, phrase) > 0),
a AS (SELECT doc_id, key, trim(substr(t, pos, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), length(t) + 1) - pos), ' ' || chr(10)) AS text FROM p) """


@query(_ANCHORED + "SELECT * FROM a")
def anchor_sections(m):
    a = m("m_forms").withColumn("text", F.regexp_replace("text", "3\\. \\( a \\)", "3. "))
    return forms.anchor_sections(a)


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 4 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS score, CASE WHEN o_orderkey % 5 = 4 THEN 'occurrence.info_date' ELSE '' END AS missing FROM orders")
def form_diagnostics(m):
    d = forms.form_diagnostics(forms.form_record(m("m_forms"), few=True))
    return d.select("doc_id", "score", F.array_join("missing", ",").alias("missing"))


@query("""SELECT doc_id, text AS fir_contents, 'basic.fir_no,basic.police_station,basic.year,basic.fir_datetime,acts,accused' AS missing, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM documents WHERE NOT regexp_matches(text, '(?i)FIRST\\s+INFORMATION\\s+REPORT|FIR\\s+No\\.|प्रथम\\s+सूचना')""")
def fallback_records(m):
    return forms.fallback_records(m("documents").unionByName(m("m_forms"), allowMissingColumns=True)).withColumn("missing", F.array_join("missing", ","))


_SECTIONS = f"""'district: District ' || CAST(o_custkey % 75 AS STRING) || chr(10) || 'police_station: Station ' || CAST(o_custkey AS STRING) || chr(10) || 'year: ' || CAST(year(o_orderdate) AS STRING) || chr(10) || 'fir_no: ' || CAST(o_orderkey AS STRING) || chr(10) || 'fir_datetime: 17/02/' || CAST(year(o_orderdate) AS STRING) || ' 14:21 घंटे' AS header,
  '1. भारतीय न्याय संहिता (बी एन एस), 2023 - धारा ' || CAST(o_orderkey % 300 + 20 AS STRING) || chr(10) || '2. भारतीय न्याय संहिता (बी एन एस), 2023 - धारा 115(' || CAST(o_orderkey % 4 + 1 AS STRING) || ')' AS sections_law,
  '1 - Coin and Currency - Indian Currency - ' || CAST(o_orderkey % 40 AS STRING) || ' notes - ' || CAST(o_orderkey AS STRING) AS properties, 'registered: Yes' || chr(10) || 'io_name: officer ' || CAST(o_orderkey % 60 AS STRING) || chr(10) || 'io_rank: उपनिरीक्षक' AS action_taken,
  'direction_distance: दक्षिण , 06 कि . मी .' || chr(10) || 'address: ' || {_PLACE} AS place"""


@query(f"""WITH c AS ({_ACCUSED}), l AS (SELECT doc_id, string_agg(serial || '. ' || name || ' - पिता का नाम: ' || father || ' - ' || address, chr(10) ORDER BY serial) AS accused FROM c GROUP BY 1)
SELECT o_orderkey AS doc_id, 'text_fallback' AS acts, 'text_fallback' AS basic, CAST(o_orderkey AS STRING) AS fir_no, 14 AS n_sections, accused, {_SECTIONS} FROM orders JOIN l ON doc_id = o_orderkey""")
def form_record(m):
    r = forms.form_record(m("m_forms"))
    return r.select("doc_id", F.col("source_map")["acts"].alias("acts"), F.col("source_map")["basic"].alias("basic"), F.col("fields")["fir_no"].alias("fir_no"), F.size("sections").alias("n_sections"), *[F.col("sections")[k].alias(k) for k in ("header", "sections_law", "properties", "action_taken", "place", "accused")])


def _artifacts(m):
    """For every third form an artifact: acts without a header that is marked, misspelt; accused under Hindi headers; properties and an inquest."""
    key = F.col("doc_id").cast("string")
    cells = lambda *c: F.concat(F.lit("["), F.concat_ws(",", *[F.concat(F.lit('{"text":"'), F.lit(x) if isinstance(x, str) else x, F.lit('","confidence":0.5}')) for x in c]), F.lit("]"))
    table = lambda head, *rows: F.concat(F.lit('{"header_rows":['), *([head] if head is not None else []), F.lit('],"body_rows":['), F.concat_ws(",", *rows), F.lit("]}"))
    acts = table(None, cells("क्र.सं.", "Sectons", "Acts (अधिनियम)"), cells("1", F.concat(key, F.lit(" ")), "Some Act"), cells("", "", "under 77 ( 2 ) of 2023"), cells("3", "", ""))
    accused = table(cells("S. No.", "नाम", "उपनाम", "Relative's Name", "वर्तमान पता"), cells("1", "राजू", "", F.concat(F.lit("पिता का नाम : Elder "), key), "गली 5"), cells("", "", "", "", ""), cells("", "सीता", "मीना", "", ""))
    goods = table(cells("S.No.", "Property Category", "Property Type", "Description", "Value (Rs)"), cells("1", "Cash", "Notes", F.concat(F.lit("bundle "), key), "900"), cells("", "Lost", "Row", "without serial", ""))
    inquest = table(cells("S. No.", "UIDB Number"), cells("", F.concat(F.lit("UD/"), key)))
    js = F.concat(F.lit('{"pages":[{"page_number":1,"tables":['), F.concat_ws(",", acts, goods), F.lit(']},{"page_number":2,"tables":['), F.concat_ws(",", accused, inquest), F.lit("]}]}"))
    return m("m_forms").where("doc_id % 3 = 0").select("doc_id", js.alias("artifact"))


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'layout_table' ELSE 'text_fallback' END AS source, CASE WHEN o_orderkey % 7 = 0 THEN 'form_field' ELSE 'text_fallback' END AS occurrence, CASE WHEN o_orderkey % 7 = 0 THEN '01/01/2020' WHEN o_orderkey % 5 = 4 THEN '' ELSE '17/02/2025' END AS info_date,
  CASE WHEN o_orderkey % 3 = 0 THEN '1|Some Act|' || CASE WHEN o_orderkey BETWEEN 10 AND 999 THEN CAST(o_orderkey AS STRING) ELSE '' END || ';2|under 77 ( 2 ) of 2023|77(2)' ELSE '1|भारतीय न्याय संहिता (बी एन एस), 2023|' || CAST(o_orderkey % 300 + 20 AS STRING) || ';2|भारतीय न्याय संहिता (बी एन एस), 2023|115(' || CAST(o_orderkey % 4 + 1 AS STRING) || ')' END AS acts,
  CASE WHEN o_orderkey % 3 = 0 THEN '1|राजू|Elder ' || CAST(o_orderkey AS STRING) || '|गली 5|;2|सीता|||मीना' END AS accused, CASE WHEN o_orderkey % 3 = 0 THEN '1|Cash|Notes|bundle ' || CAST(o_orderkey AS STRING) || '|900' END AS properties, CASE WHEN o_orderkey % 3 = 0 THEN '1|UD/' || CAST(o_orderkey AS STRING) END AS inquest,
  least(1.0::DOUBLE, CASE WHEN o_orderkey % 5 = 4 AND o_orderkey % 7 <> 0 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END + CASE WHEN o_orderkey % 3 = 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM orders""")
def form_layout(m):
    layout = forms.layout_rows(tables.explode_tables(_artifacts(m)))
    values = m("m_forms").where("doc_id % 7 = 0").select("doc_id", F.lit("info_date").alias("form_key"), F.lit("on 01/01/2020 at night").alias("value"))
    r = forms.with_diagnostics(forms.form_record(m("m_forms"), layout, values))  # in one parse
    flat = lambda n: F.array_join(F.transform(n, lambda x: F.concat_ws("|", *[x[k] for k in forms.LAYOUTS[n][2]])), ";")
    given = F.col("source_map")["accused"] == "layout_table"
    return r.select("doc_id", F.col("source_map")["acts"].alias("source"), F.col("source_map")["occurrence"].alias("occurrence"), F.col("fields")["info_date"].alias("info_date"), flat("acts").alias("acts"), *[F.when(given, flat(n)).alias(n) for n in ("accused", "properties", "inquest")], "score")


@query("""WITH x AS (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'v' || CAST(l_linenumber AS STRING) END AS value, ['header', 'accused', 'place'][CAST(l_suppkey % 3 + 1 AS INT)] AS key FROM lineitem)
SELECT l_orderkey AS doc_id, key, CASE WHEN key = 'accused' THEN string_agg(value, chr(10) || chr(10) ORDER BY l_linenumber) ELSE arg_min(value, l_linenumber) END AS value FROM x WHERE value <> '' AND (key <> 'header' OR l_linenumber = 1) GROUP BY 1, 2""")
def merge_sections(m):
    p = m("lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("batch"), F.element_at(F.array(F.lit("header"), F.lit("accused"), F.lit("place")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("key"), F.when(F.col("l_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("v"), F.col("l_linenumber").cast("string"))).alias("value"))
    return forms.merge_sections(p)


@query("""SELECT l_orderkey, l_linenumber, array_to_string(list_filter(['sections_law', 'complainant', CASE WHEN l_partkey % 3 = 0 THEN 'accused' END, 'fir_contents', 'action_taken'], lambda x: x IS NOT NULL), ',') AS missing,
round_even((CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN l_linenumber > 2 THEN 1 ELSE 0 END) / 8.0::DOUBLE, 2) AS confidence FROM lineitem""")
def audit_sections(m):
    f = _fields(m).select(F.struct("l_orderkey", "l_linenumber").alias("doc_id"), F.col("f").alias("sections"))
    return forms.audit_sections(f).select("doc_id.*", F.array_join("missing_critical", ",").alias("missing"), "confidence")


@query(_ANCHORED + """, s AS (SELECT doc_id, max(text) FILTER (key = 'section_6') AS c, max(text) FILTER (key = 'section_12') AS f FROM a GROUP BY 1)
SELECT doc_id, CASE WHEN doc_id % 5 = 3 THEN 'accused,' ELSE '' END || 'action_taken,complainant,fir_contents,place' AS recovered, '1. ( a ) Direction and distance from P.S. ( दूरी ) : दक्षिण , 06 कि . मी .' AS place,
  CASE WHEN doc_id % 5 = 3 THEN '1. राम कुमार पिता का नाम : श्याम लाल ग्राम- नया गांव ' || CAST(doc_id AS STRING) || chr(10) || '2. मोहन पिता का नाम सोहन' END AS accused, '(1) प्रकरण दर्ज किया गया और जांच प्रारम्भ की गयी।' || chr(10) || '(2) जांच अधिकारी (I.O.): officer ' || CAST(doc_id % 60 AS STRING) || ' Rank ( पद ) : उपनिरीक्षक No. ( सं . ) :' AS action_taken,
  substr(c, strpos(c, chr(10)) + 1) AS complainant, substr(f, strpos(f, chr(10)) + 1) AS fir_contents, 'x' AS sections_law FROM s""")
def gap_fill(m):
    f = m("m_forms").withColumn("text", F.regexp_replace("text", "3\\. \\( a \\)", "3. "))
    d = f.select("doc_id", F.create_map(F.lit("sections_law"), F.lit("x"), F.lit("occurrence"), F.lit("y")).alias("sections"))
    return forms.gap_fill(d, f).select("doc_id", F.array_join("recovered", ",").alias("recovered"), *[F.col("sections")[k].alias(k) for k in ("place", "accused", "action_taken", "complainant", "fir_contents", "sections_law")])


def _html() -> str:
    """The printed form with its values as SQL, from the columns of orders."""
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    esc = lambda x: x.replace("'", "&#x27;")
    key, cust, year = (f"CAST({c} AS STRING)" for c in ("o_orderkey", "o_custkey", "year(o_orderdate)"))
    v = {n: "'Not stated'" for n in ("outside_ps", "occupation", "beat_no", "io_no", "transferred_to", "dispatch", "time_period", "officer_name", "officer_rank", "officer_no")}
    v |= {"district": "'District ' || CAST(o_custkey % 75 AS STRING)", "police_station": f"'Station ' || {cust}", "year": year, "fir_no": key, "fir_datetime": f"'17/02/' || {year} || ' 14:21 घंटे'", "info_date": "CASE WHEN o_orderkey % 5 = 4 THEN 'Not stated' ELSE '17/02/2025' END", "info_time": "'14:' || CAST(o_orderkey % 50 + 10 AS STRING) || ' बजे'", "gd_entry": "CAST(o_orderkey % 90 + 10 AS STRING)", "info_type": "'लिखित'", "direction_distance": "'दक्षिण , 06 कि . मी .'", "address": _PLACE, "name": f"'Person ' || {cust}", "father": "'Elder ' || CAST(o_custkey % 100 AS STRING)", "dob_year": "CAST(1950 + o_custkey % 50 AS STRING)", "nationality": "'भारत'", "mobile": "'91-97197XXXXX'", "total_value": key, "io_name": "'officer ' || CAST(o_orderkey % 60 AS STRING)", "io_rank": "'उपनिरीक्षक'"}
    row = lambda *cells: "'<tr>' || " + " || ".join(f"'<td>' || {c} || '</td>'" for c in cells) + " || '</tr>'"
    act, blank = "'भारतीय न्याय संहिता (बी एन एस), 2023'", row(*["''"] * 7)
    rows = {
        "acts": [row("'1'", act, "CAST(o_orderkey % 300 + 20 AS STRING)"), row("'2'", act, "'115(' || CAST(o_orderkey % 4 + 1 AS STRING) || ')'")],
        "occurrence": [row("'1'", "'Day (दिन): शनिवार'", "'Date from (दिनांक से): 15/02/2025'", "'Date To (दिनांक तक): 16/02/2025'"), row("''", "'Time Period (समय अवधि): Not stated'", "'Time From (समय से): 20:00 बजे'", "'Time To (समय तक): 21:30 बजे'")],
        "ids": [row("''", "''", "''")],
        "addresses": [row("'1'", "'वर्तमान पता'", _PLACE), row("'2'", "'स्थायी पता'", _PLACE)],
        "accused": ["(SELECT string_agg('<tr><td>' || serial || '</td><td>' || name || '</td><td></td><td>पिता का नाम: ' || father || '</td><td>' || address || '</td></tr>', '' ORDER BY serial) FROM c WHERE c.doc_id = o_orderkey)"],
        "properties": [row("'1'", "'Coin and Currency'", "'Indian Currency'", "CAST(o_orderkey % 40 AS STRING) || ' notes'", key)],
        "inquest": [row("'1'", f"'UD/' || {key}")],
        "signature": [row("''", "'Name (नाम): Not stated Rank (पद): Not stated No. (सं.): Not stated'")],
        "features_1": [row(f"'{n}'", "'पुरुष'", "''", "''", "''", "''", "'चेचक: नहीं'") for n in (1, 2)],
        "features_2": [blank, blank],
        "features_3": [blank, blank],
    }
    block = {n: lit("<table><tr>" + "".join(f"<th>{esc(h)}</th>" for h in forms.HEADS[n]) + "</tr>") + " || " + " || ".join(r) + " || '</table>'" for n, r in rows.items()}
    block |= {"delay": "''", "narrative": f"'<p>वहां पर मौजूद योगेश पुत्र हरि सिंह गौरव सिंह पुत्र हरि सिंह ने report ' || {key} || '</p><p>second part</p>'"}
    lines = [block[x[2:-2]] if x.startswith("{{") else " || ".join(v[p] if i % 2 else lit(p) for i, p in enumerate(re.split(r"\{(\w+)!\}", x))) for x in forms.HTML]
    return f"WITH c AS ({_ACCUSED}) SELECT o_orderkey AS doc_id, " + " || chr(10) || ".join(lines) + " AS html FROM orders"


@query(_html())
def form_html(m):
    return forms.form_html(forms.form_record(m("m_forms")))


@query("SELECT o_orderkey AS doc_id, CAST(s AS STRING) AS serial, CASE s WHEN 1 THEN 'पुरुष' ELSE 'Female' END AS sex FROM orders, (VALUES (1), (2)) v(s)")
def physical_features(m):
    f = m("m_forms").withColumn("text", F.concat("text", F.lit("\nPhysical features of the\nsuspect/accused\n1 पुरुष 1990\n2 Female 1991\n")))
    return forms.physical_features(f)


# --- rendering ---


@query("""SELECT o_orderkey AS doc_id, CAST(b AS INT) AS block, ['heading', 'rule', 'bullets', 'numbers', 'paragraph'][b + 1] AS kind, ['<h2>Order <strong>' || CAST(o_orderkey AS STRING) || '</strong></h2>', '<hr/>', '<ul><li>one</li><li><em>two</em></li></ul>', '<ol><li>a</li><li>b</li></ol>', '<p>plain text of ' || o_orderpriority || '</p>'][b + 1] AS html FROM orders, range(0, 5) r(b)""")
def markup_blocks(m):
    t = F.concat(F.lit("## Order **"), F.col("o_orderkey").cast("string"), F.lit("**\n\n---\n\n- one\n* *two*\n\n\n1. a\n2) b\n\nplain text\n  of "), "o_orderpriority")
    return render.markup_blocks(m("orders").select(F.col("o_orderkey").alias("doc_id"), t.alias("text")))


@query("""SELECT o_orderkey AS doc_id, '<p>R &amp; D</p><p>second</p><p>one line</p><p>two</p><p>' || o_orderpriority || '</p>' AS html FROM orders""")
def render_sections(m):
    o = m("orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.create_map(F.lit("zzz"), F.col("o_orderpriority"), F.lit("fir_contents"), F.lit("one\nline\n\ntwo"), F.lit("place"), F.lit("  "), F.lit("header"), F.lit("R & D\nsecond"))).alias("key", "text"))
    return render.render_sections(o)


@query("SELECT l_orderkey, l_linenumber, 'flag=' || l_returnflag || CASE WHEN l_linenumber > 2 THEN ' | line=' || CAST(l_linenumber AS STRING) ELSE '' END AS note FROM lineitem")
def audit_notes(m):
    x = m("lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"), F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).alias("line"))
    return render.audit_notes(x, ["flag", "line"]).drop("flag", "line")


@query("SELECT id, CASE case_type WHEN 'WRIA' THEN 'Writ' WHEN 'BAIL' THEN 'Bail application' ELSE 'Legal document' END AS label FROM m_cases")
def lookup_label(m):
    return render.lookup_label(m("m_cases").select("id", "case_type"), "case_type", {"WRIA": "Writ", "BAIL": "Bail application"}, "Legal document").drop("case_type")
