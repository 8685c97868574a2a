"""Model tables derived from the driver's tables, as SQL that both Spark and DuckDB read (or one text for each)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_KIND = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'WRIA' WHEN '2' THEN 'CRLA' WHEN '3' THEN 'SPLA' WHEN '4' THEN 'BAIL' ELSE 'APPL' END"
_STEP = "CASE event_type WHEN 'signup' THEN {0} WHEN 'view' THEN {1} WHEN 'click' THEN {2} WHEN 'purchase' THEN {3} ELSE {4} END"
_NUM = "CAST((o_orderkey * 7919) % 1000003 AS STRING)"


def _braced(sql: str) -> tuple[str, str]:
    """SQL with braces in its texts: doubled for Spark, but for those around table names."""
    return re.sub(r"\{\{(\w+)\}\}", r"{\1}", sql.replace("{", "{{").replace("}", "}}")), sql


#: name -> SQL, or (Spark SQL, DuckDB SQL) where they differ. {x} is another model table or a driver table.
ADAPTERS: dict[str, str | tuple[str, str]] = {
    "m_cases": f"""SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS lawyer_id, 'State vs party ' || CAST(o_custkey % 97 AS STRING) AS case_title,
        CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'disposed' ELSE 'archived' END AS status, {_KIND} AS case_type,
        'Petitioner ' || CAST(o_custkey AS STRING) AS petitioner_name, 'Respondent ' || CAST(o_orderkey % 500 AS STRING) AS respondent_name,
        CAST(o_orderdate AS DATE) AS filing_date, o_orderkey AS seq FROM {{orders}}""",
    "m_numbers": f"""SELECT CAST(o_orderkey AS STRING) AS case_id, {_KIND} || '/' || {_NUM} || '/' || CAST(year(o_orderdate) AS STRING) AS case_number FROM {{orders}}""",
    "m_choices": "SELECT n.case_id, n.case_number AS number FROM {m_numbers} n JOIN {m_cases} c ON n.case_id = c.id WHERE c.status = 'active'",
    "m_listchoices": "SELECT CAST(o_orderkey AS STRING) AS case_id, 'WRIA-' || CAST(o_orderkey % 5000 AS STRING) || '-2026' AS number FROM {orders} WHERE o_orderkey % 6 = 0",
    "m_sections": "SELECT CAST(l_orderkey AS STRING) AS case_id, CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS id, 'S' || CAST(l_partkey % 511 AS STRING) AS section, l_returnflag <> 'R' AS is_active FROM {lineitem}",
    "m_parties": "SELECT CAST(l_orderkey AS STRING) AS case_id, 'Party ' || CAST(l_suppkey AS STRING) AS name FROM {lineitem}",
    "m_access": "SELECT CAST(l_orderkey AS STRING) AS case_id, 'a' || CAST(l_suppkey AS STRING) AS user_id, CAST(min(o_custkey) AS STRING) AS granted_by, max(CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 0 END) = 1 AS can_edit FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_suppkey",
    "m_users": "SELECT 'a' || CAST(s_suppkey AS STRING) AS id, ' ' || s_name || '@X.org' AS email, CASE WHEN s_suppkey % 5 = 0 THEN 'lawyer' ELSE 'munshi' END AS role FROM {supplier} UNION ALL SELECT CAST(c_custkey AS STRING) AS id, c_name || '@x.org' AS email, 'lawyer' AS role FROM {customer}",
    "m_listings": f"""SELECT CAST(o_orderkey AS STRING) AS row_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS listing_date, 'C' || CAST(o_custkey % 20 AS STRING) AS court_number,
        CAST(row_number() OVER (PARTITION BY date_trunc('month', o_orderdate), o_custkey % 20 ORDER BY o_orderkey) AS INT) AS serial_number,
        CASE WHEN o_orderkey % 5 = 0 THEN replace({_KIND} || '/' || n || '/' || CAST(year(o_orderdate) AS STRING), '/', '-') ELSE {_KIND} || '/' || n || '/' || CAST(year(o_orderdate) AS STRING) END AS case_number,
        'State vs party ' || CAST(o_custkey % 97 AS STRING) AS case_title, 'Adv ' || CAST(o_custkey % 31 AS STRING) AS advocate_name
        FROM (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN substr({_NUM}, 1, length({_NUM}) - 2) || CAST((o_orderkey + 3) % 10 AS STRING) || CAST((o_orderkey + 7) % 10 AS STRING)
            WHEN o_orderkey % 7 = 0 THEN substr({_NUM}, 1, length({_NUM}) - 1) || CAST((o_orderkey + 5) % 10 AS STRING) ELSE {_NUM} END AS n FROM {{orders}}) x""",
    "m_existing": "SELECT 'e' || row_id AS existing_id, CAST(row_id AS BIGINT) AS seq, CASE WHEN CAST(row_id AS BIGINT) % 3 = 0 THEN NULL ELSE case_number END AS case_number, court_number, CASE WHEN CAST(row_id AS BIGINT) % 6 = 0 THEN NULL ELSE serial_number END AS serial_number FROM {m_listings} WHERE CAST(row_id AS BIGINT) % 2 = 0",
    "m_matched": "SELECT l.row_id, l.listing_date, l.court_number, l.serial_number, l.case_number, CASE WHEN c.status = 'active' THEN c.id END AS matched_case_id, CASE WHEN c.seq % 4 = 0 THEN c.id END AS previous_case_id, CASE WHEN c.seq % 2 = 0 THEN 'e' || l.row_id END AS existing_id FROM {m_listings} l JOIN {m_cases} c ON l.row_id = c.id",
    "m_sent": "SELECT 'cause_list_match:' || CAST(listing_date AS STRING) || ':' || row_id AS dedup_key, 'u' AS user_id FROM {m_listings} WHERE CAST(row_id AS BIGINT) % 9 = 0",
    "m_pages": (
        "SELECT doc_id, p AS page, CASE WHEN doc_id % 5 = 0 AND p % 2 = 0 THEN '' ELSE substr(text, (p - 1) * 1500 + 1, 1500) END AS text, CAST(length(text) AS BIGINT) * p * 4000 AS bytes FROM (SELECT doc_id, text, explode(sequence(1, greatest(1, CAST(ceil(length(text) / 1500.0) AS INT)))) AS p FROM {documents}) x",
        "SELECT doc_id, p AS page, CASE WHEN doc_id % 5 = 0 AND p % 2 = 0 THEN '' ELSE substr(text, (p - 1) * 1500 + 1, 1500) END AS text, CAST(length(text) AS BIGINT) * p * 4000 AS bytes FROM (SELECT doc_id, text, CAST(unnest(range(1, greatest(1, CAST(ceil(length(text) / 1500.0) AS INT)) + 1)) AS INT) AS p FROM {documents}) x",
    ),
    "m_ocr": "SELECT doc_id, page, 'OCR page ' || CAST(page AS STRING) AS text FROM {m_pages} WHERE doc_id % 5 = 0 AND page % 2 = 0",
    "m_langs": "SELECT doc_id, page AS pos, CASE (doc_id + page) % 4 WHEN 0 THEN 'hi' WHEN 1 THEN 'en' WHEN 2 THEN '' ELSE 'und' END AS lang, ((doc_id * 7 + page * 3) % 16) / 16.0E0 AS confidence FROM {m_pages}",
    "m_docs": """SELECT d.doc_id, d.doc_id % 211 AS case_id, CASE WHEN d.doc_id % 7 = 0 THEN 'pending' WHEN d.doc_id % 7 = 1 THEN 'not_required' ELSE 'completed' END AS ocr_status,
        CASE WHEN d.doc_id % 3 = 0 THEN 'digital_extract' ELSE 'ocr' END AS processing_route, CASE d.doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'text/plain' END AS mime,
        CASE WHEN d.doc_id % 3 = 0 THEN 'uploaded' ELSE 'pending' END AS upload_status, 'k' || CAST(d.doc_id AS STRING) AS storage_key, CASE WHEN d.doc_id % 4 = 0 THEN ' ' WHEN d.doc_id % 4 = 1 THEN NULL ELSE 'reviewed ' || CAST(d.doc_id AS STRING) END AS reviewed, d.text FROM {documents} d""",
    "m_typed": "SELECT doc_id, CASE WHEN quality = 1 THEN 'accepted' ELSE 'pending' END AS status FROM {labels}",
    "m_extract": "SELECT doc_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'edited' ELSE 'pending' END AS review_status FROM {labels} WHERE doc_id % 2 = 0",
    "m_objects": "SELECT 'k' || CAST(doc_id AS STRING) AS key FROM {documents} WHERE doc_id % 2 = 0",
    "m_calls": "SELECT user_id, CAST(ts AS TIMESTAMP) AS ts FROM {events}",
    "m_jobs": f"SELECT user_id AS job_id, event_id AS seq, CAST(ts AS TIMESTAMP) AS updated_at, {_STEP.format("'pending'", "'processing'", "'processing'", "'completed'", "'failed'")} AS status FROM {{events}}",
    "m_doclog": f"SELECT user_id AS doc_id, event_id AS seq, {_STEP.format("'start'", "'start'", "'complete'", "'skip'", "'fail'")} AS event FROM {{events}}",
    "m_draftlog": f"SELECT user_id AS id, event_id AS seq, CAST(ts AS TIMESTAMP) AS ts, {_STEP.format("'generating'", "'ready'", "'editing'", "'final'", "'archived'")} AS state FROM {{events}}",
    "m_exlog": f"SELECT user_id AS id, event_id AS seq, CAST(ts AS TIMESTAMP) AS ts, {_STEP.format("'pending'", "'processing'", "'completed'", "'failed'", "'processing'")} AS state FROM {{events}}",
    "m_notes": "SELECT event_id AS id, user_id, event_type = 'view' AS is_read FROM {events}",
    "m_entries": "SELECT user_id AS case_id, event_id % 7 AS doc_id, event_id AS seq, event_type || ' ' || props AS content FROM {events}",
    "m_contexts": _braced("""SELECT DISTINCT user_id AS case_id, '{"_case":{"n":' || CAST(user_id AS STRING) || '},"9":{"fields":{"a":[1,2]},"review_status":"edited"},"documents":[{"content":"old","document_id":"1"},7,{"content":"keep","document_id":"8"}]}' AS context_json FROM {events} WHERE user_id % 2 = 0"""),
    "m_pushes": _braced("""SELECT user_id AS case_id, CAST(event_id % 5 AS STRING) AS doc_id, event_id AS seq, CASE WHEN event_id % 5 = 4 THEN 'keys' ELSE 'documents' END AS part, '{"document_id":"' || CAST(event_id % 5 AS STRING) || '","content":"' || event_type || '"}' AS entry,
        '{"source":"document_review","content_chars":' || CAST(length(event_type) AS STRING) || '}' AS meta FROM {events} WHERE event_id % 3 <> 0"""),
    "m_drafts": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 < 3 OR o_orderkey < 10 THEN NULL ELSE o_orderkey - 7 END AS parent, CAST(o_orderkey % 5 + 1 AS INT) AS version, CASE WHEN o_orderstatus = 'F' THEN 'ready' ELSE 'editing' END AS status, o_custkey AS created_by FROM {orders}",
    "m_forms": """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN replace(text, 'Village ', 'Village मुरा 0 ') WHEN 1 THEN replace(text, '4. Type of', '4 . Type of') WHEN 2 THEN replace(text, '2. S.No. Acts', '2. Acts')
        WHEN 3 THEN replace(text, '/ suspected accused', '/ suspected accused' || chr(10) || '1 राम कुमार पिता का नाम : श्याम लाल ग्राम- नया गांव ' || CAST(doc_id AS STRING) || chr(10) || '2 मोहन पिता का नाम सोहन')
        ELSE replace(text, 'Date ( दिनांक ): 17/02/2025 Time', 'Time') END AS text FROM {m_plainforms}""",
    "m_keys": "SELECT o_orderkey, o_custkey, o_orderdate FROM {orders}",
    "m_plainforms": """SELECT o_orderkey AS doc_id, 'FIRST INFORMATION REPORT' || chr(10) || chr(10) || '1. District / Unit ( जिला / इकाई ) : P.S. ( थाना ) : Station ' || CAST(o_custkey AS STRING) || ' Year ( वर्ष ) : ' || CAST(year(o_orderdate) AS STRING) || chr(10) || 'District ' || CAST(o_custkey % 75 AS STRING) || chr(10)
        || 'FIR No. ( सं . ) : ' || CAST(o_orderkey AS STRING) || chr(10) || 'Date and Time of FIR ( दिनांक और समय ): 17/02/' || CAST(year(o_orderdate) AS STRING) || ' 14:21 घंटे' || chr(10) || chr(10)
        || '2. S.No. Acts ( अधिनियम ) Sections ( धारा ( एँ ) )' || chr(10) || '1 भारतीय न्याय संहिता ( बी एन एस ) , 2023 ' || CAST(o_orderkey % 300 + 20 AS STRING) || chr(10) || '2 भारतीय न्याय संहिता ( बी एन एस ) , 2023 115 ( ' || CAST(o_orderkey % 4 + 1 AS STRING) || ' )' || chr(10) || chr(10)
        || '3. ( a ) Occurrence of offence ( घटना )' || chr(10) || '1 Day ( दिन ): शनिवार Date from ( दिनांक से ) : 15/02/2025 Date To ( दिनांक तक ): 16/02/2025' || chr(10) || 'Time From ( समय से ): 20:00 बजे Time To ( समय तक ) : 21:30 बजे' || chr(10)
        || '( b ) Information received at P.S. ( थाना ): Date ( दिनांक ): 17/02/2025 Time ( समय ) : 14:' || CAST(o_orderkey % 50 + 10 AS STRING) || ' बजे' || chr(10) || '( c ) General Diary Reference ( संदर्भ ): Entry No. ( सं . ) : ' || CAST(o_orderkey % 90 + 10 AS STRING) || chr(10) || chr(10)
        || '4. Type of Information ( प्रकार ): लिखित' || chr(10) || chr(10) || '5. Place of Occurrence' || chr(10) || '1. ( a ) Direction and distance from P.S. ( दूरी ) : दक्षिण , 06 कि . मी .' || chr(10) || '( b ) Address ( पता ) : Village ' || CAST(o_custkey AS STRING) || chr(10) || chr(10)
        || '6. Complainant / Informant ( शिकायतकर्ता )' || chr(10) || '( a ) Name ( नाम ): Person ' || CAST(o_custkey AS STRING) || chr(10) || '( b ) Father''s Name ( पिता ): Elder ' || CAST(o_custkey % 100 AS STRING) || chr(10) || '( c ) Date / Year of Birth ( वर्ष ): ' || CAST(1950 + o_custkey % 50 AS STRING) || chr(10) || '( d ) Nationality ( राष्ट्रीयता ): भारत' || chr(10) || '( j ) Phone number ( सं . ): Mobile ( सं . ) : 91-97197XXXXX' || chr(10) || chr(10)
        || '7. Details of known / suspected accused' || chr(10) || chr(10) || '8. Reasons for delay in reporting :' || chr(10) || chr(10) || '9. Particulars of properties of interest :' || chr(10) || '1 Coin and Currency  Indian Currency  ' || CAST(o_orderkey % 40 AS STRING) || ' notes  ' || CAST(o_orderkey AS STRING) || chr(10) || chr(10)
        || '10. Total value of property ( In Rs ) : ' || CAST(o_orderkey AS STRING) || chr(10) || chr(10) || '11. Inquest Report / U.D. case No. , if any : 1 UD/' || CAST(o_orderkey AS STRING) || chr(10) || chr(10)
        || '12. First Information contents ( तथ्य ):' || chr(10) || 'वहां पर मौजूद योगेश पुत्र हरि सिंह गौरव सिंह पुत्र हरि सिंह ने' || chr(10) || 'report ' || CAST(o_orderkey AS STRING) || chr(10) || chr(10) || 'second part' || chr(10) || chr(10)
        || '13. Action taken :' || chr(10) || '( 1 ) Registered the case and took up the investigation' || chr(10) || '( 2 ) Directed ( Name of I.O. ) ( नाम ) : officer ' || CAST(o_orderkey % 60 AS STRING) || ' Rank ( पद ) : उपनिरीक्षक No. ( सं . ) :' || chr(10) || chr(10) || '14. Signature' || chr(10) || chr(10) || '15. Date and time of dispatch' AS text FROM {m_keys}""",
    "m_lists": """SELECT CAST(date_trunc('month', o_orderdate) AS STRING) AS list_id, CAST(o_custkey % 20 AS INT) AS page,
        CASE WHEN o_custkey % 20 % 3 = 0 THEN 'Court No-' || CAST(o_custkey % 20 AS STRING) || chr(10) ELSE '' END AS head, o_orderkey,
        '  ' || CAST(o_orderkey % 9000 + 1 AS STRING) || ' Pet ' || CAST(o_custkey AS STRING) || '   VS   Resp ' || CAST(o_orderkey AS STRING) || chr(10) AS body, 'WRIA/' || CAST(o_orderkey % 5000 AS STRING) || '/2026' AS cn FROM {orders}""",
}


#: Tables of narrow keys from which long texts are made: dealt out first, as their few bytes would be read by one task.
SPREAD = {"m_keys": "o_orderkey"}


def parts(name: str) -> list[str]:
    sql = ADAPTERS[name]
    return sorted(set(re.findall(r"\{(\w+)\}", sql if isinstance(sql, str) else sql[0])))


def model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A model table, or a driver table of that name."""
    if name not in ADAPTERS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = ADAPTERS[name]
    out = spark.sql(sql if isinstance(sql, str) else sql[0], **{p: model(spark, sf_dir, p) for p in parts(name)})
    return out.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), SPREAD[name]) if name in SPREAD else out


def with_models(sql: str) -> str:
    """DuckDB SQL with the model tables it names as common table expressions."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in ADAPTERS and name not in done:
            for p in parts(name):
                add(p)
            text = ADAPTERS[name]
            done[name] = re.sub(r"\{(\w+)\}", r"\1", text if isinstance(text, str) else text[1])

    for name in sorted(set(re.findall(r"\bm_\w+", sql))):
        add(name)
    head = ", ".join(f"{n} AS ({s})" for n, s in done.items())
    body = sql.strip()
    if not head:
        return body
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body):
        return f"WITH {m[1] or ''}{head}, {body[m.end():]}"
    return f"WITH {head} {body}"
