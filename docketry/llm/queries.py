"""The queries of the numbered operators, with production parameters, over whole tables; and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import centroids, chat, decontaminate, licenses, media, mixing, quality, resampling, secret_scan, sharding, simhash, token_store, url_filter
from docketry.llm.common import small_batches

#: The URL rules of the contract.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: The added conversation of the contract.
ADDED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_output(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_of_texts(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return n.select("doc_id", F.lpad(F.lower(F.hex(F.element_at("fp", 1))), 16, "0").alias("fingerprint"), "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(ADDED, "conv_id long, turn long, role string, text string")
    return chat.chat_output(rows.unionByName(added), tokenizer_path())


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents")).drop("vslot")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster_vectors(table(spark, sf_dir, "embeddings")))


QUERIES = {f.__name__: f for f in (op1_token_output, op2_media, op3_simhash, op4_quality, op5_decontamination, op6_secrets, op7_licenses, op8_mixing, op9_url_filter, op10_chat, op11_resampling, op12_sharding, op13_centroids)}

_WORD5 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP5 = f"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW.format("text")}, '{_WORD5}') AS w FROM benchmark),
wins AS (SELECT DISTINCT item, w[s:s + 9] AS win, len(w[s:s + 9]) AS n FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all({_LOW.format("text")}, '{_WORD5}'), []) AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (SELECT rid, s, n, w[s:s + n - 1] AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT g.rid, g.s, g.n, i.item FROM grams g JOIN wins i ON g.win = i.win),
spots AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hits) GROUP BY rid),
lists AS (SELECT DISTINCT win FROM wins WHERE n = 10),
tens AS (SELECT rid, s, v[s:s + 9] AS g FROM (SELECT rid, list_append(w, '') AS v, unnest(range(1, len(w) - 7)) AS s FROM dw WHERE len(w) >= 9)),
pairs AS (SELECT rid, s, g, win FROM tens JOIN lists ON g[1:5] = win[1:5] UNION SELECT rid, s, g, win FROM tens JOIN lists ON g[6:10] = win[6:10]),
nears AS (SELECT rid, count(DISTINCT s) AS n_near FROM pairs WHERE len(list_filter(range(1, 11), lambda i: g[i] = win[i])) = 9
  AND NOT EXISTS (SELECT 1 FROM hits WHERE hits.rid = pairs.rid AND hits.s = pairs.s) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM dw LEFT JOIN spots USING (rid) LEFT JOIN items USING (rid) LEFT JOIN nears USING (rid)
"""

_OP8 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][CAST(i % 3 + 1 AS INTEGER)] AS DOUBLE) AS wt, source_size * 2.0::DOUBLE AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / wt, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
  sum(wt) OVER (ORDER BY cap / wt, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w, sum(source_size) OVER () AS every FROM w),
l AS (SELECT *, (every * 1.5::DOUBLE - before) / left_w AS lev FROM o),
t AS (SELECT source, source_size, CASE WHEN lev * wt >= cap THEN cap ELSE wt * (SELECT arg_min(lev, cap / wt) FROM l WHERE lev * wt < cap) END AS target FROM l)
SELECT source_size, target, count(*) AS n, sum(size) AS words FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY ALL
"""

_OP9 = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS v(rh, rp, verdict)),
j AS (SELECT p.*, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh || rp) DESC NULLS LAST, rh || rp) AS k
  FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM j WHERE k = 1
"""


_OP11 = rf"""
WITH RECURSIVE crcs(i, c) AS (SELECT 0 AS i, [x::UBIGINT FOR x IN range(256)] AS c UNION ALL
  SELECT i + 1, [CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END FOR x IN c] FROM crcs WHERE i < 8),
tab AS (SELECT c FROM crcs WHERE i = 8),
d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all({_LOW.format("text")}, '{_WORD5}'), []) AS w FROM documents),
b AS (SELECT coalesce(regexp_extract_all({_LOW.format("text")}, '{_WORD5}'), []) AS w FROM benchmark),
df AS (SELECT rid, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, greatest(1, len(w)))])) AS f FROM d),
bf AS (SELECT unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, greatest(1, len(w)))])) AS f FROM b),
kinds AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
crc AS (SELECT f, xor(list_reduce(list_prepend(4294967295::UBIGINT, [('0x' || h[2 * i + 1:2 * i + 2])::UBIGINT FOR i IN range(len(h) // 2)]),
  lambda a, x: xor(a // 256, c[CAST(xor(a % 256, x) + 1 AS BIGINT)])), 4294967295::UBIGINT) % 10000 AS bucket FROM kinds, tab),
s AS (SELECT bucket, count(*) AS s FROM df JOIN crc USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN crc USING (f) GROUP BY bucket),
big AS (SELECT (SELECT count(*) FROM df) AS ns, (SELECT count(*) FROM bf) AS nt),
gain AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1) * (ns + 10000))::DOUBLE / ((s + 1) * (nt + 10000))::DOUBLE)) AS BIGINT) AS g FROM s LEFT JOIN t USING (bucket), big),
w AS (SELECT rid, count(*) AS n, CAST(sum(g) AS BIGINT) AS g FROM df JOIN crc USING (f) JOIN gain USING (bucket) GROUP BY rid),
o AS (SELECT doc_id, rid, len(w) AS words, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END AS weight,
  ('0x' || sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8])::BIGINT AS h FROM d LEFT JOIN w USING (rid)),
k AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS k, count(*) FILTER (words >= 20) OVER () AS able FROM k)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN words >= 20 AND k <= able * 25 // 100 THEN k END AS rank FROM r
"""


def _op13(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """One pair of steps for each round; components are whole numbers throughout."""
    near = "(SELECT v.vid, vec_id, x, CAST(num AS INTEGER) AS cluster, d AS distance FROM v JOIN (SELECT vid, arg_min(num, d * 1000 + num) AS num, min(d) AS d FROM (SELECT vid, num, CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, {c}) GROUP BY vid) USING (vid))"
    steps = [f"""v AS (SELECT row_number() OVER () AS vid, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS num, x AS c FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT {k}))"""]  # fmt: skip
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED {near.format(c=f'c{i}')}")
        steps.append(f"""m{i} AS (SELECT cluster, list(s ORDER BY dim) AS c FROM (SELECT cluster, dim, CAST(floor(sum(e) / count(*)) AS BIGINT) AS s FROM (SELECT cluster, unnest(x) AS e, unnest(range({dims})) AS dim FROM a{i}) GROUP BY ALL) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT num, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON num = cluster)""")
    steps.append(f"z AS MATERIALIZED {near.format(c=f'c{rounds}')}")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM z JOIN c{rounds} ON num = cluster"""


def _op7() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quote(i)}, {quote(s)}, {quote(o)}, {c}, {w}, {quote(p) if p else 'NULL'})" for i, s, o, c, w, p in licenses.known_table(licenses.SENTENCES))
    rules = ", ".join(f"({quote(','.join(ids))}, {quote(name)}, {len(ids)})" for name, ids in licenses.RULES)
    names = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in licenses.spdx_table())
    longest = max(len(ids) for _, ids in licenses.RULES)
    return rf"""
WITH known AS (SELECT * FROM (VALUES {known}) AS v(sid, norm, opening, chars, words, pat)), rules AS (SELECT * FROM (VALUES {rules}) AS v(seq, license, n)), names AS (SELECT * FROM (VALUES {names}) AS v(part, license)),
d AS (SELECT doc_id, row_number() OVER () AS rid, text FROM documents),
c AS (SELECT rid, list_filter(list_transform(string_split(lower(regexp_replace(regexp_replace(regexp_replace(text, '{licenses.COMMENT}', '', 'g'), '{licenses.LIST_MARK}', '\1' || chr(10), 'g'), '{licenses.END_MARK}', '\1' || chr(10), 'g')), chr(10)),
  lambda x: {{'raw': x, 'norm': trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))}}), lambda x: x.norm <> '') AS b FROM d),
e AS (SELECT rid, b, list_transform(b, lambda x: x.norm) AS s, list_filter(range(len(b)), lambda i: regexp_matches(b[i + 1].norm, '{licenses.MARK}')) AS marks, unnest(range(len(b))) AS pos FROM c),
w AS (SELECT rid, s, marks, pos, s[pos + 1] AS piece, regexp_matches(s[pos + 1], '^copyright( c)? [0-9]{{4}}( |$)') AS notice FROM e),
j AS (SELECT rid, marks, pos, sid, notice, norm, chars, pat, array_to_string(s[pos + 1:pos + words], chr(10)) AS ahead FROM w JOIN known ON opening = CASE WHEN notice THEN 'copyright' ELSE string_split(piece, ' ')[1] END),
q AS (SELECT *, CASE WHEN sid = 'copyright' THEN chars WHEN pat IS NOT NULL THEN length(regexp_extract(replace(ahead, chr(10), ' '), pat)) WHEN starts_with(replace(ahead, chr(10), ' '), norm) THEN chars ELSE 0 END AS size FROM j),
h AS (SELECT rid, marks, pos, pos + CASE WHEN sid = 'copyright' THEN 0 ELSE len(string_split(left(ahead, size), chr(10))) - 1 END AS last, sid, row_number() OVER (PARTITION BY rid, pos ORDER BY size DESC, sid DESC) AS b
  FROM q WHERE CASE WHEN sid = 'copyright' THEN notice ELSE size > 0 AND substr(ahead, size + 1, 1) IN ('', chr(10)) END),
k0 AS (SELECT rid, pos, last, sid, coalesce(list_max(list_filter(marks, lambda i: i < pos - 1)), -1) AS mark, list_contains(marks, pos - 1) AND list_contains(marks, last + 1) AS open, row_number() OVER (PARTITION BY rid ORDER BY pos) - 1 AS at FROM h WHERE b = 1),
k AS (SELECT *, CASE WHEN mark > lag(last) OVER v THEN 1 ELSE 0 END AS cut, open AND lead(pos) OVER v IS DISTINCT FROM last + 2 AS more FROM k0 WINDOW v AS (PARTITION BY rid ORDER BY pos)),
g AS (SELECT a.rid, a.at, a.pos AS first, b.last AS last, b.at + 1 AS fin, (SELECT string_agg(x.sid, ',' ORDER BY x.at) FROM k x WHERE x.rid = a.rid AND x.at BETWEEN a.at AND b.at) AS seq
  FROM k a JOIN k b ON a.rid = b.rid AND b.at BETWEEN a.at AND a.at + {longest - 1} WHERE (b.at = a.at OR NOT b.more) AND NOT EXISTS (SELECT 1 FROM k x WHERE x.rid = a.rid AND x.at > a.at AND x.at <= b.at AND x.cut = 1)),
m AS (SELECT g.*, license, max(fin) OVER (PARTITION BY rid ORDER BY g.at, fin DESC, license ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM g JOIN rules USING (seq)),
x0 AS (SELECT rid, pos, regexp_extract(b[pos + 1].raw, '{licenses.SPDX_HEAD}', 1) AS tail, b[pos + 2].raw AS next FROM e WHERE starts_with(s[pos + 1], 'spdx license identifier')),
x1 AS (SELECT rid, pos, pos + CASE WHEN tail <> '' THEN 0 ELSE 1 END AS last, regexp_extract_all(CASE WHEN tail <> '' THEN tail ELSE next END, '{licenses.SPDX_PART}') AS t FROM x0),
x AS (SELECT DISTINCT rid, pos AS first, last, license FROM (SELECT rid, pos, last, unnest(list_filter(t, lambda v, i: i = 1 OR t[i - 1] <> 'with')) AS part FROM x1) JOIN names USING (part)),
o AS (SELECT rid, count(*) AS n_matches, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, string_agg(license || ':' || first || ':' || last, ',' ORDER BY first, last, license) AS matches
  FROM (SELECT rid, first, last, license FROM m WHERE seen IS NULL OR fin > seen UNION ALL SELECT * FROM x) GROUP BY rid),
n AS (SELECT rid, count(*) AS n_known FROM (SELECT rid, pos FROM k UNION ALL SELECT DISTINCT rid, first FROM x) GROUP BY rid)
SELECT doc_id, coalesce(n_known, 0) AS n_known, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses, coalesce(matches, '') AS matches
FROM d LEFT JOIN n USING (rid) LEFT JOIN o USING (rid)
"""


#: SQL where it can express the operator; op 8's is kept in the tests only, as the cut follows hashes that DuckDB lacks.
ORACLES = {"op5_decontamination": _OP5, "op7_licenses": _op7(), "op9_url_filter": _OP9, "op11_resampling": _OP11, "op13_centroids": _op13()}
TARGETS_SQL = _OP8
