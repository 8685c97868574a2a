"""The registered queries against DuckDB, and the pipeline against its stages' own rules."""

import pytest

import corpus_pipeline
from docketry.llm.queries import ORACLES, QUERIES, TARGETS_SQL
from tests.compare import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, con, name):
    same(QUERIES[name](spark, SF), ORACLES[name], con)


def test_targets_sql(spark, con):
    from pyspark.sql import functions as F

    got = QUERIES["op8_mixing"](spark, SF).groupBy("source_size", "target").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    same(got, TARGETS_SQL, con)


CASES = "doc_id long, text string, lang string, source string, n_chars long, quality int, row string, n int, copies int, text_hash long, component_id long, win string, key int"


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and names that the operators use themselves."""
    tail = (1, "x", 2, 3, 4, 5, "w", 6)
    text = " ".join(f"word{i * i % 97}" for i in range(80))
    rows = [(1, text, "en", "s1", 5), (2, text + " end", "en", "s1", 5), (2, text + " end", "en", "s1", 5), (3, None, "en", "s1", None), (None, "a text without an id of its own", None, None, None), (5, "", "de", None, 0), (6, "long words " * 40000, "en", "s2", 1), (None, None, None, None, None), (8, "one", "en", "s3", 3), (8, "one", "fr", "s3", 3)]
    return spark.createDataFrame([(*r, *tail) for r in rows] + [(9, "nulls all over here", *[None] * 11)], CASES)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:4], ids=lambda s: s[0])
def test_stage_cases(spark, hard, stage):
    """Each stage returns the columns as they came, values too, from hard rows and from none."""
    name, apply = stage
    out = apply(spark, hard, SF)
    assert out.columns == hard.columns and out.dtypes == hard.dtypes
    key = lambda d: {tuple(r) for r in d.collect()}
    assert key(out) <= key(hard) and out.count() > 0
    if name == "SimHash near-dedup":
        ids = [r.doc_id for r in out.collect()]
        assert ids.count(1) == 1 and 2 not in ids and ids.count(8) == 1
    if name == "benchmark decontamination":
        assert out.count() == hard.count()
    none = apply(spark, hard.limit(0), SF)
    assert none.columns == hard.columns and none.count() == 0


def test_last_stage_cases(spark, hard):
    out = corpus_pipeline.tokenised(spark, hard, SF)
    assert out.count() == hard.count() and out.where("doc_id IS NULL").count() == 2
    assert corpus_pipeline.tokenised(spark, hard.limit(0), SF).count() == 0


def test_pages_cases(spark):
    """An empty table of pages, and a column named like the operator's own."""
    from docketry.llm import queries, url_filter

    p = spark.createDataFrame([(1, "http://a.net/", "x", "y")], "page_id long, url string, host string, rule string")
    rules = url_filter.rule_table(spark, queries.URL_RULES)
    assert [tuple(r) for r in url_filter.judge_urls(p, rules).collect()] == [(1, "a.net", "/", "net/", "block")]
    assert url_filter.judge_urls(p.limit(0), rules).count() == 0


def test_pipeline(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    kept = corpus_pipeline.classify(spark, d, SF)
    assert kept.columns == d.columns
    good = lab.where("quality = 1 AND toxic = 0").join(kept, "doc_id").count() / lab.where("quality = 1 AND toxic = 0").count()
    assert good > 0.95
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0
    starts = [(r.start, r.n_tokens) for r in out.orderBy("start").collect()]
    assert all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:], strict=False))
