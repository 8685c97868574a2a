"""Quality classifier (op 4): hierarchical empirical Bayes.

Two classifiers (low quality, toxic) give each document a log-odds of evidence. Hosts (here: `source`) and paths in them
(here: `source`, `lang`) have their own rates of bad documents: soft counts of all documents are summed by host and
by path, the spread of hosts around the global rate, and of paths around their host, gives the strength of each prior
(method of moments), and sparse sites shrink towards the level above. A document's posterior is the evidence plus the
log-odds of its path's shrunk rate, less that of the rate the classifier was trained at.

Fitting: at most `sample` labelled doc_ids are picked by hash, and they alone are broadcast to the documents; from those
documents come the word list, at most `words` long (word counts by grouped aggregation), and the weights. Both bounds are
documented parameters that bound labelled rows and the model. Everything else covers all documents.

Cases: null or empty text has no evidence but its lack of words and is judged by the fitted weights; a null source or
lang is a site of its own; a label row with a null in any of its three columns is ignored; repeated label rows of a
doc_id count once (its largest labels); documents that share a labelled doc_id count as one: with the words of all, and
the style of the one whose features sort first; without labels of both classes nothing is rejected; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import discard, join_rows, rows_of, small_batches, stored, with_keys

_TOKEN = re.compile(r"[^\W\d_]+")
_MARKS = "!|*#%&$@<>{}[]=+~^_\\"
STYLE = ["log_words", "upper", "marks", "digits", "distinct", "repeats", "mean_len", "top_share", "line_repeats", "marked_words", "pipes", "bangs"]


def style(text: str) -> list[float]:
    """Shape of a text, each value between 0 and about 1."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    kinds = set(words)
    upper = sum(map(str.isupper, words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    marks = sum(map(text.count, _MARKS))
    return [
        float(np.log1p(len(words)) / 10),
        upper / n,
        min(1.0, marks / n),
        sum(map(text.count, "0123456789")) / chars,
        len(kinds) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        min(2.0, chars / n / 10),
        max(counts.values(), default=0) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(not w[-1].isalnum() and not w[0].isalnum() or w[-1:] in _MARKS for w in words) / n,
        text.count("|") / n,
        text.count("!") / n,
    ]


def tokens(text: str) -> set[str]:
    return set(_TOKEN.findall(text.lower()))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the intercept) by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def word_scores(text: str, weights: dict[str, float]) -> list[float]:
    """The four largest weights of listed words that the text holds, and the sum of all."""
    found = sorted((weights[w] for w in tokens(text) if w in weights), reverse=True)
    return [*found[:4], *[0.0] * (4 - len(found[:4])), float(np.sum(found))]


def _features(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [style(t) + word_scores(t, weights) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64())), b.column(2), b.column(3)], names=["doc_id", "x", "quality", "toxic"])

    return run


class Model:
    """Style weights and word weights of both classifiers, and the rate of bad documents they were fitted at."""

    def __init__(self, low: np.ndarray, toxic: np.ndarray, scale: tuple[np.ndarray, np.ndarray], words: dict[str, float], rates: tuple[float, float]):
        self.low, self.toxic, self.scale, self.words, self.rates = low, toxic, scale, words, rates

    def evidence(self, text: str | None) -> tuple[float, float]:
        t = text or ""
        s = (np.array(style(t)) - self.scale[0]) / self.scale[1]
        z = np.array(word_scores(t, self.words))
        return float(np.append(s, 1) @ self.low), float(np.append(np.append(z, s[0]), 1) @ self.toxic)


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, text, quality, toxic of documents with one of `sample` labelled doc_ids, picked by hash.

    Labels are reduced to one small row a doc_id; of those at most `sample` are broadcast, so no text is shuffled to meet them."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).dropna()
    lab = lab.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    picked = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "quality", "toxic")  # at most `sample` rows are broadcast


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8000, least_docs: int = 4) -> Model:
    """Fits on the sampled documents. The word list: all words in `least_docs` of them or more whose share among toxic documents
    exceeds that among the rest by a z-score of over 3; only the sample bounds it."""
    small_batches(docs.sparkSession)
    lab = stored(labelled(docs, labels, sample), "labelled")
    of = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    n = of.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("quality")), F.lit(0))).first()
    total, bad, low = int(n[0]), int(n[1]), int(n[2])
    weights: dict[str, float] = {}
    if 0 < bad < total:
        t = lab.select("doc_id", "toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)))).alias("word")).distinct()
        t = t.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")).where(F.col("n") >= least_docs)
        rate = bad / total
        t = t.withColumn("z", (F.col("k") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate)))
        top = t.where("z > 3").collect()  # the model: words of at most `sample` texts
        weights = {r["word"]: float(np.log((r["k"] + 0.5) / (bad + 1)) - np.log((r["n"] - r["k"] + 0.5) / (total - bad + 1))) for r in top}
    # One row of a few numbers for each of at most `sample` doc_ids reaches the driver; texts stay in the tasks.
    part = lab.mapInArrow(_features(weights), "doc_id long, x array<double>, quality int, toxic int")
    part = part.groupBy("doc_id").agg(F.min(F.struct("x", "quality", "toxic")).alias("m")).select("m.*").toPandas()
    discard(lab)
    k = len(STYLE)
    if not len(part) or not low or low == total:
        return Model(np.append(np.zeros(k), -20.0), np.append(np.zeros(6), -20.0), (np.zeros(k), np.ones(k)), weights, (0.5, 0.5))
    x = np.array(part["x"].tolist(), float)
    order = np.lexsort((*x.T, part["toxic"], part["quality"]))  # sums in one order, so that all runs agree
    x, part = x[order], part.iloc[order]
    s, z = x[:, :k], x[:, k:]
    mean, sd = s.mean(0), s.std(0) + 1e-3
    s = (s - mean) / sd
    low_w = fit_logistic(s, 1.0 - part["quality"].to_numpy(float))
    toxic_w = fit_logistic(np.hstack([z, s[:, :1]]), part["toxic"].to_numpy(float)) if weights else np.append(np.zeros(6), -20.0)
    return Model(low_w, toxic_w, (mean, sd), weights, (low / total, max(bad, 1) / total))


def evidence(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """doc_id, text_hash, host, path, e_low, e_toxic: log-odds of both classifiers for every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = np.array([model.evidence(t) for t in b.column(4).to_pylist()], float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(e[:, 0]), pa.array(e[:, 1])], names=["doc_id", "text_hash", "host", "path", "e_low", "e_toxic"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, text_hash long, host string, path string, e_low double, e_toxic double")


def _sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def _logit(c: Column) -> Column:
    p = F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (F.lit(1.0) - p))


def _strength(groups: DataFrame, n: str, s: str, over: Column) -> float:
    """Pseudo-count of the prior around the rate `over`, from the spread of group rates (method of moments)."""
    rate = F.col(s) / F.col(n)
    r = groups.agg(F.sum(F.col(n) * (rate - over) ** 2).alias("v"), F.sum(over * (1 - over)).alias("b"), F.sum(F.col(n) * over * (1 - over)).alias("m"), F.sum(n).alias("n")).first()
    if not r["n"] or not r["m"]:
        return 1.0
    excess = (r["v"] - r["b"]) / r["n"]  # variance between groups beyond that of counting
    mean = r["m"] / r["n"]
    return float(min(max(mean / excess - 1, 1.0), 1e6)) if excess > 0 else 1e6


def posteriors(ev: DataFrame, rates: tuple[float, float]) -> DataFrame:
    """Adds site_low, site_toxic, p_low and p_toxic. Sites are one row each; sums are of whole millionths, so that all runs agree."""
    soft = {w: F.round(_sigmoid(F.col(f"e_{w}")) * 1_000_000).cast("long") for w in ("low", "toxic")}
    paths = stored(ev.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *[(F.sum(s) / 1_000_000).alias(w) for w, s in soft.items()]), "sites")
    hosts = paths.groupBy(F.col("host").alias("h")).agg(F.sum("n").alias("hn"), *[F.round(F.sum(w), 6).alias(f"h_{w}") for w in soft])
    total = hosts.agg(F.sum("hn"), *[F.round(F.sum(f"h_{w}"), 6) for w in soft]).first()
    for i, w in enumerate(soft):
        overall = float(total[i + 1]) / total[0] if total[0] else 0.5
        k = round(_strength(hosts, "hn", f"h_{w}", F.lit(overall)), 6)
        hosts = hosts.withColumn(f"hp_{w}", (F.col(f"h_{w}") + F.lit(k * overall)) / (F.col("hn") + F.lit(k)))
    sites = stored(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))), "shrunk")
    shrunk = {}
    for w in soft:
        k = round(_strength(sites, "n", w, F.col(f"hp_{w}")), 6)
        shrunk[w] = (F.col(w) + F.lit(k) * F.col(f"hp_{w}")) / (F.col("n") + F.lit(k))
    out = join_rows(ev, sites.select("host", "path", *[c.alias(f"site_{w}") for w, c in shrunk.items()]), ["host", "path"])
    for w, rate in zip(soft, rates, strict=True):
        out = out.withColumn(f"p_{w}", _sigmoid(F.col(f"e_{w}") + _logit(F.col(f"site_{w}")) - _logit(F.lit(float(rate)))))
    discard(paths)
    return out


def classify(docs: DataFrame, labels: DataFrame, at: float = 0.5, **options) -> DataFrame:
    """doc_id, text_hash, host, path, p_quality, p_toxic, site_quality, keep for every row of docs."""
    model = fit(docs, labels, **options)
    ev = stored(evidence(docs, model), "evidence")
    p = posteriors(ev, model.rates)
    return p.select("doc_id", "text_hash", "host", "path", F.round(1 - F.col("p_low"), 6).alias("p_quality"), F.round("p_toxic", 6).alias("p_toxic"), F.round(1 - F.col("site_low"), 6).alias("site_quality"), ((F.col("p_low") < at) & (F.col("p_toxic") < at)).alias("keep"))


def kept_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier keeps."""
    bad = classify(docs, labels, **options).where("NOT keep").select("doc_id", "text_hash").distinct()
    d = with_keys(docs, doc_id=F.col("doc_id").cast("long"), text_hash=F.xxhash64("text"))
    return rows_of(join_rows(d, bad, ["doc_id", "text_hash"], "left_anti"))
