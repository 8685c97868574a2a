"""The training-corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

All stages but the last return rows as they came, with all their columns, whatever those are named. Cases: a null text is
judged like an empty one; rows with a null id, source or lang are rows like others (a null source is a source of its own);
an empty table gives an empty one. What becomes of empty and long texts, ties and repeated rows is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.llm import decontaminate, mixing, quality, simhash, token_store
from docketry.llm.common import discard, stored
from docketry.llm.queries import table, tokenizer_path


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps: an empty text goes if the fitted weights reject it, a long one is read whole,
    repeated rows share their fate; a probability of just one half rejects; without labels all stay."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more, found by the Gray-order index over
    SimHash fingerprints and confirmed by the sets. The smallest id stays, null only where a group has no other; of rows with that
    id the text with the smallest hash, once; texts without words are one group."""
    return simhash.one_of_each(docs, **simhash.SIMILAR)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; a text without words has none; repeated rows stay or go together."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in whole copies: the one at a source's cut stays whole. Texts without
    words take nothing and go; repeated rows deal their copies out among themselves."""
    return mixing.mixed_documents(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold of each document: an empty text is its end id alone; null ids come first; repeated rows are kept."""
    return token_store.token_output(docs, tokenizer_path())


STAGES = [("quality classifier", classify), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminated), ("mixing sources to target weights", mixed), ("token-ID / binary output", tokenised)]
#: The stages sum up classifiers, fingerprints and hash-ordered cuts that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's result is a table in the shared folder."""
    docs, last = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{i}")
        if last is not None:
            discard(last)
        last = docs
    return docs
