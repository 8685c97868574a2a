"""Benchmark decontamination (op 5), DataFrame functions only: a positional inverted index of the training tokens.

1. The index: the posting lists of every document, split by blocks of positions, are stored in the shared folder. A posting
   is one long: 40 bits of the term's hash, then the position in the block; a block's postings are in that order, so each
   term's list stands together. Blocks overlap by a window, so a window lies whole in the block it starts in, and no row
   grows with its document.
2. The terms are counted over all postings. In each window of an item they are ranked by that count.
3. The lists of a window's rarest terms, adjusted by their offsets, give the starts at which it may stand.
4. In the block of such a start the postings are intersected with the adjusted postings of all the window's terms: if all are
   there it is an exact phrase match, if at least `near` of them are it is a proximity match.
5. Overlapping exact matches in a document are merged as intervals.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. Windows have `size` words; an item of
fewer words, but not none, is one window. Of a window of n words at most n - ceil(near * n) are missing from a proximity
match, so one of so many and one more of its rarest terms is there, and none is missed. A false match takes a collision of
40 bits where all other words are right.

Cases: null text has no words; a null item_id is left out of items but its words count as hits; repeated items count
once; equal documents have equal results, and every row of documents comes back; an empty benchmark contaminates
nothing; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import ascii_lower, join_rows, rows_of, stored, with_keys

#: What is between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Positions in a block.
BLOCK = 256
#: Bits of a posting that hold the position in its block; 40 bits above them hold the term.
PLACE = 23


def words_of(text: Column) -> Column:
    """The words with A-Z lower-cased; lower() does just that for a text of ASCII characters alone. Splitting at what is
    between words takes an eighth of the time of extracting each word."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))
    return F.array_remove(F.split(low, GAP), "")


def term_of(word: Column) -> Column:
    """The term of a word, shifted to its place in a posting."""
    return F.shiftleft(F.xxhash64(word).bitwiseAND((1 << 40) - 1), PLACE)


def windows_of(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, win, len: the distinct windows of items."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("_w")).where(F.size("_w") > 0)
    last = F.greatest(F.lit(1), F.size("_w") - F.lit(size - 1))
    w = w.select("item", "_w", F.explode(F.sequence(F.lit(1), last)).alias("at"))
    return w.select("item", F.slice("_w", F.col("at"), F.lit(size)).alias("win")).distinct().withColumn("len", F.size("win"))


def posting_index(docs: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, doc_key, text_hash, block, n_words, postings: one row for each block of BLOCK positions of each row of docs."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col)).alias("doc_key"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), words_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("w"))
    d = d.select("doc_id", "doc_key", "text_hash", F.size("w").cast("long").alias("n_words"), F.transform("w", term_of).alias("t"))
    blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("t") - 1) / BLOCK).cast("int")))
    d = d.select("doc_id", "doc_key", "text_hash", "n_words", "t", F.explode(blocks).alias("block"))
    part = F.slice("t", F.col("block") * BLOCK + 1, F.lit(BLOCK + size - 1))
    return d.select("doc_id", "doc_key", "text_hash", "block", "n_words", F.sort_array(F.transform(part, lambda t, i: t + i)).alias("postings"))


def _own(index: DataFrame, *columns: str) -> DataFrame:
    """The columns with term and pos of every posting, once: those in the overlap belong to the next block."""
    p = index.select(*columns, F.explode("postings").alias("p"))
    place = F.col("p").bitwiseAND((1 << PLACE) - 1)
    return p.where(place < BLOCK).select(*columns, F.shiftright("p", PLACE).alias("term"), place.cast("int").alias("place"))


def find_contamination(docs: DataFrame, items: DataFrame, size: int = 10, near: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated, items, n_near for every row of docs.

    n_near: the positions at which some window has at least `near` of its words at their offsets, and none stands whole."""
    index = stored(posting_index(docs, size, id_col, text_col), "postings")
    wins = stored(windows_of(items, size).withColumn("win_id", F.xxhash64("win", "len")), "windows")
    shapes = wins.select("win_id", "win", "len").dropDuplicates(["win_id"])
    # Counted before they meet the benchmark's terms: rows shrink in the scan, and nothing here depends on the benchmark's size.
    counts = _own(index).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    spots = shapes.select("win_id", "len", F.posexplode("win").alias("off", "word")).withColumn("term", F.shiftright(term_of(F.col("word")), PLACE))
    spots = spots.join(counts, "term")  # a term that no document has can't lead
    rank = F.row_number().over(Window.partitionBy("win_id").orderBy("n", "off"))
    missing = F.col("len") - F.ceil(F.lit(near) * F.col("len"))
    leads = stored(spots.withColumn("rank", rank).where(F.col("rank") <= missing + 1).select("win_id", "term", "off"), "leads")

    # Offset-adjusted lists of the rarest terms: the starts at which a window may stand, each in its block.
    starts = _own(index, "doc_key", "text_hash", "block").join(leads, "term").withColumn("start", F.col("block") * BLOCK + F.col("place") - F.col("off")).where("start >= 0")
    keys = ["doc_key", "text_hash", "block"]
    starts = starts.select("doc_key", "text_hash", F.floor(F.col("start") / BLOCK).cast("int").alias("block"), "win_id", (F.col("start") % BLOCK).cast("int").alias("at"))
    starts = starts.repartition(*keys).distinct()
    listed = shapes.select("win_id", "len", F.transform("win", lambda w, i: term_of(w) + i).alias("want"))
    x = starts.join(listed, "win_id").join(index.select(*keys, "postings").dropDuplicates(keys), keys)
    found = F.size(F.array_intersect("postings", F.transform("want", lambda p: p + F.col("at"))))
    x = x.withColumn("found", found).where(F.col("found") >= F.ceil(F.lit(near) * F.col("len")))
    hits = stored(x.select("doc_key", "text_hash", "win_id", (F.col("block") * BLOCK + F.col("at")).alias("start"), "len", (F.col("found") == F.col("len")).alias("exact")), "hits")

    key = ["doc_key", "text_hash"]
    at = hits.groupBy(*key, "start").agg(F.max(F.when(F.col("exact"), F.col("len"))).alias("len"))
    seq = Window.partitionBy(*key).orderBy("start")
    done = F.coalesce(F.max(F.col("start") + F.col("len")).over(seq.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = at.withColumn("new", F.when(F.col("len").isNotNull(), F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest("start", done))))
    covered = covered.groupBy(*key).agg(F.sum("new").alias("n_hit"), F.count_if(F.col("len").isNull()).alias("n_near"))
    of_win = wins.select("win_id", "item").distinct()
    named = hits.where("exact").select(*key, "win_id").distinct().join(of_win, "win_id").groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = covered.join(named, key, "left")
    out = index.where("block = 0").select("doc_id", *key, "n_words").join(found, key, "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), names.alias("items"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no window of an item."""
    bad = find_contamination(docs, items, id_col=id_col, text_col=text_col, **options).where("contaminated").select("doc_id", "text_hash").distinct()
    d = with_keys(docs, doc_id=F.col(id_col), text_hash=F.xxhash64(F.col(text_col).cast("string")))
    return rows_of(join_rows(d, bad, ["doc_id", "text_hash"], "left_anti"))
