"""Page routing, text assembly, chunking and languages of scanned documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import meaningful_chars

#: Characters that make a page digital; chunk limits.
DIGITAL_CHARS, CHUNK_PAGES, CHUNK_BYTES, BATCH_PAGES = 40, 15, 40 * 1024 * 1024, 10
#: Media types by route, and magic bytes (hex) with their offset.
IMAGES = ["image/jpeg", "image/png", "image/tiff", "image/webp"]
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
MAGIC = {"application/pdf": ["25504446"], "image/jpeg": ["FFD8FF"], "image/png": ["89504E470D0A1A0A"], "image/tiff": ["49492A00", "4D4D002A"], "image/webp": ["52494646"], DOCX: ["504B0304"]}


def check_signature(files: DataFrame) -> DataFrame:
    """files(path, content, mime) with `problem`: null, unsupported, empty or mismatch. A DOCX is a zip that names its two parts."""
    head = F.hex(F.substring("content", 1, 8))
    ok: Column = F.lit(False)
    for mime, magics in MAGIC.items():
        hit: Column = F.lit(False)
        for m in magics:
            hit = hit | head.startswith(m)
        if mime == "image/webp":
            hit = hit & (F.hex(F.substring("content", 9, 4)) == "57454250")
        if mime == DOCX:  # names in a zip's directory are stored as they are
            text = F.decode("content", "ISO-8859-1")
            hit = hit & text.contains("[Content_Types].xml") & text.contains("word/document.xml")
        ok = ok | ((F.col("mime") == mime) & hit)
    problem = F.when(~F.col("mime").isin(*MAGIC), "unsupported").when(F.coalesce(F.length("content"), F.lit(0)) == 0, "empty").when(~ok, "mismatch")
    return files.withColumn("problem", problem)


def classify_pages(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, text) -> one row a document: route digital, scanned or hybrid, and its pages of either kind."""
    p = pages.withColumn("digital", meaningful_chars(F.col("text")) >= DIGITAL_CHARS)
    kind = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("page"))))
    g = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"), kind(F.col("digital")).alias("digital_pages"), kind(~F.col("digital")).alias("scanned_pages"))
    route = F.when(F.size("scanned_pages") == 0, "digital").when(F.size("digital_pages") == 0, "scanned").otherwise("hybrid")
    return g.withColumn("route", route)


def route_documents(files: DataFrame, classified: DataFrame) -> DataFrame:
    """Route by media type: images are scanned (one page), DOCX digital, PDF by its pages, the rest an error."""
    x = files.join(classified.select("doc_id", F.col("route").alias("_r"), F.col("page_count").alias("_n")), "doc_id", "left")
    route = F.when(F.col("mime").isin(*IMAGES), "scanned").when(F.col("mime") == DOCX, "digital").when(F.col("mime") == "application/pdf", F.coalesce("_r", F.lit("scanned"))).otherwise("error")
    pages = F.when(F.col("mime").isin(*IMAGES), F.lit(1)).otherwise(F.col("_n"))
    return x.withColumn("route", route).withColumn("page_count", pages.cast("long")).drop("_r", "_n")


def merge_pages(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """The text of each page: read by OCR where there is such a page, else the local one."""
    return pages.join(ocr.select("doc_id", "page", F.col("text").alias("_o")), ["doc_id", "page"], "left").withColumn("text", F.coalesce("_o", "text")).drop("_o")


def join_pages(pages: DataFrame) -> DataFrame:
    """Non-blank page texts of a document in order, with an empty line between."""
    keep = pages.where(F.trim("text") != "")
    rows = F.array_sort(F.collect_list(F.struct("page", "text")))
    return keep.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n\n").alias("text"))


def chunk_pages(pages: DataFrame, most: int = CHUNK_PAGES, limit: int = CHUNK_BYTES, rounds: int = 4) -> DataFrame:
    """pages(doc_id, page, bytes) -> chunk ranges: at most `most` pages, halved while their bytes exceed the limit; a single page above it is an error."""
    w = Window.partitionBy("doc_id").orderBy("page")
    x = pages.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / most).cast("string"))
    for _ in range(rounds):
        g = Window.partitionBy("doc_id", "chunk")
        n, size = F.count(F.lit(1)).over(g), F.sum("bytes").over(g)
        half = F.when(F.row_number().over(g.orderBy("page")) <= F.floor((n + 1) / 2), "0").otherwise("1")
        x = x.withColumn("_c", F.when((size > limit) & (n > 1), F.concat("chunk", F.lit("."), half)).otherwise(F.col("chunk"))).drop("chunk").withColumnRenamed("_c", "chunk")
    return x.groupBy("doc_id", "chunk").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.sum("bytes").alias("bytes"), (F.sum("bytes") > limit).alias("too_large")).drop("chunk")


def batch_pages(pages: DataFrame, most: int = BATCH_PAGES) -> DataFrame:
    n = pages.groupBy("doc_id").agg(F.max("page").alias("n"))
    x = n.select("doc_id", "n", F.posexplode(F.sequence(F.lit(1), F.col("n"), F.lit(most))).alias("batch", "first_page"))
    return x.select("doc_id", "batch", "first_page", F.least("n", F.col("first_page") + most - 1).alias("last_page"))


def dominant_language(spans: DataFrame) -> DataFrame:
    """spans(doc_id, pos, lang, confidence) -> the language with the largest sum of confidence (ties: seen first), else und."""
    g = spans.where("lang IS NOT NULL AND lang <> ''").groupBy("doc_id", "lang").agg(F.sum("confidence").alias("c"), F.min("pos").alias("p"))
    best = g.groupBy("doc_id").agg(F.max_by("lang", F.struct(F.col("c"), (-F.col("p")).alias("p"))).alias("language"))
    return spans.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce("language", F.lit("und")).alias("language"))


def chunk_language(chunks: DataFrame) -> DataFrame:
    """chunks(doc_id, chunk, lang) -> the last language that is not und."""
    best = chunks.groupBy("doc_id").agg(F.max_by(F.when(F.col("lang") != "und", F.col("lang")), F.when(F.col("lang") != "und", F.col("chunk"))).alias("language"))
    return best.select("doc_id", F.coalesce("language", F.lit("und")).alias("language"))


def best_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The first of the columns that is not blank."""
    return docs.withColumn("best_text", F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in columns]))


def has_content(df: DataFrame, column: str) -> DataFrame:
    """Whether text is left when tags go and blank entities are read; entities of visible characters are content as they stand."""
    bare = F.regexp_replace(F.regexp_replace(F.col(column), r"<[^>]+>", " "), r"&(nbsp|ensp|emsp|thinsp|#160|#xa0|#xA0|#32|#x20|#9|#10|#13);?|\x{00A0}", " ")
    return df.withColumn("has_content", F.coalesce(F.regexp_replace(bare, r"(?U)\s+", "") != "", F.lit(False)))


def pick_template(docs: DataFrame) -> DataFrame:
    """docs(doc_id, document_type, text) with the template, and whether it was found from the text."""
    form = F.col("text").rlike(r"(?iU)FIRST\s+INFORMATION\s+REPORT|FIR\s+No\.|प्रथम\s+सूचना")
    fir = F.col("document_type") == "fir"
    return docs.withColumn("template", F.when(fir | form, "fir_ncrb").otherwise("generic")).withColumn("detected", ~fir & form)
