"""Texts made of rows: light markup, sections, audit notes, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import escape_html, inline_markup

#: Section order, and sections shown line by line.
ORDER = ["header", "sections_law", "occurrence", "place", "complainant", "accused", "fir_contents", "action_taken", "signatures", "leftovers"]
TABULAR = ["header", "sections_law", "accused"]


def markup_blocks(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, block, kind, html): blocks between empty lines, typed; texts with tags pass through as they are."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    text = F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    tagged = F.col("text").rlike(r"<[a-zA-Z][^>]*>")
    x = docs.select("doc_id", F.posexplode(F.when(tagged, F.array("text")).otherwise(F.split(strip(text), r"\n{2,}"))).alias("block", "b"), tagged.alias("_html"))
    x = x.withColumn("b", F.when(F.col("_html"), F.col("b")).otherwise(strip(F.col("b")))).where("b <> ''")
    lines = F.filter(F.transform(F.split("b", "\n"), strip), lambda s: s != "")
    every = lambda rx: F.forall(lines, lambda s: s.rlike(rx))
    kind = (
        F.when(F.col("_html"), "html")
        .when(F.col("b").rlike(r"^[-*_]{3,}$"), "rule")
        .when(F.col("b").rlike(r"^#{1,6}\s+.*"), "heading")
        .when(every(r"^[-*]\s+"), "bullets")
        .when(every(r"^\d+[.)]\s+"), "numbers")
        .otherwise("paragraph")
    )
    x = x.withColumn("kind", kind).withColumn("_l", lines)
    items = lambda rx: F.array_join(F.transform("_l", lambda s: F.concat(F.lit("<li>"), inline_markup(F.regexp_replace(s, rx, "")), F.lit("</li>"))), "")
    level = F.length(F.regexp_extract("b", r"^(#{1,6})\s+", 1)).cast("string")
    head = inline_markup(F.trim(F.regexp_extract("b", r"^#{1,6}\s+(.*)", 1)))
    html = (
        F.when(F.col("kind") == "html", F.col("b"))
        .when(F.col("kind") == "rule", "<hr/>")
        .when(F.col("kind") == "heading", F.concat(F.lit("<h"), level, F.lit(">"), head, F.lit("</h"), level, F.lit(">")))
        .when(F.col("kind") == "bullets", F.concat(F.lit("<ul>"), items(r"^[-*]\s+"), F.lit("</ul>")))
        .when(F.col("kind") == "numbers", F.concat(F.lit("<ol>"), items(r"^\d+[.)]\s+"), F.lit("</ol>")))
        .otherwise(F.concat(F.lit("<p>"), inline_markup(F.array_join("_l", " ")), F.lit("</p>")))
    )
    return x.select("doc_id", "block", "kind", html.alias("html"))


def render_sections(sections: DataFrame) -> DataFrame:
    """sections(doc_id, key, text) -> (doc_id, html): known sections in order, then others by name; tabular ones a paragraph a line, narrative ones a paragraph a block; blank ones left out."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ORDER)), F.col("key")), F.lit(0)), F.lit(1000))
    parts = F.when(F.col("key").isin(*TABULAR), F.split("text", "\n")).otherwise(F.split("text", r"\n\s*\n"))
    clean = F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"\s*\n\s*", " "))), lambda s: s != "")
    body = F.array_join(F.transform(clean, lambda s: F.concat(F.lit("<p>"), escape_html(s), F.lit("</p>"))), "")
    x = sections.where("trim(text) <> ''").select("doc_id", "key", place.alias("o"), body.alias("h"))
    rows = F.array_sort(F.collect_list(F.struct("o", "key", "h")))
    return x.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["h"]), "").alias("html"))


def audit_notes(df: DataFrame, columns: list[str]) -> DataFrame:
    """k=v pairs joined by bars; null values left out."""
    pairs = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in columns]
    return df.withColumn("note", F.concat_ws(" | ", *pairs))


def lookup_label(df: DataFrame, column: str, labels: dict[str, str], default: str) -> DataFrame:
    out: Column | None = None
    for k, v in labels.items():
        out = F.when(F.col(column) == k, v) if out is None else out.when(F.col(column) == k, v)
    return df.withColumn("label", out.otherwise(default))
