"""Scalar functions over columns: plain Spark expressions, evaluated in the JVM. Rounding is half-even (bround)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that results depend on. (?U) makes \s, \d and \w know Unicode, as the texts are bilingual.
CASE_NUMBER = r"\b([A-Z]{2,10}/\d+/\d{4})\b"
COURT = r"(?i)Court\s+No[-.\s]+([A-Z0-9]+)"
SERIAL = r"(?m)^\s{1,5}(\d{1,4})\s"
VERSUS = r"(?i)\s{2,}VS\s{2,}"
CASE_TYPE = r"(?i)^([A-Z][A-Z0-9.\-]{1,15})/"
#: Abbreviations and artefacts of scanned text, replaced in this order.
SCAN_FIXES = [
    (r"(?U)मुरा\s*0\b", "मुरादाबाद"),
    (r"(?U)उ\s*0\s*प्र\s*0\b", "उत्तर प्रदेश"),
    (r"(?U)उ\s*\.\s*प्र\s*\.\B", "उत्तर प्रदेश"),
    (r"(?U)म\s*0\s*हे\s*0\s*का\s*0", "म0हे0का0"),
    (r"(?U)म\s*0\s*का\s*0", "म0का0"),
    (r"(?U)\bNot\s+stated\b", ""),
    (r"(?U)\bNot\s+Stated\b", ""),
    (r"(?U)\(\s*i\s*\)", ""),
    (r"[ \t]{2,}", " "),
]
#: Place names that scans misread, repaired in this order.
PLACE_FIXES = [("मुरा0", "मुरादाबाद"), ("मुरा 0", "मुरादाबाद"), ("मुरा०", "मुरादाबाद"), ("उ0प्र0", "उत्तर प्रदेश")]
#: Phrases that a well-read form shows.
FORM_ANCHORS = [r"FIRST\s+INFORMATION\s+REPORT", r"District/Unit", r"Acts\s*\(अधिनियम\)", r"Complainant", r"Action\s+taken"]


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def norm_case_no(c: Column) -> Column:
    """Trimmed, lower case, without blanks, slashes, hyphens and points; null is empty."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(c)), r"(?U)[\s/\-.]+", ""), F.lit(""))


def clean_space(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def case_type_of(c: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(F.trim(c), CASE_TYPE, 1)), F.lit(""))


def compact(c: Column, fixes: list[tuple[str, str]] = ()) -> Column:
    """One blank for each run, without :;,- and blanks at the ends, then fixes of misread names, in order."""
    out = F.btrim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(" :;,-"))
    for old, new in fixes:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def normalize_lines(c: Column) -> Column:
    """NUL becomes a blank, runs of blanks and tabs one blank, lines are trimmed and empty ones dropped."""
    text = F.replace(c, F.lit("\0"), F.lit(" "))
    lines = F.transform(F.split(text, r"\r\n|[\n\r]"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def normalize_scan(c: Column) -> Column:
    for pattern, new in SCAN_FIXES:
        c = F.regexp_replace(c, pattern, new)
    return c


def meaningful_chars(c: Column) -> Column:
    """Letters and digits in a page's text."""
    return F.coalesce(F.length(F.regexp_replace(c, r"[^\p{L}\p{N}_]+", "")), F.lit(0))


def tokens_estimate(c: Column) -> Column:
    """A quarter of the characters, one at least for a text that is not empty."""
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.length(c) / 4))).cast("long")


def slice_by_page(c: Column, first: Column | int, last: Column | int, lines: int = 60, cap: int = 8000) -> Column:
    """The lines of pages first to last, at 60 lines a page, cut to 8000 characters."""
    first, last = (x if isinstance(x, Column) else F.lit(x) for x in (first, last))
    start = F.greatest(F.lit(0), (first - 1) * lines)
    return F.left(F.array_join(F.slice(F.split(c, "\n"), (start + 1).cast("int"), F.greatest(F.lit(0), last * lines - start).cast("int")), "\n"), F.lit(cap))


def row_text(cells: Column) -> Column:
    """Non-empty cells, trimmed, joined by a bar."""
    return F.array_join(F.filter(F.transform(cells, lambda x: F.trim(x)), lambda x: x != ""), " | ")


def has_script(c: Column, latin: bool) -> Column:
    return c.rlike(r"[A-Za-z]" if latin else r"[ऀ-ॿ]")


def text_quality(c: Column) -> Column:
    """struct(score, language, issues): scripts that are present, and 0.02 for each anchor phrase.

    Each test is made once: the flags are a value that the expressions over it share, as a lambda binds it."""
    flags = F.array(has_script(c, False), has_script(c, True), *[c.rlike(f"(?iU){p}") for p in FORM_ANCHORS])
    return F.transform(F.array(flags), _rated)[0]


def _rated(flags: Column) -> Column:
    hits = F.size(F.filter(F.slice(flags, 3, len(FORM_ANCHORS)), lambda x: x))
    hi, en = flags[0], flags[1]
    base = F.when(hi & en, 0.85).when(hi, 0.55).when(en, 0.50).otherwise(0.30)
    language = F.when(hi & en, "mixed").when(hi, "hindi").when(en, "english").otherwise("unknown")
    issues = F.filter(F.array(F.when(~hi, F.lit("no_devanagari")), F.when(~en, F.lit("no_english_anchors")), F.when(hits < 2, F.lit("few_section_anchors"))), lambda x: x.isNotNull())
    return F.struct(F.bround(F.least(F.lit(1.0), base + hits * 0.02), 2).alias("score"), language.alias("language"), issues.alias("issues"))


def inline_markup(c: Column) -> Column:
    c = F.regexp_replace(c, r"\*\*\*(.+?)\*\*\*", "<strong><em>$1</em></strong>")
    c = F.regexp_replace(c, r"\*\*(.+?)\*\*", "<strong>$1</strong>")
    return F.regexp_replace(c, r"\*([^*\n]+?)\*", "<em>$1</em>")


def escape_html(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c
