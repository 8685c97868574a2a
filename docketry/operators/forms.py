"""Fields and rows of a bilingual, numbered form, as tables: one job over all forms, native patterns only."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import PLACE_FIXES, compact, escape_html
from docketry.operators.tables import layout_key, typed_tables

#: Patterns of the form.
DATE, TIME = r"\d{1,2}/\d{1,2}/\d{4}", r"\d{1,2}\s*:\s*\d{2}"
ITEM = r"(?mU)(?:^|\n)\s*(\d{1,2})\s*[.)]\s*"
#: Anchor phrases of sections, in order.
ANCHORS = [
    ("header", r"FIRST\s+INFORMATION\s+REPORT"),
    ("section_1", r"1\.\s+District/Unit"),
    ("section_2", r"Acts\s*\(अधिनियम\)"),
    ("section_3", r"3\.\s*\(a\)\s*Occurrence"),
    ("section_4", r"4\.\s*Type of Information"),
    ("section_5", r"5\.\s*Place of Occurrence"),
    ("section_6", r"6\.\s*Complainant\s*/\s*Informant"),
    ("section_7", r"7\.\s*Details of known"),
    ("section_8", r"8\.\s*Reasons for delay"),
    ("section_9", r"9\.\s*Particulars of properties"),
    ("section_10", r"10\.\s*Total value of property"),
    ("section_11", r"11\.\s*Inquest Report"),
    ("section_12", r"12\.\s*First Information contents"),
    ("section_13", r"13\.\s*Action taken"),
    ("section_14", r"14\.\s*Signature"),
    ("section_15", r"15\.\s*Date and time of dispatch"),
    ("attachment", r"Attachment to item\s+7"),
    ("physical", r"Physical features.*?suspect/accused"),
]
#: Where a section's text begins and ends.
BETWEEN = {
    "acts": (r"\b2\.\s*S\.?\s*No\.?", r"\b3\.\s*\(?\s*a\s*\)?\s*Occurrence"),
    "occurrence": (r"\b3\.\s*\(?\s*a\s*\)?\s*Occurrence", r"\b4\.\s*Type\s+of\s+Information"),
    "info": (r"\b4\.\s*Type\s+of\s+Information", r"\b5\.\s*Place\s+of\s+Occurrence"),
    "place": (r"\b5\.\s*Place\s+of\s+Occurrence", r"Complainant\s*/\s*Informant"),
    "complainant": (r"Complainant\s*/\s*Informant", r"\b7\.\s*Details\s+of\s+known"),
    "accused": (r"\b7\.\s*Details\s+of\s+known", r"\b8\.\s*Reasons\s+for\s+delay"),
    "action": (r"\b13\.\s*Action\s+taken", r"\b15\.\s*Date\s+and\s+time"),
}
#: Labelled fields, by the text they are sought in.
FIELDS: dict[str, dict[str, str]] = {
    "text": {
        "police_station": r"P\.?\s*S\.?\s*\([^)]*(?:थाना)?[^)]*\)\s*:\s*(.*?)\s+Year",
        "year": r"Year\s*\([^)]*\)\s*:\s*(\d{4})",
        "fir_no": r"FIR\s+No\.[^:]*:\s*([A-Za-z0-9/-]+)",
        "fir_datetime": rf"Date\s+and\s+Time\s+of\s+FIR.*?:\s*({DATE}\s+{TIME}\s*(?:घंटे|बजे)?)",
    },
    "occurrence": {
        "day": r"Day\s*\([^)]*\)\s*:\s*([^\n:]+?)(?:\s+Date|\n|$)",
        "date_from": rf"Date\s+from\s*\([^)]*\)\s*:\s*({DATE})",
        "date_to": rf"Date\s+To\s*\([^)]*\)\s*:\s*({DATE})",
        "time_from": rf"Time\s+From.*?:\s*({TIME}\s*(?:बजे)?)",
        "time_to": rf"Time\s+To.*?:\s*({TIME}\s*(?:बजे)?)",
        "info_date": rf"Information\s+received.*?Date.*?:\s*({DATE})",
        "gd_entry": r"Entry\s+No\..*?:\s*([0-9]+)",
        "time_period": r"Time\s+Period.*?:\s*([^:\n]+?)(?:\s+Time\s+From|\n|$)",
    },
    "place": {
        "direction_distance": r"Direction\s+and\s+distance\s+from\s+P\.S\..*?:\s*(.*?)(?:Beat\s+No|\(\s*b\s*\)|Address|$)",
        "beat_no": r"Beat\s+No\..*?:\s*([^\n(]+)",
        "address": r"\(\s*b\s*\)\s*Address\s*\([^)]*\)\s*:\s*(.*?)(?:\s+\(\s*c\s*\)|\n\s*\(\s*c\s*\)|\s+6\s*[.)]|$)",
        "outside_ps": r"Name\s+of\s+P\.S\..*?:\s*(.*?)(?:District|$)",
    },
    "complainant": {
        "name": r"Name\s*\([^)]*\)\s*:\s*(.*?)(?:\s+\(\s*b\s*\)|Father)",
        "father": r"Father'?s\s+Name.*?:\s*(.*?)(?:\s+\(\s*c\s*\)|Date)",
        "dob_year": r"Date\s*/\s*Year\s+of\s+Birth.*?:\s*([0-9]{4}|[0-9/-]+)",
        "nationality": r"Nationality.*?:\s*(.*?)(?:Date\s+of\s+Issue|\s+\(\s*[ei]\s*\)|UID|Occupation|Address|$)",
        "occupation": r"Occupation.*?:\s*(.*?)(?:\s+\(\s*i\s*\)|Address|$)",
        "mobile": r"Mobile.*?:\s*([0-9Xx+\-\s]+)",
        "address_1": r"1\s+वर्तमान\s+पता\s+(.*?)(?:\s+2\s+स्थायी|\n\s*2\s+स्थायी|$)",
        "address_2": r"2\s+स्थायी\s+पता\s+(.*?)(?:\s+\(\s*j\s*\)|Phone|$)",
    },
    "action": {
        "io_name": r"(?:Directed.*?Name\s+of\s+I\.O\..*?:|नाम\)\s*:)\s*(.*?)(?:\s+Rank|\n\s*Rank)",
        "io_rank": r"Rank\s*\([^)]*\)\s*:\s*(.*?)(?:\s+No\.|\n\s*No\.|$)",
        "transferred_to": r"Transferred\s+to\s+P\.S\..*?:\s*(.*?)(?:District|on\s+point|$)",
        "io_no": r"No\.\s*\([^)]*\)\s*:\s*([A-Za-z0-9/-]+)",
    },
    "officer": {
        "officer_name": r"Name\s*\([^)]*\)\s*:\s*(.*?)\s+Rank\s*\(",
        "officer_rank": r"Name\s*\([^)]*\)\s*:.*?Rank\s*\([^)]*\)\s*:\s*(.*?)\s+No\.\s*\(",
        "officer_no": r"Name\s*\([^)]*\)\s*:.*?No\.\s*\([^)]*\)\s*:\s*([0-9]+)",
    },
}
#: Where the district is sought, in turn; the last in item 1 only.
DISTRICT = [r"District\s*/?\s*Unit.*?:\s*(.*?)\s+FIR\s+No", r"District\s*/?\s*Unit.*?:\s*(.*?)\s+P\.?\s*S\.?\s*\(", r"Year\s*\([^)]*\)\s*:\s*\d{4}\s+(.+?)\s+FIR\s+No"]
DISTRICT_IN_ITEM = r"Year.*?:\s*\d{4}\s+(.+?)\s+FIR\s+No"
#: The item that stands in for a phrase that is not found.
ITEM_OF = {"acts": 2, "occurrence": 3, "info": 4, "place": 5, "complainant": 6, "accused": 7, "action": 13}
#: Rows and what is in them.
DEFAULT_ACT = "भारतीय न्याय संहिता (बी एन एस), 2023"
SECTION_NO, BRACKETED_NO, NOT_A_SECTION = r"(?<!\d)(\d{2,3}(?:\s*\(\s*\d+\s*\))?)(?!\d)", r"(?<!\d)(\d{2,3}\s*\(\s*\d+\s*\))(?!\d)", "2023"
ACT_ROW = r"(?sU)(?:^|\n)\s*(\d{1,2})\s+(.*?)(?=(?:\n\s*\d{1,2}\s+भारतीय)|\n\s*3\s*[.)]|\z)"
ACCUSED_ROW = r"(?sU)(?:^|\n)\s*(\d{1,2})\s+([ऀ-ॿ].*?)(?=\n\s*\d{1,2}\s+[ऀ-ॿ]|\n\s*Accused\s+More|\z)"
RELATION, VILLAGE = r"(?U)पि[तप]ा\s+का\s+नाम\s*:?", r"(?U)(?:1\.\s*)?ग्राम[-\s]"
HEADER_WORDS, LAYOUT_HEADER_WORDS = ["S. No", "Name", "Alias", "Address Type"], ["s. no", "name", "alias", "present address"]
CROWD, SON_OF = r"(?sU)मौजूद\s+(.{0,500}?)\s+ने\s+", r"([ऀ-ॿ]{2,}(?:\s+सिंह)?)\s+पुत्र\s+([ऀ-ॿ]{2,}(?:\s+सिंह)?)"
PROPERTY_ROW = r"(?m)^\s*(\d{1,2})\s+([^\n]+?)\s{2,}([^\n]+?)\s{2,}([^\n]+?)(?:\s{2,}([0-9,.]+))?$"
INQUEST_ROW = r"(?:^|\s)(\d{1,2})\s+([A-Za-z0-9/-]+)"
FEATURE_ROW = r"(?m)^\s*(\d{1,2})\s+(पुरुष|महिला|Male|Female)"
ADDRESS_FROM, ADDRESS_TO, ADDRESS_STOP = "ग्राम", "भारत", r"^(का प्रकार|वर्तमान पता|स्थायी पता|Phone|Mobile|\(\s*j\s*\))"
LABELS = ["", "not stated", "s. no.", "uidb number", "property category", "property type", "description", "value"]
DIGITS = ("०१२३४५६७८९", "0123456789")
#: Required fields by group, and sections that are looked for.
REQUIRED = {"basic.fir_no": "fir_no", "basic.police_station": "police_station", "basic.year": "year", "basic.fir_datetime": "fir_datetime", "occurrence.info_date": "info_date", "occurrence.info_time": "info_time", "complainant.name": "name", "fir_contents": "fir_contents", "acts": None, "accused": None}
NOT_A_FORM = ["basic.fir_no", "basic.police_station", "basic.year", "basic.fir_datetime", "acts", "accused"]
CRITICAL, IMPORTANT = ["sections_law", "complainant", "accused", "fir_contents", "action_taken"], ["occurrence", "place", "signatures"]
EXPECTED = ["header", "sections_law", "occurrence", "place", "complainant", "accused", "fir_contents", "action_taken"]
#: The fields of each group, in order.
GROUPS = {
    "basic": ["district", "police_station", "year", "fir_no", "fir_datetime"],
    "occurrence": ["day", "date_from", "date_to", "time_period", "time_from", "time_to", "info_date", "info_time", "gd_entry"],
    "place": ["direction_distance", "beat_no", "address", "outside_ps"],
    "complainant": ["name", "father", "dob_year", "nationality", "occupation", "mobile", "present_address", "permanent_address"],
    "action": ["registered", "io_name", "io_rank", "io_no", "transferred_to", "officer_name", "officer_rank", "officer_no"],
}
ACTS, ACCUSED = "array<struct<serial:string,act:string,section:string>>", "array<struct<serial:string,name:string,father:string,address:string,alias:string>>"
PROPERTIES, INQUEST = "array<struct<serial:string,category:string,type:string,description:string,value:string>>", "array<struct<serial:string,uidb_number:string>>"
#: Kinds of layout tables, the rows that they give, and the column of each cell.
LAYOUTS = {
    "acts": ("acts_sections", ACTS, {"serial": "serial", "act": "acts", "section": "sections"}),
    "accused": ("accused", ACCUSED, {"serial": "serial", "name": "name", "father": "relative", "address": "present_address", "alias": "alias"}),
    "properties": ("property", PROPERTIES, {"serial": "serial", "category": "property_category", "type": "property_type", "description": "description", "value": "value"}),
    "inquest": ("inquest", INQUEST, {"serial": "serial", "uidb_number": "uidb_number"}),
}


def clean(c: Column) -> Column:
    """Compacted, with misread place names repaired."""
    return compact(c, PLACE_FIXES)


#: What (?U)\s stands for.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def filled(c: Column) -> Column:
    """The value, null if it is empty."""
    return F.nullif(c, F.lit(""))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first hit, cleaned; empty where there is none."""
    return clean(F.coalesce(F.regexp_extract(text, f"(?isU){pattern}", group), F.lit("")))


def is_form(text: Column) -> Column:
    return text.rlike(r"(?iU)FIRST\s+INFORMATION\s+REPORT|FIR\s+No\.|प्रथम\s+सूचना")


#: A mark before a hit and one after it. No text has them, as what stands for their first character in a text is put for it before.
MARK, TILL, ITSELF = "\x01\x03", "\x01\x04", "\x01\x02"


def marked(text: Column, pattern: str, to: str) -> Column:
    """The text with its hits replaced: a cut at MARK then finds them without a second search."""
    return F.regexp_replace(F.replace(text, F.lit(MARK[0]), F.lit(ITSELF)), pattern, to)


def unmarked(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(TILL), F.lit("")), F.lit(ITSELF), F.lit(MARK[0]))


def after_hit(c: Column) -> Column:
    """What follows the first hit, without marks."""
    return unmarked(F.substr(c, F.instr(c, F.lit(TILL)) + 2))


def _phrases() -> tuple[str, dict[str, str]]:
    """One pattern for all phrases of BETWEEN, none of which begins inside another, and the two characters that tell each one."""
    found = dict.fromkeys(p for pair in BETWEEN.values() for p in pair)
    bare = {p: p.removeprefix(r"\b") for p in found}
    behind = lambda p: rf"(?<={p[: len(p) - len(bare[p]) + 1]}){bare[p][1:]}"
    one, two, named = ([p for p in found if bool(bare[p][1] == "\\") is a and bare[p][0].isdigit() is b] for a, b in ((True, True), (False, True), (False, False)))
    groups = [(r"(?=\.)", one), (r"(?=\d)", two), ("(?=[Oo])", named)]
    pattern = f"[{''.join(sorted({c for p in found for c in (bare[p][0].lower(), bare[p][0].upper())}))}](?:{'|'.join(f'{look}(?iU:' + '|'.join(map(behind, g)) + ')' for look, g in groups)})"
    return pattern, {p: bare[p].replace("\\", "")[:2].upper() for p in found}


PHRASES, PHRASE_CODES = _phrases()


def groups_of(text: Column, pattern: str, *names: str) -> Column:
    """Array of struct(names): the groups of each hit."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(n) for i, n in enumerate(names, 1)])


def _items(forms: DataFrame, parts: bool = False) -> DataFrame:
    """doc_id, text, items: array of the texts of items 1 to 15, each item's first occurrence, up to the next head with a larger number
    up to 15; null where there is none. With parts also parts: array of what is between the two phrases of each part of BETWEEN, to
    the end of the text if the second is missing, empty without the first.

    All heads are found in one search, and all phrases in another, and stand in a string, a character each: first places and ends are
    looked up there by plain string functions. Layers hold what is named often, so that it is worked out once."""
    no = lambda t: F.translate(F.btrim(F.substring_index(t, TILL, 1), F.lit(f".){BLANKS}")), *DIGITS).try_cast("int")
    head = lambda t: F.transform(F.array(no(t)), lambda n: F.when(n.between(1, 15), F.char(n + 64)).otherwise("0"))[0]
    phrase = lambda t: F.transform(F.array(F.upper(F.left(t, F.lit(2)))), lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for k, code in enumerate(sorted(PHRASE_CODES.values())) for v in (code, chr(65 + k))]), c), F.lit("0")))[0]
    letter = {p: chr(65 + sorted(PHRASE_CODES.values()).index(c)) for p, c in PHRASE_CODES.items()}
    more = lambda *c: c if parts else ()
    cut = lambda c: F.split(c, MARK, -1)
    codes = lambda c, f: F.array_join(F.transform(c, lambda t, i: F.when(i == 0, "0").otherwise(f(t))), "")
    x = forms.select("doc_id", "text", cut(marked(F.col("text"), ITEM, f"{MARK}$0{TILL}")).alias("_h"), *more(cut(marked(F.concat(F.lit("\n"), "text"), PHRASES, f"{MARK}$0{TILL}")).alias("_p")))
    x = x.select("*", codes("_h", head).alias("_hc"), *more(codes("_p", phrase).alias("_pc")))
    at = [F.instr("_hc", chr(64 + n)).alias(f"_h{n}") for n in range(1, 16)]
    x = x.select("*", *at, *more(*[F.instr("_pc", letter[a]).alias(f"_p{i}") for i, (a, _) in enumerate(BETWEEN.values())]))
    rest = lambda codes, i: F.substr(codes, F.col(i) + 1)
    # An item goes on over the heads that are no larger; a part up to its second phrase.
    runs = [F.length(rest("_hc", f"_h{n}")) - F.length(F.ltrim(rest("_hc", f"_h{n}"), F.lit("0" + "".join(chr(64 + k) for k in range(1, n + 1))))) for n in range(1, 16)]
    ends = [F.when(F.instr(rest("_pc", f"_p{i}"), letter[b]) > 0, F.instr(rest("_pc", f"_p{i}"), letter[b]) - 1).otherwise(F.length(rest("_pc", f"_p{i}"))) for i, (_, b) in enumerate(BETWEEN.values())]
    x = x.select("*", *[c.cast("int").alias(f"_hn{n}") for n, c in enumerate(runs, 1)], *more(*[c.cast("int").alias(f"_pn{i}") for i, c in enumerate(ends)]))

    def joined(pieces: str, i: str, n: str) -> Column:
        one = F.get(pieces, F.col(i) - 1)
        return after_hit(F.when(F.col(n) == 0, one).otherwise(F.array_join(F.slice(pieces, F.col(i), F.col(n) + 1), "")))

    items = F.array(*[F.when(F.col(f"_h{n}") > 0, strip(joined("_h", f"_h{n}", f"_hn{n}"))) for n in range(1, 16)])
    found = F.array(*[F.when(F.col(f"_p{i}") > 0, F.trim(joined("_p", f"_p{i}", f"_pn{i}"))).otherwise("") for i in range(len(BETWEEN))])
    return x.select("doc_id", "text", items.alias("items"), *more(found.alias("parts")))


def with_items(forms: DataFrame) -> DataFrame:
    """doc_id, text, items: map(no -> text) of the numbered items."""
    items = F.filter(F.transform("items", lambda t, i: F.struct((i + 1).alias("no"), t.alias("text"))), lambda i: i["text"].isNotNull())
    return _items(forms).select("doc_id", "text", F.map_from_entries(items).alias("items"))


def form_sections(forms: DataFrame) -> DataFrame:
    """(doc_id, no, text): the numbered items."""
    return _items(forms).select("doc_id", F.posexplode_outer("items").alias("no", "text")).where("text IS NOT NULL").withColumn("no", F.col("no") + 1)


#: What an anchor begins with, as _anchor_code gives it; the phrase that must come somewhere after "Physical features".
ANCHOR_CODES = {"header": "F", "section_2": "AC", "attachment": "AT", "physical": "P"}
PHYSICAL_HEAD, PHYSICAL_TAIL = ANCHORS[-1][1].split(".*?")


def _anchor_starts() -> str:
    """The first character of an anchor, as all are found in one search. None begins inside another, but for item 7 in the
    attachment's, so the rest is looked at only. A plain class is tried at each character, phrases where two characters fit."""
    heads = [PHYSICAL_HEAD if k == "physical" else p for k, p in ANCHORS]
    rest = lambda c: "|".join(p[1:] for p in heads if p[0] == c)
    items = "|".join(rf"(?<={p[0]}){p[1:]}" for p in heads if p[0] in "3456789")
    named = rf"(?=[CTct])(?<=[Aa])(?iU:(?={rest('A')}))|(?=[IiİıHh])(?:(?<=[Ff])(?iU:(?={rest('F')}))|(?<=[Pp])(?iU:(?={rest('P')})))"
    return rf"[1-9AFPafp](?:(?<=1)(?iU:(?={rest('1')}))|(?=\.)(?iU:(?={items}))|{named})"


ANCHOR_STARTS = _anchor_starts()


def _anchor_code(piece: Column) -> Column:
    """One or two characters that tell which anchor a piece begins with."""
    one = F.upper(F.left(piece, F.lit(1)))
    return F.when(one.isin("F", "P"), one).otherwise(F.upper(F.left(piece, F.lit(2))))


def anchor_map(text: Column) -> Column:
    """map(key -> text): from each anchor phrase to the next one found in the text.

    The text is cut wherever an anchor begins; of each anchor the first place counts, and what later places cut is joined again."""
    pieces = F.split(marked(F.concat(F.lit("\n"), text), ANCHOR_STARTS, f"{MARK}$0"), MARK, -1)

    def spots(p: Column) -> Column:
        codes = F.transform(p, _anchor_code)
        at = lambda c: F.array(*[F.struct(F.array_position(c, ANCHOR_CODES.get(k, f"{k.removeprefix('section_')}."[:2])).cast("int").alias("at"), F.lit(k).alias("key")) for k, _ in ANCHORS])
        there = lambda s: (s["at"] > 0) & ((s["key"] != "physical") | F.exists(F.slice(p, s["at"], F.size(p)), lambda x: x.rlike(f"(?iU){PHYSICAL_TAIL}")))
        return F.transform(F.array(codes), lambda c: F.sort_array(F.filter(at(c), there)))[0]

    def cut(p: Column, s: Column) -> Column:
        """The texts of the spots, in order."""
        end = lambda i: F.coalesce(F.get(s, i + 1)["at"], F.size(p) + 1)
        whole = lambda x, i: unmarked(F.array_join(F.slice(p, x["at"], end(i) - x["at"]), ""))
        return F.map_from_entries(F.transform(s, lambda x, i: F.struct(x["key"], strip(whole(x, i)).alias("text"))))

    # Pieces and spots are found once each.
    return F.transform(F.array(pieces), lambda p: F.transform(F.array(spots(p)), lambda s: cut(p, s))[0])[0]


def anchor_sections(forms: DataFrame) -> DataFrame:
    """(doc_id, key, text) of each anchor found. Texts are not filtered before: that would be done below a shuffle of what they are
    made from, and make them twice."""
    return forms.select("doc_id", F.explode_outer(anchor_map(F.col("text"))).alias("key", "text")).where("key IS NOT NULL")


def free_value(item: Column) -> Column:
    """An item's text after its label, cleaned; a label alone is empty."""
    v = clean(F.regexp_replace(F.coalesce(item, F.lit("")), r"(?s)^[^:]{0,180}:\s*", ""))
    return F.when(F.lower(v).isin(*LABELS), "").otherwise(v)


def paragraphs(item: Column) -> Column:
    """Item 12 without its label, lines joined inside paragraphs, an empty line between them."""
    body = F.regexp_replace(F.coalesce(item, F.lit("")), r"(?is)^First\s+Information\s+contents?.*?:", "")
    parts = F.transform(F.split(body, r"\n[ \t]*\n\s*"), lambda p: F.array_join(F.filter(F.transform(F.split(p, "\n"), lambda x: F.trim(x)), lambda x: x != ""), " "))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def section_number(row: Column) -> Column:
    """The first number of a row that can be a section's, null if there is none."""
    numbers = F.transform(F.regexp_extract_all(row, F.lit(SECTION_NO), F.lit(1)), lambda v: F.regexp_replace(v, r"\s+", ""))
    return F.get(F.filter(numbers, lambda v: v != NOT_A_SECTION), 0)


def acts_of(section: Column) -> Column:
    """Candidates by rank: numbered rows with a section in each (one in brackets counts first); else all distinct sections."""
    body = F.regexp_replace(section, r"(?is)^.*?Sections\s*\(", "")
    bracketed = lambda row: filled(F.regexp_replace(F.regexp_extract(row, BRACKETED_NO, 1), r"\s+", ""))
    rows = F.transform(groups_of(body, ACT_ROW, "serial", "row"), lambda r: F.struct(r["serial"].alias("serial"), F.lit(DEFAULT_ACT).alias("act"), F.coalesce(bracketed(clean(r["row"])), section_number(clean(r["row"]))).alias("section")))
    rows = F.filter(rows, lambda r: r["section"].isNotNull())
    numbers = F.transform(F.regexp_extract_all(body, F.lit(SECTION_NO), F.lit(1)), lambda v: F.regexp_replace(v, r"\s+", ""))
    loose = F.transform(F.array_distinct(F.filter(numbers, lambda v: v != NOT_A_SECTION)), lambda v, i: F.struct((i + 1).cast("string").alias("serial"), F.lit(DEFAULT_ACT).alias("act"), v.alias("section")))
    return F.transform(F.array(rows), lambda r: F.when(F.size(r) > 0, r).otherwise(loose))[0]


def _numbered(rows: Column) -> Column:
    """Accused with their running number."""
    return F.transform(rows, lambda r, i: F.struct((i + 1).cast("string").alias("serial"), r["name"].alias("name"), r["father"].alias("father"), r["address"].alias("address"), F.lit("").alias("alias")))


def accused_of(section: Column, story: Column, place: Column) -> Column:
    """Candidates by rank: numbered rows that name a relation, cut at it and at the address; else pairs "X son-of Y" of the narrative."""
    bodies = F.transform(groups_of(section, ACCUSED_ROW, "serial", "row"), lambda r: clean(r["row"]))
    bodies = F.filter(bodies, lambda b: b.rlike(RELATION) & ~F.exists(F.array(*map(F.lit, HEADER_WORDS)), lambda w: b.contains(w)))

    def row(b: Column) -> Column:
        parts = F.split(b, RELATION, 2)
        rest = clean(F.get(parts, 1))
        father = F.get(F.split(rest, VILLAGE, 2), 0)
        address = clean(F.substring(rest, F.length(father) + 1, F.length(rest)))
        return F.struct(clean(F.get(parts, 0)).alias("name"), clean(father).alias("father"), F.coalesce(filled(address), place).alias("address"))

    rows = F.filter(F.transform(bodies, row), lambda r: r["name"] != "")
    crowd = F.coalesce(filled(F.regexp_extract(story, CROWD, 1)), story)
    pairs = F.array_distinct(F.transform(groups_of(crowd, SON_OF, "a", "b"), lambda p: F.struct(clean(p["a"]).alias("name"), clean(p["b"]).alias("father"), place.alias("address"))))
    pairs = F.filter(pairs, lambda r: r["name"] != "")
    return _numbered(F.transform(F.array(rows), lambda r: F.when(F.size(r) > 0, r).otherwise(pairs))[0])


def addresses_of(text: Column) -> Column:
    """Distinct addresses stitched from lines: from one that names a village, over the next ones, to one that names the country."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    state = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, line: Column) -> Column:
        goes_on = (acc["open"] != "") & ~line.rlike(ADDRESS_STOP)
        now = F.when(goes_on, F.concat(acc["open"], F.lit(" "), line)).when(line.contains(ADDRESS_FROM), line).otherwise("")
        ends = now.contains(ADDRESS_TO)
        return F.struct(F.when(ends, "").otherwise(now).alias("open"), F.when(ends, F.array_distinct(F.array_append(acc["done"], clean(now)))).otherwise(acc["done"]).alias("done"))

    return F.aggregate(lines, state, step, lambda acc: acc["done"])


def parsed(forms: DataFrame) -> DataFrame:
    """One row a form, forms only, in one pass over the texts: all fields, and the arrays acts, accused, properties and inquest.

    Each part is sought between its phrases, or else in its numbered item."""
    # A filter would be done below a shuffle of what texts are made from, and make them twice; it is not pushed below an explode.
    x = forms.select("doc_id", F.explode_outer(F.when(is_form(F.col("text")), F.array("text"))).alias("text")).where("text IS NOT NULL")
    x = _items(x, parts=True)
    item = lambda n: F.get("items", F.lit(n - 1))
    first = lambda *c: F.coalesce(F.get(F.filter(F.array(*c), lambda v: v != ""), 0), F.lit(""))
    part = {k: first(F.col("parts")[i], item(ITEM_OF[k])).alias(f"_{k}") for i, k in enumerate(BETWEEN)}
    part["officer"] = part["action"].alias("_officer")
    part["action"] = F.get(F.split(part["action"], r"(?i)\b14\.\s*Signature", 2), 0).alias("_action")
    x = x.select("doc_id", "text", F.coalesce(item(1), "text").alias("_item1"), *part.values(), paragraphs(item(12)).alias("fir_contents"), free_value(item(8)).alias("delay_reasons"), F.coalesce(item(9), F.lit("")).alias("_properties"), free_value(item(10)).alias("total_value"), free_value(item(11)).alias("_inquest"), F.coalesce(item(15), F.lit("")).alias("_dispatch"))
    # Hits are found once, in a layer of their own; what is made of them names them often.
    hits = {name: first_match(F.col("text" if source == "text" else f"_{source}"), pattern) for source, fields in FIELDS.items() for name, pattern in fields.items()}
    hits |= {f"_district_{i}": first_match(F.col("text"), p) for i, p in enumerate(DISTRICT)}
    hits["_info_type"] = clean(F.regexp_extract("_info", r"(?U)^[^\n:]*:\s*([^\n]+)", 1))
    hits["_dates"] = F.regexp_extract_all("_occurrence", F.lit(f"({DATE})"), F.lit(1))
    hits["_times"] = F.regexp_extract_all("_occurrence", F.lit(rf"(?U)({TIME}\s*(?:बजे)?)"), F.lit(1))
    hits["_named"] = F.regexp_extract_all("_occurrence", F.lit(rf"(?iU)Time\s*\([^)]*समय[^)]*\)\s*:\s*({TIME}\s*(?:बजे)?)"), F.lit(1))
    hits["dispatch"] = first_match(F.col("_dispatch"), rf"({DATE}(?:\s+{TIME}\s*(?:\S+)?)?)")
    hits["_stitched"] = addresses_of(F.col("_complainant"))
    x = x.select("*", *[c.alias(n) for n, c in hits.items()])
    out = {name: F.col(name) for fields in FIELDS.values() for name in fields if name not in ("address_1", "address_2")}
    out["info_type"] = F.regexp_replace("_info_type", r"(?i)\s*Date\s+and\s+Time.*$", "")
    usable = lambda c: F.when((c != "") & ~c.rlike(r"FIR No|S\.No|P\.S\.|Year"), c)
    out["district"] = F.coalesce(*[usable(F.col(f"_district_{i}")) for i in range(len(DISTRICT))], filled(first_match(F.col("_item1"), DISTRICT_IN_ITEM)), F.lit(""))
    nth = lambda name, hits, n: F.when(out[name] != "", out[name]).otherwise(F.coalesce(clean(F.get(hits, n)), F.lit("")))
    out |= {"date_from": nth("date_from", "_dates", 0), "date_to": nth("date_to", "_dates", 1), "time_from": nth("time_from", "_times", 0), "time_to": nth("time_to", "_times", 1)}
    out["info_time"] = F.coalesce(clean(F.try_element_at("_named", F.lit(-1))), F.when(F.size("_times") > 2, clean(F.try_element_at("_times", F.lit(-1)))), F.lit(""))
    period = out["time_period"]
    out["time_period"] = F.when(period.contains("Time To") | period.contains("समय"), first_match(F.col("_occurrence"), r"अवधि\)\s*:\s*([^:\n]+?)(?:\s+Time|\n|$)")).otherwise(period)
    out["occupation"] = F.when(out["occupation"].isin("(i)", "i"), "").otherwise(out["occupation"])
    out["father"] = F.regexp_replace(out["father"], r"(?i)\s+\(\s*d\s*\)\s*Nationality.*$", "")
    out["nationality"] = F.when(out["nationality"].contains(ADDRESS_TO), ADDRESS_TO).otherwise(out["nationality"])
    x = x.withColumn("_way", F.regexp_replace("direction_distance", r"\s+सं\.\)?$", ""))
    out["direction_distance"] = way = F.col("_way")
    beat = out["beat_no"]
    out["beat_no"] = F.when(beat.contains("Address") | beat.contains(ADDRESS_FROM) | way.startswith(beat), "").otherwise(beat)
    out["registered"] = F.when(F.col("_action").rlike(r"(?iU)Registered\s+the\s+case"), "Yes").otherwise("")
    out["io_no"] = F.when(F.lower(out["io_no"]).isin("name", "rank", "no", "to"), "").otherwise(out["io_no"])
    out["officer_name"] = F.regexp_replace(out["officer_name"], r"(?is)\s+14\.\s*Signature.*$", "")
    out["dispatch"] = F.col("dispatch")
    names = [*out, "fir_contents", "delay_reasons", "total_value"]
    address = lambda i: F.coalesce(F.get("_stitched", i), F.col(f"address_{i + 1}"))
    properties = F.filter(F.transform(groups_of(F.regexp_replace("_properties", r"(?s)^[^:]{0,180}:\s*", ""), PROPERTY_ROW, "serial", "category", "type", "description", "value"), lambda r: F.struct(r["serial"].alias("serial"), *[clean(F.coalesce(r[n], F.lit(""))).alias(n) for n in ("category", "type", "description", "value")])), lambda r: r["serial"].isNotNull())
    tables = {"acts": acts_of(F.col("_acts")).cast(ACTS), "accused": accused_of(F.col("_accused"), F.col("fir_contents"), F.col("address")).cast(ACCUSED), "properties": properties.cast(PROPERTIES), "inquest": groups_of(F.col("_inquest"), INQUEST_ROW, "serial", "uidb_number").cast(INQUEST)}
    return x.select("doc_id", *[out.get(n, F.col(n)).alias(n) for n in names], address(0).alias("present_address"), address(1).alias("permanent_address"), *[c.alias(n) for n, c in tables.items()])


def form_fields(forms: DataFrame) -> DataFrame:
    """One row a form with all labelled fields."""
    return parsed(forms).drop("acts", "accused", "properties", "inquest")


def _rows(forms: DataFrame, name: str) -> DataFrame:
    """The rows of one array. A plain inline would have the optimizer filter by the array's size first, and work it out twice."""
    return parsed(forms).select("doc_id", F.inline_outer(name)).where("serial IS NOT NULL")


def form_acts(forms: DataFrame) -> DataFrame:
    """(doc_id, serial, act, section)."""
    return _rows(forms, "acts")


def form_accused(forms: DataFrame) -> DataFrame:
    """(doc_id, serial, name, father, address, alias)."""
    return _rows(forms, "accused")


def form_properties(forms: DataFrame) -> DataFrame:
    """(doc_id, serial, category, type, description, value): rows of item 9 whose cells are two blanks apart."""
    return _rows(forms, "properties")


def form_inquest(forms: DataFrame) -> DataFrame:
    """(doc_id, serial, uidb_number): rows of item 11 after its label."""
    return _rows(forms, "inquest")


def free_text(forms: DataFrame, no: int) -> DataFrame:
    """(doc_id, value): the text of an item after its label; a label alone is empty."""
    return form_sections(forms).where(F.col("no") == no).select("doc_id", free_value(F.col("text")).alias("value"))


def narrative(forms: DataFrame) -> DataFrame:
    """(doc_id, fir_contents) of every form with an item 12."""
    return form_sections(forms).where("no = 12").select("doc_id", paragraphs(F.col("text")).alias("fir_contents"))


def physical_features(forms: DataFrame) -> DataFrame:
    """(doc_id, serial, sex): rows of the physical-features table."""
    rows = F.transform(F.array(anchor_map(F.col("text"))["physical"]), lambda t: groups_of(t, FEATURE_ROW, "serial", "sex"))[0]
    return forms.select("doc_id", F.inline_outer(rows)).where("serial IS NOT NULL")


# --- layout tables, provenance, merge ---


def layout_rows(tables: DataFrame) -> DataFrame:
    """Tables of explode_tables -> (doc_id, acts, accused, properties, inquest): the rows of a form's typed tables, in order.

    A row's serial is the one in it, else its place among the rows kept; a row with nothing but numbers is blank."""
    t = typed_tables(tables).withColumn("cols", F.transform("headers", layout_key))
    cell = lambda r, key: F.coalesce(clean(F.get(r, F.array_position(F.col("cols"), key) - 1)), F.lit(""))
    solid = lambda *v: F.concat(*[F.regexp_replace(c, r"(?U)^\d+$", "") for c in v]) != ""
    parts = {}
    for name, (kind, shape, columns) in LAYOUTS.items():
        rows = F.transform("rows", lambda r: F.struct(*[cell(r, key).alias(n) for n, key in columns.items()], F.array_join(r, " ").alias("all")))  # noqa: B023
        v = list(columns)
        rows = F.filter(rows, lambda r: solid(*[r[n] for n in v]))  # noqa: B023
        if name == "acts":
            section = lambda r: F.coalesce(filled(r["section"]), section_number(r["all"]), F.lit(""))
            rows = F.transform(rows, lambda r: F.struct(r["serial"].alias("serial"), F.coalesce(filled(r["act"]), F.when(section(r) != "", DEFAULT_ACT), F.lit("")).alias("act"), section(r).alias("section")))
            rows = F.filter(rows, lambda r: (r["act"] != "") | (r["section"] != ""))
        elif name == "accused":
            text = lambda r: F.lower(F.concat_ws(" ", r["name"], r["alias"], r["father"], r["address"]))
            rows = F.filter(rows, lambda r: ~F.exists(F.array(*map(F.lit, LAYOUT_HEADER_WORDS)), lambda w: text(r).contains(w)))
            rows = F.transform(rows, lambda r: F.struct(*[(F.trim(F.regexp_replace(r[n], r"(?U)^पिता\s+का\s+नाम\s*:?", "")) if n == "father" else r[n]).alias(n) for n in v]))  # noqa: B023
            rows = F.filter(rows, lambda r: (r["name"] != "") | (r["father"] != "") | (r["address"] != ""))
        elif name == "properties":
            rows = F.filter(rows, lambda r: r["serial"] != "")
        rows = F.transform(rows, lambda r: F.struct(*[r[n].alias(n) for n in v]))  # noqa: B023
        parts[name] = F.when(F.col("kind") == kind, rows).otherwise(F.array()).cast(shape).alias(name)
    t = t.select("doc_id", "pos", "table_no", *parts.values())
    g = t.groupBy("doc_id").agg(*[F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "table_no", n))), lambda x: x[n])).alias(n) for n in LAYOUTS])
    serial = lambda n: F.transform(n, lambda r, i: F.struct(*[F.coalesce(filled(r["serial"]), (i + 1).cast("string")).alias("serial"), *[r[k].alias(k) for k in LAYOUTS[n][2] if k != "serial"]]))
    return g.select("doc_id", *[serial(n).alias(n) for n in LAYOUTS])


def form_value_maps(values: DataFrame) -> DataFrame:
    """values(doc_id, form_key, value) -> (doc_id, values map): dates, times and years brought into the form's own shape."""
    v, low = F.col("value"), F.col("form_key")
    date, time = first_match(v, f"({DATE})"), first_match(v, f"({TIME})")
    hour, past = F.when(v.contains("घंटे"), "घंटे"), F.when(v.contains("बजे"), "बजे")
    timed = F.when(time == "", "").otherwise(F.concat_ws(" ", time, F.coalesce(past, hour)))
    both = clean(F.concat_ws(" ", filled(date), filled(time), F.coalesce(hour, past)))
    shaped = F.when(low == "year", first_match(v, r"(\d{4})")).when(low == "fir_datetime", both).when(low.isin("date_from", "date_to", "info_date"), date).when(low.isin("time_from", "time_to", "info_time"), timed).otherwise(v)
    x = values.select("doc_id", "form_key", shaped.alias("v")).where("v <> ''")
    return x.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("form_key", "v")))).alias("values"))


def form_record(forms: DataFrame, layout: DataFrame | None = None, values: DataFrame | None = None, few: bool = False) -> DataFrame:
    """(doc_id, fields map, acts, accused, properties, inquest, source_map, sections map) of each form.

    Form values over fields of the text; rows of layout tables (see layout_rows) instead of rows of the text. source_map says
    which it was: layout_table, form_field or text_fallback. sections: the 14 detected sections as text. few: a few fields will be
    looked up and nothing else done with them, so the map is made of its entries, and the optimizer drops all others; same rows."""
    p = parsed(forms)
    names = [c for c in p.columns if c not in ("doc_id", *LAYOUTS)]
    entries = F.create_map(*[c for n in names for c in (F.lit(n), F.coalesce(n, F.lit("")))])
    arrays = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.coalesce(c, F.lit("")) for c in names]))
    x = p.select("doc_id", (entries if few else arrays).alias("t"), *LAYOUTS)
    none = F.create_map().cast("map<string,string>")
    x = x.join(form_value_maps(values), "doc_id", "left").withColumn("v", F.coalesce("values", none)) if values is not None else x.withColumn("v", none)
    if layout is not None:
        x = x.join(layout.select("doc_id", *[F.col(n).alias(f"l_{n}") for n in LAYOUTS]), "doc_id", "left")
    has = {n: F.coalesce(F.size(f"l_{n}") > 0, F.lit(False)) if layout is not None else F.lit(False) for n in LAYOUTS}
    rows = {n: F.when(has[n], F.col(f"l_{n}")).otherwise(F.col(n)).alias(n) if layout is not None else F.col(n) for n in LAYOUTS}
    given = lambda group: F.exists(F.array(*map(F.lit, GROUPS[group])), lambda k: F.coalesce(F.col("v")[k] != "", F.lit(False)))
    source = {n: F.when(has[n], "layout_table").otherwise("text_fallback") for n in LAYOUTS} | {"narrative": F.lit("text_fallback")} | {g: F.when(given(g), "form_field").otherwise("text_fallback") for g in ("basic", "occurrence")}
    fields = F.col("t") if few and values is None else F.map_zip_with("t", F.map_filter("v", lambda k, v: F.array_contains(F.array(*map(F.lit, [*GROUPS["basic"], *GROUPS["occurrence"]])), k)), lambda k, a, b: F.coalesce(filled(b), a, F.lit("")))
    x = x.select("doc_id", fields.alias("fields"), *rows.values(), F.create_map(*[c for n, s in source.items() for c in (F.lit(n), s)]).alias("source_map"))
    return x.withColumn("sections", detected_sections())


def detected_sections() -> Column:
    """The sections map of a record's columns."""
    f = F.col("fields")
    lines = lambda group: F.array_join(F.filter(F.array(*[F.when(f[k] != "", F.concat(F.lit(f"{k}: "), f[k])) for k in GROUPS[group]]), lambda x: x.isNotNull()), "\n")
    dashed = lambda parts: F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " - ")
    act = F.array_join(F.transform("acts", lambda r: F.trim(F.concat(r["serial"], F.lit(". "), r["act"], F.lit(" - धारा "), r["section"]))), "\n")
    acc = F.array_join(F.transform("accused", lambda r: dashed([F.trim(F.concat(r["serial"], F.lit(". "), r["name"])), F.when(r["father"] != "", F.concat(F.lit("पिता का नाम: "), r["father"])).otherwise(""), r["address"]])), "\n")
    prop = F.array_join(F.transform("properties", lambda r: dashed([r[k] for k in LAYOUTS["properties"][2]])), "\n")
    sign = F.array_join(F.filter(F.array(*[F.when(f[k] != "", F.concat(F.lit(f"{label}: "), f[k])) for label, k in (("Name (नाम)", "officer_name"), ("Rank (पद)", "officer_rank"), ("No. (सं.)", "officer_no"))]), lambda x: x.isNotNull()), "\n")
    parts = {"header": lines("basic"), "sections_law": act, "occurrence": lines("occurrence"), "info_type": f["info_type"], "place": lines("place"), "complainant": lines("complainant"), "accused": acc, "delay_reasons": f["delay_reasons"], "properties": prop, "total_value": f["total_value"], "fir_contents": f["fir_contents"], "action_taken": lines("action"), "signatures": sign, "dispatch": f["dispatch"]}
    return F.create_map(*[c for k, v in parts.items() for c in (F.lit(k), v)])


def with_diagnostics(record: DataFrame) -> DataFrame:
    """A record (see form_record) with missing and score: required fields without a value; a tenth for each that is there, 0.05 for
    each list that came from a layout table."""
    lack = lambda name, field: F.size(name) == 0 if field is None else F.coalesce(F.col("fields")[field], F.lit("")) == ""
    missing = F.filter(F.array(*[F.when(lack(n, k), F.lit(n)) for n, k in REQUIRED.items()]), lambda x: x.isNotNull())
    bonus = sum((F.when(F.col("source_map")[n] == "layout_table", 0.05).otherwise(0.0) for n in ("acts", "accused")), F.lit(0.0))
    x = record.withColumn("missing", missing)
    return x.withColumn("score", F.bround(F.least(F.lit(1.0), (10 - F.size("missing")) / 10 + bonus), 2))


def form_diagnostics(record: DataFrame) -> DataFrame:
    """(doc_id, missing, score), see with_diagnostics."""
    return with_diagnostics(record).select("doc_id", "missing", "score")


def fallback_records(docs: DataFrame) -> DataFrame:
    """(doc_id, fir_contents, missing, score) of texts that are no form: the text as it is, 0.2 if there is any."""
    text = F.coalesce("text", F.lit(""))
    x = docs.where(~is_form(text))
    return x.select("doc_id", text.alias("fir_contents"), F.array(*map(F.lit, NOT_A_FORM)).alias("missing"), F.when(strip(text) != "", 0.2).otherwise(0.0).alias("score"))


def audit_sections(docs: DataFrame) -> DataFrame:
    """docs(doc_id, sections map) -> missing critical and important sections, and the share that is there."""
    there = F.map_keys(F.map_filter("sections", lambda k, v: F.coalesce(v != "", F.lit(False))))
    lack = lambda keys: F.array_except(F.array(*map(F.lit, keys)), there)
    x = docs.select("doc_id", lack(CRITICAL).alias("missing_critical"), lack(IMPORTANT).alias("missing_important"))
    n = len(CRITICAL) + len(IMPORTANT)
    return x.withColumn("confidence", F.bround((n - F.size("missing_critical") - F.size("missing_important")) / n, 2))


def merge_sections(parts: DataFrame) -> DataFrame:
    """parts(doc_id, batch, key, value): the header only from batch 0; three keys joined in order; of others the first that is not empty."""
    p = parts.where("value IS NOT NULL AND value <> '' AND (key <> 'header' OR batch = 0)")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("batch", "value"))), lambda x: x["value"]), "\n\n")
    pick = F.when(F.col("key").isin("fir_contents", "accused", "leftovers"), joined).otherwise(F.min_by("value", "batch"))
    return p.groupBy("doc_id", "key").agg(pick.alias("value"))


#: The anchor of each section, and what is taken from its text when nothing better is.
ANCHOR_OF = {"sections_law": "section_2", "occurrence": "section_3", "place": "section_5", "complainant": "section_6", "accused": "section_7", "fir_contents": "section_12", "action_taken": "section_13", "signatures": "section_14"}
REGISTERED = "(1) प्रकरण दर्ज किया गया और जांच प्रारम्भ की गयी।"


def loose_sections(a: Column) -> Column:
    """map(section -> text) from the anchors' texts by very loose patterns; sections without a usable text are left out."""
    t = lambda k: F.coalesce(a[ANCHOR_OF[k]], F.lit(""))
    ten = lambda rows: F.array_join(F.slice(rows, 1, 10), "\n")
    lines = lambda c: F.transform(F.split(c, "\n"), strip)
    one = lambda c, rx: F.trim(F.regexp_extract(c, rx, 1))
    said = lambda label, v: F.when(v != "", F.concat(F.lit(label), v))
    both = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "\n")
    dates, times = (F.regexp_extract_all(t("occurrence"), F.lit(rx), F.lit(1)) for rx in (r"(?U)(\d{2}/\d{2}/\d{4})", r"(?U)(\d{2}:\d{2})"))
    named = F.transform(groups_of(t("accused"), r"(?U)(\d{1,2})\s+([ऀ-ॿ][^\n]{5,60})", "n", "x"), lambda r: F.concat(r["n"], F.lit(". "), strip(r["x"])))
    parts = {
        "sections_law": ten(F.filter(lines(t("sections_law")), lambda x: x.rlike(r"(?U)[ऀ-ॿ].*\d{4}"))),
        "complainant": F.left(strip(F.regexp_replace(t("complainant"), r"(?i)^6\..*?Informant[^\n]*\n?", "")), F.lit(800)),
        "accused": ten(named),
        "fir_contents": strip(F.regexp_replace(t("fir_contents"), r"(?is)^12\..*?contents[^\n]*\n?", "")),
        "action_taken": both(F.when(t("action_taken") != "", F.lit(REGISTERED)), said("(2) जांच अधिकारी (I.O.): ", one(t("action_taken"), r"(?i)I\.O\.[^\n:]*:\s*([^\n]+)"))),
        "occurrence": F.array_join(F.slice(F.concat(dates, times), 1, 4), " | "),
        "place": F.coalesce(F.get(F.filter(lines(t("place")), lambda x: x.rlike(r"[ऀ-ॿ].{10,}")), 0), F.lit("")),
        "signatures": both(said("थाना प्रभारी: ", one(t("signatures"), r"(?i)Name[^\n:]*:\s*([^\n]+)")), said("प्रेषण दिनांक: ", one(t("signatures"), r"(?U)(\d{2}/\d{2}/\d{4})"))),
    }
    return F.map_filter(F.create_map(*[c for k, v in parts.items() for c in (F.lit(k), v)]), lambda k, v: v != "")


def gap_fill(docs: DataFrame, forms: DataFrame) -> DataFrame:
    """docs(doc_id, sections map): missing sections are recovered from their anchor's text, loosely; and which ones were."""
    a = forms.select("doc_id", anchor_map(F.col("text")).alias("a")).select("doc_id", loose_sections(F.col("a")).alias("loose"))
    x = docs.join(a, "doc_id", "left").withColumn("loose", F.coalesce("loose", F.create_map().cast("map<string,string>")))
    gaps = F.filter(F.array(*map(F.lit, [*CRITICAL, *IMPORTANT])), lambda k: (F.coalesce(F.col("sections")[k], F.lit("")) == "") & F.map_contains_key("loose", k))
    x = x.withColumn("recovered", F.array_sort(gaps))
    found = F.map_filter("loose", lambda k, v: F.array_contains("recovered", k))
    rest = F.map_filter("sections", lambda k, v: ~F.array_contains("recovered", k))
    return x.select("doc_id", F.map_concat(rest, found).alias("sections"), "recovered")


#: The printed form. {x} is a field, {x!} one that reads "Not stated" when it is blank, {{x}} a table.
HTML = [
    '<div class="typed-document typed-fir">',
    '<h2 style="text-align:center">FIRST INFORMATION REPORT</h2>',
    '<p style="text-align:center"><strong>(Under Section 173 B.N.S.S)</strong></p>',
    '<p style="text-align:center"><strong>प्रथम सूचना रिपोर्ट</strong></p>',
    '<p style="text-align:center"><strong>(धारा 173 बी एन एस एस के तहत)</strong></p>',
    "<p><strong>1. District/Unit (जिला/इकाई):</strong> {district!}, <strong>P.S. (थाना):</strong> {police_station!} <strong>Year (वर्ष):</strong> {year!}</p>",
    "<p><strong>FIR No. (प्र.सू.रि. सं.):</strong> {fir_no!} <strong>Date and Time of FIR (प्र.सू.रि. की दिनांक और समय):</strong> {fir_datetime!}</p>",
    "<p><strong>2.</strong></p>",
    "{{acts}}",
    "<p><strong>3. (a) Occurrence of offence (अपराध की घटना):</strong></p>",
    "{{occurrence}}",
    "<p><strong>(b) Information received at P.S. (थाना जहां सूचना प्राप्त हुई):</strong> Date (दिनांक): {info_date!} Time (समय): {info_time!}</p>",
    "<p><strong>(c) General Diary Reference (रोजनामचा संदर्भ):</strong> Entry No. (प्रविष्टि सं.): {gd_entry!}</p>",
    "<p><strong>4. Type of Information (सूचना का प्रकार):</strong> {info_type!}</p>",
    "<p><strong>5. Place of Occurrence (घटनास्थल):</strong></p>",
    "<p><strong>1. (a) Direction and distance from P.S. (थाना से दूरी और दिशा):</strong> {direction_distance!}</p>",
    "<p><strong>Beat No. (बीट सं.):</strong> {beat_no!}</p>",
    "<p><strong>(b) Address (पता):</strong> {address!}</p>",
    "<p><strong>(c) Outside Police Station - Name of P.S.:</strong> {outside_ps!}</p>",
    "<p><strong>6. Complainant / Informant (शिकायतकर्ता / सूचनाकर्ता):</strong></p>",
    "<p><strong>(a) Name (नाम):</strong> {name!}</p>",
    "<p><strong>(b) Father&#x27;s Name (पिताका नाम):</strong> {father!}</p>",
    "<p><strong>(c) Date/Year of Birth (जन्म तिथि / वर्ष):</strong> {dob_year!} <strong>(d) Nationality (राष्ट्रीयता):</strong> {nationality!}</p>",
    "<p><strong>(e) UID No. (यूआईडी सं.):</strong></p>",
    "<p><strong>(f) Passport No. (पासपोर्ट सं.):</strong></p>",
    "<p><strong>(g) ID Details:</strong></p>",
    "{{ids}}",
    "<p><strong>(h) Occupation (व्यवसाय):</strong> {occupation!}</p>",
    "<p><strong>(i) Address (पता):</strong></p>",
    "{{addresses}}",
    "<p><strong>(j) Phone number (दूरभाष सं.):</strong> <strong>Mobile (मोबाइल सं.):</strong> {mobile!}</p>",
    "<p><strong>7. Details of known / suspected / unknown accused with full particulars</strong></p>",
    "<p>(ज्ञात / संदिग्ध / अज्ञात अभियुक्त का पूरे विवरण सहित वर्णन):</p>",
    "<p><strong>Accused More Than (अज्ञात आरोपी एक से अधिक हों तो संख्या):</strong> 0</p>",
    "{{accused}}",
    "<p><strong>8. Reasons for delay in reporting by the complainant / informant</strong></p>",
    "<p>(शिकायतकर्ता / सूचनाकर्ता द्वारा रिपोर्ट देरी से दर्ज कराने के कारण):</p>",
    "{{delay}}",
    "<p><strong>9. Particulars of properties of interest (संबन्धित सम्पत्ति का विवरण):</strong></p>",
    "{{properties}}",
    "<p><strong>10. Total value of property (In Rs/-) (सम्पत्ति का कुल मूल्य (रु में)):</strong> {total_value!}</p>",
    "<p><strong>11. Inquest Report / U.D. case No., if any (मृत्यु समीक्षा रिपोर्ट / यू.डी.प्रकरण सं., यदि कोई हो):</strong></p>",
    "{{inquest}}",
    "<p><strong>12. First Information contents (प्रथम सूचना तथ्य):</strong></p>",
    "{{narrative}}",
    "<p><strong>13. Action taken: Since the above information reveals commission of offence(s) u/s as mentioned at Item No. 2.</strong></p>",
    "<p>(की गयी कार्यवाही : चूंकि उपरोक्त जानकारी से पता चलता है कि अपराध करने का तरीका मद सं. 2 में उल्लेख धारा के तहत है.):</p>",
    "<p><strong>(1) Registered the case and took up the investigation:</strong> / or (या)</p>",
    "<p><strong>(2) Directed (Name of I.O.) (जांच अधिकारी का नाम):</strong> {io_name!}</p>",
    "<p><strong>Rank (पद):</strong> {io_rank!}</p>",
    "<p><strong>No. (सं.):</strong> {io_no!}</p>",
    "<p><strong>(3) Refused investigation due to (जांच के लिए):</strong> or (के कारण इंकार किया या)</p>",
    "<p><strong>(4) Transferred to P.S. (थाना):</strong> {transferred_to!}</p>",
    "<p>F.I.R. read over to the complainant / informant, admitted to be correctly recorded and a copy given to the complainant / informant, free of cost.</p>",
    "<p>R.O.A.C. (आर.ओ.ए.सी.)</p>",
    "{{signature}}",
    "<p><strong>15. Date and time of dispatch to the court (अदालत में प्रेषण की दिनांक और समय):</strong> {dispatch!}</p>",
    "<p><strong>Attachment to item 7 of First Information Report (प्रथम सूचना रिपोर्ट के मद 7 संलग्नक):</strong></p>",
    "<p><strong>Physical features, deformities and other details of the suspect/accused: (If known / seen)</strong></p>",
    "{{features_1}}",
    "{{features_2}}",
    "{{features_3}}",
    "<p>These fields will be entered only if complainant/informant gives any one or more particulars about the suspect/accused.</p>",
    "</div>",
]
#: The heads of its eleven tables.
HEADS = {
    "acts": ["S.No. (क्र.सं.)", "Acts (अधिनियम)", "Sections (धारा(एँ))"],
    "occurrence": ["", "", "", ""],
    "ids": ["S. No. (क्र.सं.)", "ID Type (पहचान पत्र का प्रकार)", "ID Number (पहचान संख्या)"],
    "addresses": ["S.No. (क्र.सं.)", "Address Type (पता का प्रकार)", "Address (पता)"],
    "accused": ["S. No. (क्र.सं.)", "Name (नाम)", "Alias (उपनाम)", "Relative's Name (रिश्तेदार का नाम)", "Present Address (वर्तमान पता)"],
    "properties": ["S. No. (क्र.सं.)", "Property Category (सम्पत्ति श्रेणी)", "Property Type (सम्पत्ति के प्रकार)", "Description (विवरण)", "Value (In Rs/-) (मूल्य (रु में))"],
    "inquest": ["S. No. (क्र.सं.)", "UIDB Number (यू.डी.प्रकरण सं.)"],
    "signature": ["14. Signature / Thumb impression of the complainant / informant (शिकायतकर्ता / सूचनाकर्ता के हस्ताक्षर / अंगूठे का निशान)", "Signature of Officer in charge, Police Station (थाना प्रभारी के हस्ताक्षर)"],
    "features_1": ["S. No. (क्र.सं.)", "Sex (लिंग)", "Date/Year Of Birth (जन्म तिथि / वर्ष)", "Build (बनावट)", "Height cms (कद (से.मी.))", "Complexion (रंग)", "Identification Mark(s) (पहचान चिन्ह)"],
    "features_2": ["Deformities / Peculiarities (विकृतियाँ / विशिष्टताएँ)", "Teeth (दाँत)", "Hair (बाल)", "Eye (आँखें)", "Habit(s) (आदतें)", "Dress Habit(s) (पहनावा)", "Language / Dialect (भाषा/बोली)"],
    "features_3": ["Place of (का स्थान)", "Burn Mark (जले हुए का निशान)", "Leucodema (लुकोदेर्मा (सफेद धब्बे))", "Mole (मस्सा)", "Scar (घाव)", "Tattoo (गूदे हुए का)", "Others (अन्य)"],
}
NOT_STATED = "Not stated"


def _row(cells: list[Column | str]) -> Column:
    """One row of a table. Cells that are the same in every form are worked out once, as they are no elements of an array."""
    td = lambda c: F.coalesce(F.concat(F.lit("<td>"), escape_html(clean(F.lit(c) if isinstance(c, str) else c)), F.lit("</td>")), F.lit(""))
    return F.concat(F.lit("<tr>"), *map(td, cells), F.lit("</tr>"))


def _table(name: str, rows: Column | list[list], cells: Callable[[Column], list] | None = None) -> Column:
    """rows: lists of cells, or an array with the cells of each element; without rows one of blanks is shown."""
    if cells is None:
        body = [_row(r) for r in rows or [[""] * len(HEADS[name])]]
    else:
        body = [F.when(F.size(rows) > 0, F.array_join(F.transform(rows, lambda r: _row(cells(r))), "")).otherwise(_row([""] * len(HEADS[name])))]
    head = F.concat(F.lit("<table><tr>"), *[F.concat(F.lit("<th>"), escape_html(F.lit(h)), F.lit("</th>")) for h in HEADS[name]], F.lit("</tr>"))
    return F.concat(head, *body, F.lit("</table>"))


def form_html(record: DataFrame) -> DataFrame:
    """(doc_id, html): a record (see form_record) as the printed form, escaped, with its eleven tables."""
    f = F.col("fields")
    said = lambda c: F.coalesce(filled(clean(c)), F.lit(NOT_STATED))
    labelled = lambda label, k: F.concat(F.lit(f"{label}: "), said(f[k]))
    present = F.coalesce(filled(f["present_address"]), f["address"])
    keys = lambda *names: lambda r: [r[k] for k in names]
    accused, blanks = F.col("accused"), lambda r: [""] * 7
    tables = {
        "acts": (F.col("acts"), keys("serial", "act", "section")),
        "occurrence": ([["1", labelled("Day (दिन)", "day"), labelled("Date from (दिनांक से)", "date_from"), labelled("Date To (दिनांक तक)", "date_to")], ["", labelled("Time Period (समय अवधि)", "time_period"), labelled("Time From (समय से)", "time_from"), labelled("Time To (समय तक)", "time_to")]],),
        "ids": ([],),
        "addresses": ([["1", "वर्तमान पता", present], ["2", "स्थायी पता", F.coalesce(filled(f["permanent_address"]), present)]],),
        "accused": (accused, lambda r: [r["serial"], r["name"], r["alias"], F.concat(F.lit("पिता का नाम: "), said(r["father"])), said(r["address"])]),
        "properties": (F.col("properties"), keys(*LAYOUTS["properties"][2])),
        "inquest": (F.col("inquest"), keys(*LAYOUTS["inquest"][2])),
        "signature": ([["", F.concat_ws("\n", labelled("Name (नाम)", "officer_name"), labelled("Rank (पद)", "officer_rank"), labelled("No. (सं.)", "officer_no"))]],),
        "features_1": (accused, lambda r: [r["serial"], "पुरुष", "", "", "-", "", "चेचक: नहीं"]),
        "features_2": (accused, blanks),
        "features_3": (accused, blanks),
    }
    para = lambda c: F.concat(F.lit("<p>"), escape_html(c), F.lit("</p>"))
    story = F.filter(F.transform(F.split(f["fir_contents"], "\n\n"), strip), lambda x: x != "")
    blocks = {n: _table(n, *t) for n, t in tables.items()} | {"delay": F.when(f["delay_reasons"] != "", para(f["delay_reasons"])).otherwise(""), "narrative": F.when(F.size(story) > 0, F.array_join(F.transform(story, para), "")).otherwise(f"<p>{NOT_STATED}</p>")}
    lines = []
    for line in HTML:
        if line.startswith("{{"):
            lines.append(blocks[line[2:-2]])
            continue
        parts = re.split(r"\{(\w+)!\}", line)
        lines.append(F.concat(*[escape_html(said(f[x])) if i % 2 else F.lit(x) for i, x in enumerate(parts)]))
    return record.select("doc_id", F.concat_ws("\n", *lines).alias("html"))
