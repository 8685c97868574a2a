"""License scans (op 7), DataFrame functions only: sentence-rule recognition.

Texts are cut into pieces, and normalised pieces are mapped to the identifiers of known licence sentences; the sequence of
identifiers of a document is matched against ordered licence rules: a rule holds where its identifiers follow each other,
sentences that are not known aside. An unknown item of a list is not passed over: no rule holds across it, nor one that ends with
an item of a list which goes on with it. Of matches inside one another the longest stays. A sentence may have a slot, for a name of
up to 12 words. After "SPDX-License-Identifier:" each identifier of the expression is a match (AND, OR, brackets and "+" are
understood; what follows WITH is an exception, no licence).

Normalised: lower case, every run of other than a-z and 0-9 one blank, trimmed; a piece that begins as a copyright notice
with a year is the sentence "copyright notice". Pieces end at line feeds, at . ! ? ; or : before a blank, and after a list
mark at a line's beginning; pieces without a letter or digit are none. A sentence may be wrapped, behind comment marks too:
it is known where some pieces in a row read like it, from the beginning of the first to the end of the last. Of sentences
known at one piece the longest counts.

Cases: null or empty text has no sentences; repeated sentences are matched each time; every row comes back, equal rows
with equal results; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import join_rows, stored

#: Sentences of public licences and notices, normalised, by identifier.
SENTENCES = {
    "copyright": "copyright notice",
    "rights": "all rights reserved",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-1": "licensed under the apache license version 2 0 the license",
    "apache-2": "you may not use this file except in compliance with the license",
    "apache-3": "you may obtain a copy of the license at",
    "apache-4": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-5": "see the license for the specific language governing permissions and limitations under the license",
    "mit-notice": "released under the mit license",
    "mit-line": "licensed under the mit license",
    "mit-1": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-2": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-3": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "bsd-1": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-2": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-3": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-4": "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-5": "this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-6": "in no event shall * be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "mit-4": "in no event shall * be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-2": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-3": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "gpl-4": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-5": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-6": "see the gnu general public license for more details",
    "gpl-2x": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl-23": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-23": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-23": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-1": "this library is free software",
    "lgpl-2": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl-21": "either version 2 1 of the license or at your option any later version",
    "agpl-2": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "unlicense-1": "this is free and unencumbered software released into the public domain",
    "unlicense-2": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib-1": "this software is provided as is without any express or implied warranty",
    "zlib-2": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-3": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-1": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "boost-notice": "distributed under the boost software license version 1 0",
    "mpl-2": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl-3": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "isc-1": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl2-notice": "this work is licensed under the gnu general public license version 2",
    "gpl-1": "this program is free software",
    "gpl-2": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-3v": "either version 3 of the license or at your option any later version",
    "gpl-2v": "either version 2 of the license or at your option any later version",
    "mpl-1": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "bsd-4a": "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-ad": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "epl-1": "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution",
    "epl-1a": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution",
    "epl-2": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "cc0-1": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cddl-1": "the contents of this file are subject to the terms of the common development and distribution license the license",
    "artistic-notice": "licensed under the artistic license 2 0",
    "psf-2": "psf is making python available to licensee on an as is basis",
}
#: Rules in order, by licence.
RULES = [
    ("Apache-2.0", ["apache-1", "apache-2", "apache-3", "apache-4", "apache-5"]),
    ("Apache-2.0", ["apache-notice"]),
    ("MIT", ["copyright", "mit-1", "mit-2", "mit-3"]),
    ("MIT", ["mit-1", "mit-2", "mit-3", "mit-4"]),
    ("MIT", ["mit-1", "mit-2", "mit-3"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-line"]),
    ("BSD-4-Clause", ["bsd-1", "bsd-2", "bsd-3", "bsd-ad", "bsd-4", "bsd-5", "bsd-6"]),
    ("BSD-4-Clause", ["bsd-1", "bsd-2", "bsd-3", "bsd-ad", "bsd-4"]),
    ("BSD-3-Clause", ["bsd-1", "bsd-2", "bsd-3", "bsd-4a", "bsd-5", "bsd-6"]),
    ("BSD-3-Clause", ["bsd-1", "bsd-2", "bsd-3", "bsd-4a"]),
    ("BSD-3-Clause", ["bsd-1", "bsd-2", "bsd-3", "bsd-4", "bsd-5", "bsd-6"]),
    ("BSD-3-Clause", ["bsd-1", "bsd-2", "bsd-3", "bsd-4"]),
    ("BSD-2-Clause", ["bsd-1", "bsd-2", "bsd-3", "bsd-5", "bsd-6"]),
    ("BSD-2-Clause", ["bsd-1", "bsd-2", "bsd-3"]),
    ("ISC", ["isc-1", "isc-2", "isc-3"]),
    ("ISC", ["isc-1"]),
    ("GPL-3.0-or-later", ["gpl-1", "gpl-2", "gpl-3v"]),
    ("GPL-3.0-or-later", ["gpl-1", "gpl-23"]),
    ("GPL-2.0-or-later", ["gpl-1", "gpl-2", "gpl-2v"]),
    ("GPL-2.0-only", ["gpl-1", "gpl-2x"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("GPL-2.0-only", ["gpl2-notice"]),
    ("LGPL-2.1-or-later", ["lgpl-1", "lgpl-2", "lgpl-21"]),
    ("LGPL-3.0-or-later", ["lgpl-1", "lgpl-2", "gpl-3v"]),
    ("LGPL-3.0-or-later", ["lgpl-1", "lgpl-23"]),
    ("AGPL-3.0-or-later", ["gpl-1", "agpl-2", "gpl-3v"]),
    ("AGPL-3.0-or-later", ["gpl-1", "agpl-23"]),
    ("MPL-2.0", ["mpl-1"]),
    ("Unlicense", ["unlicense-1", "unlicense-2"]),
    ("Zlib", ["zlib-1", "zlib-2", "zlib-3"]),
    ("BSL-1.0", ["boost-1"]),
    ("BSL-1.0", ["boost-notice"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("EPL-1.0", ["epl-1"]),
    ("EPL-1.0", ["epl-1a"]),
    ("EPL-2.0", ["epl-2"]),
    ("CC0-1.0", ["cc0-1"]),
    ("CDDL-1.0", ["cddl-1"]),
    ("Artistic-2.0", ["artistic-notice"]),
    ("PSF-2.0", ["psf-2"]),
]
#: Identifiers that stand in expressions after "SPDX-License-Identifier:", and what older ones are now called.
SPDX = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0",
    "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "PSF-2.0", "Unlicense", "WTFPL", "Zlib",
]
SPDX_OLD = {f"{n}{plus}": f"{n}-{'or-later' if plus else 'only'}" for n in ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0") for plus in ("", "+")}
#: Words that a slot of a sentence (" * ") may hold.
SLOT = 12
#: How a piece with an expression begins, what its parts look like, and what a mark of a list is.
SPDX_HEAD, SPDX_PART, MARK = r"(?s)^.*?spdx-license-identifier[ \t]*:?[ \t]*(.*)$", r"[a-z0-9][a-z0-9.+-]*", "^[a-z0-9]{1,2}$"
#: A text without any of these has no sentence by which a rule could hold.
HINTS = ["license", "copyright", "reserved", "permission", "redistribut", "software", "mpl", "warranty"]
#: Comment words that go at a line's beginning, list marks that a piece ends after, and other ends of pieces.
COMMENT, LIST_MARK, END_MARK = r"(?im)^[ \t]*(?:dnl|rem)[ \t]", r"(?m)^([^A-Za-z0-9\n]*[A-Za-z0-9]{1,2}[.)])[ \t]+", r"([.!?;:])[\t\f\r ]+"


def pieces_of(text: Column) -> Column:
    """Array of struct(raw, norm): the pieces in lower case, as they are and normalised."""
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, COMMENT, ""), LIST_MARK, "$1\n"), END_MARK, "$1\n")
    both = F.transform(F.split(F.lower(cut), "\n"), lambda s: F.struct(s.alias("raw"), F.trim(F.regexp_replace(s, r"[^a-z0-9]+", " ")).alias("norm")))
    return F.filter(both, lambda s: s["norm"] != "")


def pattern_of(sentence: str) -> str | None:
    """The pattern of a sentence with a slot, None for one without."""
    return "^" + sentence.replace(" * ", f" (?:[a-z0-9]+ ){{1,{SLOT}}}?") if " * " in sentence else None


def known_table(sentences: dict[str, str]) -> list[tuple]:
    """(identifier, sentence, first word, characters, most words, pattern)."""
    return [(i, s, s.split(" ")[0], len(s), len(s.split(" ")) + (SLOT if " * " in s else 0), pattern_of(s)) for i, s in sentences.items()]


def spdx_table() -> list[tuple[str, str]]:
    return [(n.lower(), n) for n in SPDX] + [(old.lower(), n) for old, n in SPDX_OLD.items()]


def _hinted(text: Column) -> Column:
    low, out = F.lower(text), F.lit(False)
    for h in HINTS:
        out = out | low.contains(h)
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES, hints: Column | None = None) -> DataFrame:
    """doc_id, n_known (known sentences), n_matches, licenses (comma-joined, sorted), matches (licence:first:last piece number)."""
    spark = docs.sparkSession
    # The rule tables have a fixed number of rows.
    known = F.broadcast(spark.createDataFrame(known_table(sentences), "sid string, norm string, opening string, chars int, words int, pattern string"))
    ruled = F.broadcast(spark.createDataFrame([(",".join(ids), name, len(ids)) for name, ids in rules], "seq string, license string, n int"))
    named = F.broadcast(spark.createDataFrame(spdx_table(), "part string, license string"))
    longest = max(len(ids) for _, ids in rules)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    if sentences is SENTENCES:
        hints = _hinted(F.col("text"))
    key = ["doc_id", "text_hash"]
    p = (d if hints is None else d.where(hints)).select(*key, pieces_of(F.col("text")).alias("both"))
    s = p.select(*key, F.transform("both", lambda x: x["norm"]).alias("pieces"))
    marks = F.filter(F.transform("pieces", lambda x, i: F.when(x.rlike(MARK), i)), lambda i: i.isNotNull())
    s = s.withColumn("marks", marks).select(*key, "pieces", "marks", F.posexplode("pieces").alias("pos", "piece"))
    notice = F.col("piece").rlike(r"^copyright( c)? [0-9]{4}( |$)")
    s = s.withColumn("opening", F.when(notice, "copyright").otherwise(F.substring_index("piece", " ", 1))).withColumn("notice", notice).join(known, "opening")
    # Each piece has a word at least, so a sentence of n words takes n pieces at most.
    s = s.withColumn("ahead", F.array_join(F.slice("pieces", F.col("pos") + 1, F.col("words")), "\n")).withColumn("flat", F.translate("ahead", "\n", " "))
    is_notice = F.col("norm") == "copyright notice"
    size = F.when(is_notice, F.col("chars")).when(F.col("pattern").isNull(), F.when(F.col("flat").startswith(F.col("norm")), F.col("chars")).otherwise(0)).otherwise(F.length(F.expr("regexp_extract(flat, pattern, 0)")))
    s = s.withColumn("size", size).where(F.when(is_notice, F.col("notice")).otherwise((F.col("size") > 0) & F.substring(F.col("ahead"), F.col("size") + 1, F.lit(1)).isin("", "\n")))
    taken = F.left("ahead", F.col("size"))
    s = s.withColumn("last", (F.col("pos") + F.when(is_notice, 0).otherwise(F.length(taken) - F.length(F.replace(taken, F.lit("\n"), F.lit(""))))).cast("int"))
    # The last mark before the sentence's own, whether it has one itself, and whether one comes next.
    s = s.withColumns({"mark": F.coalesce(F.array_max(F.filter("marks", lambda i: i < F.col("pos") - 1)), F.lit(-1)), "own": F.array_contains("marks", F.col("pos") - 1), "more": F.array_contains("marks", F.col("last") + 1)})
    s = s.groupBy(*key, "pos").agg(F.max_by(F.struct("last", "sid", "mark", "own", "more"), F.struct("size", "sid")).alias("s"))  # equal rows are one here
    s = stored(s.select(*key, "pos", "s.*"), "sentences")
    seq = s.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "last", "sid", "mark", "own", "more"))).alias("_s"))
    starts = seq.select(*key, "_s", F.posexplode("_s").alias("at", "one"))
    grams = starts.select(*key, "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("_s") - F.col("at")))).alias("n"), "_s")
    grams = grams.withColumn("_g", F.slice("_s", F.col("at") + 1, F.col("n"))).withColumn("_next", F.get("_s", F.col("at") + F.col("n"))).withColumn("seq", F.array_join(F.col("_g.sid"), ",")).drop("_s")
    m = grams.join(ruled.withColumnRenamed("n", "_n"), "seq").drop("_n").withColumn("end", F.col("at") + F.col("n"))
    across = F.exists(F.zip_with(F.slice("_g", F.lit(1), F.col("n") - 1), F.slice("_g", F.lit(2), F.col("n")), lambda a, b: b["mark"] > a["last"]), lambda x: F.coalesce(x, F.lit(False)))
    z = F.element_at("_g", -1)
    goes_on = (F.col("n") > 1) & z["own"] & z["more"] & ~F.coalesce(F.col("_next.pos") == z["last"] + 2, F.lit(False))
    m = m.where(~across & ~goes_on)
    before = Window.partitionBy(*key).orderBy("at", F.desc("end"), "license").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("_seen", F.max("end").over(before)).where(F.col("_seen").isNull() | (F.col("end") > F.col("_seen")))
    m = m.select(*key, F.element_at("_g.pos", 1).alias("first"), F.element_at("_g.last", -1).alias("last"), "license")
    # Expressions: in the piece of the tag itself, or in the next one.
    e = p.select(*key, "both", F.posexplode("both").alias("pos", "b")).where(F.col("b.norm").startswith("spdx license identifier"))
    tail = F.regexp_extract("b.raw", SPDX_HEAD, 1)
    e = e.select(*key, "pos", F.when(tail != "", F.col("pos")).otherwise(F.col("pos") + 1).alias("last"), F.when(tail != "", tail).otherwise(F.get("both", F.col("pos") + 1)["raw"]).alias("x"))
    parts = F.transform(F.array(F.regexp_extract_all("x", F.lit(SPDX_PART), F.lit(0))), lambda v: F.filter(v, lambda t, i: (i == 0) | (F.get(v, i - 1) != "with")))[0]
    e = e.select(*key, F.col("pos").alias("first"), "last", F.explode(parts).alias("part")).join(named, "part").select(*key, "first", "last", "license").distinct()
    e = stored(e, "expressions")
    span = F.struct("first", "last", "license")
    m = m.unionByName(e).groupBy(*key).agg(F.count(F.lit(1)).alias("n_matches"), F.array_sort(F.collect_set("license")).alias("_names"), F.array_sort(F.collect_list(span)).alias("_spans"))
    lines = s.select(*key, "pos").unionByName(e.select(*key, F.col("first").alias("pos")).distinct())
    counts = lines.groupBy(*key).agg(F.count(F.lit(1)).alias("n_known"))
    out = join_rows(d.select(*key), join_rows(counts, m, key), key)
    spans = F.transform("_spans", lambda x: F.concat_ws(":", x["license"], x["first"].cast("string"), x["last"].cast("string")))
    return out.select("doc_id", F.coalesce("n_known", F.lit(0)).cast("long").alias("n_known"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.coalesce(F.array_join("_names", ","), F.lit("")).alias("licenses"), F.coalesce(F.array_join(spans, ","), F.lit("")).alias("matches"))
