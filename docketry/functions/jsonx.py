"""Functions over JSON text and maps of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAP = "map<string,string>"
EMPTY = ["", "[]", "{}"]


def filled(v: Column) -> Column:
    """True unless the value is null, empty, or an empty list or object."""
    return v.isNotNull() & ~v.isin(*EMPTY)


def parse_loose_json(raw: Column) -> Column:
    """Text that a model wrote, as a map: a leading code fence is stripped; what does not parse becomes {raw_text: raw}."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    clean = bare(raw)
    fenced = F.regexp_extract(clean, r"(?s)^```(?:json)?(.*?)(?:```|\z)", 1)
    clean = bare(F.when(clean.startswith("```"), fenced).otherwise(clean))
    # In a list, nothing may follow the object; alone, the parser would stop at its end.
    parsed = F.when(F.try_parse_json(F.concat(F.lit("["), clean, F.lit("]"))).isNotNull() & clean.startswith("{"), F.from_json(clean, MAP))
    return F.coalesce(parsed, F.create_map(F.lit("raw_text"), raw))


def parse_sections_json(raw: Column) -> Column:
    """The first fenced block if there is one, of it the widest {...}; null and empty values dropped; null if it does not parse."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.+?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(raw)
    brace = F.regexp_extract(body, r"(?s)\{.+\}", 0)
    parsed = F.from_json(F.when(brace != "", brace).otherwise(body), MAP)
    return F.map_filter(parsed, lambda k, v: v.isNotNull() & (v != ""))


def fill_ratio(m: Column) -> Column:
    """Share of values that are filled, to 3 places; 0 for an empty map."""
    n = F.size(m)
    return F.when(n > 0, F.bround(F.size(F.map_filter(m, lambda k, v: filled(v))) / n, 3)).otherwise(F.lit(0.0))


def structure_confidence(m: Column, expected: list[str] | None) -> Column:
    """Share of the expected keys that are filled, or of four keys for a free template."""
    if expected:
        found = F.size(F.filter(F.array(*map(F.lit, expected)), lambda k: F.coalesce(F.element_at(m, k) != "", F.lit(False))))
        return F.bround(found / len(expected), 2)
    found = F.size(F.map_filter(m, lambda k, v: v.isNotNull() & (v != "")))
    return F.bround(F.least(found / 4, F.lit(1.0)), 2)


def edit_diff(new: Column, old: Column) -> Column:
    """Entries of new whose value differs from old's; null if there are none. Removed keys are not reported."""
    d = F.map_filter(new, lambda k, v: ~v.eqNullSafe(F.element_at(old, k)))
    return F.when(F.size(d) > 0, d)


def context_hash(m: Column) -> Column:
    """sha256 over the entries in key order, as JSON."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m)))), 256)


def json_depth(raw: Column) -> Column:
    """How deep objects and lists are nested in JSON text: the highest count of open brackets outside of strings."""
    bare = F.regexp_replace(F.regexp_replace(raw, r'"(?:[^"\\\\]|\\\\.)*+"', ""), r"[^\[\]{}]", "")
    step = lambda acc, c: F.struct((acc["now"] + F.when(c.isin("{", "["), 1).when(c == "", 0).otherwise(-1)).alias("now"), F.greatest(acc["most"], acc["now"] + 1).alias("most"))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(F.split(bare, ""), start, step, lambda acc: acc["most"])


def flatten_json(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """keys, path, kind, value: the leaves of JSON texts of any depth, one row each; empty objects and lists are leaves too.

    One pass over the texts tells how many levels there are; the levels are then unfolded row by row, without a shuffle. path: an
    array of steps, each a key or a place; kind: object, array, string, number, boolean or null. A text that does not parse (or names
    a key twice) has one row of nulls. keys should tell the rows of df apart."""
    levels = df.agg(F.max(json_depth(F.col(col)))).first()[0] or 0
    steps = F.array().cast("array<struct<key:string,pos:int>>")
    x = df.select(*keys, F.try_parse_json(F.col(col)).alias("_v"), steps.alias("path"))
    for _ in range(levels):
        x = x.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("_v").outer()))
        inner = F.col("pos").isNotNull()
        path = F.when(inner, F.array_append("path", F.struct(F.col("key"), F.when(F.col("key").isNull(), F.col("pos")).alias("pos")))).otherwise(F.col("path"))
        x = x.select(*keys, F.when(inner, F.col("value")).otherwise(F.col("_v")).alias("_v"), path.alias("path"))
    kind = F.regexp_extract(F.schema_of_variant("_v"), "^[A-Z]+", 0)
    named = F.when(kind.isin("OBJECT", "ARRAY", "STRING", "BOOLEAN"), F.lower(kind)).when(kind == "VOID", "null").when(kind.isNotNull(), "number")
    return x.select(*keys, F.when(kind.isNotNull(), F.col("path")).alias("path"), named.alias("kind"), F.to_json("_v").alias("value"))


def canonical_hashes(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """keys, hash, leaves: sha256 over the sorted leaves of a JSON text, so that it depends on no order of keys, but on that of lists;
    null for a text that does not parse."""
    leaf = F.struct("path", "kind", "value")
    g = flatten_json(df, keys, col).groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), leaf))).alias("_l"))
    return g.select(*keys, F.when(F.size("_l") > 0, F.sha2(F.to_json("_l"), 256)).alias("hash"), F.size("_l").alias("leaves"))


def dedupe_ids(ids: Column, most: int = 20) -> Column:
    """struct(ids without repeats in order, ok): ok unless more than `most` remain."""
    d = F.array_distinct(ids)
    return F.struct(d.alias("ids"), (F.size(d) <= most).alias("ok"))


def coerce_assessment(score: Column, language: Column) -> Column:
    """struct(score in [0, 1], 0 or absent taken as 0.5; language of a fixed list, else unknown)."""
    s = F.when(score.isNull() | (score == 0), F.lit(0.5)).otherwise(score)
    low = F.lower(F.coalesce(language, F.lit("unknown")))
    return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)).alias("score"), F.when(low.isin("hindi", "english", "mixed", "unknown"), low).otherwise("unknown").alias("language"))
