"""Duplicates hidden by formatting differences.

Columns are dictionary-encoded.  Every distinct value of a column is
canonicalised once (letters, digits and their accents, case-folded; contents
made of fields also as their (key, value) pairs); every distinct canonical
value gets an integer; a record is rewritten as its category's and content's
integers and, if made of fields, the sorted tuple of its (key, value) integers;
and the integers are grouped.  Texts are shuffled once, to find the distinct
ones; records travel as hashes and integers only.

Two records of one scope are copies when their categories are equal and either
their tuples of fields or their contents as a whole are equal; what is tied by
both ways in turn is one group.

Defined cases: a null category is an empty one; a content without letter or
digit takes no part; a null scope is a scope of its own; texts are compared in
Unicode form C, so a decomposed accent equals a composed one; contents count
as fields only when every part cut at ``;``, ``|`` or a line end begins with a
one-word key and ``:`` or ``=`` (parts without one belong to the field before)
and there are two fields at least; a group of any size is spread by
``lookup_join``; repeated ids stay one row each; a null id is an id like any
other.  Two texts whose 128-bit hashes are equal are taken as equal.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.plans.durable import cut, spread
from tessella.plans.skew import hot_keys, lookup_join

_PARTS = re.compile(r"[;|\n\r]")
_FIELD = re.compile(r"[\W_]*([^\W_]+)\s*[:=](.*)", re.S)
_HAS_WORD = re.compile(r"[^\W_]")
_ASCII = re.compile(r"[^0-9a-z]+")


def canonical(text: str) -> str:
    """Only letters, digits and accents, in one letter case."""
    if text.isascii():
        return _ASCII.sub("", text.lower())
    s = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    return "".join(ch for ch in s if ch.isalnum() or unicodedata.category(ch)[0] == "M")


def fields(text: str) -> list[tuple[str, str]] | None:
    """The canonical (key, value) pairs of a content made of fields, sorted; None for any other."""
    if ":" not in text and "=" not in text:
        return None
    found: list[list[str]] = []
    for part in _PARTS.split(text):
        m = _FIELD.fullmatch(part)
        if m:
            found.append([m[1], m[2]])
        elif not _HAS_WORD.search(part):
            continue
        elif found:
            found[-1][1] += " " + part
        else:
            return None
    return sorted((canonical(k), canonical(v)) for k, v in found) if len(found) > 1 else None


# ---- dictionaries


def _h128(c: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(c))


_CANON = "h binary, text string, keys array<string>, vals array<string>"


def canonical_values(values: DataFrame) -> DataFrame:
    """h, text, keys, vals of ``values`` (h, value), a row per distinct raw value: its canonical text and fields.

    ``text`` is null for a value without letter or digit, ``keys`` and ``vals`` for one not made of fields.
    """

    def run(batches):
        for b in batches:
            texts, keys, vals = [], [], []
            for value in b.column(1).to_pylist():
                plain = canonical(value or "")
                # accents alone are no text
                some = any(ch.isalnum() for ch in plain)
                pairs = fields(value) if some else None
                texts.append(plain if some else None)
                keys.append([k for k, _ in pairs] if pairs else None)
                vals.append([v for _, v in pairs] if pairs else None)
            st = pa.string()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, st), pa.array(keys, pa.list_(st)), pa.array(vals, pa.list_(st))], names=["h", "text", "keys", "vals"])

    return spread(values.select("h", "value")).mapInArrow(run, _CANON)


def dictionary(canon: DataFrame) -> DataFrame:
    """v (the hash of a canonical value), n: a different integer for every distinct canonical text, key and value."""
    used = F.explode(F.concat(F.array("text"), F.coalesce("keys", F.array().cast("array<string>")), F.coalesce("vals", F.array().cast("array<string>"))))
    distinct = canon.where(F.col("text").isNotNull()).select(used.alias("x")).select(_h128(F.col("x")).alias("v")).distinct()
    # the numbers are given once and kept
    return cut(distinct.withColumn("n", F.monotonically_increasing_id()))


def encode_values(canon: DataFrame, numbers: DataFrame) -> DataFrame:
    """h, text_id, tuple: every distinct raw value as integers; ``tuple`` is sorted by key and value, null unless made of fields."""
    def placed(c: str, side: int) -> Column:
        entry = F.transform(c, lambda x, i: F.struct(i.alias("at"), F.lit(side).alias("side"), x.alias("x")))
        return F.coalesce(entry, F.array().cast("array<struct<at:int,side:int,x:string>>"))

    used = F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("side"), F.col("text").alias("x"))), placed("keys", 0), placed("vals", 1))
    parts = canon.where(F.col("text").isNotNull()).select("h", F.explode(used).alias("u")).select("h", "u.at", "u.side", _h128(F.col("u.x")).alias("v"))
    met = lookup_join(parts, numbers, ["v"], "inner", hot_keys(parts, ["v"]))
    fields_ = met.groupBy("h", "at").agg(F.max(F.when(F.col("side") == 0, F.col("n"))).alias("k"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("v"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("at") >= 0, F.struct("k", "v"))))
    made = fields_.groupBy("h").agg(F.max(F.when(F.col("at") < 0, F.col("k"))).alias("text_id"), pairs.alias("__p"))
    flat = F.flatten(F.transform("__p", lambda p: F.array(p["k"], p["v"])))
    return made.select("h", "text_id", F.when(F.size("__p") > 0, flat).alias("tuple"))


def encode(df: DataFrame, id_col: str = "id", scope_col: str = "scope", category_col: str = "category", content_col: str = "content") -> DataFrame:
    """id, scope, cat_id, text_id, tuple: one row of integers per record that takes part."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(scope_col), F.lit("\x00")).alias("scope"), F.coalesce(F.col(category_col), F.lit("")).alias("cat"), F.col(content_col).alias("content"))
    rows = rows.where(F.col("content").isNotNull())
    column = F.explode(F.array(F.struct(F.lit(False).alias("content"), F.col("cat").alias("value")), F.struct(F.lit(True).alias("content"), F.col("content").alias("value")))).alias("c")
    raw = rows.select(column).select("c.content", "c.value")
    # each distinct raw value once; copies are combined before the shuffle
    distinct = raw.select(_h128(F.col("value")).alias("h"), "value").groupBy("h").agg(F.first("value").alias("value"))
    canon = cut(canonical_values(distinct))
    values = cut(encode_values(canon, dictionary(canon)))
    records = rows.select("id", "scope", _h128(F.col("cat")).alias("cat_h"), _h128(F.col("content")).alias("h"))
    met = lookup_join(records, values, ["h"], "inner", hot_keys(records, ["h"]))
    # categories: those without letter or digit are the empty one
    cats = values.select(F.col("h").alias("cat_h"), F.col("text_id").alias("cat_id"))
    met = lookup_join(met, cats, ["cat_h"], "left", hot_keys(met, ["cat_h"]))
    return met.select("id", "scope", F.coalesce("cat_id", F.lit(-1)).alias("cat_id"), "text_id", "tuple")


# ---- groups


def tied(ties: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, text_id, tuple, group: distinct (text, tuple) ties joined to groups by what they share, in turn.

    A group is named by its least text; rounds go on until nothing changes, each over the distinct ties only.
    """
    state = cut(ties.withColumn("group", F.col("text_id")))
    while True:
        by_tuple = state.groupBy(*keys, "tuple").agg(F.min("group").alias("__t"))
        by_text = state.groupBy(*keys, "text_id").agg(F.min("group").alias("__x"))
        met = state.join(by_tuple, [*keys, "tuple"]).join(by_text, [*keys, "text_id"])
        new = cut(met.select(*keys, "text_id", "tuple", "group", F.least("__t", "__x").alias("__g")))
        moved = new.where("__g <> group").limit(1).count()
        state = new.select(*keys, "text_id", "tuple", F.col("__g").alias("group"))
        if not moved:
            return state


def grouped(df: DataFrame, **columns: str) -> DataFrame:
    """id, scope, cat_id, group_id: every record that takes part with the integer of its group."""
    rows = cut(encode(df, **columns))
    keys = ["scope", "cat_id"]
    # texts tied to each other through equal tuples; a text without fields, or with fields of its own only, is its own group
    ties = rows.where(F.col("tuple").isNotNull()).select(*keys, "text_id", "tuple").distinct()
    groups_ = tied(ties, keys).groupBy(*keys, "text_id").agg(F.min("group").alias("__g")).where("__g <> text_id")
    met = lookup_join(rows, groups_, [*keys, "text_id"], "left", hot_keys(rows, [*keys, "text_id"]))
    return met.select("id", *keys, F.coalesce("__g", "text_id").alias("group_id"))


KEYS = ["scope", "cat_id", "group_id"]


def groups(rows: DataFrame) -> DataFrame:
    """scope, cat_id, group_id, first_id, n_copies; counted before the shuffle."""
    return rows.groupBy(*KEYS).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))


def copy_pairs(df: DataFrame, **columns: str) -> DataFrame:
    """first_id, copy_id: each copy with the smallest id of its group."""
    rows = grouped(df, **columns)
    many = groups(rows).where("n_copies > 1").drop("n_copies")
    return lookup_join(rows, many, KEYS, "inner", hot_keys(rows, KEYS)).where("id <> first_id").select("first_id", F.col("id").alias("copy_id")).distinct()


def collapse(df: DataFrame, **columns: str) -> DataFrame:
    """first_id, n_copies: one row per group."""
    return groups(grouped(df, **columns)).select("first_id", "n_copies")
