"""Column expressions over text: folds, tokens, terms, relevance, masking."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that an accent-stripping label fold still transliterates (fixed values).
TRANSLITERATION = {
    "æ": "ae", "ð": "d", "ø": "o", "þ": "th", "đ": "d", "ħ": "h", "ı": "i", "ĳ": "ij",
    "ĸ": "q", "ŀ": "l", "ł": "l", "ŋ": "n", "œ": "oe", "ŧ": "t", "ʼ": "'",
}

#: Function words of Portuguese and English that carry no meaning of their own (fixed values).
STOPWORDS_TEXT = """
a as ao aos da das de do dos na nas no nos em um uma uns umas os se ser sao ou que qual quais
quando onde como por pra para pelo pela com sem sobre mais menos muito ja nao sim meu minha
seu sua ele ela eles elas eu tu voce voces isso isto aquilo esse essa este esta aquele aquela
tem ter tenho temos foi era estao ha ate tambem so bem aqui ali la entao qualquer cada
the of and or to for in on at is are was be it this that with from by an my your we you they
does what when where how which who
"""


def _fold_tables(form: str) -> tuple[str, str, dict[str, str]]:
    """Single-letter translations and longer replacements of the Latin blocks, derived from Unicode."""
    one_from, one_to, longer = "", "", {}
    for cp in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00)):
        ch = chr(cp)
        low = ch.lower()
        to = "".join(x for x in unicodedata.normalize(form, ch.casefold()) if not unicodedata.combining(x))
        if len(low) == 1 and low != ch:
            continue  # lower() comes first
        if to == ch:
            continue
        if len(to) == 1:
            one_from, one_to = one_from + ch, one_to + to
        elif form == "NFD" or to.isalnum():
            longer[ch] = to
    return one_from, one_to, longer


def _apply(c: Column, form: str) -> Column:
    one_from, one_to, longer = _fold_tables(form)
    out = F.translate(F.lower(c), one_from, one_to)
    for ch, to in longer.items():
        if ch in "ßŉĳ½¼¾" or form == "NFKD" and ch in "ǆǉǌǳ":
            out = F.replace(out, F.lit(ch), F.lit(to))
    return F.regexp_replace(out, "[\\u0300-\\u036f]", "")


def fold(c: Column) -> Column:
    """Compatibility fold: case, accents and compatibility forms disregarded."""
    return _apply(c, "NFKD")


def fold_label(c: Column) -> Column:
    """Key of a label: case and accents disregarded, letters without decomposition transliterated."""
    out = _apply(c, "NFD")
    ones = {k: v for k, v in TRANSLITERATION.items() if len(v) == 1}
    out = F.translate(out, "".join(ones), "".join(ones.values()))
    for k, v in TRANSLITERATION.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def has_diacritics(c: Column) -> Column:
    return fold_label(c) != F.lower(c)


def tokens(c: Column) -> Column:
    """Runs of two or more ASCII letters and digits of the folded text, a plural s dropped."""
    runs = F.regexp_extract_all(fold(c), F.lit("([a-z0-9]{2,})"), F.lit(1))
    return F.transform(runs, lambda t: F.when((F.length(t) >= 4) & t.endswith("s") & ~t.endswith("ss"), F.left(t, F.length(t) - 1)).otherwise(t))


def _py_tokens(text: str) -> list[str]:
    import re

    folded = "".join(x for x in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(x))
    found = re.findall(r"[a-z0-9]{2,}", folded)
    return [t[:-1] if len(t) >= 4 and t.endswith("s") and not t.endswith("ss") else t for t in found]


STOPWORDS = tuple(sorted(set(_py_tokens(STOPWORDS_TEXT))))


def terms(c: Column, prefix: int = 0) -> Column:
    """The different meaning-carrying tokens, cut to their first ``prefix`` letters where that is not 0."""
    kept = F.filter(tokens(c), lambda t: ~t.isin(*STOPWORDS))
    return F.array_distinct(F.transform(kept, lambda t: F.left(t, F.lit(prefix))) if prefix else kept)


def share(query: Column, candidate: Column) -> Column:
    """Share of the query's terms that the candidate has; 0 for an empty query or a null candidate."""
    return F.when((F.size(query) > 0) & candidate.isNotNull(), F.size(F.array_intersect(query, candidate)) / F.size(query)).otherwise(F.lit(0.0))


#: Masks in the order they are applied (fixed values).
MASKS = (
    (r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", "[CPF MASKED]"),
    (r"\b\d{11}\b", "[CPF MASKED]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[EMAIL MASKED]"),
    (r"\b(?:\+55\s?)?\(?\d{2}\)?\s?9?\d{4}[-\s]?\d{4}\b", "[PHONE MASKED]"),
)


def mask(c: Column) -> Column:
    for pattern, to in MASKS:
        c = F.regexp_replace(c, pattern, to)
    return c


def in_subtree(scope: Column, prefix: str) -> Column:
    """The scope itself or one below it; the prefix is plain text, no pattern."""
    return (scope == prefix) | scope.startswith(prefix + "/")


def squeezed(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))
