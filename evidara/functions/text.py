"""Text normalisation: placeholders, accents, subject leaves, white space, titles."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders that stand for a missing value in the decision summaries.
PLACEHOLDERS = ("", "none", "null", "nan", "-")

# White space that SQL's trim takes off.
SPACES = "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) == "Zs")


def _composed(s: str | None) -> str | None:
    """NFC without combining marks of any kind."""
    return s if s is None or s.isascii() else unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c)[0] != "M"))


# Marks and what is made with them, in the planes that have any; composed Hangul is not among them.
_BARE = {c: _composed(c) for c in map(chr, (*range(0x80, 0x30000), *range(0xE0000, 0xE0200))) if unicodedata.category(c)[0] == "M" or unicodedata.decomposition(c)[:1].isalnum()}
_MARKED = sorted(_BARE, key=lambda c: (not _BARE[c], c))  # what leaves nothing comes last
_PLAIN = "".join(_BARE[c] for c in _MARKED)
#: Where loose Hangul letters follow each other that NFC composes.
JAMO = "[\u1100-\u1112\uac00-\ud7a3][\u1161-\u1175\u11a8-\u11c2]"


def fold_accents(value: Column) -> Column:
    """Letters of any script without their accents, inside code generation; loose marks go, Hangul is not composed."""
    return F.translate(value, "".join(_MARKED), _PLAIN)


def each(make: Callable, returns: str) -> Callable[[Column], Column]:
    """A Column function that applies make to each value, an Arrow batch at a time; made when called, as it needs a session."""

    def mapped(batch):
        return batch.map(make)

    mapped.__annotations__ = {"batch": pd.Series, "return": pd.Series}

    def column(value: Column) -> Column:
        return F.pandas_udf(mapped, returns)(value)

    column.__doc__ = make.__doc__
    return column


def _marks(s: str | None) -> str | None:
    """NFD without combining marks, for text of any script."""
    return None if s is None else "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")


def _ascii(s: str | None) -> str | None:
    """NFKD without anything beyond ASCII."""
    return None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()


_decomposed_column, _composed_column, to_ascii = each(_marks, "string"), each(_composed, "string"), each(_ascii, "string")


def strip_marks(value: Column, sql: bool = False) -> Column:
    """NFD without nonspacing marks, for text of any script; with sql, as strip_accents has it, NFC without marks of any kind."""
    return (_composed_column if sql else _decomposed_column)(value)


def trimmed(value: Column) -> Column:
    """Without spaces of any width at the ends, as SQL's trim has it: no tabs, no newlines."""
    plain, wide = F.trim(value), SPACES.replace(" ", "")
    # Trimming a set of characters takes several times a text's memory, so only texts that need it get it.
    return F.when(F.substring(plain, 1, 1).isin(*wide) | F.substring(plain, -1, 1).isin(*wide), F.trim(plain, F.lit(SPACES))).otherwise(plain)


def clean(value: Column) -> Column:
    """Trimmed, null for the empty text, None and null as written."""
    v = trimmed(value.cast("string"))
    return F.when(~v.isin("", "None", "null"), v)


def clean_placeholder(value: Column) -> Column:
    """Trimmed, null for PLACEHOLDERS in any case."""
    v = trimmed(value.cast("string"))
    return F.when(~F.lower(v).isin(*PLACEHOLDERS), v)


def subject_leaves(value: Column) -> Column:
    """Leaf codes joined by ';', each once and in order: last parts of dotted paths, else parts between ';' and ','."""
    s = clean(value)
    dotted = F.transform(F.filter(F.split(s, ","), lambda p: p.rlike(r"[^.\s]")), lambda p: F.element_at(F.filter(F.split(F.trim(p), r"\."), lambda x: x != ""), -1))
    plain = F.transform(F.split(s, "[;,]"), lambda p: F.trim(p))
    leaves = F.filter(F.when(F.contains(s, F.lit(".")), dotted).otherwise(plain), lambda x: x.rlike(r"^\d+$"))
    codes = F.array_distinct(F.transform(leaves, lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")))
    return F.when(F.size(codes) > 0, F.array_join(codes, ";"))


def collapse(value: Column, sql: bool = False) -> Column:
    """Runs of white space as one space, none at the ends; with sql, runs of what \\s is in RE2: ASCII, without the vertical tab."""
    return trimmed(F.regexp_replace(value, r"[\t\n\f\r ]+" if sql else r"(?U)\s+", " "))


def file_key(path: Column) -> Column:
    """The first six to eight digits of a file's name."""
    key = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"\d{6,8}", 0)
    return F.when(key != "", key)


def document_id(key: Column, seq: Column) -> Column:
    return F.concat_ws("-", key, seq.cast("string"))


def document_parts(doc_id: Column) -> Column:
    """Struct key, seq of a document id; the last '-' parts them."""
    return F.struct(F.regexp_extract(doc_id, "^(.*)-([^-]*)$", 1).alias("key"), F.regexp_extract(doc_id, "^(.*)-([^-]*)$", 2).try_cast("bigint").alias("seq"))


def title_matches(a: Column, b: Column) -> Column:
    """Whether one title holds the other, or they share 60 % of the words of the shorter one; null without a first title."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9]+", " "))
    x, y = plain(a), F.coalesce(plain(b), F.lit(""))
    u, v = F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))
    share = F.size(F.array_intersect(u, v)) / F.greatest(F.least(F.size(u), F.size(v)), F.lit(1))
    return F.when(a != "", (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x) | (share >= 0.6)))
