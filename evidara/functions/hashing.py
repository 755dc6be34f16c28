"""Salted pseudonyms, content digests, seeded order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, to_ascii


def _salted(text: Column, salt: bytes, length: int) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(bytearray(salt)), text.cast("binary")), 256), 1, length)


def pseudonym24(name: Column, salt: bytes) -> Column:
    """24 hex digits of a name's ASCII upper-case form, as in document metadata."""
    return _salted(F.upper(to_ascii(clean(name))), salt, 24)


def pseudonym32(name: Column, salt: bytes) -> Column:
    """32 hex digits of a name's trimmed upper-case form, as in links and decision summaries."""
    return F.when(F.length(name) > 0, _salted(F.upper(F.trim(name)), salt, 32))


def content_sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def seeded_order(doc_id: Column, seed: int) -> Column:
    """Pseudo-random position of a document: sha256 of 'seed:doc_id'."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256)


def seeded_md5(seed: str, *key: Column) -> Column:
    """Growth-stable sampling order: md5 of the key columns and the seed, joined by '-'."""
    return F.md5(F.concat_ws("-", *(k.cast("string") for k in key), F.lit(str(seed))).cast("binary"))
