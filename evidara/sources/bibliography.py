"""Reference entries from registry answers (JSON of a DOI registry) as BibTeX, checked by their titles."""

from __future__ import annotations

import re

# Entry kind of each kind of work that registries name; anything else is misc.
ENTRY = {"journal-article": "article", "proceedings-article": "inproceedings", "book": "book", "book-chapter": "incollection", "report": "techreport", "dissertation": "phdthesis"}


def first(value) -> str:
    return str(value[0] if isinstance(value, list) and value else value or "").strip()


def entry(key: str, work: dict) -> str:
    """BibTeX of a work; absent fields are left out, braces are balanced by removal."""
    people = [", ".join(x for x in (p.get("family"), p.get("given")) if x) or p.get("name", "") for p in work.get("author") or []]
    year = ((work.get("issued") or {}).get("date-parts") or [[None]])[0][0] or work.get("publicationYear")
    fields = {
        "author": " and ".join(p for p in people if p), "title": first(work.get("title")), "journal": first(work.get("container-title")), "year": str(year or ""),
        "volume": first(work.get("volume")), "number": first(work.get("issue")), "pages": first(work.get("page")).replace("-", "--"), "publisher": first(work.get("publisher")), "doi": first(work.get("DOI")),
    }
    lines = [f"  {k} = {{{re.sub('[{}]', '', v)}}}," for k, v in fields.items() if v]
    return "\n".join([f"@{ENTRY.get(work.get('type', ''), 'misc')}{{{key},", *lines, "}"])
