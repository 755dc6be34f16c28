"""Staging of published files before Spark reads them: catalogue entries, resumable downloads, a thread for each connection."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from urllib.parse import urlsplit
from urllib.request import urlopen

Opener = Callable[[str], "object"]


def resources(answer: str | dict, formats: tuple[str, ...] = ("json", "zip", "csv")) -> Iterator[dict]:
    """name, url and size of the files that a catalogue's package description lists, of the wanted formats."""
    package = json.loads(answer) if isinstance(answer, str) else answer
    if not package.get("success", True):
        raise ValueError("the catalogue refused the request")
    for r in package.get("result", package).get("resources") or []:
        url = r.get("url") or ""
        kind = (r.get("format") or url.rsplit(".", 1)[-1]).lower()
        if url and kind in formats:
            yield {"name": urlsplit(url).path.rsplit("/", 1)[-1], "url": url, "size": int(r["size"]) if str(r.get("size") or "").isdigit() else None}


def download(url: str, to: Path, size: int | None = None, opener: Opener = urlopen, chunk: int = 1 << 20) -> bool:
    """Fetch url unless `to` is there (and has the size, where one is known); a part file becomes `to` only when whole."""
    if to.exists() and (size is None or to.stat().st_size == size):
        return False
    to.parent.mkdir(parents=True, exist_ok=True)
    part = to.with_name(to.name + ".part")
    with opener(url) as answer, part.open("wb") as out:
        while data := answer.read(chunk):
            out.write(data)
    if size is not None and part.stat().st_size != size:
        raise OSError(f"{url}: {part.stat().st_size} bytes instead of {size}")
    part.replace(to)
    return True


def download_all(files: Iterable[dict], folder: Path, connections: int = 6, opener: Opener = urlopen) -> dict[str, str]:
    """Outcome by name: new, kept, or the error; one failure does not stop the others."""

    def one(f: dict) -> tuple[str, str]:
        try:
            return f["name"], "new" if download(f["url"], folder / f["name"], f.get("size"), opener) else "kept"
        except OSError as e:
            return f["name"], f"error: {e}"

    with ThreadPoolExecutor(connections) as pool:
        return dict(pool.map(one, files))
