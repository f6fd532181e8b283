"""Content hashes that don't depend on line ends or formatting."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexidrift.functions.constants import ANCHORS


def canonical_text(text: Column) -> Column:
    """LF line ends and one final line feed, or nothing at all for a text of line feeds only."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n+\z", "")
    return F.when(bare == "", F.lit("")).otherwise(F.concat(bare, F.lit("\n")))


def canonical_text_sha256(text: Column) -> Column:
    """Hash of the canonical text as hexadecimal digits."""
    return F.sha2(canonical_text(text), 256)


def text_sha256(text: str) -> str:
    """The same of a Python string; anything else, such as a path, is refused."""
    if not isinstance(text, str):
        raise TypeError("give the text itself, not where it is")
    bare = text.replace("\r\n", "\n").replace("\r", "\n").rstrip("\n")
    return hashlib.sha256((bare + "\n" if bare else "").encode()).hexdigest()


def json_sha256(value: Any) -> str:
    """Hash of JSON with sorted keys, no blanks and characters as they are."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def file_sha256(path: str | Path, block: int = 1 << 20) -> str:
    """Hash of a file's bytes, read block by block."""
    out = hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(block):
            out.update(data)
    return out.hexdigest()


def text_file_sha256(path: str | Path) -> str:
    """Canonical text hash of a UTF-8 file."""
    return text_sha256(Path(path).read_bytes().decode("utf-8"))


def json_file_sha256(path: str | Path) -> str:
    """Canonical hash of a JSON file."""
    return json_sha256(json.loads(Path(path).read_text(encoding="utf-8")))


def anchors_sha256() -> str:
    """Hash that identifies the anchor list, one anchor on a line."""
    return text_sha256("\n".join(ANCHORS))
