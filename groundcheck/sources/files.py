"""Small driver-side documents: JSON objects, hashes, atomic writes."""

from __future__ import annotations

import csv
import hashlib
import json
import os
from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from pathlib import Path
from typing import IO, Any


def sha256(path: str | Path) -> str:
    """Of the raw bytes; line ends are never changed."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def read_object(path: str | Path) -> dict[str, Any]:
    try:
        value = json.loads(Path(path).read_text("utf-8"))
    except json.JSONDecodeError as error:
        raise ValueError(f"invalid JSON in {path}") from error
    if not isinstance(value, dict):
        raise ValueError(f"{path} must hold a JSON object")
    return value


@contextmanager
def atomic(path: str | Path) -> Iterator[IO[str]]:
    """A file to write to, beside the target, which takes its place at the end: readers see all or nothing."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{os.getpid()}.part")
    try:
        with part.open("w", encoding="utf-8", newline="") as f:
            yield f
        part.replace(path)
    finally:
        part.unlink(missing_ok=True)


def write_atomic(path: str | Path, text: str) -> None:
    with atomic(path) as f:
        f.write(text)


def write_object(path: str | Path, value: Mapping[str, Any]) -> None:
    write_atomic(path, json.dumps(value, ensure_ascii=False, indent=2) + "\n")


def write_csv(path: str | Path, fields: Sequence[str], rows: Iterable[Mapping[str, Any]]) -> None:
    """A fixed header; other keys are left out and None is empty."""
    with atomic(path) as f:
        out = csv.DictWriter(f, fields, extrasaction="ignore")
        out.writeheader()
        out.writerows(rows)


def missing(paths: Iterable[str | Path]) -> list[str]:
    return [str(p) for p in paths if not Path(p).exists()]
