"""File formats by name."""

from __future__ import annotations

import logging
import posixpath

log = logging.getLogger(__name__)

FORMATS = ("text", "csv", "parquet")

# File name endings and what they mean.
SUFFIX_FORMATS = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet"}


def is_parquet(path: str) -> bool:
    return SUFFIX_FORMATS.get(_suffix(path)) == "parquet"


def _suffix(path: str) -> str:
    return posixpath.splitext(path.rstrip("/"))[1].lower()


def detect_format(path: str) -> str:
    """Format by file name ending, whatever its case; anything unknown is text."""
    suffix = _suffix(path)
    if suffix not in SUFFIX_FORMATS:
        log.warning("no known format for ending %r of %s, reading it as text", suffix, path)
    return SUFFIX_FORMATS.get(suffix, "text")
