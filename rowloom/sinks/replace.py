"""Replace a table or folder in two phases, so that no failure leaves less than was there."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from rowloom.sources.files import _hadoop, exists, holds, qualified

# Hidden names beside the target: being written, whole but not in place yet, moved out of the way.
WRITING, READY, OLD = "writing", "ready", "old"


def _beside(path: str, state: str, run: str) -> str:
    folder, name = posixpath.split(path.rstrip("/"))
    return f"{folder}/.rowloom-{run}-{state}-{name}"


@contextmanager
def replacing(spark: SparkSession, path: str) -> Iterator[str]:
    """Give a hidden folder beside ``path`` to write to, and put it in the place of ``path`` at the end.

    The new content is renamed once it is whole, what was there is moved aside, the new one moved
    in, and only then is the old one deleted.  A write that fails leaves ``path`` as it was; one
    that dies between the two moves is finished by ``settle``.  On stores without atomic renames
    the moves are copies, the order is the same.
    """
    path = qualified(spark, path)
    settle(spark, path)
    run = uuid.uuid4().hex
    writing, ready, old = (_beside(path, state, run) for state in (WRITING, READY, OLD))
    try:
        yield writing
    except BaseException:
        _delete(spark, writing)
        raise
    _move(spark, writing, ready)
    if exists(spark, path):
        _move(spark, path, old)
    try:
        _move(spark, ready, path)
    except BaseException:
        if exists(spark, old) and not exists(spark, path):
            _move(spark, old, path)
        raise
    _delete(spark, old)
    spark.catalog.refreshByPath(path)


def settle(spark: SparkSession, path: str) -> None:
    """Finish a replacement that died between its two moves; nothing is done while ``path`` exists."""
    path = qualified(spark, path)
    if exists(spark, path):
        return
    folder, name = posixpath.split(path)
    for state in (READY, OLD):
        left = holds(spark, folder, f".rowloom-{'[0-9a-f]' * 32}-{state}-{''.join('[' + c + ']' if c in '*?[' else c for c in name)}")
        if left:
            _move(spark, left[0], path)
            return


def _move(spark: SparkSession, source: str, target: str) -> None:
    filesystem, from_path = _hadoop(spark, source)
    if not filesystem.rename(from_path, _hadoop(spark, target)[1]):
        raise OSError(f"{source} cannot be moved to {target}")


def _delete(spark: SparkSession, path: str) -> None:
    filesystem, jvm_path = _hadoop(spark, path)
    filesystem.delete(jvm_path, True)


def refuse_sources_in(spark: SparkSession, sources: list[str], path: str) -> None:
    """Refuse to replace a folder that holds one of the files which are read."""
    target = qualified(spark, path)
    for source in sources:
        plain = qualified(spark, unquote(source))
        if plain == target or plain.startswith(target + "/"):
            raise ValueError(f"{path} and the source {plain} overlap")


def sources_of(df: DataFrame) -> list[str]:
    """Files that the plan of ``df`` reads."""
    return list(df.inputFiles())
