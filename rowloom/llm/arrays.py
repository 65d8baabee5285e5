"""Numpy arrays as files in the shared folder, memory-mapped by the tasks that read them."""

from __future__ import annotations

import io
import os
import tempfile
import uuid

import numpy as np


def local_path(path: str) -> str | None:
    """The path as mounted on this machine, None if it is in a store."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


def put_array(path: str, values: np.ndarray) -> None:
    """Write in one step: a task that runs twice leaves one whole file."""
    local = local_path(path)
    if local:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        part = f"{local}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, values)
        os.replace(part, local)
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    data = io.BytesIO()
    np.save(data, values)
    with store.open_output_stream(name) as out:
        out.write(data.getbuffer())


def get_array(path: str) -> np.ndarray:
    """Map the file; from a store it is copied first, and the copy goes with the mapping."""
    local = local_path(path)
    if local:
        return np.load(local, mmap_mode="r")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with tempfile.NamedTemporaryFile() as copy:
        with store.open_input_stream(name) as source:
            while block := source.read(1 << 24):
                copy.write(block)
        copy.flush()
        return np.load(copy.name, mmap_mode="r")
