"""Files of plain arrays in the shared folder: written by tasks, mapped into memory by the workers that read them."""

from __future__ import annotations

import atexit
import os
import resource
import shutil
import tempfile
import uuid

import numpy as np
from pyarrow import fs

_ALIGN = 64

# Files that a worker keeps open at once: a quarter of what its system allows, and well below the usual limit of maps.
MAX_OPEN_FILES = 16_384


def open_files() -> int:
    allowed = resource.getrlimit(resource.RLIMIT_NOFILE)[0]
    return MAX_OPEN_FILES if allowed == resource.RLIM_INFINITY else max(1, min(allowed // 4, MAX_OPEN_FILES))


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, as Spark writes them, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def write(path: str, arrays: list[np.ndarray]) -> None:
    """Writes arrays one after the other. A repeated task replaces the file by an equal one; no reader sees a part of it."""
    system, place = _open(path)
    system.create_dir(os.path.dirname(place), recursive=True)
    attempt = f"{place}.{uuid.uuid4().hex}"
    header = np.zeros(_ALIGN // 8, np.int64)
    header[: len(arrays)] = [len(a) for a in arrays]
    with system.open_output_stream(attempt) as out:
        out.write(header.tobytes())
        for array in arrays:
            raw = array.tobytes()
            out.write(raw + bytes(-len(raw) % _ALIGN))
    system.move(attempt, place)


_local: dict[str, str] = {}


def mapped(path: str, kinds: list) -> list[np.ndarray]:
    """The arrays of a file, cut out of one map of it, which ends with the last of them. A file on a store that cannot be
    mapped is copied once per worker, and removed when the worker ends. A file that no task wrote holds nothing."""
    system, place = _open(path)
    if not isinstance(system, fs.LocalFileSystem):
        if path not in _local:
            if system.get_file_info(place).type == fs.FileType.NotFound:
                return [np.zeros(0, kind) for kind in kinds]
            folder = tempfile.mkdtemp(prefix="shelf-")
            atexit.register(shutil.rmtree, folder, True)
            _local[path] = os.path.join(folder, "arrays")
            fs.copy_files(place, _local[path], source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
        place = _local[path]
    try:
        whole = np.asarray(np.memmap(place, np.uint8, "r"))
    except FileNotFoundError:
        return [np.zeros(0, kind) for kind in kinds]
    arrays, at = [], _ALIGN
    for kind, n in zip(kinds, whole[:_ALIGN].view(np.int64), strict=False):
        size = int(n) * np.dtype(kind).itemsize
        arrays.append(whole[at : at + size].view(kind))
        at += size + -size % _ALIGN
    return arrays


class Shelf:
    """Files opened when they are asked for, of which at most ``limit`` stay open. Readers go through the files in the same
    order again and again, so the file used last is the one to close: those before it will be asked for sooner."""

    def __init__(self, limit: int | None = None):
        self.limit = open_files() if limit is None else limit
        self._held: dict[str, list[np.ndarray]] = {}
        self._last = ""

    def get(self, path: str, kinds: list) -> list[np.ndarray]:
        if path not in self._held:
            if len(self._held) >= self.limit:
                del self._held[self._last]
            self._held[path] = mapped(path, kinds)
        self._last = path
        return self._held[path]
