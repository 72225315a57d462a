"""Files of tasks in the shared folder: written under a name of the attempt, then moved to their own name.

A task that runs again writes the same file again, so a lost executor leaves no half file and no second one.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)  # as Hadoop writes it
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file://{uri}")


@contextmanager
def replaced(uri: str) -> Iterator[pa.NativeFile]:
    """A stream whose file takes its name when the block ends well."""
    files, path = opened(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(own) as out:
        yield out
    files.move(own, path)


class Ranged:
    """Numbers of a file that can't be mapped: a slice reads its own range."""

    def __init__(self, files: pafs.FileSystem, path: str, kind: str):
        self.file, self.kind = files.open_input_file(path), np.dtype(kind)
        self.size = self.file.size() // self.kind.itemsize

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, span: slice) -> np.ndarray:
        a, b, _ = span.indices(self.size)
        n = max(0, b - a) * self.kind.itemsize
        return np.frombuffer(self.file.read_at(n, a * self.kind.itemsize), self.kind)


def mapped(uri: str, kind: str) -> np.ndarray | Ranged:
    """A file's numbers: memory-mapped where the folder is a local path, else read as they are asked for."""
    files, path = opened(uri)
    if not files.get_file_info(path).size:
        return np.empty(0, kind)
    return np.memmap(path, kind, "r") if isinstance(files, pafs.LocalFileSystem) else Ranged(files, path, kind)
