"""Whole files in the shared folder, written and read by tasks."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def _open(uri: str):
    if re.match(r"file:/(?!/)", uri):
        uri = uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def put(folder: str, name: str, parts) -> int:
    """Write the parts as one file. A task that runs twice replaces it by the same bytes;
    readers never see half a file, because it gets its name at the end."""
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    size = 0
    with system.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    try:
        system.move(own, f"{path}/{name}")
    except OSError:  # some stores don't replace
        system.delete_file(f"{path}/{name}")
        system.move(own, f"{path}/{name}")
    return size


def get(folder: str, name: str) -> bytes:
    system, path = _open(folder)
    with system.open_input_stream(f"{path}/{name}") as file:
        return file.read()


class Reader:
    """Ranges of one file at a time."""

    def __init__(self, folder: str):
        self.system, self.path = _open(folder)
        self.name, self.file = None, None

    def read(self, name: str, at: int, size: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.system.open_input_file(f"{self.path}/{name}")
        return self.file.read_at(size, at)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.name = self.file = None
