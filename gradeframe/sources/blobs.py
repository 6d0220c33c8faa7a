"""Files that tasks write to the shared folder and other tasks read."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def _write(uri: str, data: bytes) -> None:
    files, path = pafs.FileSystem.from_uri(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(path) as out:
        out.write(data)


def write_blob(folder: str, data: bytes) -> str:
    """Write a new file below a folder that all executors share; its address.

    The name is the attempt's own, so a repeated task never meets what a lost one has left.
    """
    uri = f"{folder}/{uuid.uuid4().hex}"
    _write(uri, data)
    return uri


def write_text(uri: str, text: str) -> None:
    """Write a file under a name of its own; a task that comes again writes the same."""
    _write(uri, text.encode())


def read_blob(uri: str) -> bytes:
    files, path = pafs.FileSystem.from_uri(uri)
    with files.open_input_stream(path) as source:
        return source.read()
