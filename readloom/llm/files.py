"""Binary files in the shared folder, written by tasks under names of their own and known through a manifest.

A task writes each file under a name that no other attempt uses and reports it as a row of its output. Only
the rows of successful attempts reach the manifest, so a file that a lost or repeated attempt left is never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def write_file(folder: str, data: bytes, suffix: str) -> str:
    """Write a new file under ``folder`` (a path or URI); returns its name."""
    name = f"{uuid.uuid4().hex}{suffix}"
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(data)
    return name


def read_file(folder: str, name: str) -> bytes:
    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{path}/{name}") as source:
        return source.read()
