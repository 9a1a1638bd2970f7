"""Files that tasks write to and read from shared storage, by URI (file, hdfs, s3, gs: what pyarrow.fs can open)."""

from __future__ import annotations

import uuid


def opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def ensure_folder(uri: str) -> None:
    system, path = opened(uri)
    system.create_dir(path, recursive=True)


def fresh_name(folder: str, stem: str, suffix: str) -> str:
    """A name no other attempt of the task uses: a table of names that Spark commits tells which files count."""
    return f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"


def write_bytes(uri: str, data: bytes) -> None:
    system, path = opened(uri)
    with system.open_output_stream(path, compression=None) as out:
        out.write(data)


def read_bytes(uri: str) -> bytes:
    system, path = opened(uri)
    with system.open_input_stream(path, compression=None) as source:
        return source.read()
