"""Files written and read inside tasks, on any store that pyarrow can open."""

from __future__ import annotations

import uuid

from pyarrow import fs


#: Hadoop's names of stores and those that pyarrow knows.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def locate(uri: str):
    """The file system and the path in it of a URI or a plain local path."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    scheme, colon, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}") if colon else (fs.LocalFileSystem(), uri)


def attempt_name(stem: str, suffix: str) -> str:
    """A name no other attempt of the same task uses.

    A repeated or speculative task writes files of its own; which files count
    is decided by the manifest rows that Spark keeps of the successful one.
    """
    return f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"


def write_file(uri: str, parts) -> int:
    """Write the byte strings ``parts``; returns the number of bytes."""
    store, path = locate(uri)
    size = 0
    with store.open_output_stream(path) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    return size
