"""Files that tasks write and read in the shared folder, whatever store it is in."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs as arrow_fs


def opened(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a uri or an absolute path (local, HDFS, S3, GCS)."""
    return arrow_fs.FileSystem.from_uri(uri)


@contextmanager
def written(uri: str):
    """An output stream whose file appears under its name only when it is complete.

    A task that is lost or tried again leaves no half file and replaces its own.
    """
    store, path = opened(uri)
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(draft, compression=None) as out:
        yield out
    store.move(draft, path)


def read_bytes(uri: str) -> bytes:
    store, path = opened(uri)
    with store.open_input_file(path) as source:
        return source.read()
