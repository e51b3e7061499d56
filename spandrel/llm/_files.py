"""Files that executors write and read by URI, in any store that Arrow knows (file, hdfs, s3, gs)."""

from __future__ import annotations

import posixpath

from pyarrow import fs


def store(uri: str):
    """The file system of a URI, and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def create(uri: str):
    files, path = store(uri)
    files.create_dir(posixpath.dirname(path), recursive=True)
    return files.open_output_stream(path, compression=None)  # a name ending in .zst would be compressed again


def open_input(uri: str):
    files, path = store(uri)
    return files.open_input_file(path)
