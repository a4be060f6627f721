"""Plain files in the shared folder, written and read by executors through Arrow's file systems.

A path is a URI (file://, hdfs://, s3://, gs:// ...) or an absolute path. Each attempt of a task
writes a name of its own; what counts is named by the manifest row the attempt committed.
"""

from __future__ import annotations

from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def write_bytes(path: str, data: bytes) -> None:
    with open_out(path) as f:
        f.write(data)


def open_out(path: str):
    files, at = _at(path)
    files.create_dir(at.rsplit("/", 1)[0], recursive=True)
    return files.open_output_stream(at, compression=None)


def open_in(path: str):
    files, at = _at(path)
    return files.open_input_stream(at, compression=None)


def read_bytes(path: str) -> bytes:
    with open_in(path) as f:
        return f.read()
