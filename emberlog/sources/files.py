"""Files opened by tasks that read them a part at a time."""

from __future__ import annotations


def file_system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
