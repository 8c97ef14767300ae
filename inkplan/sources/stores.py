"""Files as Python workers reach them: by pyarrow's file systems, which know local and mounted folders, HDFS and object stores by their addresses."""

from __future__ import annotations

import fnmatch

from pyarrow import fs


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of an address; a plain path is local."""
    if "://" in address:
        return fs.FileSystem.from_uri(address)
    if address.startswith("file:"):
        return fs.LocalFileSystem(), address.removeprefix("file:")
    return fs.LocalFileSystem(), address


def listed(address: str) -> list[tuple[str, int]]:
    """(path, size) of the files under a folder, or that fit a pattern in the last part of the address, in order."""
    folder, _, last = address.rstrip("/").rpartition("/")
    pattern = last if any(c in last for c in "*?[") else None
    store, path = opened(folder if pattern else address)
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = store.get_file_info(fs.FileSelector(path, recursive=pattern is None))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and (pattern is None or fnmatch.fnmatch(f.base_name, pattern)))
