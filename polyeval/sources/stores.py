"""File systems behind shared folders, for tasks that write files of their own."""

from __future__ import annotations

import pyarrow.fs as pafs


def open_store(root: str):
    """(file system, path) of a folder that driver and executors share."""
    if root.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + root[len("file:"):].lstrip("/")
    if "://" not in root:
        return pafs.LocalFileSystem(), root
    return pafs.FileSystem.from_uri(root)
