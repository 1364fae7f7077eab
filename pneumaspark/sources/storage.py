"""Files of Python data sources: paths, listings and manifests through ``pyarrow.fs``.

A path may be local, or a URI that ``pyarrow.fs`` knows (file, hdfs, s3, gs).  A folder
written by one of the data sources holds ``_files.json``, the names that the driver
committed; only those are listed, so what a failed attempt left behind is never read.
"""

from __future__ import annotations

import json
import posixpath
from fnmatch import fnmatch

from pyarrow import fs

MANIFEST = "_files.json"


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what a path in it needs before it to be a URI again)."""
    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:"), "file://"
    system, inner = fs.FileSystem.from_uri(path)
    at = path.find(inner)
    return system, inner, path[:at] if at > 0 else path.partition("://")[0] + "://"


def listed(path: str) -> list[tuple[str, int]]:
    """(URI, bytes) of a file, of a folder's files, or of the files that a pattern with ``*`` or ``?`` in its last part names; in order of name."""
    system, inner, before = opened(path)
    inner = inner.rstrip("/")
    folder, last = posixpath.split(inner)
    if any(c in last for c in "*?["):
        found = [f for f in system.get_file_info(fs.FileSelector(folder)) if fnmatch(f.base_name, last)]
    else:
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info]
        if info.type == fs.FileType.Directory:
            found = system.get_file_info(fs.FileSelector(inner))
            if any(f.base_name == MANIFEST for f in found):
                with system.open_input_stream(f"{inner}/{MANIFEST}") as source:
                    names = set(json.loads(source.read()))
                found = [f for f in found if f.base_name in names]
    files = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted((before + f.path, f.size) for f in files)


def commit(path: str, names: list[str]) -> None:
    """Add names to a folder's manifest."""
    system, inner, _ = opened(path)
    inner = inner.rstrip("/")
    system.create_dir(inner, recursive=True)
    place = f"{inner}/{MANIFEST}"
    if system.get_file_info(place).type == fs.FileType.File:
        with system.open_input_stream(place) as source:
            names = [*json.loads(source.read()), *names]
    with system.open_output_stream(place) as out:
        out.write(json.dumps(sorted(names)).encode())


def remove(path: str, names: list[str]) -> None:
    system, inner, _ = opened(path)
    for name in names:
        place = f"{inner.rstrip('/')}/{name}"
        if system.get_file_info(place).type == fs.FileType.File:
            system.delete_file(place)
