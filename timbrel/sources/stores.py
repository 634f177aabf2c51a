"""Files named by a path or an address, through Arrow's file systems."""

from __future__ import annotations

from pyarrow import fs


def reached(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of a folder's own files of that suffix, in order of path; hidden files are passed over."""
    store, at = reached(path)
    here = store.get_file_info(at)
    if here.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [here] if here.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=False))
    names = [(f.path, f.size) for f in found if f.type == fs.FileType.File and (f is here or f.base_name.endswith(suffix) and f.base_name[0] not in "._")]
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    return [(head + name, size) for name, size in sorted(names)]
