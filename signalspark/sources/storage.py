"""Files by path or address: local paths, and what pyarrow can open (file://, hdfs://, s3://, gs:// ...)."""

from __future__ import annotations

import fnmatch
import posixpath
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual


def place(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it)."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def files(path: str) -> list[str]:
    """The files of a folder (hidden ones left out), of a pattern in the last part, or the file itself, as they can be opened."""
    head, tail = path.rsplit("/", 1) if "/" in path else (".", path)
    pattern = tail if any(c in tail for c in "*?[") else None
    system, at = place(head if pattern else path)
    scheme = path.split("://", 1)[0] + "://" if "://" in path else ""
    host = path[len(scheme) :].split("/", 1)[0] if scheme and not at.startswith(path[len(scheme) :].split("/", 1)[0]) else ""
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    found = [f.path for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted(f"{scheme}{host}{f}" for f in found if pattern is None or fnmatch.fnmatch(posixpath.basename(f), pattern))


def open_read(path: str):
    """A file object that can seek; nothing is read before it is asked for."""
    system, at = place(path)
    return system.open_input_file(at)


def exists(path: str) -> bool:
    system, at = place(path)
    return system.get_file_info(at).type == fs.FileType.File


class Wanted:
    """What pushed filters leave of paths, channels and times of rows; Spark applies the filters again."""

    def __init__(self, filters=()):
        self.names: dict[str, set] = {}
        self.low = self.high = None
        for f in filters:
            column = getattr(f, "attribute", ("",))[0]
            if column in ("chan", "path", "name", "type") and isinstance(f, EqualTo | In):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.names[column] = self.names.get(column, values) & values
            if column == "start" and isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | EqualTo) and isinstance(f.value, datetime):
                at = f.value if f.value.tzinfo else f.value.replace(tzinfo=timezone.utc)
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.low = at if self.low is None else max(self.low, at)
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.high = at if self.high is None else min(self.high, at)

    def takes(self, column: str, value) -> bool:
        return column not in self.names or value in self.names[column]

    def rows(self, start: datetime, seconds: float, n: int) -> range:
        """Of ``n`` rows that begin at ``start`` and every ``seconds`` after, those that may be asked for."""
        a, b = 0, n
        if self.low is not None:
            a = max(0, int((self.low - start).total_seconds() / seconds))
        if self.high is not None:
            b = min(n, int((self.high - start).total_seconds() / seconds) + 1)
        return range(a, max(a, b))
