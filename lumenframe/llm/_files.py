"""Files under a URI that driver and executors share, whatever store it is in."""

from __future__ import annotations

import posixpath

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and the path within it; a path without a scheme is a local one."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Staged:
    """Writes to a temporary name and takes the final one when all is written."""

    def __init__(self, folder: str, name: str, attempt: str) -> None:
        self.fs, base = at(folder)
        self.fs.create_dir(base, recursive=True)
        self.final, self.temporary = posixpath.join(base, name), posixpath.join(base, f".{name}.{attempt}.tmp")
        self.out = self.fs.open_output_stream(self.temporary, compression=None)

    def write(self, raw: bytes) -> None:
        self.out.write(raw)

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.final)

    def abort(self) -> None:
        self.out.close()
        self.fs.delete_file(self.temporary)
