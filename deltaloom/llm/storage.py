"""Binary files in the shared store, written by executors through Arrow's file systems."""

from __future__ import annotations

import re

from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        path = re.sub(r"^file:/+", "file:///", path)
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class publish:
    """A file that appears under its name only once it is whole.

    A lost or repeated attempt leaves at most a hidden file, never half of a visible one;
    only paths that a finished task returns are read later.
    """

    def __init__(self, folder: str, name: str):
        self.folder, self.name = folder.rstrip("/"), name

    def open(self):
        self.store, path = _at(self.folder)
        self.store.create_dir(path, recursive=True)
        self.temp, self.final = f"{path}/.{self.name}", f"{path}/{self.name}"
        return self.store.open_output_stream(self.temp, compression=None)

    def done(self) -> str:
        self.store.move(self.temp, self.final)
        return f"{self.folder}/{self.name}"


def open_input(path: str):
    store, at = _at(path)
    return store.open_input_file(at)


class _File:
    def __init__(self, path: str):
        self.store, self.path = _at(path)

    def delete(self) -> None:
        self.store.delete_file(self.path)


def list_files(paths: list[str]) -> list[_File]:
    return [_File(p) for p in paths]
