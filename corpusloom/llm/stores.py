"""Files of any store that executors can open: the shared folder's file system through pyarrow."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    path = uri.removeprefix("file:") if uri.startswith("file:") else uri
    if "://" not in uri or path is not uri:  # file:/x, file:///x or a plain path
        return fs.LocalFileSystem(), f"/{path.lstrip('/')}"
    return fs.FileSystem.from_uri(uri)


class AtomicFile:
    """A file that appears under its name only when it is whole, so that a task that runs twice leaves one file."""

    def __init__(self, uri: str):
        self.store, self.path = opened(uri)
        folder = self.path.rsplit("/", 1)[0]
        self.store.create_dir(folder, recursive=True)
        self.temp = f"{folder}/_temp-{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.temp, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        """Give the file its name. What a first attempt of the task has put there goes first: not every store replaces a
        file when another one is moved there."""
        self.out.close()
        if self.store.get_file_info(self.path).type != fs.FileType.NotFound:
            self.store.delete_file(self.path)
        self.store.move(self.temp, self.path)


def open_input(uri: str):
    """A random-access file."""
    store, path = opened(uri)
    return store.open_input_file(path)
