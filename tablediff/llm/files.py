"""Files in the shared folder, through whatever file system its address names."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class Replaced:
    """A file that appears under its name when it is complete; a retried task replaces it with the same."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.tmp)
        self.write = self.out.write

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.tmp, self.path)
