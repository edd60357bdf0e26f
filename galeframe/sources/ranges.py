"""Byte ranges of files on any file system, for readers that run on the executors."""

from __future__ import annotations

import pyarrow.fs


def system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" not in path and not path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


class Ranges:
    """A file of which only the asked ranges are read."""

    def __init__(self, path: str):
        fs, at = system(path)
        self.path, self.file = path, fs.open_input_file(at)
        self.size = self.file.size()

    def read(self, start: int, size: int) -> bytes:
        got = self.file.read_at(size, start)
        if len(got) < size:
            raise EOFError(f"{self.path} ends at {self.size}, asked for {size} bytes at {start}")
        return got

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def exists(path: str) -> bool:
    fs, at = system(path)
    return fs.get_file_info(at).type == pyarrow.fs.FileType.File


def yearly_files(root: str, years: list[int], names: list[str], missing: str = "error") -> dict[int, str]:
    """Year -> file: the first of the names (with {year}) that exists. missing: error, or skip."""
    found = {}
    for year in years:
        path = next((p for p in (f"{root.rstrip('/')}/{n.format(year=year)}" for n in names) if exists(p)), None)
        if path:
            found[year] = path
        elif missing != "skip":
            raise FileNotFoundError(f"none of {names} for {year} in {root}")
    return found


def write(path: str, data: bytes) -> None:
    fs, at = system(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at) as out:
        out.write(data)
