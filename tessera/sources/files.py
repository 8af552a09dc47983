"""Opening files of any store that Arrow knows, with decompression by suffix."""

from __future__ import annotations

import bz2
import gzip
import io
import zipfile
from collections.abc import Iterable
from pathlib import PurePosixPath
from typing import BinaryIO

from pyarrow import fs


def _resolve(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def open_raw(path: str) -> BinaryIO:
    system, name = _resolve(path)
    return system.open_input_file(name)


def read_bytes(path: str) -> bytes:
    """Whole content; of a zip the first entry whose name starts with the archive's stem."""
    with open_raw(path) as f:
        data = f.read()
    if path.endswith(".gz"):
        return gzip.decompress(data)
    if path.endswith(".bz2"):
        return bz2.decompress(data)
    if path.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            stem = PurePosixPath(path).stem
            return z.read(next(n for n in z.namelist() if n.startswith(stem)))
    return data


def read_text(path: str) -> str:
    return read_bytes(path).decode("utf-8")


def write_lines(path: str, lines: Iterable[str]) -> None:
    """Line by line, however many there are."""
    system, name = _resolve(path)
    system.create_dir(str(PurePosixPath(name).parent), recursive=True)
    with system.open_output_stream(name, compression=None) as f:
        for line in lines:
            f.write(line.encode("utf-8") + b"\n")


def exists(path: str) -> bool:
    system, name = _resolve(path)
    return system.get_file_info(name).type == fs.FileType.File


def write_bytes(path: str, data: bytes) -> None:
    system, name = _resolve(path)
    system.create_dir(str(PurePosixPath(name).parent), recursive=True)
    with system.open_output_stream(name, compression=None) as f:
        f.write(data)
