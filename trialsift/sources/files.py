"""Small driver-side helpers on the file system of the lake (metadata only)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

_GLOB = re.compile(r"([\\{}\[\]*?])")
# Characters Java leaves alone in a URI path.
_URI_SAFE = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789/_-!.~'()*,;:$&+=@")


def escape_glob(path: str) -> str:
    """Path with glob characters escaped, for readers that expand patterns."""
    return _GLOB.sub(r"\\\1", path)


def encoded(path: str) -> str:
    """Path as it appears in ``_metadata.file_path``."""
    return "".join(
        c if c in _URI_SAFE or ord(c) > 127 else f"%{ord(c):02X}" for c in path
    )


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def glob(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """Sorted (path, length) of everything matching a pattern; files and directories."""
    p, fs = _fs(spark, pattern)
    found = fs.globStatus(p)
    return sorted((s.getPath().toString(), int(s.getLen())) for s in (found or []))


def size_of(spark: SparkSession, path: str) -> int:
    p, fs = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength())


def delete(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return bool(fs.delete(p, True))


def make_folder(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.mkdirs(p)


def rename(spark: SparkSession, path: str, target: str) -> None:
    p, fs = _fs(spark, path)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"could not move {path} to {target}")


class _Whole:
    """Output stream whose file gets its name when it is closed."""

    def __init__(self, path: str):
        from pyarrow import fs

        local = re.sub(r"^file:/+", "/", path)
        if "://" in local:
            self.fs, self.path = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", local))
        else:
            self.fs, self.path = fs.LocalFileSystem(), local
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.stream = self.fs.open_output_stream(self.part)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.part, self.path)


def open_for_writing(path: str) -> _Whole:
    """A new file on a file system that pyarrow knows, for use inside a task.

    It is written under another name and moved at the end, so that a lost or repeated task leaves either
    nothing or the whole file.
    """
    return _Whole(path)
