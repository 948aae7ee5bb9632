"""Small text files of a deployment (rules, maps), on a local disk or any file system that Spark reads."""

from __future__ import annotations

import hashlib
from pathlib import Path, PurePosixPath

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class LocalFiles:
    """Paths are strings; a stamp changes with a file's content."""

    def list(self, folder: str, suffix: str) -> list[str]:
        return sorted(str(p) for p in Path(folder).rglob(f"*{suffix}") if p.is_file())

    def stamps(self, paths: list[str]) -> dict[str, str]:
        """Of those paths that exist."""
        return {p: hashlib.sha256(Path(p).read_bytes()).hexdigest() for p in paths if Path(p).exists()}

    def read(self, path: str) -> str:
        return Path(path).read_text()

    def write(self, path: str, text: str) -> None:
        Path(path).write_text(text)

    def delete(self, path: str) -> None:
        Path(path).unlink()


class SharedFiles:
    """Files below a URI. Folders are listed by Spark's own reader of binary files; a stamp is the time of the last change, and the length."""

    def __init__(self, spark: SparkSession):
        self.spark, self.known = spark, {}

    def list(self, folder: str, suffix: str) -> list[str]:
        if not self._path(folder)[1].exists(self._path(folder)[0]):
            return []
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder)
        rows = files.select("path", F.unix_micros("modificationTime").alias("t"), "length").collect()
        self.known |= {r["path"]: f"{r['t']} {r['length']}" for r in rows}
        return sorted(r["path"] for r in rows)

    def stamps(self, paths: list[str]) -> dict[str, str]:
        out = {}
        for p in paths:
            path, fs = self._path(p)
            if p in self.known:
                out[p] = self.known[p]
            elif fs.exists(path):
                status = fs.getFileStatus(path)
                out[p] = f"{status.getModificationTime() * 1000} {status.getLen()}"
        self.known = {}  # they hold for one listing
        return out

    def read(self, path: str) -> str:
        at, fs = self._path(path)
        stream = fs.open(at)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        at, fs = self._path(path)
        out = fs.create(at, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def delete(self, path: str) -> None:
        at, fs = self._path(path)
        fs.delete(at, False)

    def _path(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


def files_of(folder: str) -> LocalFiles | SharedFiles:
    """By the folder's form: a URI is read through the active Spark session."""
    if "://" not in folder and not folder.startswith("file:/"):
        return LocalFiles()
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise ValueError(f"{folder} needs a Spark session")
    return SharedFiles(spark)


def sibling(folder: str, path: str, suffix: str) -> str:
    """The file in `folder` that is named like the one at `path` but for the suffix."""
    return f"{folder.rstrip('/')}/{PurePosixPath(path).with_suffix(suffix).name}"
