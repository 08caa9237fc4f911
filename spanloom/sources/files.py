"""Small files of a store on any Hadoop file system."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import SparkSession

#: Threads for many small calls to the file system.
THREADS = 16


class Files:
    """put_new is the store's only means of agreement: it makes a file whole or not
    at all, and fails if there is one. On a local disk that is a hard link, elsewhere a
    rename, which HDFS and its like refuse if the target exists."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._path = spark, spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.local = self.fs.getUri().getScheme() == "file"

    def path(self, p: str):
        return self._path(p)

    def plain(self, p: str) -> str:
        return self._path(p).toUri().getPath()

    def read(self, p: str) -> str | None:
        if self.local:
            try:
                return Path(self.plain(p)).read_text()
            except FileNotFoundError:
                return None
        if not self.exists(p):
            return None
        f = self.fs.open(self.path(p))
        try:
            return self._spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")
        finally:
            f.close()

    def _write(self, p: str, text: str) -> None:
        if self.local:
            os.makedirs(os.path.dirname(self.plain(p)), exist_ok=True)
            Path(self.plain(p)).write_text(text)
            return
        out = self.fs.create(self.path(p), True)
        out.write(bytearray(text.encode()))
        out.close()

    def put_new(self, p: str, text: str) -> bool:
        tmp = f"{p}.{uuid.uuid4().hex}.tmp"
        self._write(tmp, text)
        try:
            if not self.local:
                return not self.exists(p) and self.fs.rename(self.path(tmp), self.path(p))
            os.link(self.plain(tmp), self.plain(p))
            return True
        except FileExistsError:
            return False
        finally:
            self.delete([tmp])

    def put(self, p: str, text: str) -> None:
        """Replaces a file."""
        tmp = f"{p}.{uuid.uuid4().hex}.tmp"
        self._write(tmp, text)
        if self.local:
            os.replace(self.plain(tmp), self.plain(p))
            return
        opt = self._spark.sparkContext._gateway.new_array(self._spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        opt[0] = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self._spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri()).rename(self.path(tmp), self.path(p), opt)

    def exists(self, p: str) -> bool:
        return os.path.exists(self.plain(p)) if self.local else self.fs.exists(self.path(p))

    def missing(self, paths: Iterable[str]) -> list[str]:
        with ThreadPoolExecutor(THREADS) as pool:
            paths = list(paths)
            return [p for p, there in zip(paths, pool.map(self.exists, paths), strict=True) if not there]

    def delete(self, paths: Iterable[str]) -> None:
        with ThreadPoolExecutor(THREADS) as pool:
            list(pool.map(lambda p: self.fs.delete(self.path(p), True), paths))

    def listing(self, folder: str) -> list[tuple[str, int, int]]:
        """(name, bytes, time of change in ms) of what lies in a folder."""
        if not self.exists(folder):
            return []
        return [(s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in self.fs.listStatus(self.path(folder))]
