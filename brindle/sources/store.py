"""Files of a table root, through Hadoop's file systems, so any store that Spark reads will do."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Exists(Exception):
    """Another writer put the file first."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._utils = jvm.org.apache.hadoop.io.IOUtils
        self._bytes = jvm.java.io.ByteArrayOutputStream
        self.local = self._fs.getScheme() == "file"

    def at(self, name: str) -> str:
        return name if "://" in name or name.startswith("/") else f"{self.root}/{name}"

    def _p(self, name: str):
        return self._path(self.at(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._p(name))

    def read(self, name: str) -> str:
        with_stream = self._fs.open(self._p(name))
        try:
            out = self._bytes()
            self._utils.copyBytes(with_stream, out, 65536, False)
            return bytes(out.toByteArray()).decode()
        finally:
            with_stream.close()

    def _write(self, name: str, text: str, overwrite: bool) -> None:
        out = self._fs.create(self._p(name), overwrite)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def replace(self, name: str, text: str) -> None:
        self._write(name, text, True)

    def put_new(self, name: str, text: str) -> None:
        """Write a file that must not exist yet; exactly one of several writers succeeds."""
        if self.local:  # the local file system has no atomic create without overwriting: link a finished file
            to = self._p(name).toUri().getPath()
            os.makedirs(os.path.dirname(to), exist_ok=True)
            part = f"{os.path.dirname(to)}/.{uuid.uuid4().hex}"
            with open(part, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(part, to)
            except FileExistsError as e:
                raise Exists(name) from e
            finally:
                os.unlink(part)
            return
        try:
            self._write(name, text, False)
        except Exception as e:
            if self.exists(name):
                raise Exists(name) from e
            raise

    def list(self, name: str, recursive: bool = False) -> list[tuple[str, int, int]]:
        """(path, bytes, modification time) of the files below a folder; none where it is missing."""
        if not self.exists(name):
            return []
        found, out = self._fs.listFiles(self._p(name), recursive), []
        while found.hasNext():
            s = found.next()
            out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        return sorted(out)

    def count(self, name: str, ending: str) -> int:
        """How many files right below a folder have the ending, in one call."""
        found = self._fs.globStatus(self._p(f"{name}/*{ending}"))
        return len(found) if found is not None else 0

    def folders(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._p(name)) if s.isDirectory())

    def delete(self, name: str) -> None:
        self._fs.delete(self._p(name), True)

    def move(self, name: str, to: str) -> None:
        self._fs.mkdirs(self._p(to).getParent())
        if not self._fs.rename(self._p(name), self._p(to)):
            raise OSError(f"can't move {name} to {to}")

    def copy(self, name: str, to: str) -> None:
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._p(name), self._fs, self._p(to), False, conf)
