"""Small files of a stored graph, on any file system that Spark reaches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import StorageError


class Folder:
    """A folder by path or URL; files are read whole, replaced in one step, or made only if they aren't there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        root = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = root.getFileSystem(self.conf)
        self.full = root.makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.full, name)

    def make(self) -> None:
        self.fs.mkdirs(self.full)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        if not self.exists(name):
            raise FileNotFoundError(name)
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str, overwrite: bool) -> None:
        stream = self.fs.create(self._path(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Readers see the old file or the new one."""
        new = f".{name}.{uuid.uuid4().hex}"
        self._write(new, text, False)
        fs = self.jvm.org.apache.hadoop.fs
        how = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        how[0] = fs.Options.Rename.OVERWRITE
        fs.FileContext.getFileContext(self.full.toUri(), self.conf).rename(self._path(new), self._path(name), how)

    def create(self, name: str, text: str = "") -> bool:
        """Make a file, whole, in one step; false if it is there already."""
        new = f".{name}.{uuid.uuid4().hex}"
        self._write(new, text, False)
        fs = self.jvm.org.apache.hadoop.fs
        how = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        how[0] = fs.Options.Rename.NONE
        try:
            fs.FileContext.getFileContext(self.full.toUri(), self.conf).rename(self._path(new), self._path(name), how)
            return True
        except Py4JJavaError as e:
            self.delete(new)
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                return False
            raise

    def names(self) -> list[str]:
        """What lies in the folder."""
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.full)) if self.fs.exists(self.full) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``; where none is set and driver and executors are one process, a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise StorageError("spark.checkpoint.dir names no shared folder")
        root = f"file://{os.path.join(tempfile.gettempdir(), 'lodegraph-checkpoints')}"
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
