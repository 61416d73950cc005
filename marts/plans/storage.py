"""The few file operations a commit needs, through Hadoop's file system API."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root = root.rstrip("/")
        self._jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.at(name))

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def entries(self, name: str) -> list[tuple[str, int]]:
        """``(name, modification time in ms)`` of the children; none if absent."""
        path = self._path(name)
        if not self._fs.exists(path):
            return []
        return [
            (status.getPath().getName(), status.getModificationTime())
            for status in self._fs.listStatus(path)
        ]

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(name)).getLength()

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def publish(self, name: str, text: str) -> None:
        """Create ``name`` whole or not at all; FileExistsError if it is there.

        The text is written to a side file first, so a reader never sees part
        of it. The last step is a hard link on local disks and a rename without
        overwrite elsewhere, which must be atomic there (HDFS and alike).
        """
        side = f"{name}.{uuid.uuid4().hex}.tmp"
        self._fs.mkdirs(self._path(name).getParent())
        stream = self._fs.create(self._path(side), False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                self._link(side, name)
            else:
                self._rename(side, name)
        finally:
            self._fs.delete(self._path(side), False)

    def _link(self, side: str, name: str) -> None:
        os.link(self._path(side).toUri().getPath(), self._path(name).toUri().getPath())

    def _rename(self, side: str, name: str) -> None:
        options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._fs.getUri(), self._conf
        )
        try:
            context.rename(self._path(side), self._path(name), options)
        except Exception as error:
            if "FileAlreadyExistsException" in str(error):
                raise FileExistsError(self.at(name)) from error
            raise
