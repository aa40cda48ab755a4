"""Small files and folders on any file system that Spark reads, through the session's own Hadoop client."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class FileSystem:
    """Paths are those that Spark takes: with a scheme, or of the default file system."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str | None:
        """The text of a small file; None if there is none."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """The file holds ``text`` from now on; readers see the old content or the new one, where renaming is atomic."""
        new = f"{path}-{uuid.uuid4().hex}.tmp"
        fs, source = self._at(new)
        stream = fs.create(source, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        target = self._jvm.org.apache.hadoop.fs.Path(path)
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self._conf).rename(fs.makeQualified(source), fs.makeQualified(target), how)
        except Py4JJavaError as e:
            if "UnsupportedFileSystem" not in str(e):
                raise
            out = fs.create(target, True)  # stores without rename put whole objects
            out.write(bytearray(text.encode()))
            out.close()
            fs.delete(source, False)

    def names(self, path: str) -> list[str]:
        """Names within a folder, none if there is no such folder."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def marks(self, path: str) -> list[tuple[str, int, int]]:
        """(name, length, time of change) of a file, or of each file within a folder."""
        fs, p = self._at(path)
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p))

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
