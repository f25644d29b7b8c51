"""Small files through Hadoop's file systems, so that paths work wherever Spark's do."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def list(self, name: str) -> list[str]:
        """Names in a folder, in order; none if it isn't there."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.at(name))))

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        """Write a new file under another name and rename it: readers see all of it or nothing."""
        temp = self._path(self.at(name + ".tmp"))
        stream = self._fs.create(temp, True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        if not self._fs.rename(temp, self._path(self.at(name))):
            raise OSError(f"can't rename to {name}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)
