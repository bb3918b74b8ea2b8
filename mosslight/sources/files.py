"""Small files and folders through Hadoop's file systems, so that any store path works."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark.sparkContext._jvm

    def at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        p, fs = self.at(path)
        return bool(fs.exists(p))

    def read(self, path: str) -> str | None:
        """A small file's text, None if it isn't there."""
        p, fs = self.at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        p, fs = self.at(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def rename_new(self, source: str, target: str) -> bool:
        """Give a file another name; False if that name is taken."""
        (a, fs), (b, _) = self.at(source), self.at(target)
        if fs.exists(b) or not fs.rename(a, b):
            fs.delete(a, False)
            return False
        return True

    def remove(self, path: str) -> None:
        p, fs = self.at(path)
        fs.delete(p, True)

    def _children(self, path: str) -> list:
        p, fs = self.at(path)
        return list(fs.listStatus(p)) if fs.exists(p) else []

    def folders(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._children(path) if s.isDirectory())

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._children(path) if not s.isDirectory())

    def make(self, path: str) -> None:
        p, fs = self.at(path)
        fs.mkdirs(p)
