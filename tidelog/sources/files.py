"""Small files on any Hadoop file system, from the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        where, fs = self._at(path)
        return fs.exists(where)

    def names(self, path: str) -> list[str]:
        """Names in a folder, hidden ones left out; none if there is no such folder."""
        where, fs = self._at(path)
        if not fs.exists(where):
            return []
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(where)) if not n.startswith((".", "_")))

    def size(self, path: str) -> int:
        where, fs = self._at(path)
        return fs.getContentSummary(where).getLength()

    def read(self, path: str) -> str:
        where, fs = self._at(path)
        stream = fs.open(where)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, path: str, text: str, overwrite: bool) -> None:
        where, fs = self._at(path)
        stream = fs.create(where, overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a new file as a whole: a complete copy is renamed into place. False if the path is taken."""
        temporary = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        self._write(temporary, text, False)
        where, _ = self._at(path)
        source, fs = self._at(temporary)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.conf) if where.toUri().getScheme() else self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.conf)
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(source, where, none)
            return True
        except Exception as e:
            fs.delete(source, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def replace(self, path: str, text: str) -> None:
        self._write(path, text, True)

    def copy(self, source: str, target: str) -> None:
        a, from_fs = self._at(source)
        b, to_fs = self._at(target)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(from_fs, a, to_fs, b, False, self.conf)

    def delete(self, path: str) -> None:
        where, fs = self._at(path)
        fs.delete(where, True)
