"""The few file operations a store needs, on any Hadoop file system; and the same with faults for tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Files below a folder. The file system's object is this one's own, so its settings concern nobody else."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.jvm, self.base = spark, spark._jvm, base.rstrip("/")
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self.jvm.org.apache.hadoop.fs.FileSystem.newInstance(self.path("").toUri(), conf)
        self.fs.setVerifyChecksum(False)  # records have their own, and damage is to be seen as such

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def list(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def create(self, name: str, text: str, replace: bool = False) -> None:
        """Write a file; fails if there is one, unless it is to be replaced."""
        out = self.fs.create(self.path(name), replace)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
        finally:
            stream.close()

    def rename(self, name: str, to: str) -> bool:
        return self.fs.rename(self.path(name), self.path(to))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength()

    def copy(self, name: str, to: Files) -> None:
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.path(name), to.fs, to.path(name), False, self.fs.getConf())

    def close(self) -> None:
        self.fs.close()


class FaultyFiles(Files):
    """Files whose n-th changing operation fails, and all after it, as if the machine had stopped there.

    ``torn``: a failing create leaves the first half of its text behind.
    """

    def __init__(self, spark: SparkSession, base: str, fail_at: int, torn: bool = False) -> None:
        super().__init__(spark, base)
        self.left, self.torn, self.calls = fail_at, torn, 0

    def _count(self) -> bool:
        self.calls += 1
        self.left -= 1
        return self.left < 0

    def create(self, name: str, text: str, replace: bool = False) -> None:
        if self._count():
            if self.torn and self.left == -1 and not self.exists(name):
                super().create(name, text[: len(text) // 2], replace)
            raise OSError(f"fault at {name}")
        super().create(name, text, replace)

    def rename(self, name: str, to: str) -> bool:
        if self._count():
            raise OSError(f"fault at {name}")
        return super().rename(name, to)

    def delete(self, name: str) -> None:
        if self._count():
            raise OSError(f"fault at {name}")
        super().delete(name)
