"""Small files that are published as a whole, and numbered files that many writers add to."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

from ..model import EvlogError

#: File systems whose rename neither fails where the name is taken nor happens at once.
UNSAFE = ("s3", "s3a", "s3n", "gs", "oss", "cos")


class Files:
    """Reads and writes below one path. Local paths are handled by the kernel (link, replace), others by Hadoop's FileContext,
    whose rename is one step on HDFS and its like; on object stores, where it isn't, create and replace are refused."""

    def __init__(self, spark: SparkSession, root: str, through_hadoop: bool = False):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)
        uri = self.fs.makeQualified(self._path("")).toUri()
        self.scheme = uri.getScheme()
        self.local = uri.getPath() if self.scheme == "file" and not through_hadoop else None

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        if self.local is not None:
            here = f"{self.local}/{folder}"
            return sorted(n for n in os.listdir(here) if not n.startswith(".")) if os.path.isdir(here) else []
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        if self.local is not None:
            with open(f"{self.local}/{name}", encoding="utf-8") as f:
                return f.read()
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file, whole or not at all; False if there is one of that name."""
        return self._publish(name, text, False)

    def replace(self, name: str, text: str) -> None:
        """Write a file over whatever has the name, whole, in one step: there is always the old one or the new one."""
        self._publish(name, text, True)

    def _publish(self, name: str, text: str, over: bool) -> bool:
        if self.scheme in UNSAFE:
            raise EvlogError(f"{self.scheme}: has no rename in one step; keep the log on a file system that has")
        temporary = f"{name}.{uuid.uuid4().hex}.tmp"
        self.write(temporary, text.encode())
        try:
            if self.local is not None:
                if over:
                    os.replace(f"{self.local}/{temporary}", f"{self.local}/{name}")
                    return True
                try:
                    os.link(f"{self.local}/{temporary}", f"{self.local}/{name}")
                except FileExistsError:
                    return False
                return True
            return self._rename(temporary, name, over)
        finally:
            self.delete(temporary)

    def _rename(self, before: str, after: str, over: bool) -> bool:
        kinds = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        option = self.jvm.java.lang.reflect.Array.newInstance(kinds.NONE.getClass(), 1)
        option[0] = kinds.OVERWRITE if over else kinds.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(self._path("")).toUri(), self.conf)
        try:
            context.rename(self.fs.makeQualified(self._path(before)), self.fs.makeQualified(self._path(after)), option)
        except Exception as e:
            if not over and "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def write(self, name: str, data: bytes) -> None:
        """Write a file under a name that no one else uses."""
        if self.local is not None:
            os.makedirs(os.path.dirname(f"{self.local}/{name}"), exist_ok=True)
            with open(f"{self.local}/{name}", "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            return
        out = self.fs.create(self._path(name), False)  # makes the folders above
        out.write(bytearray(data))
        out.close()

    def delete(self, name: str) -> None:
        if self.local is not None:
            here = f"{self.local}/{name}"
            if os.path.isdir(here):
                shutil.rmtree(here, ignore_errors=True)
            elif os.path.exists(here):
                os.unlink(here)
            return
        self.fs.delete(self._path(name), True)

    def exists(self, name: str) -> bool:
        return os.path.exists(f"{self.local}/{name}") if self.local is not None else bool(self.fs.exists(self._path(name)))


class Journal:
    """Files 0, 1, 2 … of a folder. A writer creates number n+1 only after it has read n, and creates it exclusively: of two
    writers that build on the same n one is told so, reads on, and decides anew. Bodies never change, so each is read once."""

    def __init__(self, files: Files, folder: str):
        self.files, self.folder = files, folder

    def name(self, number: int) -> str:
        return f"{self.folder}/{number:020d}.json"

    def after(self, number: int) -> Iterator[tuple[int, dict]]:
        """The entries past a number, as far as they go without a gap."""
        while self.files.exists(self.name(number + 1)):
            number += 1
            yield number, json.loads(self.files.read(self.name(number)))

    def publish(self, number: int, body: dict) -> bool:
        return self.files.create(self.name(number), json.dumps(body))

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(self.folder) if n.endswith(".json")]
