"""Files published whole and once: the storage under a run.

A file or folder is written aside, under a hidden name, and then given its own
name if nothing has it.  So a reader sees all of it or nothing, a crash before
leaves something hidden that no reader looks at, and of two who publish one
name one is told.  On a local disk the name is a hard link, which the system
gives once; elsewhere it is a rename that refuses an existing name, which
HDFS does in one step.  A store without such a rename (an object store) needs
a committer of its own in front of it.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._hadoop = spark, path.rstrip("/"), spark._jvm.org.apache.hadoop.fs

    def at(self, name: str = ""):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def files(self):
        return self.at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, name: str = "") -> list[str]:
        """What is in a folder, without what is hidden or being written; nothing if there is no such folder."""
        files, path = self.files(), self.at(name)
        found = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return sorted(n for n in found if n[0] not in "._")

    def aside(self, name: str) -> str:
        """A hidden name beside ``name``."""
        folder, _, last = name.rpartition("/")
        return f"{folder}/.{last}-{uuid.uuid4().hex}".lstrip("/")

    def publish(self, aside: str, name: str) -> bool:
        """Give what was written aside its name; False, and it is gone, if the name is taken."""
        files, source, target = self.files(), self.at(aside), self.at(name)
        files.mkdirs(target.getParent())
        try:
            if files.getUri().getScheme() == "file" and files.getFileStatus(source).isFile():
                java = self.spark._jvm.java
                local = lambda path: java.io.File(files.makeQualified(path).toUri().getPath()).toPath()
                java.nio.file.Files.createLink(local(target), local(source))
                files.delete(source, False)
            else:
                none = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
                none[0] = self._hadoop.Options.Rename.NONE
                where = files.makeQualified(target)
                self._hadoop.FileContext.getFileContext(where.toUri(), self.spark._jsc.hadoopConfiguration()).rename(files.makeQualified(source), where, none)
            return True
        except Py4JJavaError:
            if not files.exists(target):
                raise
            files.delete(source, True)
            return False

    def write(self, name: str, row: dict) -> None:
        """One JSON line."""
        out = self.files().create(self.at(name), True)
        out.write(bytearray(json.dumps(row).encode()))
        out.close()

    def put(self, name: str, row: dict) -> bool:
        """Publish one JSON line, unless the name is taken."""
        aside = self.aside(name)
        self.write(aside, row)
        return self.publish(aside, name)

    def delete(self, name: str = "") -> None:
        self.files().delete(self.at(name), True)
