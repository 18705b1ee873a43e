"""Small files that appear whole and only once: logs and layouts of tables.

Paths without a scheme are of the shared file system (a hard link fails if its
name is taken); others go through the Hadoop file system, whose rename without
overwriting does the same.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class SmallFiles:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def create(self, path: str, text: str) -> bool:
        """A file with this text, whole from the start; false if there is one."""
        part = f"{path}.{uuid.uuid4().hex}.part"
        if "://" not in path:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(part, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(part, path)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(part)
        fs, target = self._fs(path)
        _, staged = self._fs(part)
        out = fs.create(staged, True)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(staged, target, none)  # fails if the target is there
            return True
        except Exception as e:  # noqa: BLE001 - the class is the JVM's
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(staged, False)
            return False

    def read(self, path: str) -> str:
        if "://" not in path:
            with open(path, encoding="utf-8") as f:
                return f.read()
        return self.spark.read.text(path, wholetext=True).first()[0]

    def names(self, directory: str) -> list[str]:
        """Names of the ``.json`` files in order; none of a missing directory."""
        if "://" not in directory:
            found = os.listdir(directory) if os.path.isdir(directory) else []
        else:
            fs, p = self._fs(directory)
            found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in found if n.endswith(".json"))

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return bool(fs.exists(p))
