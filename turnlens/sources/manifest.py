"""Resumable work: a result in named parts, each committed once.

A part is written to a folder of its own that no reader knows yet. Its commit is one file in the manifest, which names the folder and
appears under its part's name by a rename, if none is there; that rename is the only step that counts. A job that dies leaves at most a folder that
no file names, and the next run does that part again. Of two runs that make the same part one commits, and the other's folder
stays unnamed. ``vacuum`` deletes such folders when nothing runs.

The driver holds the names of the parts, so their number should follow from a part's size, not from the data's keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


class Manifest:
    """Parts of one result under ``root``. The name of the root should tell what the result depends on."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *names: path("/".join([self.root, *names]))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def committed(self) -> dict[str, str]:
        """The folder of each committed part."""
        out = {}
        for name in self._names("manifest"):
            lines = self._fs.open(self._path("manifest", name))
            out[name] = bytes(lines.readAllBytes()).decode()
            lines.close()
        return {k: v for k, v in out.items() if v}

    def commit(self, part: str, df: DataFrame) -> bool:
        """Writes the part and commits it; False if another run was first."""
        folder = f"{part}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/data/{folder}")
        pending = self._path("pending", folder)
        out = self._fs.create(pending, True)
        out.write(bytearray(folder.encode()))
        out.close()
        self._fs.mkdirs(self._path("manifest"))
        where = self._path("manifest", part)
        if self._fs.exists(where):
            self._fs.delete(pending, False)
            return False
        # The file appears under its name whole or not at all; a rename onto a file that is there fails.
        return bool(self._fs.rename(pending, where))

    def run(self, parts: Iterable[str], make: Callable[[str], DataFrame]) -> list[str]:
        """Makes and commits the parts that are not there yet, one after another, and returns their names."""
        there, made = self.committed(), []
        for part in parts:
            if part not in there and self.commit(part, make(part)):
                made.append(part)
        return made

    def read(self, of: Callable[[str], bool] = lambda part: True) -> DataFrame:
        """All rows of the committed parts whose name ``of`` accepts."""
        found = [f"{self.root}/data/{folder}" for part, folder in sorted(self.committed().items()) if of(part)]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def vacuum(self) -> list[str]:
        """Deletes folders that no commit names, and returns them."""
        named = set(self.committed().values())
        gone = [f for f in self._names("data") if f not in named]
        for f in gone:
            self._fs.delete(self._path("data", f), True)
        self._fs.delete(self._path("pending"), True)
        return gone
