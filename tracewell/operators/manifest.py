"""A log of numbered entries that several builders may write at once (inventory rows M7, M9, D15).

Entry n is one small JSON file. It is written under another name and takes its own by a step that fails if the name is
taken: a hard link on a local file system, a rename elsewhere (HDFS refuses to rename onto a file; a store whose rename
overwrites, like most object stores, needs a committer that refuses). Of two writers that read the same last entry one
gets number n, the other reads n and decides again. Entries never change, so each is read once.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

Entry = dict
#: Times that a commit is tried anew.
TRIES = 200


class Conflict(RuntimeError):
    """Other writers were faster each time."""


class Manifest:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.known: list[Entry] = []

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def entries(self) -> list[Entry]:
        """All entries in order, with their number as ``sequence``: a few for each build."""
        fs, jvm = self._fs(), self.spark._jvm
        while fs.exists(path := self._path(f"{len(self.known) + 1:012d}.json")):
            stream = fs.open(path)
            try:
                text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            self.known.append({**json.loads(text), "sequence": len(self.known) + 1})
        return list(self.known)

    def _create(self, number: int, entry: Entry) -> bool:
        fs, jvm = self._fs(), self.spark._jvm
        target, temp = self._path(f"{number:012d}.json"), self._path(f".{uuid.uuid4().hex}.tmp")
        stream = fs.create(temp, True)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        try:
            if fs.getScheme() != "file":
                return not fs.exists(target) and fs.rename(temp, target)
            here = [jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri()) for p in (target, temp)]
            jvm.java.nio.file.Files.createLink(*here)
            return True
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            return False
        finally:
            fs.delete(temp, False)

    def commit(self, decide: Callable[[list[Entry]], Entry | None]) -> Entry | None:
        """Append what ``decide`` makes of the entries so far, asked anew if another writer was faster; None commits nothing."""
        for _ in range(TRIES):
            entries = self.entries()
            entry = decide(entries)
            if entry is None:
                return None
            if self._create(len(entries) + 1, {k: v for k, v in entry.items() if k != "sequence"}):
                return {**entry, "sequence": len(entries) + 1}
            time.sleep(random.uniform(0, 0.05))
        raise Conflict(self.folder)


def latest(entries: list[Entry]) -> dict[str, Entry]:
    """The last entry of each build."""
    return {e["build_id"]: e for e in entries}
