"""Versions of an index behind an alias.

Each version is a small JSON file that names the folders it consists of; the alias is a
sequence of files of its own, the last readable one of which names the version in use.
A file is created only if its number is free, so of two writers one fails, and what a
lost writer left is never read: folders that no version names, or a file that is not
whole, whose number is passed over. Going back is one more alias file.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Versions:
    """Versions and alias below a folder that the driver and all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self, kind: str) -> list[int]:
        """Numbers in use, of whole files or not."""
        if not self._fs.exists(self._at(kind)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at(kind))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, kind: str, number: int) -> dict | None:
        """What a file says; nothing if it is not whole."""
        source = self._fs.open(self._at(f"{kind}/{number:012d}.json"))
        try:
            raw = bytes(source.readAllBytes())
        finally:
            source.close()
        try:
            found = json.loads(raw)
        except ValueError:
            return None
        return found if isinstance(found, dict) else None

    def last(self) -> int:
        """The latest alias file's number, whole or not; -1 before the first."""
        return max(self.numbers("alias"), default=-1)

    def _create(self, kind: str, content: dict, after: int | None = None) -> int:
        number = (max(self.numbers(kind), default=-1) if after is None else after) + 1
        out = self._fs.create(self._at(f"{kind}/{number:012d}.json"), False)  # fails if another writer has the number
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        return number

    def add(self, content: dict) -> int:
        """Writes a version that nobody uses yet."""
        return self._create("versions", content)

    def use(self, version: int, seen: int | None = None) -> None:
        """Swaps the alias; fails if it has been swapped since the one numbered ``seen``."""
        if version not in self.numbers("versions") or self.read("versions", version) is None:
            raise ValueError(f"no version {version}")
        self._create("alias", {"version": version}, seen)

    def current(self) -> tuple[int, dict] | None:
        """The version in use."""
        for number in reversed(self.numbers("alias")):
            if (found := self.read("alias", number)) is not None:
                return found["version"], self.read("versions", found["version"])
        return None
