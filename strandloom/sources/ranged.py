"""Files read by ranges of bytes, by whichever task needs them: local and shared folders, HDFS and object stores."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def named(path: str) -> str:
    """One form of a path: Spark tells local ones with one slash."""
    return re.sub("^(file:)?/+", "file:///", path)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, and the path within it."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", named(path)))


class Ranged:
    """A file whose bytes are read `window` at a time; `taken` counts what was read."""

    def __init__(self, path: str, window: int = 1 << 20):
        store, inner = located(path)
        self.path, self.window = path, window
        self.file = store.open_input_file(inner)
        self.size, self.taken = self.file.size(), 0
        self._at, self._held = 0, b""

    def bytes(self, at: int, n: int) -> bytes:
        """Up to n bytes from `at` on, fewer at the end of the file."""
        n = max(0, min(n, self.size - at))
        if at < self._at or at + n > self._at + len(self._held):
            self._at, self._held = at, self.file.read_at(min(max(n, self.window), self.size - at), at)
            self.taken += len(self._held)
        return self._held[at - self._at : at - self._at + n]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Files at a path cut into ranges of `size` bytes, dealt to tasks one by one: path, start, stop."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "length").where("length > 0")  # what they hold isn't read
    cut = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"), "length")
    dealt = cut.select("path", "start", F.least(F.col("start") + size, "length").alias("stop"))
    n = files.agg(F.sum(F.ceil(F.col("length") / size))).first()[0] or 1
    return dealt.repartition(int(n))
