"""A streaming source that follows files as they grow: rows are lines, offsets are bytes read of each file."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Part(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class TailReader(DataSourceStreamReader):
    """Files that match a pattern on a disk that all executors mount. Only whole lines are read; a file that shrank is read from its start again."""

    def __init__(self, options: dict):
        self.pattern = options["path"]
        self.from_end = options.get("from", "start") == "end"

    def _ends(self) -> dict[str, int]:
        """For each file the byte after its last line end."""
        out = {}
        for path in sorted(glob.glob(self.pattern)):
            with open(path, "rb") as f:
                at = f.seek(0, os.SEEK_END)
                while at:
                    step = min(at, 1 << 16)
                    f.seek(at - step)
                    cut = f.read(step).rfind(b"\n")
                    if cut >= 0:
                        at = at - step + cut + 1
                        break
                    at -= step
                out[path] = at
        return out

    def initialOffset(self) -> dict:
        return self._ends() if self.from_end else {}

    def latestOffset(self) -> dict:
        return self._ends()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        begin = {p: start.get(p, 0) if start.get(p, 0) <= e else 0 for p, e in end.items()}
        return [Part(p, begin[p], e) for p, e in end.items() if e > begin[p]]

    def read(self, partition: Part) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            left = partition.end - partition.start
            for line in f:
                if left <= 0:
                    break
                left -= len(line)
                yield (line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace"), partition.path)


class TailSource(DataSource):
    """Options: path (a pattern), from (start or end)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "value string, path string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)
