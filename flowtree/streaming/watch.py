"""A folder as a stream of paths: each file when it is new, and again whenever it was modified."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


class _Reader(DataSourceStreamReader):
    """The offset is the latest modification time seen, in nanoseconds, and the paths of that very time, as others may still get the same."""

    FILES_A_TASK = 1000

    def __init__(self, directory: str, since: int) -> None:
        self.directory, self.since = directory, since

    def _list(self) -> list[tuple[int, str]]:
        out = []
        for folder, _, names in os.walk(self.directory):
            for name in names:
                path = os.path.join(folder, name)
                try:
                    out.append((os.stat(path).st_mtime_ns, path))
                except FileNotFoundError:
                    continue
        return sorted(out)

    def initialOffset(self) -> dict:
        return {"time": self.since, "paths": []}

    def latestOffset(self) -> dict:
        files = self._list()
        if not files:
            return self.initialOffset()
        last = files[-1][0]
        return {"time": last, "paths": [p for t, p in files if t == last]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        done = set(start["paths"])
        new = [(p, t) for t, p in self._list() if start["time"] <= t <= end["time"] and not (t == start["time"] and (p in done or t == self.since)) and not (t == end["time"] and p not in end["paths"])]
        return [_Files(new[k : k + self.FILES_A_TASK]) for k in range(0, len(new), self.FILES_A_TASK)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path, ns in partition.files:
            yield path, ns

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class DirectoryWatch(DataSource):
    """Format 'watched_directory'; options: path, since (nanoseconds since 1970)."""

    @classmethod
    def name(cls) -> str:
        return "watched_directory"

    def schema(self) -> str:
        return "path string, modified long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], int(self.options.get("since", "-1")))


def watch_directory(spark: SparkSession, directory: str = ".", since: int = -1) -> DataFrame:
    """(path, modified) of files under a folder that all executors share, as a stream; the trigger is the check interval."""
    spark.dataSource.register(DirectoryWatch)
    return spark.readStream.format("watched_directory").option("path", directory).option("since", since).load()
