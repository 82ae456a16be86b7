"""A folder as a stream of what comes, goes, changes and is renamed in it."""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "type string, path string, before string, size long, modified timestamp, ts timestamp"
#: Rows that one task puts out.
ROWS = 10_000
_NAME = re.compile(r"(\d{12})\.json")


def _opened(uri: str):
    """(file system, path) of a folder in any store that Arrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1)) if uri.startswith("file:/") else (fs.LocalFileSystem(), uri)


def listed(folder: str, suffix: str) -> dict[str, list[int]]:
    """{name: [size, modified in microseconds]} of the files right in a folder whose names end with ``suffix``, upper and lower case alike; none if there is no folder."""
    from pyarrow import fs

    files, root = _opened(folder)
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return {f.base_name: [f.size, f.mtime_ns // 1000] for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(suffix)}


def changes(old: dict[str, list[int]], new: dict[str, list[int]]) -> list[tuple[str, str, str | None]]:
    """(type, name, name before) of what changed between two listings, by name: created, deleted, changed, renamed.

    A file that went and one that came with its size and time are one that was renamed, if there is one of each.
    """
    gone, come = [n for n in sorted(old) if n not in new], [n for n in sorted(new) if n not in old]
    alike: dict[tuple, tuple[list[str], list[str]]] = {}
    for side, names, table in ((0, gone, old), (1, come, new)):
        for n in names:
            alike.setdefault(tuple(table[n]), ([], []))[side].append(n)
    renamed = {b[0]: a[0] for a, b in alike.values() if len(a) == len(b) == 1}
    moved = set(renamed.values())
    out = [("deleted", n, None) for n in gone if n not in moved]
    out += [("renamed", n, renamed[n]) if n in renamed else ("created", n, None) for n in come]
    out += [("changed", n, None) for n in sorted(new) if n in old and old[n] != new[n]]
    return sorted(out, key=lambda e: e[1])


class _Slice(InputPartition):
    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows


class _Reader(DataSourceStreamReader):
    """Offsets number the snapshots of the folder, which are kept as files in ``state``.

    A snapshot is written before its number is an offset, and taken anew only if the folder differs from the newest one.  So whenever a query
    stops, the rows of a batch follow from two files that are there, and nothing is lost or repeated.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.state, self.suffix = options["path"], options["state"], options.get("suffix", ".wav").lower()

    def _numbers(self) -> list[int]:
        from pyarrow import fs

        files, root = _opened(self.state)
        return sorted(int(m[1]) for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if (m := _NAME.fullmatch(f.base_name)))

    def _load(self, number: int) -> dict:
        if not number:
            return {"files": {}, "at": 0}
        files, root = _opened(self.state)
        with files.open_input_stream(f"{root}/{number:012d}.json") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        last = (self._numbers() or [0])[-1]
        now = listed(self.folder, self.suffix)
        if now == self._load(last)["files"]:
            return {"snapshot": last}
        files, root = _opened(self.state)
        files.create_dir(root, recursive=True)
        at = int(datetime.datetime.now(datetime.UTC).timestamp() * 1e6)
        with files.open_output_stream(f"{root}/{last + 1:012d}.tmp") as f:
            f.write(json.dumps({"files": now, "at": at}).encode())
        files.move(f"{root}/{last + 1:012d}.tmp", f"{root}/{last + 1:012d}.json")
        return {"snapshot": last + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = self._load(start["snapshot"]), self._load(end["snapshot"])
        when = lambda micros: datetime.datetime.fromtimestamp(micros / 1e6, datetime.UTC)
        rows = []
        for kind, name, before in changes(old["files"], new["files"]):
            size, modified = (old if kind == "deleted" else new)["files"][name]
            rows.append((kind, f"{self.folder}/{name}", before and f"{self.folder}/{before}", size, when(modified), when(new["at"])))
        return [_Slice(rows[i : i + ROWS]) for i in range(0, len(rows), ROWS)] or [_Slice([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        files, root = _opened(self.state)
        for n in self._numbers():
            if n < end["snapshot"]:
                files.delete_file(f"{root}/{n:012d}.json")


class FolderWatch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lectern_watch"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def watch(spark: SparkSession, folder: str, state: str, suffix: str = ".wav") -> DataFrame:
    """A stream of (type, path, before, size, modified, ts): created, deleted, changed and renamed files right in ``folder``.

    What happens between two looks at the folder counts as one step: a file that came and went in between is not seen.  ts is when
    a change was seen, before the old path of a file that was renamed.  Snapshots live in ``state``, a folder of its own that outlasts restarts, as the checkpoint does.
    The folder is listed by the driver; its files are not read.
    """
    spark.dataSource.register(FolderWatch)
    return spark.readStream.format(FolderWatch.name()).option("path", folder).option("state", state).option("suffix", suffix).load()
