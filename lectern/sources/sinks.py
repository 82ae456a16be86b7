"""Files out: one file a name, all of them or none."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lectern.sources.watch import _opened

SCHEMA = "name string, at long, content binary"
#: What a name may not hold: separators, and names that mean a folder.
_BAD_NAME = re.compile(r"[/\\\0]|\A\.{0,2}\Z|\A_staging-")


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _Writer(DataSourceWriter):
    """Each attempt of a task writes into a folder of its own; only those of the attempts that Spark accepts are moved to their places.

    Rows of a file come one after the other (name, at); only the block at hand is held.
    """

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.folder, self.overwrite = options["path"].rstrip("/"), overwrite
        self.staging = f"{self.folder}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        mine, names, out, at = f"{self.staging}/{uuid.uuid4().hex}", set(), None, 0
        files, root = _opened(mine)
        last = None
        try:
            for name, start, content in iterator:
                if name is None or _BAD_NAME.search(name):
                    raise ValueError(f"not the name of a file: {name!r}")
                if name != last:
                    if name in names:
                        raise ValueError(f"the blocks of {name} do not follow each other")
                    if not names:
                        files.create_dir(root, recursive=True)
                    if out:
                        out.close()
                    out, at, last = files.open_output_stream(f"{root}/{name}"), 0, name
                    names.add(name)
                if start != at:
                    raise ValueError(f"{name} has {at} bytes, the next block is for {start}")
                out.write(content or b"")
                at += len(content or b"")
        finally:
            if out:
                out.close()
        return _Written(mine, sorted(names))

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        files, root = _opened(self.folder)
        seen: set[str] = set()
        for m in messages:
            for name in m.names if m else []:
                if name in seen:
                    raise ValueError(f"two tasks wrote {name}")
                seen.add(name)
        if not self.overwrite:
            have = {f.base_name for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True))} & seen
            if have:
                raise FileExistsError(f"{len(have)} files are there already, {min(have)} for one")
        for m in messages:
            for name in m.names if m else []:
                files.move(f"{_opened(m.folder)[1]}/{name}", f"{root}/{name}")
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        files, root = _opened(self.staging)
        if files.get_file_info(root).type == fs.FileType.Directory:
            files.delete_dir(root)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lectern_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def write_files(blocks: DataFrame, folder: str, replace: bool = False) -> None:
    """Writes ``blocks`` (name, content, and at, the bytes before it, if a file has more than one) as files right in ``folder``.

    Files take their places once all are complete; if the job fails none does, and what failed or repeated tasks wrote is deleted.  A name that is there
    already stops the job unless ``replace``; other files of the folder stay.  A null content is an empty block, a null name an error.
    Rows are shuffled by name; a task streams one file after the other and holds a block at a time.  The driver gets the names alone.
    """
    blocks.sparkSession.dataSource.register(Files)
    at = F.col("at") if "at" in blocks.columns else F.lit(0)
    rows = blocks.select("name", at.cast("long").alias("at"), "content").repartition("name")
    rows = rows.sortWithinPartitions("name", "at", F.octet_length("content"))  # of blocks at one place all but the last are empty
    rows.write.format(Files.name()).mode("overwrite" if replace else "append").option("path", folder).save()


def placed(pieces: DataFrame, order: str, content: Column, block: int = 1024) -> DataFrame:
    """(name, at, content): the pieces (name, ``order`` from 0 or so, whole numbers) of each file with the bytes before them.

    Sums by blocks of ``block`` numbers first, then within a block, so the pieces of a file never meet in one task.
    """
    rows = pieces.select("name", F.col(order).cast("long").alias("i"), content.cast("binary").alias("content"))
    rows = rows.withColumns({"b": F.floor(F.col("i") / block), "n": F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")})
    before = lambda *by: Window.partitionBy("name", *by).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("name", "b").agg(F.sum("n").alias("all"))
    starts = sums.select("name", "b", F.coalesce(F.sum("all").over(before().orderBy("b")), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("n").over(before("b").orderBy("i")), F.lit(0))
    return rows.withColumn("inside", inside).join(starts, ["name", "b"]).select("name", (F.col("start") + F.col("inside")).alias("at"), "content")


def delete_files(paths: DataFrame) -> DataFrame:
    """(path, deleted): deletes each file of ``paths`` (path) from the task that holds its row; a file that is not there counts as not deleted.

    Runs when the result is read, and is harmless when a task repeats, but for what it reports.
    """

    def work(batches):
        from pyarrow import fs

        for pdf in batches:
            done = []
            for path in pdf["path"]:
                files, root = _opened(path) if path is not None else (None, None)
                there = files is not None and files.get_file_info(root).type == fs.FileType.File
                if there:
                    files.delete_file(root)
                done.append(there)
            yield pdf[["path"]].assign(deleted=done)

    return paths.select("path").mapInPandas(work, "path string, deleted boolean")
