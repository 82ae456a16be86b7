"""Tables whose every change is one commit: the old table or the new one, never less."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets of a table that is merged by key; a merge writes anew those that its rows fall in.
BUCKETS = 64
_BUCKET, _NEW, _TIE = "_bucket", "_new", "_tie"


class Conflict(RuntimeError):
    """Another writer made the version first."""


@dataclass
class Version:
    """What the log says of one version: folders of Parquet files by bucket, the columns, and the last batch of each source."""

    number: int = 0
    schema: str | None = None
    keys: list[str] = field(default_factory=list)
    buckets: int = 1
    folders: dict[str, list[str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class Table:
    """A table at ``path``: immutable data folders under data/, and a log of numbered versions under log/.

    A commit writes its data into a new folder and then creates the next entry of the log, which fails if there is one.  A reader takes the newest entry, and
    keeps to its files whatever is committed meanwhile.  A writer that stops on the way leaves data that no version names; ``vacuum`` deletes it.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        files, at = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []

    def versions(self) -> list[int]:
        """The numbers of the versions that the log still has."""
        return [int(n.removesuffix(".json")) for n in self._names("log") if n.endswith(".json")]

    def version(self, number: int | None = None) -> Version:
        """An entry of the log, the newest if ``number`` is None; number 0 with no folders where the table has never been written."""
        known = self.versions()
        number = (known or [0])[-1] if number is None else number
        if number and number not in known:
            raise ValueError(f"{self.path} has no version {number}")
        if not number:
            return Version()
        text = self.spark.read.text(f"{self.path}/log/{number:012d}.json", wholetext=True).first()[0]
        return Version(**json.loads(text))

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, of the newest if ``number`` is None; it names its files, so later commits do not change it."""
        v = self.version(number)
        if v.schema is None:
            raise ValueError(f"{self.path} has never been written")
        folders = [f"{self.path}/{f}" for b in sorted(v.folders) for f in v.folders[b]]
        if not folders:
            return self.spark.createDataFrame([], v.schema)
        return self.spark.read.schema(v.schema).parquet(*folders)

    def _commit(self, v: Version) -> int:
        """Creates the next entry of the log from what is written beside it; raises ``Conflict`` if it is there."""
        jvm = self.spark._jvm
        files, target = self._fs(f"{self.path}/log/{v.number:012d}.json")
        _, beside = self._fs(f"{self.path}/log/.{v.number:012d}-{uuid.uuid4().hex}")
        out = files.create(beside, False)
        out.write(json.dumps(v.__dict__).encode())
        out.close()
        self._step("entry written")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(beside, target, options)
        except Exception as e:
            files.delete(beside, False)
            if files.exists(target):
                raise Conflict(f"version {v.number} of {self.path} was made by another writer") from e
            raise
        self._step("entry renamed")
        return v.number

    def _step(self, name: str) -> None:
        """Called after each step of a commit; tests stop here."""

    def _write(self, df: DataFrame, *by: str) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.partitionBy(*by).parquet(f"{self.path}/{folder}") if by else df.write.parquet(f"{self.path}/{folder}")
        self._step("data written")
        return folder

    def replace(self, df: DataFrame) -> int:
        """Makes ``df``, which may have been read from this very table, the whole table; the number of the version."""
        now = self.version()
        folder = self._write(df)
        return self._commit(Version(now.number + 1, _ddl(df), [], 1, {"0": [folder]}, now.batches))

    def merge(self, rows: DataFrame, keys: list[str], order: str | None = None, source: str = "", batch: int | None = None, tries: int = 5) -> int | None:
        """Puts ``rows`` in place of those that have their ``keys``, and adds the others; of rows with equal keys the last by ``order`` counts.

        Of ``source`` a ``batch`` up to the last one merged changes nothing (None is returned), so a batch that is replayed counts once.  Only the buckets that
        the rows fall in are written anew.  If another writer commits first the merge is made again on what it left.  Null keys are keys like others; rows equal in keys
        and ``order`` are told apart by all their columns.
        """
        staging = f"{self.path}/data/{uuid.uuid4().hex}"
        try:
            for _ in range(tries):
                now = self.version()
                if batch is not None and batch <= now.batches.get(source, -1):
                    return None
                if now.folders and now.keys != keys:
                    raise ValueError(f"{self.path} is kept by {now.keys or 'no key'}, not by {keys}")
                n = now.buckets if now.folders else BUCKETS
                if now.folders and not self._names(staging.removeprefix(f"{self.path}/")):
                    # worked out once, for the buckets they hit and for the merge
                    rows.write.parquet(staging)
                    rows = self.spark.read.schema(rows.schema).parquet(staging)
                new = self._merged(rows, keys, order, now, n)
                folder = self._write(new, _BUCKET)
                hit = [f.removeprefix(f"{_BUCKET}=") for f in self._names(folder) if f.startswith(f"{_BUCKET}=")]
                folders = now.folders | {b: [f"{folder}/{_BUCKET}={b}"] for b in hit}
                batches = now.batches if batch is None else now.batches | {source: batch}
                try:
                    return self._commit(Version(now.number + 1, _ddl(new.drop(_BUCKET)), keys, n, folders, batches))
                except Conflict:
                    continue
            raise Conflict(f"{self.path} was changed by others {tries} times over")
        finally:
            files, at = self._fs(staging)
            files.delete(at, True)

    def _merged(self, rows: DataFrame, keys: list[str], order: str | None, now: Version, n: int) -> DataFrame:
        """``rows`` and what ``now`` has beside them in the buckets they fall in, with the bucket.

        The rows of a bucket meet once: of equal keys the first stays, new ones before old ones, and the bucket is written where it is.
        """
        bucket = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
        every = rows.withColumns({_BUCKET: bucket, _NEW: F.lit(True), _TIE: F.xxhash64(*rows.columns)})
        if now.folders:
            hit = [str(r[0]) for r in every.select(_BUCKET).distinct().collect()]  # at most n numbers
            old = [f"{self.path}/{f}" for b in hit for f in now.folders.get(b, [])]
            if old:
                kept = self.spark.read.schema(now.schema).parquet(*old)
                every = every.unionByName(kept.withColumns({_BUCKET: bucket, _NEW: F.lit(False)}), allowMissingColumns=True)
        first = Window.partitionBy(_BUCKET, *keys).orderBy(F.desc(_NEW), *([F.desc_nulls_last(order)] if order else []), _TIE)
        return every.repartition(_BUCKET).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", _NEW, _TIE)

    def merge_stream(self, stream: DataFrame, keys: list[str], order: str | None, source: str, checkpoint: str, **trigger):
        """Starts a query that merges each batch of ``stream``; a batch that is run again after a stop counts once."""
        put = lambda df, batch: self.merge(df, keys, order, source, batch)
        return stream.writeStream.foreachBatch(lambda df, batch: put(df, batch) and None).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def vacuum(self, keep: int = 1) -> int:
        """Forgets all but the newest ``keep`` versions and deletes data that none of those names; how many folders went.

        Readers of versions that are forgotten fail afterwards, and so would a writer at work now: its data is not named yet.
        """
        known = self.versions()
        held = {f.split("/")[1] for n in known[-keep:] for fs in self.version(n).folders.values() for f in fs}
        gone = 0
        for n in known[:-keep]:
            files, at = self._fs(f"{self.path}/log/{n:012d}.json")
            files.delete(at, False)
        for name in self._names("log"):
            if name.startswith("."):
                files, at = self._fs(f"{self.path}/log/{name}")
                files.delete(at, False)
        for name in self._names("data"):
            if name not in held:
                files, at = self._fs(f"{self.path}/data/{name}")
                files.delete(at, True)
                gone += 1
        return gone


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
