"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than these (space, \t \n \v \f \r).
WORD_GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the session names none and runs in one process (tests)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder named in spark.checkpoint.dir.

    The files go with the table: where spark.cleaner.referenceTracking.cleanCheckpoints is set Spark deletes them once nothing refers to it.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def loop_tables(spark: SparkSession, keep: bool = False) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that cuts the lineage of the table of a loop: it writes it to a shared folder and reads it back.

    A checkpoint keeps the planner's estimate of its size, a product over joins whose digits multiply from round to round until
    planning takes longer than the work; a written table has the size of its files.  Unless ``keep`` is set, what was
    returned two calls before is overwritten.  All of it is deleted at the end, so nothing that outlives the block may depend on it.
    """
    folder, turn = f"{_shared_folder(spark)}/{uuid.uuid4().hex}", itertools.count()

    def rewrite(df: DataFrame) -> DataFrame:
        path = f"{folder}/{next(turn) % (1 << 30 if keep else 2)}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield rewrite
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until no column of ``df`` and no other of them is called so (upper and lower case are one)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def whole_id(df: DataFrame, id_col: str) -> Column:
    """The id as a long; ids of other types than whole numbers are refused."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{id_col} must be a whole number, not {kind.simpleString()}")
    return F.col(f"`{id_col}`").cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The words of a text as an array; null texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def text_key(text: Column) -> Column:
    """Tells apart rows that share an id but not a text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def bounded_sample(df: DataFrame, id_col: str, bound: int) -> DataFrame:
    """At most ``bound`` rows, the same ones on every run: those whose id hashes lowest.

    A threshold on the hash, from the number of rows, lets through little more than ``bound`` rows before they meet in one task.
    """
    total = df.count()
    share = min(1.0, (bound + 8 * bound**0.5 + 64) / max(total, 1))
    least = df.where(F.xxhash64(F.col(id_col)) <= F.lit(int(-(2**63) + share * (2**64 - 1025)))) if share < 1 else df
    return least.orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(bound)


#: A key is hot if it holds over one in so many of all rows.
HOT_KEYS = 1000
#: So many rows of one key don't fill a task.
FEW_ROWS = 10_000


def hot_joined(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: int, most: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row per ``keys`` and in ``n`` how many of the ``total`` rows hold them.

    Rows of a hot key are joined where they are: there are fewer than ``HOT_KEYS`` such keys at any size of the input, so
    their part of ``table`` is broadcast.  No key of the shuffled rest can fill a task.  Where ``most``, which no ``n`` exceeds, says that
    no key is hot or can fill a task, nothing is: broadcasts are made in the driver, and in a loop its heap fills with those of past rounds.
    """
    if most is not None and most <= max(total / HOT_KEYS, FEW_ROWS):
        return rows.join(table, keys)
    hot = F.broadcast(table.where(F.col(n) > total / HOT_KEYS))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(table.where(F.col(n) <= total / HOT_KEYS), keys)
    return rows.join(hot, keys).unionByName(rest)
