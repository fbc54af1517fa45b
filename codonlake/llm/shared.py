"""Session helpers of the operators: the shared folder, tables kept in it, joins that bear hot keys, a bounded sieve."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from codonlake.functions.skew import join_unique

__all__ = ["Scratch", "cut", "folder", "free_names", "join_unique", "made", "made_since", "names_in", "packed", "partitions", "sieve", "table", "unpacked", "with_texts", "written"]


def folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. On one machine it may be unset (tests); elsewhere that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'codonlake-checkpoints')}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared checkpoint folder, so that lost executors cost no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Folders of tables that operators and stages made in this process and haven't dropped.
_MADE: list[str] = []


def written(df: DataFrame, replaces: list[str] | None = None) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again.

    replaces: folders (as from `made_since`) that only df's plan still reads; they are deleted once it is written."""
    path = f"{folder(df.sparkSession)}/stage-{df.sparkSession.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for old in replaces or []:
        _delete(df.sparkSession, old)
    _MADE.append(path)
    return df.sparkSession.read.parquet(path)


def made_since(n: int) -> list[str]:
    """The folders of tables made since there were n of them."""
    return _MADE[n:]


def made() -> int:
    """How many folders of tables there are."""
    return len(_MADE)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _MADE:
        _MADE.remove(path)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names of the tables in a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(f.getPath().getName() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where))


class Scratch:
    """Tables of one run of an operator, as Parquet in the shared folder. Each is dropped when no later step reads it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.path = f"{folder(spark)}/run-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
        _MADE.append(self.path)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes the tables; shuffle files of plans that nothing refers to any more go with them."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for name in names:
            path = hadoop.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self._free()

    def only(self, *names: str) -> None:
        """Deletes all tables but these."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(self.path)
        for found in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path):
            if found.getPath().getName() not in names:
                found.getPath().getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(found.getPath(), True)
        self._free()

    def _free(self) -> None:
        gc.collect()
        self.spark._jvm.System.gc()  # Spark deletes the shuffles of collected plans


#: Bits of a sieve; its broadcast table has at most a 64th as many rows.
SIEVE_BITS = 1 << 24


def sieve(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be among the keys, before a join that shuffles: all that are, and few others.

    Keys set bits of one bitmap of fixed size, kept as words of 64 bits and broadcast, so the broadcast is
    bounded whatever the number of keys; a full bitmap lets more rows pass, and the join decides."""
    slot = f"pmod(xxhash64(`{key}`), {SIEVE_BITS}L)"
    words = keys.select(F.expr(slot).alias("_slot")).groupBy(F.expr("_slot div 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_slot % 64 as int)))").alias("_mask"))
    placed = rows.withColumn("_slot", F.expr(slot)).withColumn("_word", F.expr("_slot div 64"))
    passed = placed.join(F.broadcast(words), "_word").filter("shiftright(_mask, cast(_slot % 64 as int)) & 1 = 1")
    return passed.select(*rows.columns)


def packed(df: DataFrame, **columns) -> DataFrame:
    """Each row as one struct `row`, which clashes with no name, beside the given columns."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame, names: list[str], **instead) -> DataFrame:
    """The columns of a packed row, some with another value instead."""
    return df.select(*[(instead[c] if c in instead else F.col(f"row.`{c}`")).alias(c) for c in names])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores appended to those that df (or one before) has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_texts(df: DataFrame, text_col: str, new: dict[str, DataType], function: Callable[[], Callable[[list], Iterator[tuple[int, list[pa.Array]]]]]) -> DataFrame:
    """All columns of df and the new ones that a function of the texts gives. What it passes through stays Arrow data,
    so any type, null and name of another column comes out as it went in.

    function() is called once in a task; what it returns takes a batch's texts and yields (number of rows, arrays)."""
    names, at = df.columns, df.columns.index(text_col)
    passed = [StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)]
    schema = StructType([*passed, *[StructField(f"n{i}", kind) for i, kind in enumerate(new.values())]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = function()
        for batch in batches:
            begin = 0
            for n, arrays in work(batch.column(at).to_pylist()):
                part = batch.slice(begin, n)
                begin += n
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=schema.names)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, schema).toDF(*names, *new)
