"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import itertools
import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java form of a word: what lies between space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. Where none is named a local one is set on one machine; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        named = os.path.join(tempfile.gettempdir(), "geoweave-shared")
        spark.sparkContext.setCheckpointDir(named)
    return named


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet under the shared folder and reads it back: lineage ends there, and lost
    executors cost nothing that was written. The folder goes by forget, or when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/geoweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, store = _place(spark, path)
    store.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Removes what stored has written, once nothing is read from it any more."""
    for df in frames:
        place, store = _place(df.sparkSession, df.stored_at)
        store.delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: Column | str, mod: int) -> Column:
    """crc32 of the value written as text, modulo mod (a null value: of the empty text)."""
    value = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")) % mod


def rows_of(batch, names: list[str], step: int = 256):
    """Python tuples of an Arrow batch, a few rows at a time, so that long texts are not all held twice."""
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def chunks(items, n: int):
    it = iter(items)
    while part := list(itertools.islice(it, n)):
        yield part


_held: list = []


def only(key, make):
    """What make returns, kept for later tasks of this Python worker until another key is asked for: workers outlive
    stages, whose models and memos would add up. make must give equal things for equal keys."""
    if not _held or _held[0] != key:
        _held.clear()
        gc.collect()
        tidy()
        _held[:] = key, make()
    return _held[1]


def tidy() -> None:
    """Gives this process's free memory back to the machine; a task calls it when it is done."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


#: Keys longer than this are not held by a memo.
LONG = 64


class Bounded(dict):
    """A memo of two generations: when the young one is full it becomes the old one, and what is found there comes
    back. Results never depend on what it holds; it has 2 * most entries of keys up to LONG at most."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(key) > LONG:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
