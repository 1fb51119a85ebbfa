"""The shared folder: tables that cut lineage, and archive files with a committed manifest.

Executors share no local disk, so whatever one task writes for another goes to the folder named in
``spark.checkpoint.dir``. Tables are written by Spark. Archive files are written by tasks through
``pyarrow.fs`` under a name of their own attempt; only the rows that Spark commits to the manifest name the files
that count, so a task that is lost and run again leaves at most an unnamed file behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from ..sources.folders import shared_dir

#: Folders that this session has saved tables in.
_MADE: list[str] = []


def saved(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """The same rows, written once as Parquet to the shared folder and read back."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    path = f"{folder}/{name}"
    _MADE.append(folder)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make returns, saved; the tables saved on the way to it are deleted, for nothing reads them any more."""
    before = len(_MADE)
    out = saved(make(), name)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in _MADE[before:-1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    del _MADE[before:-1]
    return out


def trained_dictionary(samples: list[bytes], size: int) -> bytes:
    """A Zstandard dictionary trained on the samples; of too few of them to train on, their own content serves as one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def unused(df: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of df has, for columns that are put beside those of a user's table."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def new_file(folder: str, suffix: str) -> tuple[str, fs.FileSystem, str]:
    """A name that no other attempt of any task uses: (its URI, the file system, its path there)."""
    name = f"{uuid.uuid4().hex}{suffix}"
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)
    return f"{folder}/{name}", system, f"{path}/{name}"
