"""Tables that cut lineage: written once to the folder that driver and executors share.

A written table survives the loss of the executors that made it, is computed once however
often it is read, and lets later reads prune columns. The folder is ``spark.checkpoint.dir``;
where that is unset, a session on one machine (tests, a laptop) gets a folder of its own and any other one an error.
Within ``scratch`` the tables that were written are dropped at its end, but for those that are kept.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

SETTING = "spark.checkpoint.dir"
#: Bytes of a generated method that the JVM still compiles; Spark's own limit is far above.
METHOD_SETTING, SPARKS_METHOD_BYTES, METHOD_BYTES = "spark.sql.codegen.hugeMethodLimit", 65_535, 8_000
#: Paths and tables of the open scratch scopes, the innermost last.
_SCOPES: list[list[tuple[str, str | None]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    found = spark.conf.get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"set {SETTING} to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _written(path: str, name: str | None = None, keep: bool = False) -> None:
    scope = _SCOPES[:-1] if keep else _SCOPES
    if scope:
        scope[-1].append((path, name))


def drop(spark: SparkSession, path: str, name: str | None = None) -> None:
    """Delete a written table; what still reads it fails from then on."""
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drop at the end what was written meanwhile, but for tables stored with ``keep``, which belong to the scope around this one."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path, name in _SCOPES.pop():
            drop(spark, path, name)


#: Rows of a file of a table that is dealt out later. Spark takes a file for 4 MB at least (spark.sql.files.openCostInBytes), so a task of 128 MB
#: reads 32 files at most, however few bytes they have.
FILE_ROWS = 50_000


def store(df: DataFrame, tag: str, partition_by: str | None = None, codec: str = "zstd", keep: bool = False, file_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    Beyond 200 parts a task that deals rows out holds all that it reads in memory. Rows that pack to a few bytes would make that millions, and ever
    more as the table grows; ``file_rows`` bounds the rows of a file, and by that the rows of a reading task.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    _written(path, keep=keep)
    writer = df.write.option("compression", codec)
    if file_rows:
        writer = writer.option("maxRecordsPerFile", file_rows)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of such a file where each stands for some ten hours of the grid.
FILE_RUNS = 5_000


#: Rows of a task of a spread table, for rows as wide as an event or an hour of the grid.
SPREAD_ROWS = 200_000
#: Events of such a task where an hourly table is made of them: an event becomes some ten hours.
SPREAD_EVENTS = 50_000


#: Parts up to which a task writes the rows that it deals out straight to files (spark.shuffle.sort.bypassMergeThreshold); for more it holds and sorts them.
UNSORTED_PARTS = 200


def spread(df: DataFrame, *keys: str, rows: int = SPREAD_ROWS, like: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """``df`` dealt out by hash of the keys to as many tasks as it has times ``rows`` rows; a small table as it stands.

    ``df``, or the table ``like`` it, should be a written one, whose rows are counted from its footers; ``n`` is their number, where it is known. Its bytes say little: columns that
    repeat pack to a few bytes a row, so tasks cut by bytes, or a fixed number of them, sort ever more rows each as the table grows.
    """
    n = (df if like is None else like).count() if n is None else n
    return df if n <= rows else df.repartition(-(-n // rows), *keys)


def store_measured(df: DataFrame, tag: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """``store`` in files of few rows, with aggregates of the written table, which reads the columns that they need."""
    table = store(df, tag, file_rows=FILE_ROWS)
    return table, table.agg(*metrics).first().asDict()  # one row


def store_observed(df: DataFrame, tag: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """``store``, with aggregates of ``df`` (no distinct ones) that are taken while it is written."""
    seen = Observation()
    table = store(df.observe(seen, *metrics), tag)
    return table, seen.get


def store_bucketed(df: DataFrame, tag: str, key: str, buckets: int, sort: bool = True) -> tuple[DataFrame, str]:
    """Write ``df`` in ``buckets`` hash buckets of ``key``: the table and its folder. Joins on the key need no shuffle of it.

    ``df`` should come from ``repartition(buckets, key)`` if its rows are small, so that each
    bucket is one file.
    """
    spark = df.sparkSession
    name, path = f"{tag}_{uuid.uuid4().hex}", fresh_path(spark, tag)
    _written(path, name)
    writer = df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key)
    if sort:
        writer = writer.sortBy(key)
    writer.saveAsTable(name)
    return spark.table(name), path


def compiled_methods(spark: SparkSession) -> None:
    """Keep the stages of wide tables compiled; a limit that the user has set stays.

    Projections of many columns become one generated method that is too long for the JVM's compiler, so it runs
    interpreted, row by row. Beyond this limit Spark cuts them into functions instead.
    """
    if int(spark.conf.get(METHOD_SETTING, str(SPARKS_METHOD_BYTES))) == SPARKS_METHOD_BYTES:
        spark.conf.set(METHOD_SETTING, str(METHOD_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (case does not tell names apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
