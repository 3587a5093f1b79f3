"""Column expressions and tables shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: \x20 and \x09 to \x0D.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Documents are long, so that an Arrow batch of them holds few.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch in this session; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: A side of a join is broadcast up to this size, by the count of its rows.
BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` (a written table) marked for broadcast if it holds at most BROADCAST_BYTES; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: More rows than these don't go into the text of a query.
INLINE_ROWS = 1_000


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Some driver-made rows of numbers as a table: inline in the plan if they are few."""
    fields = [f.split() for f in schema.split(", ")]
    if len(rows) > INLINE_ROWS:
        return spark.createDataFrame(rows, schema)
    values = ", ".join("(" + ", ".join(f"cast({v!r} AS {kind})" for v, (_, kind) in zip(row, fields, strict=True)) + ")" for row in rows)
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"cast(NULL AS {kind}) AS {name}" for name, kind in fields)).limit(0)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(name for name, _ in fields)})")


def without_space(c: Column) -> Column:
    return F.translate(c, SPACE, "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def digest128(c: Column) -> Column:
    """A 128-bit content hash as 16 bytes."""
    return F.unhex(F.md5(c))


def positions(df: DataFrame, keys: list[str], order: list[Column], out: str, rows_per_bin: int = 50_000) -> DataFrame:
    """Number the rows of each key from 0, without bringing the rows of a key together.

    Rows fall into bins by hash; a bin's first number is the count of rows in the bins before it,
    and numbers inside a bin come from a window. The bin count follows the row count, so that
    a key with a third of all rows spreads over all tasks. Needs a column ``spread`` (a
    non-negative long, even over rows: a hash of a stored row number, not of an id that rows may share) and a total
    ``order`` inside a bin.
    """
    from pyspark.sql import Window

    bins = max(16, df.count() // rows_per_bin)
    binned = df.withColumn("_bin", F.pmod(F.col("spread"), F.lit(bins)))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = binned.groupBy(*keys, "_bin").count().select(*keys, "_bin", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(*order)
    numbered = binned.withColumn("_row", F.row_number().over(inside) - 1)
    return numbered.join(starts, [*keys, "_bin"]).withColumn(out, F.col("_start") + F.col("_row")).drop("_bin", "_start", "_row")
