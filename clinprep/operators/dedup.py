"""Exact and key duplicates, told by a digest first.

Only a 128-bit digest of each row's key columns is shuffled for all rows. Rows whose digest repeats, the suspects, are few;
they alone are shuffled whole and compared by all their columns, so rows of one digest are never taken for equal unread.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinprep.sources.shared import fresh_name, spread, store

#: Digests that repeat are broadcast up to this size; beyond, rows are shuffled to meet them, dealt out by number.
BROADCAST_BYTES, DIGEST_BYTES = 64 << 20, 32
#: Bits of a number that tells null columns.
FLAGS = 62


def _keys(df: DataFrame, subset: list[str] | None) -> list[str]:
    return [c for c in (subset or df.columns) if c in df.columns and c != "row_index"]


def row_digest(df: DataFrame, keys: list[str]) -> tuple[Column, Column]:
    """128 bits of the key columns. Hashes pass over nulls, so which columns are null takes part; zeros of either sign are one."""
    kinds = dict(df.dtypes)
    values = [F.col(c) + F.lit(0.0) if kinds[c] in ("double", "float") else F.col(c) for c in keys]
    flags = [reduce(Column.__add__, [F.col(c).isNull().cast("long") * (1 << i) for i, c in enumerate(keys[at : at + FLAGS])]) for at in range(0, len(keys), FLAGS)]
    return F.xxhash64(*flags, *values), F.xxhash64(F.lit("second"), *values, *flags)


class Repeats:
    """The digests of ``df`` that repeat, as a written table, and the rows that have them."""

    def __init__(self, df: DataFrame, subset: list[str] | None = None, digest: Callable | None = None):
        self.df, self.keys = df, _keys(df, subset)
        self.names = [fresh_name(df, n) for n in ("digest_hi", "digest_lo")]
        marked = zip(self.names, (digest or row_digest)(df, self.keys), strict=True)
        self.marked = df.withColumns(dict(marked))
        # hardly any digest repeats within a task, so they are dealt out by rows and counted there
        found = spread(self.marked.select(*self.names), *self.names, like=df).groupBy(*self.names).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        self.digests = store(found, "repeated-digests")
        self.n, self.rows = self.digests.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()  # digests that repeat, and their rows
        self.digests = self.digests.select(*self.names)
        if self.n * DIGEST_BYTES <= BROADCAST_BYTES:
            self.digests = F.broadcast(self.digests)
        else:  # rows are shuffled to the tasks of their digests, so these grow in number with the rows
            self.digests = spread(self.digests, *self.names, n=df.count())

    def suspects(self) -> DataFrame:
        return self.marked.join(self.digests, self.names, "left_semi").drop(*self.names)

    def others(self) -> DataFrame:
        """Rows that equal no other one."""
        return self.marked.join(self.digests, self.names, "left_anti").drop(*self.names)

    def ranked(self, keep: str) -> tuple[DataFrame, str]:
        """The suspects with their number among equal rows; nulls are equal. They are dealt out by their digests, which tell most of them
        apart before a column is compared."""
        order = F.col("row_index").asc() if keep == "first" else F.col("row_index").desc()
        nth = fresh_name(self.df, "nth")
        rows = spread(self.marked.join(self.digests, self.names, "left_semi"), *self.names, n=self.rows)
        return rows.withColumn(nth, F.row_number().over(Window.partitionBy(*self.names, *self.keys).orderBy(order))).drop(*self.names), nth

    def kept(self, keep: str) -> DataFrame:
        rows, nth = self.ranked(keep)
        return rows.filter(F.col(nth) == 1).drop(nth)

    def distinct(self, keep: str = "first") -> DataFrame:
        """One row of each set of equal rows; the table as it is where no digest repeats."""
        return self.others().unionByName(self.kept(keep)) if self.n else self.df

    def counts(self) -> DataFrame:
        """One row: redundant rows, and rows in any set of equal rows."""
        if not self.n:
            return self.df.sparkSession.createDataFrame([(0, 0)], "redundant long, involved long")
        n = self.suspects().groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n"))
        return n.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("involved"))


def remove_duplicates(df: DataFrame, subset: list[str] | None = None, keep: str = "first", digest: Callable | None = None) -> DataFrame:
    """One row of each set of equal rows (or equal keys): the first or last by ``row_index``. Nulls are equal."""
    return Repeats(df, subset, digest).distinct(keep)


def dropped_rows(df: DataFrame, subset: list[str] | None = None, keep: str = "first", digest: Callable | None = None) -> DataFrame:
    """The rows that remove_duplicates leaves out."""
    rows, nth = Repeats(df, subset, digest).ranked(keep)
    return rows.filter(F.col(nth) > 1).drop(nth)


def count_duplicates(df: DataFrame, subset: list[str] | None = None, digest: Callable | None = None) -> DataFrame:
    """One row: redundant rows, and rows in any set of equal rows."""
    return Repeats(df, subset, digest).counts()


def dedup_audit(df: DataFrame, subset: list[str] | None = None, keep: str = "first", kept: DataFrame | None = None, before: Repeats | None = None, after: Repeats | None = None) -> DataFrame:
    """One row: strategy, rows before and after, removed, still redundant, involved. ``kept``: the deduplicated table, if it is there;
    ``before`` and ``after``: the repeated digests of both tables, if they are known."""
    before = before or Repeats(df, subset)
    kept = before.distinct(keep) if kept is None else kept
    rows = lambda t, name: t.agg(F.count(F.lit(1)).alias(name))
    one = rows(df, "rows_before").crossJoin(before.counts().select("involved")).crossJoin(rows(kept, "rows_after"))
    one = one.crossJoin((after or Repeats(kept, subset)).counts().select(F.col("redundant").alias("remaining")))  # one row each
    return one.select(F.lit(f"keep_{keep}").alias("strategy"), "rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("removed"), "remaining", "involved")


def verify_dropped(df: DataFrame, dropped: DataFrame, subset: list[str] | None = None, keep: str = "first", digest: Callable | None = None) -> DataFrame:
    """(row_index, n_matches): how many kept rows each dropped row equals; 1 is right.

    Rows meet by their digest and are compared whole then; kept rows whose digest no dropped row has are not shuffled.
    """
    found = Repeats(df, subset, digest)
    make = digest or row_digest
    told = lambda rows, side: rows.select(*[c.alias(f"{side}_{n}") for c, n in zip(make(rows, found.keys), ("hi", "lo"), strict=True)], F.struct(*found.keys).alias(f"{side}_row"), F.col("row_index").alias(f"{side}_index"))
    left = told(dropped, "d")
    wanted = store(left.select("d_hi", "d_lo").distinct(), "dropped-digests")
    wanted = F.broadcast(wanted) if wanted.count() * DIGEST_BYTES <= BROADCAST_BYTES else wanted
    kept = told(found.distinct(keep), "k")
    kept = kept.join(wanted, (F.col("k_hi") == F.col("d_hi")) & (F.col("k_lo") == F.col("d_lo")), "left_semi")
    same = (F.col("d_hi") == F.col("k_hi")) & (F.col("d_lo") == F.col("k_lo")) & F.col("d_row").eqNullSafe(F.col("k_row"))
    return left.join(kept, same, "left").groupBy(F.col("d_index").alias("row_index")).agg(F.count("k_index").alias("n_matches"))
