"""Profiling the raw text table from a dictionary of its values.

``value_counts`` reads the table once and counts each column's distinct texts, nulls included; spellings, unit tokens,
variants, implausible cells, medians and missing shares all follow from that table, which is small where values repeat. Every
function takes either the raw table or such a dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinprep import config
from clinprep.functions import numeric_view, rint, spelling, strip
from clinprep.operators.dedup import count_duplicates, row_digest
from clinprep.sources.shared import store

BARE = "<bare number>"
MAX_VARIANTS = 25
DICTIONARY = ["column", "value", "n"]
#: The name under which a dictionary holds digests of whole rows.
ROW = "<row>"
#: Distinct numbers of a column that one task sorts for an exact median; beyond, histograms narrow down to it.
MAX_DISTINCT = 1_000_000
#: Buckets of a histogram.
BUCKETS = 1024


def _columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "row_index"]


def value_counts(df: DataFrame, columns: list[str] | None = None, rows: bool = False) -> DataFrame:
    """(column, value, n): how often each text, or null, stands in a column; one scan, summed in each task before the shuffle.

    ``rows`` adds the digest of each whole row as a column ROW of its own.
    """
    names = [c for c in (columns or _columns(df)) if c in df.columns]
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names]
    if rows:
        cells.append(F.struct(F.lit(ROW).alias("column"), F.concat_ws("-", *row_digest(df, _columns(df))).alias("value")))
    return df.select(F.inline(F.array(*cells))).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _counted(source: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The dictionary of some columns, from a table or a dictionary."""
    if source.columns != DICTIONARY:
        return value_counts(source, columns)
    return source.filter(F.col("column") != ROW) if columns is None else source.filter(F.col("column").isin(columns))


def planned_columns(df: DataFrame) -> list[str]:
    """The columns that a plan's evidence may be about: ranged ones, channels, and those whose values may be few. Values of the others are set
    into 64 bits by their hashes; more bits than MAX_VARIANTS show more values, so no such column is left out but for good."""
    sure = [c for c in _columns(df) if c in config.RANGES or c in config.CHANNELS]
    rest = [c for c in _columns(df) if c not in sure and c not in config.TIME_COLUMNS]
    bit = "bit_count(bit_or(CASE WHEN `{0}` IS NOT NULL THEN shiftleft(1L, CAST(xxhash64(CAST(`{0}` AS STRING)) & 63 AS INT)) END))"
    seen = df.agg(*[F.expr(bit.format(c)).alias(f"n_{i}") for i, c in enumerate(rest)]).first() if rest else []  # one row
    few = [c for c, n in zip(rest, seen, strict=True) if (n or 0) <= MAX_VARIANTS]
    return [c for c in _columns(df) if c in sure or c in few]


def column_profile(source: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(position, column, dtype, rows, missing, missing_pct). Of a dictionary, the columns must be named; they are texts."""
    if source.columns != DICTIONARY:
        return _profile_table(source)
    names = columns or config.RAW_COLUMNS
    one = _counted(source, names).groupBy("column").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"))
    position = F.array_position(F.array(*[F.lit(c) for c in names]), F.col("column")).cast("int") - 1
    return one.select(position.alias("position"), "column", F.lit("string").alias("dtype"), "rows", "missing", _percent("missing", "rows").alias("missing_pct"))


def _percent(part: str, whole: str) -> Column:
    return rint(F.lit(100.0) * F.col(part) / F.greatest(whole, F.lit(1)), 2)


def _profile_table(df: DataFrame) -> DataFrame:
    """Counts alone need no dictionary: one aggregation without a shuffle of values."""
    names, kinds = _columns(df), dict(df.dtypes)
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n_{i}") for i, c in enumerate(names)])
    cells = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), (F.col("rows") - F.col(f"n_{i}")).alias("missing")) for i, c in enumerate(names)]
    return one.select("rows", F.explode(F.array(*cells)).alias("cell")).select("cell.position", "cell.column", "cell.dtype", "rows", "cell.missing").withColumn("missing_pct", _percent("missing", "rows"))


def duplicate_profile(df: DataFrame) -> DataFrame:
    """Exact duplicates."""
    return count_duplicates(df)


def redundant_rows(counts: DataFrame) -> DataFrame:
    """One row (redundant): rows beyond the first of each digest, from a dictionary with rows; what a plan needs to know."""
    return counts.filter(F.col("column") == ROW).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant"))


def date_formats(source: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, spelling, n) of the text as it stands."""
    cells = _counted(source, columns or config.TIME_COLUMNS).filter("value is not null")
    return cells.groupBy("column", spelling(F.col("value")).alias("spelling")).agg(F.sum("n").alias("n"))


def unit_tokens(source: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, token, n) of columns with more than one token; the token's case is kept."""
    token = F.regexp_extract(strip(F.col("value")), config.UNIT_SUFFIX, 1)
    cells = _counted(source, columns or config.CHANNELS).filter("value is not null")
    counted = cells.groupBy("column", F.when(token == "", BARE).otherwise(token).alias("token")).agg(F.sum("n").alias("n"))
    return counted.withColumn("tokens", F.count(F.lit(1)).over(Window.partitionBy("column"))).filter("tokens > 1").drop("tokens")


def implausible_values(source: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(column, low, high, out_of_range, unparseable) of ranged columns with any of either."""
    ranges = ranges or config.RANGES
    cells = _counted(source, list(ranges)).filter("value is not null").withColumn("x", numeric_view(F.col("value")))
    low, high = (_of_column({c: r[i] for c, r in ranges.items()}) for i in (0, 1))
    outside = F.col("x").isNotNull() & ~F.col("x").between(low, high)
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    found = cells.groupBy("column").agg(n(outside).alias("out_of_range"), n(F.col("x").isNull()).alias("unparseable"))
    return found.filter("out_of_range + unparseable > 0").select("column", low.alias("low"), high.alias("high"), "out_of_range", "unparseable")


def _of_column(values: dict[str, float]) -> Column:
    """The number that goes with the name in ``column``."""
    return F.element_at(F.create_map(*[F.lit(x) for c, v in values.items() for x in (c, float(v))]), F.col("column"))


def categorical_variants(source: DataFrame, rsd: float | None = None) -> DataFrame:
    """(column, distinct_raw, distinct_casefold) of columns whose few values shrink when stripped and lower-cased.

    ``rsd``, for wide raw tables: HyperLogLog with this relative error first leaves out the columns whose estimate is beyond
    the limit by more than five times the error, so that their values are never counted one by one.
    """
    names = None
    if source.columns != DICTIONARY:
        names = [c for c in _columns(source) if c not in config.RANGES and c not in config.TIME_COLUMNS]
        if rsd is not None and names:
            seen = source.agg(*[F.approx_count_distinct(c, rsd).alias(f"n_{i}") for i, c in enumerate(names)]).first()  # one row
            names = [c for i, c in enumerate(names) if seen[i] <= MAX_VARIANTS * (1 + 5 * rsd)]
        if not names:
            return source.sparkSession.createDataFrame([], "column string, distinct_raw long, distinct_casefold long")
    cells = _counted(source, names).filter("value is not null").filter(~F.col("column").isin([*config.RANGES, *config.TIME_COLUMNS]))
    counts = cells.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_raw"), F.countDistinct(F.lower(strip(F.col("value")))).alias("distinct_casefold"))
    return counts.filter((F.col("distinct_raw") <= MAX_VARIANTS) & (F.col("distinct_raw") > F.col("distinct_casefold")))


def numeric_summary(source: DataFrame, columns: list[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """(column, min, median, max, observed) of the first number in each cell, two decimals.

    The median is exact. With ``accuracy`` it comes from a quantile sketch, and its rank is off by at most observed / accuracy.
    """
    names = columns or config.CHANNELS
    if accuracy is not None and source.columns != DICTIONARY:
        names = [c for c in names if c in source.columns]
        numbers = source.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), numeric_view(F.col(c)).alias("x")) for c in names]))).filter("x is not null")
        sketched = numbers.groupBy("column").agg(F.min("x").alias("lo"), F.percentile_approx("x", 0.5, accuracy).alias("mid"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("observed"))
        return sketched.select("column", rint(F.col("lo"), 2).alias("min"), rint(F.col("mid"), 2).alias("median"), rint(F.col("hi"), 2).alias("max"), "observed")
    numbers = numbers_of(source, names)
    out = numbers.groupBy("column").agg(rint(F.min("x"), 2).alias("min"), rint(F.max("x"), 2).alias("max"), F.sum("n").alias("observed"))
    mid = medians(numbers).select(F.col("column").alias("of"), "median")
    return out.join(F.broadcast(mid), F.col("column") == F.col("of")).select("column", "min", rint(F.col("median"), 2).alias("median"), "max", "observed")  # a row for each column


def numbers_of(source: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, x, n): the distinct first numbers of a column's cells and how often they stand, as a written table."""
    cells = _counted(source, columns or config.CHANNELS).filter("value is not null").select("column", numeric_view(F.col("value")).alias("x"), "n")
    return store(cells.filter("x is not null").groupBy("column", "x").agg(F.sum("n").alias("n")), "numbers")


def medians(numbers: DataFrame, most: int = MAX_DISTINCT) -> DataFrame:
    """(column, median) of numbers (column, x, n), exact: the middle one, or the mean of the two in the middle.

    Columns of up to ``most`` distinct numbers are sorted in a task each. For any larger one, histograms are refined: each pass counts the
    numbers of BUCKETS equal parts of the range that must hold the middle, so nothing is brought together but counts.
    """
    spark = numbers.sparkSession
    sizes = numbers.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()  # a row for each column
    few = [r["column"] for r in sizes if r["distinct"] <= most]
    out = numbers.filter(F.col("column").isin(few)).groupBy("column").agg(F.expr("percentile(x, 0.5, n)").alias("median"))
    wide = {r["column"]: r for r in sizes if r["distinct"] > most}
    if wide:
        found = [(c, (_ranked(numbers, c, r, (r["n"] - 1) // 2, most) + _ranked(numbers, c, r, r["n"] // 2, most)) / 2) for c, r in wide.items()]
        out = out.unionByName(spark.createDataFrame(found, "column string, median double"))
    return out


def _ranked(numbers: DataFrame, column: str, r, rank: int, most: int) -> float:
    """The number of this rank (from 0) in a column: histograms narrow its range until ``most`` distinct numbers are in it."""
    own, lo, hi, before, distinct = numbers.filter(F.col("column") == column), r["lo"], r["hi"], 0, r["distinct"]
    while distinct > most:
        share = (F.col("x") / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)  # halves, as the whole range may leave the doubles
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).alias("bucket")
        parts = own.filter(F.col("x").between(lo, hi)).groupBy(bucket).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        for part in sorted(parts.collect(), key=lambda p: p["bucket"]):  # BUCKETS at most
            if before + part["n"] > rank:
                break
            before += part["n"]
        lo, hi, distinct = part["lo"], part["hi"], part["distinct"]
    upto = F.sum("n").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))  # of at most `most` numbers
    return own.filter(F.col("x").between(lo, hi)).select("x", upto.alias("upto")).filter(F.col("upto") > rank - before).agg(F.min("x")).first()[0]


def top_missing(profile: DataFrame, k: int = 10) -> DataFrame:
    """The k columns with the most missing values, ties in column order."""
    return profile.filter("missing > 0").orderBy(F.desc("missing"), "position").limit(k).select("column", "missing", "missing_pct")
