"""Datetimes by surface form, and one window for each admission."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from clinprep import config
from clinprep.functions import hours_between, parse_datetime, parse_stripped, rint, spelling, strip
from clinprep.sources.shared import fresh_name, spread, store


def _present(df: DataFrame, columns: list[str] | None) -> list[str]:
    return [c for c in (columns or config.TIME_COLUMNS) if c in df.columns]


def parse_times(df: DataFrame, columns: list[str] | None = None, fallbacks: list[str] | None = None, tolerant: bool = False) -> DataFrame:
    """Text columns become timestamps without a zone. Texts are stripped in a projection of their own, once.

    ``tolerant`` also reads, day first, whatever spelling a general parser knows of texts that begin with no listed one:
    each distinct text of that kind goes through it once. Without such texts nothing leaves the JVM.
    """
    names = _present(df, columns)
    texts = {c: fresh_name(df, f"text_{c}") for c in names}
    out = df.withColumns({texts[c]: strip(F.col(c)) for c in names})
    parsed = {c: parse_stripped(F.col(texts[c]), fallbacks) for c in names}
    if tolerant:
        found = tolerant_times(out, list(texts.values()), fallbacks)
        if found is not None:
            for c in names:
                known, made = fresh_name(out, f"known_{c}"), fresh_name(out, f"made_{c}")
                out = out.join(found.select(F.col("text").alias(known), F.col("instant").alias(made)), F.col(texts[c]) == F.col(known), "left").drop(known).withColumnRenamed(made, f"{texts[c]}_made")
                parsed[c] = F.coalesce(parsed[c], F.col(f"{texts[c]}_made"))
    return out.withColumns(parsed).select(*df.columns)


#: Distinct texts that are broadcast once they are parsed; beyond, cells are shuffled to meet them.
BROADCAST_TEXTS = 200_000


def _general(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pandas()
        zoned = texts.map(lambda t: pd.to_datetime(t, dayfirst=True, errors="coerce"))
        plain = zoned.map(lambda t: t.tz_localize(None) if isinstance(t, pd.Timestamp) and t.tzinfo else t)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pd.to_datetime(plain, errors="coerce").astype("datetime64[us]"), pa.timestamp("us"), from_pandas=True)], ["text", "instant"])


def tolerant_times(df: DataFrame, columns: list[str], fallbacks: list[str] | None = None) -> DataFrame | None:
    """(text, instant) of the distinct stripped texts that begin with no known spelling and that no listed form reads; None without any."""
    cells = df.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("text")).distinct()
    left = store(cells.filter((spelling(F.col("text")) == config.UNRECOGNISED) & parse_stripped(F.col("text"), fallbacks).isNull() & (F.col("text") != "")), "leftover-texts")
    n = left.count()
    if not n:
        return None
    found = store(left.mapInArrow(_general, "text string, instant timestamp_ntz").filter("instant is not null"), "tolerant-times")
    return F.broadcast(found) if n <= BROADCAST_TEXTS else found


def long_texts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(row_index, column, value) of some columns."""
    return df.select("row_index", *[F.col(c).cast("string").alias(c) for c in columns]).unpivot("row_index", columns, "column", "value")


def parse_audit(df: DataFrame, columns: list[str] | None = None, fallbacks: list[str] | None = None) -> DataFrame:
    """(column, spellings, fallback_parsed, unparseable): one row a column, of the text table."""
    cells = long_texts(df, _present(df, columns)).filter("value is not null")
    known = spelling(strip(F.col("value")))
    parsed = parse_datetime(F.col("value"), fallbacks)
    other = known == config.UNRECOGNISED
    return cells.groupBy("column").agg(
        F.countDistinct(F.when(~other, known)).alias("spellings"),
        F.count(F.when(other & parsed.isNotNull(), 1)).alias("fallback_parsed"),
        F.count(F.when(parsed.isNull(), 1)).alias("unparseable"),
    )


def spelling_counts(df: DataFrame, columns: list[str] | None = None, stripped: bool = True) -> DataFrame:
    """(column, spelling, n); P3 looks at the text as it stands, T3 at the stripped text."""
    cells = long_texts(df, _present(df, columns)).filter("value is not null")
    text = strip(F.col("value")) if stripped else F.col("value")
    return cells.groupBy("column", spelling(text).alias("spelling")).agg(F.count(F.lit(1)).alias("n"))


def naive_disagreements(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n): cells that a month-first parser would read as another day."""
    cells = long_texts(df, _present(df, columns))
    day, month = (F.regexp_extract(strip(F.col("value")), r"^(\d{2})/(\d{2})/\d{4} \d{2}:\d{2}$", i).try_cast("int") for i in (1, 2))
    wrong = parse_datetime(F.col("value"), []).isNotNull() & (day <= 12) & (day != month)
    return cells.groupBy("column").agg(F.count(F.when(wrong, 1)).alias("n"))


def admission_windows(df: DataFrame) -> DataFrame:
    """(admission_id, w_intime, w_outtime): majority votes, ties to the earliest."""
    return df.filter("admission_id is not null").groupBy("admission_id").agg(F.mode("intime", True).alias("w_intime"), F.mode("outtime", True).alias("w_outtime"))


def _voted(df: DataFrame, dealt: bool = False, like: DataFrame | None = None) -> tuple[DataFrame, dict[str, str], WindowSpec]:
    """``df`` with the majority's times of each row's admission, the names of these columns, and the window of an admission.

    One shuffle deals rows out by admission, to tasks that grow in number with the rows; rows without one are each alone and keep their own
    times, so they are no hot key. Ties go to the earliest time. Rows that are dealt out by admission already, none without, stay where they are.
    """
    if dealt:
        keyed, stay = df, Window.partitionBy("admission_id")
    else:
        lone = fresh_name(df, "lone")
        keyed = spread(df.withColumn(lone, F.when(F.col("admission_id").isNull(), F.monotonically_increasing_id())), "admission_id", lone, like=df if like is None else like)
        stay = Window.partitionBy("admission_id", lone)
    names = {c: fresh_name(df, f"voted_{c}") for c in ("intime", "outtime")}
    return keyed.withColumns({name: F.mode(c, True).over(stay) for c, name in names.items()}), names, stay


def reconcile_windows(df: DataFrame, dealt: bool = False, like: DataFrame | None = None) -> DataFrame:
    """One window an admission, chart times inside it, and the length of stay in hours. ``df`` is read once, but for a count of
    its rows. ``dealt``: ``df`` is dealt out by admission, and no row is without one. ``like``: a written table of as many rows."""
    votes, names, _ = _voted(df, dealt, like)
    start, end = F.col(names["intime"]), F.col(names["outtime"])
    chart = F.col("charttime")
    clamped = F.when(chart < start, start).when(chart > end, end).otherwise(chart)
    windowed = votes.withColumns({"charttime": clamped, "intime": start, "outtime": end}).select(*df.columns)
    return windowed.withColumn("length_of_stay_hours", rint(hours_between(F.col("intime"), F.col("outtime")), 2))


def window_audit(df: DataFrame) -> DataFrame:
    """One row of counts over parsed times: conflicting and inverted windows, chart times before and after."""
    votes, names, stay = _voted(df)
    start, end = F.col(names["intime"]), F.col(names["outtime"])
    differ = lambda c: F.min(c).over(stay) < F.max(c).over(stay)
    first = F.row_number().over(stay.orderBy("admission_id")) == 1
    flags = votes.select(
        F.when(first & F.col("admission_id").isNotNull(), differ("intime").cast("long")).alias("ins"), F.when(first & F.col("admission_id").isNotNull(), differ("outtime").cast("long")).alias("outs"),
        (end <= start).alias("inverted"), (F.col("charttime") < start).alias("before"), (F.col("charttime") > end).alias("after"),
    )
    count = lambda c: F.count(F.when(F.col(c), 1))
    total = F.coalesce(F.sum(F.coalesce("ins", F.lit(0)) + F.coalesce("outs", F.lit(0))), F.lit(0))
    return flags.agg(total.alias("conflicting_windows"), count("inverted").alias("inverted_windows"), count("before").alias("clamped_before"), count("after").alias("clamped_after"))


def stay_summary(df: DataFrame) -> DataFrame:
    """One row of min, median and max stay over rows, and the admissions."""
    c = F.col("length_of_stay_hours")
    return df.agg(F.min(c).alias("min"), F.median(c).alias("median"), F.max(c).alias("max"), F.countDistinct("admission_id").alias("admissions"))
