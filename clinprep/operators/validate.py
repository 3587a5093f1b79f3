"""Claims re-derived from the tables as assertions, and the report's tables.

Assertions are rows (name, passed, expected, observed, note); each group of them is one aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinprep import config
from clinprep.functions import rint
from clinprep.operators import hourly as hourly_ops
from clinprep.operators import vmd
from clinprep.operators.dedup import count_duplicates

SCHEMA = ["name", "passed", "expected", "observed", "note"]


def _row(name: str, passed: Column, expected, observed, note: str = "") -> Column:
    text = lambda x: x.cast("string") if isinstance(x, Column) else F.lit(str(x))
    return F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), text(expected).alias("expected"), text(observed).alias("observed"), F.lit(note).alias("note"))


def _rows(one: DataFrame, *rows: Column) -> DataFrame:
    return one.select(F.inline(F.array(*rows)))


def _none(name: str, count: Column, note: str = "") -> Column:
    return _row(name, count == 0, 0, count, note)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def table_assertions(raw: DataFrame, cleaned: DataFrame, expected_rows: DataFrame) -> DataFrame:
    """A1: row count as audited, no duplicates, no admission lost, stays positive. expected_rows: one row (rows_after)."""
    one = cleaned.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("admission_id").alias("kept"), F.min("length_of_stay_hours").alias("stay"))
    one = one.crossJoin(raw.agg(F.countDistinct("admission_id").alias("admissions"))).crossJoin(count_duplicates(cleaned)).crossJoin(expected_rows.select("rows_after"))  # one row each
    return _rows(
        one,
        _row("rows_kept_as_audited", F.col("rows") == F.col("rows_after"), F.col("rows_after"), F.col("rows")),
        _none("cleaned_rows_are_distinct", F.col("redundant")),
        _row("all_admissions_kept", F.col("kept") == F.col("admissions"), F.col("admissions"), F.col("kept")),
        _row("stays_last_some_time", F.col("stay") > 0, "> 0 hours", F.col("stay")),
    )


def range_assertions(cleaned: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """A2: every ranged column within its bounds."""
    ranges = {c: r for c, r in (ranges or config.RANGES).items() if c in cleaned.columns}
    one = cleaned.agg(*[F.count(F.when(~F.col(c).between(*r), 1)).alias(c) for c, r in ranges.items()])
    return _rows(one, *[_none(f"{c}_in_range", F.col(c), f"allowed {lo}-{hi}") for c, (lo, hi) in ranges.items()])


def grid_assertions(hourly: DataFrame) -> DataFrame:
    """A3: one row an admission and hour, and no gap in any admission."""
    hours = hourly.groupBy("admission_id", "hour").agg(F.count(F.lit(1)).alias("n"))
    span = F.timestamp_diff("SECOND", F.min("hour"), F.max("hour")) / 3600 + 1
    stays = hours.groupBy("admission_id").agg(F.sum(F.col("n") - 1).alias("doubled"), (F.count(F.lit(1)) == span).alias("contiguous"))
    one = stays.agg(F.coalesce(F.sum("doubled"), F.lit(0)).alias("doubled"), F.count(F.when(F.col("contiguous"), 1)).alias("whole"), F.count(F.lit(1)).alias("stays"))
    return _rows(
        one,
        _none("hours_not_doubled", F.col("doubled")),
        _row("hours_without_gaps", F.col("whole") == F.col("stays"), "all admissions", F.concat_ws("/", F.col("whole").cast("string"), F.col("stays").cast("string"))),
    )


def channel_claims(processed: DataFrame, channels: list[str] | None = None) -> tuple[list[Column], list[Column]]:
    """A4 as aggregates, and the claims over them."""
    channels = [c for c in (channels or config.CHANNELS) if f"{c}_value" in processed.columns]
    bad = lambda ok: F.count(F.when(~F.coalesce(ok, F.lit(False)), 1))
    sums = []
    for c in channels:
        sums += [bad(F.col(f"{c}_value").isNotNull()).alias(f"v_{c}"), bad(F.col(f"{c}_mask").isin(0, 1)).alias(f"m_{c}"), bad(F.col(f"{c}_decay").between(0, 1)).alias(f"d_{c}")]
    return sums, [_none(f"{c}_{what}", F.col(f"{k}_{c}")) for c in channels for k, what in (("v", "values_present"), ("m", "mask_is_0_or_1"), ("d", "decay_from_0_to_1"))]


def channel_assertions(processed: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """A4: for each channel, values complete, masks 0 or 1, decays between 0 and 1."""
    sums, claims = channel_claims(processed, channels)
    return _rows(processed.agg(*sums), *claims)


def observed_rows(processed: DataFrame) -> DataFrame:
    """The rows with an observed cell, some tenth of a grid: claims about observed cells need no others, whose refinement is then never computed."""
    masks = [F.coalesce(F.col(f"{c}_mask") == 1, F.lit(False)) for c in config.CHANNELS if f"{c}_mask" in processed.columns]
    return processed.filter(reduce(Column.__or__, masks))


def fabrication_assertions(processed: DataFrame, audit: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """A5: refinement left observed values as they were, by the table and by its own audit (channel, observed_modified)."""
    channels = [c for c in (channels or config.CHANNELS) if f"{c}_refined" in processed.columns]
    worst = [F.coalesce(F.max(F.when(F.col(f"{c}_mask") == 1, F.abs(F.col(f"{c}_refined") - F.col(f"{c}_value")))), F.lit(0.0)).alias(c) for c in channels]
    rows = _rows(observed_rows(processed).agg(*worst), *[_row(f"{c}_observed_values_unchanged", F.col(c) < 1e-6, "0 (exact)", F.col(c)) for c in channels])
    return rows.unionByName(_rows(audit.agg(F.sum("observed_modified").alias("n")), _none("refinement_reports_no_observed_change", F.col("n"))))


def verdict(assertions: DataFrame) -> DataFrame:
    """One row: total, failed, and the names of those that failed."""
    failed = F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("name"))))
    return assertions.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(~F.col("passed"), 1)).alias("failed"), F.array_join(failed, ",").alias("failed_names"))


def before_after_statistics(raw_numbers: DataFrame, cleaned: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """(channel, stage, n, mean, sd, min, max)."""
    names = channels or config.CHANNELS
    parts = []
    for stage, df in (("before", raw_numbers), ("after", cleaned)):
        cells = df.unpivot([], names, "channel", "value") if set(df.columns) == set(names) else df.select(*names).unpivot([], names, "channel", "value")
        parts.append(cells.groupBy("channel").agg(F.count("value").alias("n"), rint(F.avg("value"), 9).alias("mean"), rint(F.stddev_pop("value"), 9).alias("sd"), F.min("value").alias("min"), F.max("value").alias("max")).withColumn("stage", F.lit(stage)))
    return union_all(parts)


def record_counts(raw: DataFrame, cleaned: DataFrame, hourly: DataFrame) -> DataFrame:
    """(stage, records)."""
    return union_all([df.agg(F.count(F.lit(1)).alias("records")).withColumn("stage", F.lit(stage)) for stage, df in (("raw", raw), ("cleaned", cleaned), ("hourly", hourly))])


def schema_table(df: DataFrame) -> DataFrame:
    """(position, column, dtype, observed) of a table: its columns with their types and their cells that are not null."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"n{i}").alias("observed")) for i, (c, t) in enumerate(df.dtypes)]
    return counts.select(F.inline(F.array(*rows)))


def missing_by_stage(cleaned: DataFrame, hourly: DataFrame, processed: DataFrame) -> DataFrame:
    """(channel, raw, hourly, final): percent missing."""
    final = processed.agg(*[rint(100.0 * F.avg(F.col(f"{c}_value").isNull().cast("double")), 2).alias(c) for c in config.CHANNELS]).unpivot([], config.CHANNELS, "channel", "final")
    both = hourly_ops.missing_before_after(cleaned, hourly).withColumnsRenamed({"before": "raw", "after": "hourly"})
    return both.join(final, "channel")


def recovery(truth: DataFrame, recovered: DataFrame) -> DataFrame:
    """(defect, injected, recovered, pct) of a manifest (defect, injected) and counts (defect, recovered)."""
    pct = F.when(F.col("injected") > 0, rint(100.0 * F.col("recovered") / F.col("injected"), 1))
    return truth.join(recovered, "defect", "left").select("defect", "injected", F.coalesce("recovered", F.lit(0)).alias("recovered")).withColumn("pct", pct)


def observed_shares(processed: DataFrame) -> DataFrame:
    """(channel, observed_pct)."""
    return vmd.by_channel(processed, lambda c: {"observed_pct": rint(100.0 * F.avg(f"{c}_mask"), 2)})


def gap_starts(hourly: DataFrame) -> DataFrame:
    """The rows after a gap in an admission's hours: (admission_id, hour, step_hours)."""
    previous = F.lag("hour").over(Window.partitionBy("admission_id").orderBy("hour"))
    step = F.timestamp_diff("SECOND", previous, F.col("hour")) / 3600
    return hourly.select("admission_id", "hour", step.alias("step_hours")).filter("step_hours <> 1")
