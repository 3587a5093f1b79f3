"""The tables behind the review figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinprep import config
from clinprep.functions import numeric_view
from clinprep.operators import cells

BINS = 44


def histogram(values: DataFrame, column: str, low: float, high: float, bins: int = BINS) -> DataFrame:
    """(bin, n): equal bins over the range of the values between low and high; the top edge is in the last bin."""
    kept = values.filter(F.col(column).between(low, high)).select(F.col(column).alias("x"))
    span = kept.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    place = F.when(F.col("hi") > F.col("lo"), at).otherwise(0).cast("int")
    return kept.crossJoin(F.broadcast(span)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row


def temperature_bands(raw: DataFrame) -> DataFrame:
    """One row: raw magnitudes in the Celsius band (30-45) and in the Fahrenheit band (90-115)."""
    x = numeric_view(F.col("temperature"))
    return raw.agg(F.count(F.when(x.between(30, 45), 1)).alias("celsius"), F.count(F.when(x.between(90, 115), 1)).alias("fahrenheit"))


def observation_grid(processed: DataFrame, channel: str, k: int = 30, hours: int = 48) -> DataFrame:
    """A row for each of the first k admissions: its mask by hour, zero-padded, and the observed share."""
    first = processed.select("admission_id").distinct().orderBy("admission_id").limit(k)  # k rows
    rows = processed.filter(F.col("hours_since_admission") < hours).join(F.broadcast(first), "admission_id", "left_semi")
    grid = rows.groupBy("admission_id").pivot("hours_since_admission", list(range(hours))).agg(F.max(f"{channel}_mask")).na.fill(0)
    names = [str(h) for h in range(hours)]
    total = sum((F.col(h) for h in names[1:]), F.col(names[0]))
    return grid.select("admission_id", F.concat_ws("", *[F.col(h).cast("string") for h in names]).alias("mask"), (F.lit(100.0) * total / hours).alias("observed_pct"))


def densest_admission(processed: DataFrame, channel: str) -> DataFrame:
    """(admission_id): the largest number of observed cells, ties to the smaller id."""
    return processed.groupBy("admission_id").agg(F.sum(f"{channel}_mask").alias("seen")).orderBy(F.desc("seen"), "admission_id").limit(1).select("admission_id")


def trajectory(processed: DataFrame, channel: str, hours: int = 48) -> DataFrame:
    """The first hours of the densest admission."""
    fields = [f for f in ("value", "mask", "decay", "refined") if f"{channel}_{f}" in processed.columns]
    one = F.broadcast(densest_admission(processed, channel))  # one row
    rows = processed.join(one, "admission_id", "left_semi").filter(F.col("hours_since_admission") < hours)
    return rows.select("admission_id", "hours_since_admission", *[F.col(f"{channel}_{f}").alias(f) for f in fields])


def ranked_channels(scores: DataFrame) -> DataFrame:
    """Channels from the largest to the smallest improvement."""
    return scores.orderBy(F.desc("improvement_pct"), "channel")


def order_ablation(raw: DataFrame) -> DataFrame:
    """(channel, right_order, wrong_order): observations that survive ranges after units, and before units."""
    names = config.CHANNELS
    right = cells.validate_ranges(cells.convert_units(raw))
    wrong = cells.validate_ranges(raw)
    counts = lambda df, out: df.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "channel", out)
    return counts(right, "right_order").join(counts(wrong, "wrong_order"), "channel")
