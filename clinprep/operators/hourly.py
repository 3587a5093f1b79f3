"""H1-H7: from events to a contiguous grid of admission and hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinprep import config
from clinprep.functions import floor_hour, hours_between, rint

KEY = ["admission_id", "hour"]


def usable_events(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["admission_id", *config.TIME_COLUMNS])


def _bins(df: DataFrame, channels: list[str] | None, *more: Column) -> DataFrame:
    channels = [c for c in (channels or config.CHANNELS) if c in df.columns]
    statics = [c for c in config.STATIC_COLUMNS if c in df.columns]
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row_index")))
    hourly = usable_events(df).withColumn("hour", floor_hour(F.col("charttime")))
    return hourly.groupBy(*KEY).agg(*[F.avg(c).alias(c) for c in channels], *[first(c).alias(c) for c in statics], F.count(F.lit(1)).alias("events"), *more)


def bin_hours(df: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """H1: a row for each admission and hour with events: means of channels, first non-null of static columns."""
    return _bins(df, channels)


def _hours_of(start: Column, end: Column) -> tuple[Column, Column]:
    """The first and the last hour of a window."""
    floor_end = floor_hour(end)
    return floor_hour(start), F.when(floor_end == end, floor_end).otherwise(floor_end + F.expr("interval 1 hour"))


def _last_hour(max_hours: int) -> Column:
    return F.col("start") + F.make_dt_interval(F.lit(0), F.lit(max_hours - 1))


def hour_grid(df: DataFrame, max_hours: int = config.MAX_HOURS) -> DataFrame:
    """H2, H5: (admission_id, hour, hours_since_admission, truncated) from the first to the last hour of each window.

    The cap is applied before hours are made, so a corrupt discharge cannot blow up the grid.
    """
    stays = usable_events(df).groupBy("admission_id").agg(F.min("intime").alias("i"), F.max("outtime").alias("o"))
    start, end = _hours_of(F.col("i"), F.col("o"))
    stays = stays.select("admission_id", start.alias("start"), end.alias("end")).filter("end >= start")
    last = _last_hour(max_hours)
    hours = F.sequence("start", F.least("end", last), F.expr("interval 1 hour"))
    return stays.select("admission_id", (F.col("end") > last).alias("truncated"), F.posexplode(hours).alias("hours_since_admission", "hour"))


def fill_both_ways(c: Column | str) -> Column:
    """H4: forward fill over the stay, then backward fill of what leads."""
    up = Window.partitionBy("admission_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("admission_id").orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(c, True).over(up), F.last(c, True).over(down))


def build_hourly(df: DataFrame, max_hours: int = config.MAX_HOURS) -> DataFrame:
    """H1-H5: the hourly table.

    Bins are dealt out by admission once. There each bin makes the rows from its own hour up to the next bin's, the first one also
    those before it, so the grid is never joined nor shuffled. Static columns are filled over the bins, which are few, before the rows are
    made: what a row holds is what its bin holds. Bins outside the grid give nothing.
    """
    return hours_of(stay_runs(df, max_hours))


#: What a run has beside its admission, its bin's ``hour``, channels and statics.
RUN = ["start", "since", "until", "hours", "hours_since_admission"]


def stay_runs(df: DataFrame, max_hours: int = config.MAX_HOURS) -> DataFrame:
    """The hourly table in runs: for each bin what its hours hold, and the hours that it makes, ``since`` to ``until``. ``hours`` is the length of
    the stay, ``hours_since_admission`` the place of the bin; channels of a bin outside the grid are null."""
    bins = _bins(df, None, F.min("intime").alias("in_"), F.max("outtime").alias("out_"))
    statics = [c for c in config.STATIC_COLUMNS if c in bins.columns]
    channels = [c for c in config.CHANNELS if c in bins.columns]
    stay = Window.partitionBy("admission_id")
    order = stay.orderBy("hour")
    start, end = _hours_of(F.min("in_").over(stay), F.max("out_").over(stay))
    placed = bins.select(*KEY, *channels, *statics, start.alias("start"), end.alias("end"), F.lag("hour").over(order).alias("before"), F.lead("hour").over(order).alias("next"))
    one = F.expr("interval 1 hour")
    last = F.least("end", _last_hour(max_hours))
    inside = F.col("hour").between(F.col("start"), last)
    filled = placed.withColumns({c: fill_both_ways(F.when(inside, F.col(c))) for c in statics})
    since = F.when(F.col("before").isNull(), F.col("start")).otherwise(F.greatest("hour", "start"))
    until = F.least(F.coalesce(F.col("next") - one, last), last)
    ranged = filled.withColumns({"since": since, "until": until, "hours": _place(F.col("start"), last) + 1, "hours_since_admission": _place(F.col("start"), F.col("hour"))})
    own = F.col("hour").between(F.col("since"), F.col("until"))
    return ranged.filter("end >= start and since <= until").select(*KEY, *[F.when(own, F.col(c)).alias(c) for c in channels], *statics, *RUN)


def _place(start: Column, hour: Column) -> Column:
    return F.floor(hours_between(start, hour)).cast("int")


def hours_of(runs: DataFrame, *carried: str) -> DataFrame:
    """The hourly table that runs stand for, made without a shuffle. ``carried`` are columns of a run that its hours hold too, after the place of its bin, ``bin_place``."""
    channels = [c for c in config.CHANNELS if c in runs.columns]
    statics = [c for c in config.STATIC_COLUMNS if c in runs.columns]
    more = [F.col("hours_since_admission").alias("bin_place"), *carried] if carried else []
    grid = runs.select("admission_id", F.col("hour").alias("bin"), "start", *channels, *statics, *more, F.explode(F.sequence("since", "until", F.expr("interval 1 hour"))).alias("hour"))
    own = F.col("hour") == F.col("bin")
    since_start = _place(F.col("start"), F.col("hour")).alias("hours_since_admission")
    return grid.select("hour", "admission_id", *[F.when(own, F.col(c)).alias(c) for c in channels], *statics, since_start, *(["bin_place", *carried] if carried else []))


def run_rows() -> Column:
    """How many hours a run makes."""
    return F.timestamp_diff("HOUR", F.col("since"), F.col("until")) + 1


def expansion_audit(df: DataFrame, max_hours: int = config.MAX_HOURS) -> DataFrame:
    """H6: one row: rows before and after, factor, admissions, merged events, truncated admissions, hours a stay."""
    before = usable_events(df).agg(F.count(F.lit(1)).alias("rows_before"))
    bins = bin_hours(df).agg(F.coalesce(F.sum("events") - F.count(F.lit(1)), F.lit(0)).alias("merged_observations"))
    stays = hour_grid(df, max_hours).groupBy("admission_id").agg(F.count(F.lit(1)).alias("hours"), F.max("truncated").alias("truncated"))
    after = stays.agg(
        F.coalesce(F.sum("hours"), F.lit(0)).alias("rows_after"),
        F.count(F.lit(1)).alias("admissions"),
        F.count(F.when(F.col("truncated"), 1)).alias("truncated_admissions"),
        F.min("hours").alias("hours_min"),
        F.median("hours").alias("hours_median"),
        F.max("hours").alias("hours_max"),
    )
    factor = rint(F.col("rows_after") / F.greatest("rows_before", F.lit(1)), 2)
    return before.crossJoin(bins).crossJoin(after).withColumn("factor", factor)  # one row each


def _missing(df: DataFrame, out: str) -> DataFrame:
    names = [c for c in config.CHANNELS if c in df.columns]
    shares = df.agg(*[rint(100.0 * F.avg(F.col(c).isNull().cast("double")), 2).alias(c) for c in names])
    return shares.unpivot([], names, "channel", out)


def missing_before_after(df: DataFrame, hourly: DataFrame) -> DataFrame:
    """H7: (channel, before, after): percent missing in events and on the grid."""
    return _missing(usable_events(df), "before").join(_missing(hourly, "after"), "channel")
