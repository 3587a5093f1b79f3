"""Value, mask and decay of each channel on the hourly grid.

All windows share one partitioning (the admission) and two orders, so eight channels cost one shuffle and two sorts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinprep import config
from clinprep.functions import rint
from clinprep.operators.hourly import hours_of
from clinprep.sources.shared import fresh_name


def _up() -> Window:
    return Window.partitionBy("admission_id").orderBy("hours_since_admission").rowsBetween(Window.unboundedPreceding, 0)


def _down() -> Window:
    """A running frame over the reversed order; a frame to the following end would read the tail again for each row."""
    return Window.partitionBy("admission_id").orderBy(F.desc("hours_since_admission")).rowsBetween(Window.unboundedPreceding, 0)


def population_means(hourly: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """V1: one row, mean_<channel> over observed cells; null for a channel never observed."""
    return hourly.agg(*[F.avg(c).alias(f"mean_{c}") for c in channels or config.CHANNELS])


def channel_sums(channels: list[str]) -> list[Column]:
    """Aggregates of the hourly table that fix the parameters of V1 and V8: the values that are standardised are the observed ones, rounded."""
    out = []
    for c in channels:
        x = rint(F.col(c), 3)
        out += [F.avg(c).alias(f"mean_{c}"), F.avg(x).alias(f"mu_{c}"), F.stddev_pop(x).alias(f"sd_{c}"), F.count(c).alias(f"n_{c}")]
    return out


Parameters = dict[str, float | None]


def parameters(found: Parameters | DataFrame) -> Parameters:
    """mean_, mu_, sd_ (and n_) of each channel by name, from aggregates or a table of one row; a spread of 0 or none counts as 1."""
    row = found.first().asDict() if isinstance(found, DataFrame) else found  # a few numbers a channel
    return {k: (v if v is not None and v > 0 else 1.0) if k.startswith("sd_") else v for k, v in row.items()}


def neutral_fill(hourly: DataFrame, channel: str) -> DataFrame:
    """V2: only the leading gap (a whole series that was never observed) becomes the population mean."""
    mean = F.lit(parameters(population_means(hourly, [channel]))[f"mean_{channel}"]).cast("double")
    seen = F.last(channel, True).over(_up())
    return hourly.withColumn(channel, F.when(seen.isNull(), mean).otherwise(F.col(channel)))


def _seen(c: str) -> dict[str, Column]:
    """What the windows say of a channel: the places of the last and the next observed cell, and their values, the row's own included."""
    x, pos = F.col(c), F.when(F.col(c).isNotNull(), F.col("hours_since_admission"))
    return {"before": F.max(pos).over(_up()), "after": F.min(pos).over(_down()), "carried": F.last(x, True).over(_up()), "ahead": F.last(x, True).over(_down())}


def _expand(c: str, base: float, mean: Column, hours: Column, seen: dict[str, Column]) -> dict[str, Column]:
    x, pos = F.col(c), F.col("hours_since_admission")
    before, after, carried, ahead = (seen[k] for k in ("before", "after", "carried", "ahead"))
    end = F.coalesce(after, hours)
    gap = F.when(before.isNull(), end - pos).otherwise(pos - before)
    back = end - pos
    value = F.coalesce(carried, mean)
    return {
        f"{c}_value": rint(value, 3),
        f"{c}_mask": x.isNotNull().cast("int"),
        f"{c}_decay": rint(F.pow(F.lit(base), gap), 6),
        f"{c}_gap_hours": gap.cast("int"),
        f"{c}_fill_kind": F.when(x.isNotNull(), "observed").when(before.isNotNull(), "locf").otherwise("neutral_fill"),
        f"{c}_next_value": rint(F.when(before.isNull(), mean).otherwise(F.coalesce(ahead, carried)), 3),
        f"{c}_backward_gap_hours": back.cast("int"),
        f"{c}_backward_decay": rint(F.pow(F.lit(base), back), 6),
    }


def value_mask_decay(hourly: DataFrame, channels: list[str] | None = None, base: float = config.DECAY_BASE, means: Parameters | DataFrame | None = None, length: str | None = None) -> DataFrame:
    """V2-V7: eight further columns a channel. Needs admission_id and hours_since_admission (0, 1, ...). Without ``means`` the table is read for them.

    Windows are columns of their own first: each mention of one inside an expression would be computed anew. Rows without an observed cell tell
    the others nothing but the length of the stay, so a table that has it as a column ``length`` may lack them.
    """
    channels = [c for c in (channels or config.CHANNELS) if c in hourly.columns]
    known = parameters(population_means(hourly, channels) if means is None else means)
    hours = fresh_name(hourly, "hours")
    found = {c: {k: (fresh_name(hourly, f"{k}_{c}"), w) for k, w in _seen(c).items()} for c in channels}
    windows = {name: w for of in found.values() for name, w in of.values()}
    rows = hourly.withColumns({hours: F.col(length) if length else F.max("hours_since_admission").over(Window.partitionBy("admission_id")) + 1} | windows)
    new = reduce(lambda a, b: a | b, (_expand(c, base, F.lit(known[f"mean_{c}"]).cast("double"), F.col(hours), {k: F.col(name) for k, (name, _) in found[c].items()}) for c in channels), {})
    return rows.withColumns(new).drop(hours, *windows)


#: What a run knows of a channel for its hours: places and values of the last observed cell up to its bin, of the next one from its bin on, and of the next one after it.
RUN_SEEN = ["before", "carried", "after", "ahead", "later", "later_ahead"]


def _run_names(channels: list[str]) -> dict[str, dict[str, str]]:
    return {c: {k: f"{c}_run_{k}" for k in RUN_SEEN} for c in channels}


def seen_by_runs(runs: DataFrame) -> DataFrame:
    """Runs (hourly.stay_runs) with what the windows of V2-V7 say of each channel. Only bins hold observed cells, so windows over them serve all hours."""
    channels = [c for c in config.CHANNELS if c in runs.columns]
    beyond = Window.partitionBy("admission_id").orderBy(F.desc("hours_since_admission")).rowsBetween(Window.unboundedPreceding, -1)
    new = {}
    for c, names in _run_names(channels).items():
        pos = F.when(F.col(c).isNotNull(), F.col("hours_since_admission"))
        new |= {names[k]: w for k, w in _seen(c).items()}
        new |= {names["later"]: F.min(pos).over(beyond), names["later_ahead"]: F.last(c, True).over(beyond)}
    return runs.withColumns(new)


def without_seen(runs: DataFrame) -> DataFrame:
    return runs.drop(*[name for names in _run_names(config.CHANNELS).values() for name in names.values()])


def expand_runs(runs: DataFrame, means: Parameters, base: float = config.DECAY_BASE) -> DataFrame:
    """V2-V7 of the hourly table that runs with their windows (``seen_by_runs``) stand for: value_mask_decay of it, without a shuffle, a sort or a window over its hours."""
    channels = [c for c in config.CHANNELS if c in runs.columns]
    names = _run_names(channels)
    carried = ["hours", *[name for of in names.values() for name in of.values()]]
    rows = hours_of(runs, *carried)
    pos, own = F.col("hours_since_admission"), F.col("bin_place")
    new = {}
    for c, of in names.items():
        got = {k: F.when(pos >= own, F.col(of[k])) for k in ("before", "carried")}
        got |= {k: F.when(pos <= own, F.col(of[k])).otherwise(F.col(of[later])) for k, later in (("after", "later"), ("ahead", "later_ahead"))}
        new |= _expand(c, base, F.lit(means[f"mean_{c}"]).cast("double"), F.col("hours"), got)
    return rows.withColumns(new).drop("bin_place", *carried)


def statistics(vmd: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """One row, mu_<channel> and sd_<channel> of the rounded values of observed cells; a spread of 0 or none counts as 1."""
    out = []
    for c in channels or config.CHANNELS:
        x = F.when(F.col(f"{c}_mask") == 1, F.col(f"{c}_value"))
        sd = F.stddev_pop(x)
        out += [F.avg(x).alias(f"mu_{c}"), F.when(sd > 0, sd).otherwise(1.0).alias(f"sd_{c}")]
    return vmd.agg(*out)


def standardise(vmd: DataFrame, channels: list[str] | None = None, stats: Parameters | DataFrame | None = None) -> DataFrame:
    """V8: <channel>_z and <channel>_next_z, with given statistics when serving; their spread is guarded alike.

    Without statistics the table is read for them; ``channel_sums`` of the hourly table gives the same numbers without its windows.
    """
    channels = [c for c in (channels or config.CHANNELS) if f"{c}_value" in vmd.columns]
    known = parameters(statistics(vmd, channels) if stats is None else stats)
    z = lambda c, of: rint((F.col(f"{c}_{of}") - F.lit(known[f"mu_{c}"]).cast("double")) / F.lit(known[f"sd_{c}"]), 4)
    return vmd.withColumns({f"{c}_{out}": z(c, of) for c in channels for out, of in (("z", "value"), ("next_z", "next_value"))})


def wide_sums(sums: Callable[[str], dict[str, Column]], channels: list[str] | None = None) -> list[Column]:
    """The aggregates that ``by_channel`` takes, a column for each channel and name."""
    return [x.alias(f"{c}__{name}") for c in channels or config.CHANNELS for name, x in sums(c).items()]


def by_channel(df: DataFrame, sums: Callable[[str], dict[str, Column]], channels: list[str] | None = None, one: DataFrame | None = None) -> DataFrame:
    """(channel, ...): a row for each channel, of aggregates over its own columns; the table is summed wide, so no row is copied for each channel.
    ``one``: a row with these aggregates, if they were taken already."""
    made = {c: sums(c) for c in channels or config.CHANNELS}
    one = df.agg(*wide_sums(sums, channels)) if one is None else one
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), *[F.col(f"{c}__{name}").alias(name) for name in of]) for c, of in made.items()])))


def channel_audit_sums(c: str) -> dict[str, Column]:
    mask, n = F.col(f"{c}_mask"), lambda kind: F.count(F.when(F.col(f"{c}_fill_kind") == kind, 1))
    return {
        "observed": n("observed"),
        "locf": n("locf"),
        "neutral": n("neutral_fill"),
        "observed_pct": rint(100.0 * F.avg(mask), 2),
        "max_gap": F.max(f"{c}_gap_hours"),
        "mean_decay_imputed": rint(F.avg(F.when(mask == 0, F.col(f"{c}_decay"))), 4),
        "mean_used": rint(F.avg(F.when(mask == 1, F.col(f"{c}_value"))), 3),
    }


def channel_audit(vmd: DataFrame, channels: list[str] | None = None, one: DataFrame | None = None) -> DataFrame:
    """V9: (channel, observed, locf, neutral, observed_pct, max_gap, mean_decay_imputed, mean_used); mean_used: what neutral fills hold."""
    return by_channel(vmd, channel_audit_sums, channels, one)


def neutral_check(standardised: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """(channel, worst): the largest absolute z among neutral-filled cells."""
    return by_channel(standardised, lambda c: {"worst": F.coalesce(F.max(F.when(F.col(f"{c}_fill_kind") == "neutral_fill", F.abs(f"{c}_z"))), F.lit(0.0))}, channels)
