"""Hiding observed cells, and scoring imputations on them.

Cells are picked by a hash of seed, channel, admission and hour, so the choice needs no sort and does not depend on
partitions; shares are met up to the square root of the number of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinprep import config
from clinprep.functions import rint
from clinprep.sources.shared import fresh_name, spread, store

MIN_CHANNEL = 40
CELL = ["admission_id", "hours_since_admission", "channel"]


def drawn(channel: Column, share: float, seed: int = config.SEED) -> Column:
    """Whether a cell's hash falls into ``share`` of all hashes."""
    text = F.concat_ws("|", F.lit(str(seed)), channel, "admission_id", F.col("hours_since_admission").cast("string"))
    return F.substring(F.md5(text), 1, 4) < F.lit(f"{int(round(share * 65536)):04x}")


def observed_cells(hourly: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """(admission_id, hours_since_admission, channel, truth) of all observed cells."""
    names = channels or config.CHANNELS
    return hourly.unpivot(CELL[:2], names, "channel", "truth").filter("truth is not null")


def _hash(channel: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), channel, "admission_id", F.col("hours_since_admission").cast("string")))


#: Hexadecimal digits of a hash by which cells are counted before the last ones are told apart.
DIGITS = 3


def smallest(cells: DataFrame, hashed: str, fraction: float) -> DataFrame:
    """For each channel the cells with the smallest hashes: as many as ``fraction`` of all (rounded half up), and what ties with the last.

    No sort of all cells: counts by the first digits of the hash tell which digits hold the last hash that is taken; only cells
    with these digits are ranked. ``total`` counts the cells of a channel, also those without a hash.
    """
    digits = F.substring(hashed, 1, DIGITS)
    counts = cells.groupBy("channel", digits.alias("digits")).agg(F.count(F.lit(1)).alias("n"))
    per: dict[str, list] = {}
    for r in counts.collect():  # 16^DIGITS rows a channel at most
        per.setdefault(r["channel"], []).append((r["digits"], r["n"]))
    edges = []
    for channel, found in per.items():
        left = int(fraction * sum(n for _, n in found) + 0.5)
        for at, n in sorted(f for f in found if f[0] is not None):
            if left <= n:
                edges.append((channel, at, left))
                break
            left -= n
        else:
            edges.append((channel, "g", 0))  # fewer hashes than wanted: all are taken
    edge = F.broadcast(cells.sparkSession.createDataFrame(edges, "e_channel string, e_digits string, e_left int"))  # a row for each channel
    near = cells.join(edge, F.col("channel") == F.col("e_channel"))
    rank = F.rank().over(Window.partitionBy("channel").orderBy(hashed))
    last = near.filter(digits == F.col("e_digits")).withColumn("rank", rank).filter(F.col("rank") <= F.col("e_left")).drop("rank")
    return near.filter(digits < F.col("e_digits")).unionByName(last).select(*cells.columns)


def holdout(hourly: DataFrame, mode: str = "random", fraction: float = config.HOLDOUT_FRACTION, block_length: int = 3, seed: int = config.SEED, exact: bool = False) -> DataFrame:
    """B1, B2: the held cells. Blocks are runs of consecutive observed cells of one admission and channel that fit in it.

    Shares are met up to the square root of the number of cells. ``exact``: as many cells of each channel as the share asks for, in whole
    runs until it is met for blocks, whatever the partitions.
    """
    cells = observed_cells(hourly)
    if mode != "random":
        cells = spread(cells, "admission_id", "channel", like=hourly)
    series = Window.partitionBy("admission_id", "channel")
    order = series.orderBy("hours_since_admission")
    nth, n = F.row_number().over(order), F.count(F.lit(1)).over(series)
    if mode == "random":
        if not exact:
            return cells.filter(drawn(F.col("channel"), fraction, seed))
        return smallest(store(cells.withColumn("hashed", _hash(F.col("channel"), seed)), "cells"), "hashed", fraction).select(*CELL, "truth")
    fits = nth + block_length - 1 <= n
    covering = order.rowsBetween(1 - block_length, 0)
    if exact:  # a cell goes with the smallest hash of the runs that hold it
        starts = cells.withColumn("start", F.when(fits, _hash(F.col("channel"), seed)))
        return smallest(store(starts.withColumn("hashed", F.min("start").over(covering)), "cells"), "hashed", fraction).select(*CELL, "truth")
    share = 1 - (1 - fraction) ** (1 / block_length)
    starts = cells.withColumn("start", drawn(F.col("channel"), share, seed) & fits)
    return starts.withColumn("held", F.max("start").over(covering)).filter("held").select(*CELL, "truth")


def hide(hourly: DataFrame, held: DataFrame, channels: list[str] | None = None, flag: str | None = None) -> DataFrame:
    """``hourly`` without the held cells. ``flag`` names a further column: whether any cell of the row is held."""
    names = channels or config.CHANNELS
    hidden = fresh_name(hourly, "hidden")
    flags = held.groupBy(*CELL[:2]).agg(F.collect_set("channel").alias(hidden))  # a name for each channel at most
    joined = spread(hourly, *CELL[:2]).join(flags, CELL[:2], "left")
    if flag:
        joined = joined.withColumn(flag, F.col(hidden).isNotNull())
    return joined.withColumns({c: F.when(F.coalesce(F.array_contains(hidden, c), F.lit(False)), None).otherwise(F.col(c)) for c in names}).drop(hidden)


def enough(hourly: DataFrame, channels: list[str] | None = None) -> list[str]:
    """The channels with MIN_CHANNEL observed cells or more."""
    names = channels or config.CHANNELS
    seen = hourly.agg(*[F.count(c).alias(c) for c in names]).first()  # one row
    return [c for c in names if seen[c] >= MIN_CHANNEL]


def mask_cells(hourly: DataFrame, fraction: float = config.MASK_FRACTION, seed: int = config.SEED + 1, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(corrupted, truth): a share of the observed cells of each channel with enough of them (``names``, if known) is hidden.

    ``corrupted`` also has <channel>_truth, the values it hides; ``truth`` has a row for each of them.
    """
    names = enough(hourly) if names is None else names
    hidden = {f"{c}_truth": F.when(F.col(c).isNotNull() & drawn(F.lit(c), fraction, seed), F.col(c)) for c in names}  # only observed cells are hashed
    marked = hourly.withColumns(hidden) if names else hourly
    corrupted = marked.withColumns({c: F.when(F.col(f"{c}_truth").isNull(), F.col(c)) for c in names}) if names else marked
    cells = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"{c}_truth").alias("truth")) for c in names]) if names else F.array().cast("array<struct<channel:string,truth:double>>")
    return corrupted, corrupted.select(*CELL[:2], F.explode(cells).alias("cell")).select(*CELL[:2], "cell.*").filter("truth is not null")


def held_errors(truth: DataFrame, imputed: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The held cells with each method's value: fields maps a method to the column suffix that it fills."""
    key = CELL[:2]
    have = lambda f: [c for c in config.CHANNELS if f"{c}_{f}" in imputed.columns]
    pick = lambda f: F.coalesce(*[F.when(F.col("channel") == c, F.col(f"i_{c}_{f}")) for c in have(f)])
    wanted = dict.fromkeys(fields.values())
    rows = imputed.select(*key, *[F.col(f"{c}_{f}").alias(f"i_{c}_{f}") for f in wanted for c in have(f)])
    return truth.join(rows, key).select(*CELL, "truth", *[pick(f).alias(m) for m, f in fields.items()])


def score(errors: DataFrame, base: str = "locf", other: str = "refined") -> DataFrame:
    """(channel, n, mae_*, rmse_*, improvement_pct)."""
    gap = lambda m: F.col(m) - F.col("truth")
    both = [m for m in (base, other) if m in errors.columns]
    out = errors.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"),
        *[rint(F.avg(F.abs(gap(m))), 4).alias(f"mae_{m}") for m in both],
        *[rint(F.sqrt(F.avg(gap(m) * gap(m))), 4).alias(f"rmse_{m}") for m in both],
    )
    if len(both) == 2:
        pct = F.when(F.col(f"mae_{base}") > 0, rint(100.0 * (F.col(f"mae_{base}") - F.col(f"mae_{other}")) / F.col(f"mae_{base}"), 2))
        out = out.withColumn("improvement_pct", pct)
    return out


def pooled(errors: DataFrame, base: str = "locf", other: str = "refined") -> DataFrame:
    """One row: pooled errors in units of each channel's spread of held truth; channels tested (and improved)."""
    both = [m for m in (base, other) if m in errors.columns]
    channels = errors.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop("truth").alias("sd"), *[F.sum(F.abs(F.col(m) - F.col("truth"))).alias(m) for m in both]
    )
    sd = F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    sums = [rint(F.sum(F.col(m) / sd) / F.sum("n"), 4).alias(f"pooled_mae_{m}") for m in both]
    better = [F.count(F.when(F.col(other) < F.col(base), 1)).alias("channels_improved")] if len(both) == 2 else []
    return channels.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cells"), *sums, *better, F.count(F.lit(1)).alias("channels_tested"))
