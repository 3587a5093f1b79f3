"""A ridge regression for each channel refines imputed cells from the other channels.

For the fit, features are built in Arrow batches, all channels of a row at once, and the same stage sums the 43 x 43 normal
equations of its rows. Fitted weights are applied as column expressions, so whoever reads a few columns pays for these alone; the matrices of the tasks, one a channel, are added in levels and solved on the driver. What was fitted is a versioned
table that another job can apply.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinprep import config
from clinprep.functions import rint
from clinprep.operators import holdout, vmd
from clinprep.sources.shared import fresh_name, spread, store, store_measured

HARMONICS = 4
PERIOD_HOURS = 24.0 * 3.0
RIDGE = 1.0
MIN_ROWS = 30
#: Matrices of tasks that are added in a step.
FAN = 32
#: The order of features: the target's own terms (and between them one that weighs both neighbours), the same four of every
#: other channel, and the temporal basis.
OWN, OTHER = ["z", "next_z", "decay", "backward_decay", "mask"], ["z", "next_z", "mask", "decay"]
GAPS = ["gap_hours", "backward_gap_hours"]
N_FEATURES = len(OWN) + 1 + len(OTHER) * (len(config.CHANNELS) - 1) + 1 + 2 * HARMONICS


def temporal_basis(hours: Column) -> list[Column]:
    """1, and sine and cosine of k pi h / 72 for k = 1 to 4."""
    angle = lambda k: F.lit(float(k) * np.pi) * hours / F.lit(PERIOD_HOURS)
    waves = [f(angle(k)) for k in range(1, HARMONICS + 1) for f in (F.sin, F.cos)]
    return [F.lit(1.0), *waves]


def design(df: DataFrame, target: str, channels: list[str] | None = None) -> list[Column]:
    """the features of a target channel as columns; nulls and absent columns are 0."""
    def term(channel: str, suffix: str) -> Column:
        name = f"{channel}_{suffix}"
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)

    own = [term(target, suffix) for suffix in OWN]
    gap, back = (term(target, suffix) for suffix in GAPS)
    share = F.coalesce(back / F.nullif(gap + back, F.lit(0.0)), F.lit(1.0))
    between = share * own[0] + (1.0 - share) * own[1]
    others = [term(c, suffix) for c in (channels or config.CHANNELS) if c != target for suffix in OTHER]
    hours = F.col("hours_since_admission").cast("double") if "hours_since_admission" in df.columns else F.lit(0.0)
    return [*own[:-1], between, own[-1], *others, *temporal_basis(hours)]


class Features:
    """The features of design() for the rows of an Arrow batch."""

    def __init__(self, batch: pa.RecordBatch, channels: list[str]):
        self.batch, self.channels, self.n = batch, channels, batch.num_rows
        self.part = {s: np.stack([self.column(f"{c}_{s}") for c in channels], 1) for s in {*OWN, *OTHER, *GAPS}}
        angle = np.pi * self.column("hours_since_admission")[:, None] * np.arange(1, HARMONICS + 1) / PERIOD_HOURS
        self.basis = np.c_[np.ones(self.n), np.stack([np.sin(angle), np.cos(angle)], 2).reshape(self.n, -1)]

    def column(self, name: str, missing: float = 0.0) -> np.ndarray:
        at = self.batch.schema.get_field_index(name)
        if at < 0:
            return np.full(self.n, missing)
        return self.batch.column(at).cast(pa.float64()).fill_null(missing).to_numpy(zero_copy_only=False)

    def of(self, target: str) -> np.ndarray:
        k, part = self.channels.index(target), self.part
        own = [part[s][:, k] for s in OWN]
        gap, back = (part[s][:, k] for s in GAPS)
        share = np.divide(back, gap + back, out=np.ones(self.n), where=gap + back != 0)
        others = [part[s][:, i] for i in range(len(self.channels)) if i != k for s in OTHER]
        return np.c_[np.stack([*own[:-1], share * own[0] + (1.0 - share) * own[1], own[-1], *others], 1), self.basis]


def _needed(channels: list[str], df: DataFrame) -> list[str]:
    return ["hours_since_admission", *[f"{c}_{s}" for c in channels for s in sorted({*OWN, *OTHER, *GAPS}) if f"{c}_{s}" in df.columns]]


def hidden_rows(hourly: DataFrame, channels: list[str] | None = None, names: list[str] | None = None, length: str | None = None) -> tuple[DataFrame, list[str]]:
    """Rows with a hidden cell, rebuilt from what is left with parameters of their own, and the channels that hide cells; one pass over
    the hourly table for the parameters, one for the rows. With a column ``length`` of the stay, rows without an observed cell may be missing."""
    channels = channels or config.CHANNELS
    mask = lambda t: holdout.mask_cells(t, names=names)[0]
    names = holdout.enough(hourly) if names is None else names
    corrupted = mask(hourly)
    hidden = [c for c in channels if f"{c}_truth" in corrupted.columns]
    own = vmd.parameters(corrupted.agg(*vmd.channel_sums(channels)))
    rebuilt = vmd.standardise(vmd.value_mask_decay(mask(spread(hourly, "admission_id")), channels, means=own, length=length), channels, stats=own)
    if hidden:
        rebuilt = rebuilt.filter(F.coalesce(*[F.col(f"{c}_truth") for c in hidden]).isNotNull())
    return rebuilt.select(*_needed(channels, rebuilt), *[f"{c}_truth" for c in hidden]), hidden


def _examples(batch: pa.RecordBatch, channels: list[str], hidden: list[str], stats: vmd.Parameters) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(channel, features, standardised truth) of a batch's hidden cells."""
    rows = Features(batch, channels)
    for c in hidden:
        truth = np.rint(rows.column(f"{c}_truth", np.nan) * 1e3) / 1e3
        at = np.flatnonzero(~np.isnan(truth))
        if len(at):
            yield c, rows.of(c)[at], np.rint((truth[at] - stats[f"mu_{c}"]) / stats[f"sd_{c}"] * 1e4) / 1e4


def training_rows(hourly: DataFrame, stats: vmd.Parameters, channels: list[str] | None = None) -> DataFrame:
    """(channel, x, y): features of hidden cells, rebuilt from what is left, and their true value standardised by ``stats``."""
    channels = channels or config.CHANNELS
    rebuilt, hidden = hidden_rows(hourly, channels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, x, y in _examples(batch, channels, hidden, stats):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * N_FEATURES, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(y), pa.string()), lists, pa.array(y)], ["channel", "x", "y"])

    return rebuilt.mapInArrow(run, "channel string, x array<double>, y double")


GRAMS = "channel string, leg int, gram binary"


def _gram_rows(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    leg = TaskContext.get().partitionId()
    cells = [list(sums), [leg] * len(sums), [g.tobytes() for g in sums.values()]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.string(), pa.int32(), pa.binary()), strict=True)], ["channel", "leg", "gram"])


def _add(sums: dict[str, np.ndarray], channel: str, x: np.ndarray, y: np.ndarray) -> None:
    both = np.c_[x, y, np.ones(len(y))]  # one product holds x'x, x'y, y'y, sums and the count
    sums[channel] = sums.get(channel, 0.0) + both.T @ both


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One matrix for each (channel, leg) of a task."""
    sums: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for channel, leg, gram in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            sums[channel, leg] = sums.get((channel, leg), 0.0) + np.frombuffer(gram)
    cells = [[k[0] for k in sums], [k[1] for k in sums], [g.tobytes() for g in sums.values()]]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.string(), pa.int32(), pa.binary()), strict=True)], ["channel", "leg", "gram"])


def _solved(grams: DataFrame, ridge: float) -> dict[str, dict]:
    """Matrices of tasks are added FAN at a time until FAN or fewer a channel are left, which the driver adds and solves."""
    grams = store(grams, "grams")
    while (grams.agg(F.max("leg")).first()[0] or 0) >= FAN:
        legs = grams.withColumn("leg", F.floor(F.col("leg") / FAN).cast("int")).repartition("channel", "leg")
        grams = store(legs.mapInArrow(_merge, GRAMS), "grams")
    sums: dict[str, np.ndarray] = {}
    for r in grams.select("channel", "gram").collect():
        sums[r["channel"]] = sums.get(r["channel"], 0.0) + np.frombuffer(bytes(r["gram"]))
    out = {}
    for channel, gram in sorted(sums.items()):
        gram = gram.reshape(int(np.sqrt(gram.size)), -1)
        k, n = len(gram) - 2, gram[-1, -1]
        if n < MIN_ROWS:
            continue
        weights = np.linalg.solve(gram[:k, :k] + ridge * np.eye(k), gram[:k, k])
        residual = gram[k, k] - 2 * weights @ gram[:k, k] + weights @ gram[:k, :k] @ weights
        spread = gram[k, k] - gram[k, -1] ** 2 / n
        out[channel] = {"weights": weights.tolist(), "rows": int(round(n)), "n_features": k, "r2": round(float(1 - residual / (spread or 1.0)), 4)}
    return out


def fit_refiner(rows: DataFrame, ridge: float = RIDGE) -> dict[str, dict]:
    """F4 of rows (channel, x, y): by channel: weights, rows, n_features and in-sample r2. The intercept is penalised like the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            channels, x, y = np.array(batch.column(0).to_pylist()), batch.column(1), batch.column(2).to_numpy()
            for c in np.unique(channels):
                at = np.flatnonzero(channels == c)
                _add(sums, str(c), np.stack(x.take(pa.array(at)).to_numpy(zero_copy_only=False)), y[at])
        yield _gram_rows(sums)

    return _solved(rows.select("channel", "x", "y").mapInArrow(run, GRAMS), ridge)


def fit(hourly: DataFrame, stats: vmd.Parameters, channels: list[str] | None = None, ridge: float = RIDGE, length: str | None = None) -> dict[str, dict]:
    """F3, F4 of the hourly table: features and normal equations in one stage, so no row of features is ever written or shuffled.

    ``stats`` standardises the true values. Where they have counts (n_<channel>), channels with few cells are known from them. With a column
    ``length`` of the stay, rows without an observed cell may be missing: hidden cells and their neighbours are observed ones.
    """
    channels = channels or config.CHANNELS
    known = [c for c in channels if stats[f"n_{c}"] >= holdout.MIN_CHANNEL] if all(f"n_{c}" in stats for c in channels) else None
    rebuilt, hidden = hidden_rows(hourly, channels, known, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for c, x, y in _examples(batch, channels, hidden, stats):
                _add(sums, c, x, y)
        yield _gram_rows(sums)

    return _solved(rebuilt.mapInArrow(run, GRAMS), ridge)


MODEL = "version long, channel string, mean double, mu double, sd double, weights array<double>"


def save_model(spark: SparkSession, path: str, parameters: vmd.Parameters, weights: dict[str, list[float]]) -> int:
    """Statistics and weights as a new version of a table: a row for each channel. Earlier versions stay."""
    version = max(model_versions(spark, path), default=0) + 1
    rows = [(version, c, parameters.get(f"mean_{c}"), parameters.get(f"mu_{c}"), parameters.get(f"sd_{c}"), weights.get(c)) for c in config.CHANNELS if f"mu_{c}" in parameters]
    spark.createDataFrame(rows, MODEL).coalesce(1).write.parquet(f"{path}/version={version}")
    return version


def model_versions(spark: SparkSession, path: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def load_model(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """{parameters, weights} of a version, the newest by default; for value_mask_decay, standardise and refine of other tables."""
    version = version or max(model_versions(spark, path))
    rows = spark.read.schema(MODEL).parquet(f"{path}/version={version}").collect()  # a row for each channel
    parameters = {f"{k}_{r['channel']}": r[k] for r in rows for k in ("mean", "mu", "sd")}
    return {"version": version, "parameters": parameters, "weights": {r["channel"]: list(r["weights"]) for r in rows if r["weights"] is not None}}


def serve(hourly: DataFrame, model: dict) -> DataFrame:
    """V2-V8 and F5, F6 of an hourly table with frozen parameters and weights; nothing is fitted, nothing but ``hourly`` is read."""
    known = model["parameters"]
    return refine(vmd.standardise(vmd.value_mask_decay(hourly, means=known), stats=known), model["weights"], stats=known)


def refine(standardised: DataFrame, weights: dict[str, list[float]], channels: list[str] | None = None, stats: vmd.Parameters | DataFrame | None = None) -> DataFrame:
    """<channel>_refined_z and <channel>_refined; observed cells are copied, never round-tripped.

    Columns of these names are replaced. A channel without weights keeps its carried value. ``stats`` are the parameters of V8; without
    them the table is read for them.
    """
    channels = [c for c in (channels or config.CHANNELS) if f"{c}_z" in standardised.columns]
    stats = vmd.parameters(vmd.statistics(standardised, channels) if stats is None else stats)
    kept = standardised.drop(*[f"{c}_{s}" for c in channels for s in ("refined_z", "refined")])
    waves = {fresh_name(kept, f"basis_{i}"): x for i, x in enumerate(temporal_basis(F.coalesce(F.col("hours_since_admission").cast("double"), F.lit(0.0)) if "hours_since_admission" in kept.columns else F.lit(0.0)))}
    exact = {c: fresh_name(kept, f"exact_{c}") for c in channels}
    own = lambda c, s: f"`{c}_{s}`" if f"{c}_{s}" in kept.columns else "CAST(NULL AS DOUBLE)"
    seen = {c: f"coalesce({own(c, 'mask')} = 1, false)" for c in channels}
    z = {c: f"coalesce({own(c, 'z')}, 0D)" for c in channels}
    mixed = {c: f"{own(c, 'decay')} * {z[c]} + (1D - {own(c, 'decay')}) * {_predicted(kept, c, weights[c], list(waves)) if c in weights else z[c]}" for c in channels}
    rows = kept.withColumns(waves).withColumns({exact[c]: F.expr(f"CASE WHEN {seen[c]} THEN {z[c]} ELSE {mixed[c]} END") for c in channels})
    new = {}
    for c in channels:
        middle = own(c, "value") if stats[f"mu_{c}"] is None else _number(stats[f"mu_{c}"])
        natural = f"rint((`{exact[c]}` * {_number(stats[f'sd_{c}'])} + {middle}) * 1e3D) / 1e3D"
        new |= {f"{c}_refined_z": rint(F.col(exact[c]), 4), f"{c}_refined": F.expr(f"CASE WHEN {seen[c]} THEN {own(c, 'value')} ELSE {natural} END")}
    return rows.withColumns(new).drop(*waves, *exact.values())


def _number(x: float) -> str:
    return f"({float(x)!r}D)"


def _predicted(df: DataFrame, target: str, weights: list[float], basis: list[str]) -> str:
    """The features of design() times their weights; a text is parsed at once, where columns would be built call by call."""
    term = lambda c, s: f"coalesce(CAST(`{c}_{s}` AS DOUBLE), 0D)" if f"{c}_{s}" in df.columns else "0D"
    own = [term(target, s) for s in OWN]
    gap, back = (term(target, s) for s in GAPS)
    share = f"coalesce({back} / nullif({gap} + {back}, 0D), 1D)"
    between = f"({share} * {own[0]} + (1D - {share}) * {own[1]})"
    others = [term(c, s) for c in config.CHANNELS if c != target for s in OTHER]
    features = [*own[:-1], between, own[-1], *others, *[f"`{b}`" for b in basis]]
    return "(" + " + ".join(f"{_number(w)} * {x}" for w, x in zip(weights, features, strict=True) if x != "0D") + ")"


def refinement_audit_sums(c: str) -> dict[str, Column]:
    mask = F.col(f"{c}_mask")
    moved = F.when(mask == 0, F.abs(F.col(f"{c}_refined_z") - F.col(f"{c}_z")))
    return {
        "refined": F.count(F.when(mask == 0, 1)),
        "protected": F.count(F.when(mask == 1, 1)),
        "mean_adjustment": F.coalesce(rint(F.avg(moved), 4), F.lit(0.0)),
        "max_adjustment": F.coalesce(rint(F.max(moved), 4), F.lit(0.0)),
        "observed_modified": F.count(F.when((mask == 1) & ~F.col(f"{c}_refined").eqNullSafe(F.col(f"{c}_value")), 1)),
    }


def refinement_audit(refined: DataFrame, channels: list[str] | None = None, one: DataFrame | None = None) -> DataFrame:
    """(channel, refined, protected, mean_adjustment, max_adjustment, observed_modified)."""
    return vmd.by_channel(refined, refinement_audit_sums, channels, one)


def benchmark_errors(hourly: DataFrame, mode: str = "block") -> DataFrame:
    """B1-B3 with refinement: held cells with the carried and the refined value, the refiner fitted on what is left."""
    held = store(holdout.holdout(hourly, mode), "held")
    left = holdout.hide(hourly, held, flag="any_held").select(*holdout.CELL[:2], *config.CHANNELS, "any_held")
    left, sums = store_measured(left, "left", *vmd.channel_sums(config.CHANNELS))
    known = vmd.parameters(sums)
    weights = {c: f["weights"] for c, f in fit(left.drop("any_held"), known).items()}
    standardised = vmd.standardise(vmd.value_mask_decay(spread(left, "admission_id"), means=known), stats=known)
    keys = [holdout.CELL[0], *_needed(config.CHANNELS, standardised), *[f"{c}_value" for c in config.CHANNELS]]
    # all rows tell what is carried; only those with a held cell are refined and meet it
    refined = refine(standardised.filter("any_held").select(*dict.fromkeys(keys)), weights, stats=known)
    return holdout.held_errors(held, refined, {"locf": "value", "refined": "refined"})
