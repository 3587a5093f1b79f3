"""Units, vocabularies and plausible ranges, cell by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinprep import config
from clinprep.functions import literal_map, magnitude, numeric_view, rint, strip, unit
from clinprep.operators.datetimes import long_texts
from clinprep.sources.shared import fresh_name

PATHS = config.PATHS
#: Ways whose cells change scale.
TO_CELSIUS, TO_MG = (PATHS["fahrenheit"], PATHS["likely_fahrenheit"]), (PATHS["mmol"], PATHS["likely_mmol"])


def _to_celsius(x: Column) -> Column:
    return (x - 32.0) * 5.0 / 9.0


def _path(column: str, c: Column, x: Column, u: Column) -> Column:
    if column == "temperature":
        path = F.when(u.startswith("f"), PATHS["fahrenheit"]).when(u.startswith("c"), PATHS["celsius"]).when(x.between(*config.FAHRENHEIT_BAND), PATHS["likely_fahrenheit"]).otherwise(PATHS["bare_temperature"])
    elif column == "glucose":
        path = F.when(u.contains("mmol"), PATHS["mmol"]).when(u.contains("mg"), PATHS["mg"]).when(x.between(*config.MMOL_BAND), PATHS["likely_mmol"]).otherwise(PATHS["bare_glucose"])
    else:
        path = F.when(u != "", PATHS["suffix"]).otherwise(PATHS["bare"])
    return F.when(c.isNull(), None).when(x.isNull(), PATHS["unparseable"]).otherwise(path)


def unit_path(column: str, c: Column) -> Column:
    """Which way a cell goes; null for a null cell."""
    return _path(column, c, magnitude(c), unit(c))


def _converted(column: str, x: Column, path: Column) -> Column:
    if column == "temperature":
        x = F.when(path.isin(*TO_CELSIUS), _to_celsius(x)).otherwise(x)
    elif column == "glucose":
        x = F.when(path.isin(*TO_MG), x * F.lit(config.MG_PER_MMOL)).otherwise(x)
    return rint(x, 2)


def to_unit(column: str, c: Column) -> Column:
    """Degrees Celsius, mg/dL, or the bare number, with two decimals."""
    return _converted(column, magnitude(c), unit_path(column, c))


def _present(df: DataFrame, columns) -> list[str]:
    return [c for c in columns if c in df.columns]


def convert_units(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All known measurement columns. Texts are split once, before the rules that read number and unit several times."""
    names = _present(df, columns or config.UNIT_COLUMNS)
    number = {c: fresh_name(df, f"number_{c}") for c in names}
    units = {c: fresh_name(df, f"unit_{c}") for c in names if c in ("temperature", "glucose")}
    split = {number[c]: magnitude(F.col(c)) for c in names} | {units[c]: unit(F.col(c)) for c in units}
    cells = {c: _converted(c, F.col(number[c]), _path(c, F.col(c), F.col(number[c]), F.col(units[c])) if c in units else F.lit(None)) for c in names}
    return df.withColumns(split).withColumns(cells).drop(*split)


def unit_paths(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, path, n) of the text table; paths that no cell goes are omitted."""
    names = _present(df, columns or config.UNIT_COLUMNS)
    paths = df.select("row_index", *[unit_path(c, F.col(c)).alias(c) for c in names]).unpivot("row_index", names, "column", "path")
    return paths.filter("path is not null").groupBy("column", "path").agg(F.count(F.lit(1)).alias("n"))


def converted_totals(df: DataFrame) -> DataFrame:
    """(column, converted): cells converted from Fahrenheit and from mmol/L."""
    paths = unit_paths(df, ["temperature", "glucose"])
    return paths.filter(F.col("path").isin(*TO_CELSIUS, *TO_MG)).groupBy("column").agg(F.sum("n").alias("converted"))


def unit_distributions(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, stage, count, min, mean, max) before (first number in the text) and after conversion."""
    names = _present(df, columns or config.UNIT_COLUMNS)
    stages = [("before", df.select("row_index", *[numeric_view(F.col(c)).alias(c) for c in names])), ("after", df.select("row_index", *[to_unit(c, F.col(c)).alias(c) for c in names]))]
    out = None
    for stage, values in stages:
        cells = values.unpivot("row_index", names, "column", "value").groupBy("column").agg(
            F.count("value").alias("count"), rint(F.min("value"), 2).alias("min"), rint(F.avg("value"), 2).alias("mean"), rint(F.max("value"), 2).alias("max")
        )
        cells = cells.select("column", F.lit(stage).alias("stage"), "count", "min", "mean", "max")
        out = cells if out is None else out.unionByName(cells)
    return out


def _mapped(c: Column, vocabulary: dict[str, str]) -> Column:
    return F.try_element_at(literal_map(vocabulary), F.lower(strip(c)))


def standardise_categories(df: DataFrame, vocabularies: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """The vocabulary's word for the stripped, lower-cased text; unmapped values stay as written."""
    vocabularies = vocabularies or config.VOCABULARIES
    return df.withColumns({c: F.coalesce(_mapped(F.col(c), vocabularies[c]), F.col(c)) for c in _present(df, vocabularies)})


def unknown_cells(df: DataFrame, vocabularies: dict[str, dict[str, str]] | None = None) -> list[Column]:
    """For each column with a vocabulary, whether a cell holds something that the vocabulary lacks."""
    vocabularies = vocabularies or config.VOCABULARIES
    return [F.col(c).isNotNull() & _mapped(F.col(c), vocabularies[c]).isNull() for c in _present(df, vocabularies)]


def unmapped_values(df: DataFrame, vocabularies: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """(column, value, n) of values that the vocabulary lacks."""
    vocabularies = vocabularies or config.VOCABULARIES
    names = _present(df, vocabularies)
    left = df.select("row_index", *[F.when(_mapped(F.col(c), vocabularies[c]).isNull(), F.col(c)).alias(c) for c in names])
    return left.unpivot("row_index", names, "column", "value").filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


#: Values that an audit shows of a column; the rest are counted.
SHOWN = 100


def category_audit(df: DataFrame, vocabularies: dict[str, dict[str, str]] | None = None, shown: int = SHOWN) -> DataFrame:
    """(column, distinct_before, distinct_after, values_before, values_after, cells_changed).

    The values are listed in order; of a column with more than ``shown`` of them the commonest, and how many more there are.
    """
    vocabularies = vocabularies or config.VOCABULARIES
    names = _present(df, vocabularies)
    after = F.lit(None).cast("string")
    for c in names:
        after = F.when(F.col("column") == c, F.coalesce(_mapped(F.col("value"), vocabularies[c]), F.col("value"))).otherwise(after)
    # values are few, cells are many: count equal values first
    counted = long_texts(df, names).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("after", after)
    changed = counted.groupBy("column").agg(F.coalesce(F.sum(F.when(~F.col("value").eqNullSafe(F.col("after")), F.col("n"))), F.lit(0)).alias("cells_changed"))
    kinds = counted.filter("value is not null").select("column", "n", F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("text")) for s, c in (("before", "value"), ("after", "after"))])))
    values = kinds.groupBy("column", "side", "text").agg(F.sum("n").alias("n"))
    # ranks are cut in each task before the shuffle, so a column of very many values costs a row for each of them and no list
    place = F.row_number().over(Window.partitionBy("column", "side").orderBy(F.desc("n"), "text"))
    top = values.withColumn("place", place).filter(F.col("place") <= shown).groupBy("column", "side").agg(F.array_join(F.sort_array(F.collect_list("text")), "|").alias("texts"))
    sizes = values.groupBy("column", "side").agg(F.count(F.lit(1)).alias("distinct"))
    more = F.when(F.col("distinct") > shown, F.concat(F.lit("|… and "), (F.col("distinct") - shown).cast("string"), F.lit(" more"))).otherwise("")
    both = sizes.join(top, ["column", "side"]).withColumn("texts", F.concat("texts", more))
    pick = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    wide = both.groupBy("column").agg(*[pick(c, side).alias(f"{n}_{side}") for n, c in (("distinct", "distinct"), ("values", "texts")) for side in ("before", "after")])
    none = lambda c, value: F.coalesce(F.col(c), F.lit(value))
    return changed.join(wide, "column", "left").select("column", none("distinct_before", 0).alias("distinct_before"), none("distinct_after", 0).alias("distinct_after"), none("values_before", "").alias("values_before"), none("values_after", "").alias("values_after"), "cells_changed")


def _number(c: Column, kind: str) -> Column:
    """A cell as a number; one that is a double already is not spelled out and read again."""
    return c if kind == "double" else c.cast("string").try_cast("double")


def _state(c: Column, kind: str, low: float, high: float) -> Column:
    x = _number(c, kind)
    return F.when(c.isNull(), None).when(x.isNull() | F.isnan(x), "unparseable").when(~x.between(low, high), "out_of_range").otherwise("plausible")


def validate_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Unparseable or out-of-range cells become null; rows stay. Bounds are inclusive."""
    ranges, kinds = ranges or config.RANGES, dict(df.dtypes)
    numbers = {c: _number(F.col(c), kinds[c]) for c in _present(df, ranges)}
    return df.withColumns({c: F.when(x.between(*ranges[c]), x) for c, x in numbers.items()})


def _cell_states(df: DataFrame, ranges: dict[str, tuple[float, float]], *carried: str) -> DataFrame:
    names, kinds = _present(df, ranges), dict(df.dtypes)
    cells = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), _state(F.col(c), kinds[c], *ranges[c]).alias("state")) for i, c in enumerate(names)]
    return df.select(*carried, F.explode(F.array(*cells)).alias("cell")).select(*carried, "cell.*")


def range_audit(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """R2: (column, rejected, out_of_range, unparseable, observed_before, observed_after, total)."""
    n = lambda *states: F.count(F.when(F.col("state").isin(*states), 1))
    return _cell_states(df, ranges or config.RANGES).groupBy("column").agg(
        n("out_of_range", "unparseable").alias("rejected"),
        n("out_of_range").alias("out_of_range"),
        n("unparseable").alias("unparseable"),
        F.count("state").alias("observed_before"),
        n("plausible").alias("observed_after"),
        F.count(F.lit(1)).alias("total"),
    )


def rejections(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None, limit: int | None = None) -> DataFrame:
    """(row_index, admission_id, charttime, column, value, reason); with a limit, the first in column and row order."""
    cells = _cell_states(df, ranges or config.RANGES, "row_index", "admission_id", "charttime").filter(F.col("state").isin("out_of_range", "unparseable"))
    if limit is not None:
        cells = cells.orderBy("position", "row_index").limit(limit)
    return cells.select("row_index", "admission_id", "charttime", "column", "value", F.col("state").alias("reason"))


def _lost(before: Column, after: Column) -> Column:
    return rint(1 - after / F.greatest(before, F.lit(1)), 4)


def keeps_most(before: Column, after: Column) -> Column:
    """No column with enough observations may lose the majority of them."""
    return (before < config.MIN_OBSERVATIONS) | (_lost(before, after) <= config.MAX_CHANNEL_LOSS)


def channel_loss(audit: DataFrame) -> DataFrame:
    """(column, lost, passed)."""
    before, after = F.col("observed_before"), F.col("observed_after")
    return audit.select("column", _lost(before, after).alias("lost"), keeps_most(before, after).alias("passed"))
