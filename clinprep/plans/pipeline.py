"""Postconditions of each step, planning from a profile, and the job from raw events to the refined matrix.

A step's claims are checked from aggregates that are observed while its table is written, so a gate reads nothing again but where it
needs rows brought together (duplicates, gaps of the grid). Steps that change cells only are written together, each with
aggregates of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from clinprep import config
from clinprep.operators import cells, datetimes, dedup, hourly, profile, refine, validate, vmd
from clinprep.sources.events import write_report
from clinprep.sources.shared import FILE_ROWS, FILE_RUNS, SPREAD_EVENTS, spread, store

STEPS = config.STEPS
ALWAYS = {"standardise_datetimes", "build_hourly_timeseries", "build_value_mask_decay", "refine_missing_values"}
HIGH_MISSING_PCT = 25.0
#: Which step must come before.
NEEDS = {"build_hourly_timeseries": "standardise_datetimes", "build_value_mask_decay": "build_hourly_timeseries", "refine_missing_values": "build_value_mask_decay"}
#: Checks of a step's result, the first one included, before the job halts; between two of them comes the repair of what failed.
ATTEMPTS = 2
TRACE = "position int, step string, attempt int, passed boolean, failed string"


class PostconditionFailed(RuntimeError):
    """A step's result broke a claim that the next step relies on."""


@dataclass
class Check:
    """Claims about a step's result, over aggregates of the table before and after it."""

    claims: list[Column]
    after: list[Column] = field(default_factory=list)
    before: list[Column] = field(default_factory=list)
    rows: Callable[[DataFrame], DataFrame] | None = None  # the rows that the claims are about, where others tell nothing

    def of(self, after: DataFrame, before: DataFrame | None = None) -> DataFrame:
        """The claims as assertions, by aggregating the tables."""
        one = after.agg(*self.after) if self.after else None
        if self.before:
            then = before.agg(*self.before)
            one = then if one is None else one.crossJoin(then)  # one row each
        return validate._rows(one, *self.claims)

    def seen(self, after: DataFrame, before: DataFrame, values: dict) -> DataFrame:
        """The claims as assertions, from aggregates that were observed."""
        fields = [f for df, metrics in ((after, self.after), (before, self.before)) if metrics for f in df.agg(*metrics).schema.fields]
        one = after.sparkSession.createDataFrame([tuple(values.get(f.name) for f in fields)], "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in fields) + ">")
        return validate._rows(one, *self.claims)


def check_duplicates(df: DataFrame, found: dedup.Repeats | None = None) -> DataFrame:
    return validate._rows((found or dedup.Repeats(df)).counts(), validate._none("rows_are_distinct", F.col("redundant")))


def datetimes_check(df: DataFrame) -> Check:
    kinds = dict(df.dtypes)
    typed = [validate._row(f"{c}_is_timestamp", F.lit(kinds[c].startswith("timestamp")), "timestamp", kinds[c]) for c in config.TIME_COLUMNS if c in kinds]
    sums = [F.min("length_of_stay_hours").alias("stay"), F.count(F.when(F.col("outtime") <= F.col("intime"), 1)).alias("inverted_windows")]
    claims = [validate._none("windows_end_after_they_start", F.col("inverted_windows"), "counted in rows"), validate._row("stay_is_positive", F.col("stay") > 0, "> 0", F.col("stay"))]
    return Check([*typed, *claims], sums)


def check_datetimes(df: DataFrame) -> DataFrame:
    return datetimes_check(df).of(df)


def units_check(df: DataFrame) -> Check:
    kinds = dict(df.dtypes)
    typed = [validate._row(f"{c}_is_a_number", F.lit(kinds[c] == "double"), "double", kinds[c]) for c in ("temperature", "glucose", "sbp", "mbp") if c in kinds]
    x = F.col("temperature").try_cast("double") if "temperature" in kinds else F.lit(None).cast("double")
    return Check([*typed, validate._none("no_stray_fahrenheit", F.col("stray"))], [F.count(F.when(x.between(*config.STRAY_FAHRENHEIT_BAND), 1)).alias("stray")])


def check_units(df: DataFrame) -> DataFrame:
    return units_check(df).of(df)


def categories_check(df: DataFrame, vocabularies=None) -> Check:
    """``df`` is the table before the step."""
    unknown = [F.count(F.when(x, 1)) for x in cells.unknown_cells(df, vocabularies)]
    return Check([validate._none("categories_all_known", F.col("unknown_cells"))], before=[reduce(Column.__add__, unknown, F.lit(0)).alias("unknown_cells")])


def check_categories(df: DataFrame, vocabularies=None) -> DataFrame:
    return categories_check(df, vocabularies).of(df, df)


def ranges_check(before: DataFrame, ranges=None) -> Check:
    ranges = {c: r for c, r in (ranges or config.RANGES).items() if c in before.columns}
    had, kept, kinds = {}, {}, dict(before.dtypes)
    for c, r in ranges.items():
        state = cells._state(F.col(c), kinds[c], *r)
        had[c], kept[c] = F.count(state).alias(f"had_{c}"), F.count(F.when(state == "plausible", 1)).alias(f"kept_{c}")
    outside = [F.count(F.when(~F.col(c).between(*r), 1)) for c, r in ranges.items()]
    total = reduce(Column.__add__, outside, F.lit(0)).alias("outside")
    lost = reduce(Column.__add__, [(~cells.keeps_most(F.col(f"had_{c}"), F.col(f"kept_{c}"))).cast("int") for c in ranges], F.lit(0))
    return Check([validate._none("all_values_in_range", F.col("outside")), validate._none("no_column_lost_most_values", lost)], [total], [*had.values(), *kept.values()])


def check_ranges(df: DataFrame, audit: DataFrame) -> DataFrame:
    outside = validate.range_assertions(df).agg(F.count(F.when(~F.col("passed"), 1)).alias("outside"))
    lost = cells.channel_loss(audit).agg(F.count(F.when(~F.col("passed"), 1)).alias("lost"))
    return validate._rows(outside.crossJoin(lost), validate._none("all_values_in_range", F.col("outside")), validate._none("no_column_lost_most_values", F.col("lost")))  # one row each


def check_hourly(df: DataFrame, audit: DataFrame) -> DataFrame:
    grew = validate._rows(audit, validate._row("grid_has_more_rows", F.col("rows_after") > F.col("rows_before"), F.col("rows_before"), F.col("rows_after")))
    return validate.grid_assertions(df).unionByName(grew)


def vmd_check(df: DataFrame) -> Check:
    sums, claims = validate.channel_claims(df)
    channels = [c for c in config.CHANNELS if f"{c}_z" in df.columns]
    worst = [F.max(F.when(F.col(f"{c}_fill_kind") == "neutral_fill", F.abs(f"{c}_z"))).alias(f"worst_{c}") for c in channels]
    most = F.greatest(F.lit(0.0), F.lit(0.0), *[F.col(f"worst_{c}") for c in channels])
    return Check([*claims, validate._row("neutral_fill_is_zero", most < 0.01, "< 0.01", most)], [*sums, *worst])


def check_vmd(df: DataFrame) -> DataFrame:
    return vmd_check(df).of(df)


def refinement_check(df: DataFrame) -> Check:
    moved = [F.count(F.when((F.col(f"{c}_mask") == 1) & ~F.col(f"{c}_refined").eqNullSafe(F.col(f"{c}_value")), 1)) for c in config.CHANNELS if f"{c}_refined" in df.columns]
    return Check([validate._none("observed_cells_unchanged", F.col("modified"))], [reduce(Column.__add__, moved, F.lit(0)).alias("modified")], rows=validate.observed_rows)


def check_refinement(df: DataFrame) -> DataFrame:
    return refinement_check(df).of(df)


def failures(assertions: DataFrame) -> list[tuple[str, str]]:
    """Name and finding of each assertion that failed; a step has a few dozen at most."""
    return [(r["name"], r["observed"]) for r in assertions.filter(~F.col("passed")).collect()]


class Gates:
    """Checks a step's result, repairs it where that is allowed, and keeps a trace of what was found."""

    def __init__(self, active: bool = True):
        self.active, self.trace = active, []

    def settled(self, step: str, attempt: int, failed: list[tuple[str, str]]) -> list[str]:
        """Notes what was found; the assertions to repair, none if all hold. Raises if one has no repair, or had it already."""
        self.trace.append((STEPS.index(step), step, attempt, not failed, "; ".join(f"{n}: {x}" for n, x in failed)))
        if failed and (attempt == ATTEMPTS or any(n not in REPAIRS for n, _ in failed)):
            raise PostconditionFailed(f"{step}: {self.trace[-1][-1]}")
        return [n for n, _ in failed]

    def passed(self, step: str, df: DataFrame, check: Callable[[DataFrame], DataFrame], attempt: int = 1) -> DataFrame:
        """``df``, or its repaired form, once ``check(df)`` has nothing to say against it."""
        if not self.active:
            return df
        for attempt in range(attempt, ATTEMPTS + 1):
            found = self.settled(step, attempt, failures(check(df)))
            if not found:
                return df
            df = store(_repaired(df, found), "repaired", file_rows=FILE_ROWS)
        return df

    def written(self, df: DataFrame, stages: list[tuple[str, Callable, Callable]], tag: str, attempt: int = 1) -> DataFrame:
        """The table that the stages make of ``df``, written once with the aggregates of all their checks observed.

        A stage is (step, what it makes of a table, its check of the tables before and after). If the claims of one fail, its result is repaired and
        written, and the stages after it are done anew.
        """
        if not self.active:
            return reduce(lambda t, stage: stage[1](t), stages, df)
        now, told = df, []
        for step, make, check_of in stages:
            # plain twins name the tables' columns; observations ride along
            after = make(now)
            check = check_of(now, after)
            seen = {}
            if check.before:
                seen["before"] = Observation()
                after = make(now.observe(seen["before"], *check.before))
            plain = after
            if check.after:
                seen["after"] = Observation()
                after = after.observe(seen["after"], *check.after)
            told.append((step, check, seen, now, plain))
            now = after
        out = store(now, tag, file_rows=FILE_ROWS)
        for i, (step, check, seen, before, after) in enumerate(told):
            values = {k: v for o in seen.values() for k, v in o.get.items()}
            found = self.settled(step, attempt if not i else 1, failures(check.seen(after, before, values)))
            if found:
                fix = (step, lambda t, found=found: _repaired(t, found), lambda _, t, check=check: Check(check.claims, check.after, []))
                if check.before:  # what was lost before stays lost: only claims over the result can be repaired
                    fix = (step, fix[1], lambda _, t, check=check: Check(check.claims[:1], check.after))
                return self.written(store(after, "failed", file_rows=FILE_ROWS), [fix, *stages[i + 1 :]], tag, ATTEMPTS)
        return out

    def derived(self, df: DataFrame, stages: list[tuple[str, Callable, Callable]], more: list[Column]) -> tuple[DataFrame, DataFrame | None]:
        """The table that the stages make of a written one row by row, and a row of the aggregates ``more``. Nothing is written: one reading of the table
        gives these and the aggregates of the checks, another those of checks about some rows only. No claim over columns that follow from others has
        a repair; ungated, nothing is read."""
        now, told = df, []
        for step, make, check_of in stages:
            before, now = now, make(now)
            told.append((step, check_of(before, now), before, now))
        if not self.active:
            return now, None
        taken = now.agg(*[m for _, check, *_ in told if not check.rows for m in check.after], *more)
        row = taken.first()  # one row
        for step, check, before, after in told:
            values = check.rows(after).agg(*check.after).first() if check.rows else row  # one row
            self.settled(step, 1, failures(check.seen(after, before, values.asDict())))
        return now, df.sparkSession.createDataFrame([tuple(row)], taken.schema) if more else None


def _repaired(df: DataFrame, failed: list[str]) -> DataFrame:
    return reduce(lambda t, name: REPAIRS[name](t), failed, df)


def repair_temperature(df: DataFrame) -> DataFrame:
    """Values left in the Fahrenheit band of body temperature are converted."""
    x = F.col("temperature").try_cast("double")
    return df.withColumn("temperature", F.when(x.between(*config.STRAY_FAHRENHEIT_BAND), cells.rint(cells._to_celsius(x), 2)).otherwise(x))


#: What may be done about a failed assertion, and nothing else. A repair takes the step's result and gives a new one.
REPAIRS = {"rows_are_distinct": dedup.remove_duplicates, "all_values_in_range": cells.validate_ranges, "no_stray_fahrenheit": repair_temperature}


def plan_steps(raw: DataFrame, repeats: dedup.Repeats | None = None) -> DataFrame:
    """A10: (position, step, evidence): steps that the profile justifies, in the fixed order.

    The table is read once, for the dictionary of its values and of its rows' digests. Where the repeated digests (``repeats``) of a written table are
    known, the dictionary has neither digests nor the columns that no step's evidence is about, so it grows with distinct values only.
    """
    if raw.columns == profile.DICTIONARY:
        counts = raw
    else:
        counts = store(profile.value_counts(raw, profile.planned_columns(raw) if repeats else None, rows=not repeats), "value-counts")
    n = lambda df: df.agg(F.count(F.lit(1)).alias("evidence"))
    redundant = raw.sparkSession.range(1).select(F.lit(repeats.rows - repeats.n).alias("redundant")) if repeats else profile.redundant_rows(counts)
    evidence = {
        "remove_duplicates": redundant.select(F.col("redundant").alias("evidence")),
        "convert_units": n(profile.unit_tokens(counts)),
        "standardise_categories": n(profile.categorical_variants(counts)),
        "validate_ranges": profile.implausible_values(counts).agg(F.coalesce(F.sum(F.col("out_of_range") + F.col("unparseable")), F.lit(0)).alias("evidence")),
    }
    found = [df.select(F.lit(STEPS.index(s)).alias("position"), F.lit(s).alias("step"), F.col("evidence").cast("long").alias("evidence")).filter("evidence > 0") for s, df in evidence.items()]
    always = counts.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(STEPS.index(s)).alias("position"), F.lit(s).alias("step"), F.lit(0).cast("long").alias("evidence")) for s in STEPS if s in ALWAYS])))
    return validate.union_all([always, *found])


def plan_evidence(raw: DataFrame) -> DataFrame:
    """A10: (step, column, evidence, detail): what speaks for each chosen step: columns with their tokens, variants and cells out of range."""
    counts = raw if raw.columns == profile.DICTIONARY else store(profile.value_counts(raw, rows=True), "value-counts")
    row = lambda df, step, column, evidence, detail: df.select(F.lit(step).alias("step"), column.alias("column"), evidence.cast("long").alias("evidence"), detail.alias("detail"))
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ", ")
    tokens = profile.unit_tokens(counts).groupBy("column").agg(F.sum("n").alias("n"), names("token").alias("tokens"))
    return validate.union_all([
        row(profile.redundant_rows(counts).filter("redundant > 0"), "remove_duplicates", F.lit(None).cast("string"), F.col("redundant"), F.lit("rows equal to an earlier one")),
        row(tokens, "convert_units", F.col("column"), F.col("n"), F.col("tokens")),
        row(profile.categorical_variants(counts), "standardise_categories", F.col("column"), F.col("distinct_raw"), F.concat(F.col("distinct_raw").cast("string"), F.lit(" spellings of "), F.col("distinct_casefold").cast("string"))),
        row(profile.implausible_values(counts), "validate_ranges", F.col("column"), F.col("out_of_range") + F.col("unparseable"), F.concat(F.lit("outside "), F.col("low").cast("string"), F.lit(" to "), F.col("high").cast("string"))),
    ])


def concerns(raw: DataFrame, above: float = HIGH_MISSING_PCT) -> DataFrame:
    """A10: (column, missing_pct) of columns missing in more than ``above`` percent of the rows."""
    return profile.column_profile(raw).filter(F.col("missing_pct") > above).select("column", "missing_pct")


def ordered(steps: list[str]) -> list[str]:
    """The steps in their fixed order; an unknown one is rejected."""
    unknown = sorted(set(steps) - set(STEPS))
    if unknown:
        raise ValueError(f"unknown steps: {', '.join(unknown)}")
    return [s for s in STEPS if s in steps]


@dataclass
class Result:
    """What a job made: tables that its steps don't reach are None; audits by step; the trace of checks and repairs.

    ``runs`` is the written form of the grid, a row for each hour with events. ``hourly`` and ``processed`` have a row for each hour and are made of it by
    those who read them, without a shuffle; who needs them as files writes them (events.write_table).
    """

    cleaned: DataFrame
    hourly: DataFrame | None = None
    processed: DataFrame | None = None
    runs: DataFrame | None = None
    audits: dict[str, DataFrame] = field(default_factory=dict)
    steps: list[str] = field(default_factory=list)
    trace: list[tuple] = field(default_factory=list)
    model: dict | None = None


def clean(raw: DataFrame, steps: list[str] | None = None, vocabularies=None, gated: bool = False, gates: Gates | None = None, repeats: dedup.Repeats | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The event steps, with their audits; ``gated`` checks each step's postconditions and repairs what may be repaired.

    Gated, the rows are written twice: distinct, and after the steps that change cells, those of times included. ``repeats``: the repeated digests
    of ``raw``, if they are known.
    """
    gates = gates or Gates(gated)
    steps, df, audits = ordered(STEPS if steps is None else steps), raw, {}
    first, left = repeats or dedup.Repeats(raw), None
    if "remove_duplicates" in steps:
        df = first.distinct()
        if gates.active:
            df = store(df, "distinct", file_rows=FILE_ROWS)
            left = dedup.Repeats(df)  # for the gate and the audit
            passed = gates.passed("remove_duplicates", df, lambda t: check_duplicates(t, left if t is df else None))
            left, df = left if passed is df else None, passed
    audits["remove_duplicates"] = dedup.dedup_audit(raw, kept=df, before=first, after=left or (None if "remove_duplicates" in steps else first))
    before, stages = df, []  # steps on times change no other cells, so audits of these start from the distinct rows
    if "standardise_datetimes" in steps:
        parsed = df = datetimes.parse_times(df)
        audits["standardise_datetimes"] = datetimes.window_audit(parsed)
        # their number is told by the written rows
        stages.append(("standardise_datetimes", lambda t: datetimes.reconcile_windows(t, like=before), lambda _, t: datetimes_check(t)))
    cell_stages = [
        ("convert_units", cells.convert_units, lambda _, t: units_check(t)),
        ("standardise_categories", lambda t: cells.standardise_categories(t, vocabularies), lambda t, _: categories_check(t, vocabularies)),
        ("validate_ranges", cells.validate_ranges, lambda t, _: ranges_check(t)),
    ]
    audit_of = {"convert_units": cells.unit_paths, "standardise_categories": lambda t: cells.category_audit(t, vocabularies), "validate_ranges": cells.range_audit}
    cell_stages, changed = [s for s in cell_stages if s[0] in steps], before
    for step, make, _ in cell_stages:
        audits[step] = audit_of[step](changed)
        changed = make(changed)
    stages += cell_stages
    return (gates.written(df, stages, "cleaned") if stages else df), audits


def run(raw: DataFrame, steps: list[str] | None = None, vocabularies=None, gated: bool = True, max_hours: int = config.MAX_HOURS, report: str | None = None, model: dict | None = None) -> Result:
    """Profile, plan, and the steps of the plan with gates. The tables that are kept are written once and read back, that of the grid in runs (Result).

    With a ``report`` folder, audits, trace and assertions are written there as tables. With a ``model`` (see refine.load_model) nothing
    is fitted: its statistics and weights are applied.
    """
    raw = store(raw, "raw", file_rows=FILE_ROWS)
    repeats = dedup.Repeats(raw)
    steps = ordered(steps if steps is not None else [r["step"] for r in plan_steps(raw, repeats).collect()])  # eight at most
    for step in steps:
        if NEEDS.get(step, step) not in steps:
            raise ValueError(f"{step} needs {NEEDS[step]}")
    gates = Gates(gated)
    df, audits = clean(raw, steps, vocabularies, gates=gates, repeats=repeats)
    out = Result(df if gated and steps else store(df, "cleaned", file_rows=FILE_ROWS), audits=audits, steps=steps, trace=gates.trace)
    if "build_hourly_timeseries" in steps:
        audits["build_hourly_timeseries"] = hourly.expansion_audit(out.cleaned, max_hours)
        usable = reduce(Column.__and__, [F.col(c).isNotNull() for c in ("admission_id", *config.TIME_COLUMNS)])
        rows = out.cleaned.agg(F.count(F.when(usable, 1)).alias("rows_before"))
        # written in runs, some ten hours each, with the windows over them: a hundred columns of all hours cost more to encode than to compute
        made = vmd.seen_by_runs(hourly.stay_runs(spread(out.cleaned, "admission_id", rows=SPREAD_EVENTS), max_hours))
        runs = out.runs = store(made, "processed" if "build_value_mask_decay" in steps else "hourly", file_rows=FILE_RUNS)
        sums = runs.agg(F.coalesce(F.sum(hourly.run_rows()), F.lit(0)).alias("rows_after"), *vmd.channel_sums(config.CHANNELS)).first().asDict()  # one row
        rows = raw.sparkSession.createDataFrame([(rows.first()[0], sums["rows_after"])], "rows_before long, rows_after long")
        gates.passed("build_hourly_timeseries", dealt_hours(runs, sums["rows_after"]), lambda t: check_hourly(t, rows))  # none of its claims has a repair
        out.hourly = hourly.hours_of(runs)
    if "build_value_mask_decay" in steps:
        known = model["parameters"] if model else vmd.parameters(sums)
        stages = [("build_value_mask_decay", lambda t: vmd.standardise(vmd.expand_runs(t, known), stats=known), lambda _, t: vmd_check(t))]
        if "refine_missing_values" in steps:
            # the fit needs the observed cells only, so one write holds both steps
            observed = runs.filter(F.coalesce(*config.CHANNELS).isNotNull()).select("admission_id", "hours_since_admission", "hours", *config.CHANNELS)
            weights = model["weights"] if model else {c: f["weights"] for c, f in refine.fit(observed, known, length="hours").items()}
            stages.append(("refine_missing_values", lambda t: refine.refine(t, weights, stats=known), lambda _, t: refinement_check(t)))
            out.model = {"parameters": known, "weights": weights}
        refined = "refine_missing_values" in steps
        # audits are taken along where they are asked for
        more = [] if not report else [*vmd.wide_sums(vmd.channel_audit_sums), *(vmd.wide_sums(refine.refinement_audit_sums) if refined else [])]
        out.processed, one = gates.derived(runs, stages, more)
        audits["build_value_mask_decay"] = vmd.channel_audit(out.processed, one=one)
        if refined:
            audits["refine_missing_values"] = refine.refinement_audit(out.processed, one=one)
    if report:
        write_report({**audits, "trace": trace(raw, out), "assertions": assertions(raw, out)}, report)
    return out


def dealt_hours(runs: DataFrame, n: int | None = None) -> DataFrame:
    """Admission and hour of the hours that runs make (``n``, if known), dealt out by admission before they are made."""
    keys = runs.select(*hourly.KEY, *hourly.RUN)
    n = keys.agg(F.coalesce(F.sum(hourly.run_rows()), F.lit(0))).first()[0] if n is None else n
    return hourly.hours_of(spread(keys, "admission_id", n=n)).select(*hourly.KEY)


def trace(raw: DataFrame, result: Result) -> DataFrame:
    """S3: a row for each check of a step: (position, step, attempt, passed, failed)."""
    return raw.sparkSession.createDataFrame(result.trace, TRACE)


def assertions(raw: DataFrame, result: Result) -> DataFrame:
    """A1-A5 over a run, as far as its steps went."""
    parts = [validate.table_assertions(raw, result.cleaned, result.audits["remove_duplicates"]), validate.range_assertions(result.cleaned)]
    if result.hourly is not None:
        parts.append(validate.grid_assertions(dealt_hours(result.runs)))
    if result.processed is not None:
        parts.append(validate.channel_assertions(result.processed))
    if "refine_missing_values" in result.audits:
        parts.append(validate.fabrication_assertions(result.processed, result.audits["refine_missing_values"]))
    return validate.union_all(parts)
