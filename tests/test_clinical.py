"""Literal cases, awkward rows, invariants, and SQL twins of the clinical jobs."""

import datetime as dt
import functools
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinprep import config
from clinprep.functions import magnitude, numeric_view, parse_datetime, rint, spelling, strip, unit
from clinprep.operators import cells, datetimes, dedup, holdout, hourly, profile, refine, review, validate, vmd
from clinprep.plans import pipeline, registry
from clinprep.sources import events, shared

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def values(spark, texts, make):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return [r[0] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@needs_data
def test_wide_stages_stay_compiled_unless_the_user_says_otherwise(spark):
    name = shared.METHOD_SETTING
    before = spark.conf.get(name)
    try:
        for was, then in ((str(shared.SPARKS_METHOD_BYTES), str(shared.METHOD_BYTES)), ("12345", "12345")):
            spark.conf.set(name, was)
            rows = events.raw_events(spark, SF)
            assert spark.conf.get(name) == then and len(rows.columns) == 25
    finally:
        spark.conf.set(name, before)


# Numbers, texts, times
def test_rint_is_half_even(spark):
    xs = [0.125, 0.135, 2.5, -0.125, 1.005, 2.675, 1e9 + 0.125]
    df = frame(spark, [(float(x),) for x in xs], "x double")
    assert [r[0] for r in df.select(rint(F.col("x"), 2)).collect()] == np.round(xs, 2).tolist()


def test_measurements(spark):
    cases = ["6.6 mmol/L", "85 mmHg", "120.0", None, "unknown", " -3 F ", "1e5", "12 a b"]
    assert values(spark, cases, magnitude) == [6.6, 85.0, 120.0, None, None, -3.0, None, None]
    assert values(spark, cases, unit) == ["mmol/l", "mmhg", "", "", "", "f", "", ""]
    assert values(spark, ["about 12.5 kg", "x", None, "-4", "v 1.2.3"], numeric_view) == [12.5, None, None, -4.0, 1.2]
    assert values(spark, ["\t a b\n ", None, ""], strip) == ["a b", None, ""]


AT = dt.datetime(2026, 2, 10, 8, 0)


def test_datetimes_by_surface_form(spark):
    cases = ["2026-02-10 08:00", "2026/02/10 08:00", "10/02/2026 08:00", "Feb 10 2026 08:00", " \t10/02/2026 08:00 ", "feb 10 2026 08:00"]
    assert values(spark, cases, parse_datetime) == [AT] * 6
    bad = ["2026-02-10T08:00", "2026-02-10 08:00:30", "31/02/2026 08:00", "13 2026", "not recorded", None, "", "Foo 10 2026 08:00", "10/02/2026 25:00"]
    assert values(spark, bad, parse_datetime) == [None] * 9
    assert values(spark, ["10-02-2026 08:00", "10.02.2026 08:00"], parse_datetime) == [AT, AT]
    assert values(spark, ["10-02-2026 08:00"], lambda c: parse_datetime(c, [])) == [None]
    assert values(spark, ["2026-01-01 08:00", "01/02/2026 09:00", "2026-01-01T08:00", "x", None], spelling) == [config.SPELLINGS[0][0], config.SPELLINGS[2][0], config.SPELLINGS[0][0], "Unrecognised", None]


def test_naive_disagreements(spark):
    df = frame(spark, [(1, "10/02/2026 08:00"), (2, "10/10/2026 08:00"), (3, "13/02/2026 08:00"), (4, "2026-02-10 08:00"), (5, None)], "row_index long, charttime string")
    assert [(r.column, r.n) for r in datetimes.naive_disagreements(df).collect()] == [("charttime", 1)]


def test_windows_vote_clamp_and_stay(spark):
    t = lambda d, h=0: dt.datetime(2026, 1, d, h)
    rows = [
        (1, "A", t(1), t(3), t(2)), (2, "A", t(1), t(3), t(9)), (3, "A", t(2), t(4), dt.datetime(2025, 12, 1)),
        (4, "B", t(5), t(4), t(4, 12)), (5, "B", t(6), t(4), None), (6, None, t(1), t(2), t(1, 5)),
    ]
    df = frame(spark, rows, "row_index long, admission_id string, intime timestamp_ntz, outtime timestamp_ntz, charttime timestamp_ntz")
    got = {r.row_index: r for r in datetimes.reconcile_windows(df).collect()}
    assert [got[i].intime for i in (1, 2, 3)] == [t(1)] * 3 and got[2].charttime == t(3) and got[3].charttime == t(1)
    assert got[4].intime == t(5) and got[4].length_of_stay_hours == -24.0 and got[6].length_of_stay_hours == 24.0
    assert tuple(datetimes.window_audit(df).first()) == (3, 2, 2, 2)  # row 4 lies before its window and after it


def test_unit_conversion(spark):
    celsius = lambda c: cells.to_unit("temperature", c)
    assert values(spark, ["98.6 F", "32 F", "212 F", "100.4 F", "37.0 C", "98.6", "36.5", "warm", None], celsius) == [37.0, 0.0, 100.0, 38.0, 37.0, 37.0, 36.5, None, None]
    glucose = lambda c: cells.to_unit("glucose", c)
    assert values(spark, ["108.0", "6.0 mmol/L", "6.0", "120 mg/dL", None], glucose) == [108.0, 108.11, 108.11, 120.0, None]
    df = frame(spark, [(1, "37.0 C", "108.0"), (2, "98.6 F", "6.0 mmol/L"), (3, "hot", None)], "row_index long, temperature string, glucose string")
    assert {(r.column, r.path): r.n for r in cells.unit_paths(df).collect()} == {("temperature", "celsius_explicit"): 1, ("temperature", "fahrenheit_explicit"): 1, ("temperature", "unparseable"): 1, ("glucose", "bare_mg_per_dl"): 1, ("glucose", "mmol_per_l_explicit"): 1}


def test_units_leave_columns_of_the_names_of_helpers_alone(spark):
    """Columns that are called like the helpers of a conversion come through as they are, whatever their case."""
    df = frame(spark, [("98.6 F", "120 mmHg", "a", "b", 7)], "temperature string, sbp string, number_sbp string, Unit_Temperature string, _number_temperature int")
    assert tuple(cells.convert_units(df).first()) == (37.0, 120.0, "a", "b", 7)
    assert cells.convert_units(df).columns == df.columns


def test_schema_counts_what_is_there(spark):
    df = frame(spark, [(1, None), (2, "x"), (None, None)], "`a.b` int, c string")
    rows = lambda t: [tuple(r) for r in validate.schema_table(t).orderBy("position").collect()]
    assert rows(df) == [(0, "a.b", "int", 2), (1, "c", "string", 1)]
    assert [r[3] for r in rows(df.limit(0))] == [0, 0]


def test_categories_keep_what_they_do_not_know(spark):
    df = frame(spark, [(1, "\tER "), (2, "hospice "), (3, None), (4, "icu TRANSFER")], "row_index long, admission_type string")
    assert [r.admission_type for r in cells.standardise_categories(df).orderBy("row_index").collect()] == ["Emergency", "hospice ", None, "ICU"]
    assert [tuple(r) for r in cells.unmapped_values(df).collect()] == [("admission_type", "hospice ", 1)]


def test_ranges_null_cells_and_keep_rows(spark):
    df = frame(spark, [(1, "A", None, 20.0), (2, "A", None, 250.0), (3, "A", None, 250.1), (4, "A", None, None)], "row_index long, admission_id string, charttime string, heart_rate double")
    assert [r.heart_rate for r in cells.validate_ranges(df).orderBy("row_index").collect()] == [20.0, 250.0, None, None]
    text = df.withColumn("heart_rate", F.when(F.col("row_index") == 1, "x").otherwise(F.col("heart_rate").cast("string")))
    assert {r.reason for r in cells.rejections(text).collect()} == {"unparseable", "out_of_range"}
    audit = cells.range_audit(text).first()
    assert (audit.rejected, audit.out_of_range, audit.unparseable, audit.observed_before, audit.observed_after, audit.total) == (2, 1, 1, 3, 1, 4)


@pytest.mark.parametrize("before,after,passed", [(20, 9, False), (20, 10, True), (19, 0, True)])
def test_channel_loss_gate(spark, before, after, passed):
    audit = frame(spark, [("spo2", before, after)], "column string, observed_before long, observed_after long")
    assert cells.channel_loss(audit).first().passed is passed


# Duplicates
def test_duplicates_first_last_and_nulls(spark):
    rows = [(1, "a", None), (2, "a", None), (3, None, "a"), (4, "b", "x"), (5, None, "a")]
    df = frame(spark, rows, "row_index long, p string, q string").repartition(3)
    ids = lambda x: sorted(r.row_index for r in x.collect())
    assert ids(dedup.remove_duplicates(df)) == [1, 3, 4] and ids(dedup.remove_duplicates(df, keep="last")) == [2, 4, 5]
    assert ids(dedup.dropped_rows(df)) == [2, 5] and tuple(dedup.count_duplicates(df).first()) == (2, 4)
    assert ids(dedup.remove_duplicates(df, ["p"])) == [1, 3, 4]
    assert {r.n_matches for r in dedup.verify_dropped(df, dedup.dropped_rows(df)).collect()} == {1}
    assert tuple(dedup.dedup_audit(df.limit(0)).first()) == ("keep_first", 0, 0, 0, 0, 0)


def constant(df, keys):
    return F.lit(1).cast("long"), F.lit(2).cast("long")


@pytest.mark.parametrize("digest", [None, constant])
@pytest.mark.parametrize("limit", [dedup.BROADCAST_BYTES, -1])
def test_whole_rows_decide_whatever_their_digests(spark, monkeypatch, digest, limit):
    monkeypatch.setattr(dedup, "BROADCAST_BYTES", limit)
    rows = [(1, "a", None, 1.0), (2, "a", None, 1.0), (3, None, "a", 1.0), (4, None, "a", -0.0), (5, None, "a", 0.0), (6, "", "a", 0.0), (7, "b", "c", None), (8, "b", "c", None), (9, "b", "c", 0.0)]
    df = frame(spark, rows, "row_index long, digest_hi string, nth string, x double").repartition(3)  # names that the job uses itself
    ids = lambda x: sorted(r.row_index for r in x.collect())
    assert ids(dedup.remove_duplicates(df, digest=digest)) == [1, 3, 4, 6, 7, 9] and ids(dedup.remove_duplicates(df, keep="last", digest=digest)) == [2, 3, 5, 6, 8, 9]
    assert ids(dedup.dropped_rows(df, digest=digest)) == [2, 5, 8] and tuple(dedup.count_duplicates(df, digest=digest).first()) == (3, 6)
    assert dedup.remove_duplicates(df, digest=digest).columns == df.columns
    found = dedup.verify_dropped(df, df.filter("row_index in (2, 5, 8, 9)"), digest=digest).collect()
    assert {r.row_index: r.n_matches for r in found} == {2: 1, 5: 1, 8: 1, 9: 1}
    assert dedup.verify_dropped(df, frame(spark, [(99, "z", "z", None)], df.schema), digest=digest).first().n_matches == 0


@needs_data
def test_the_vote_reads_its_rows_once(spark):
    plan = registry.windowed_events(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1 and "Join" not in plan


@needs_data
def test_digests_alone_are_shuffled(spark):
    raw = registry.stored_raw(spark, SF)
    found = dedup.Repeats(raw)
    plan = found.marked.groupBy(*found.names).count()._jdf.queryExecution().executedPlan().toString()
    exchange = plan[plan.index("Exchange") :]
    assert found.n == 100 and "partial_count" in exchange and plan.count("Exchange") == 1
    rest = found.others()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in rest and "Exchange hashpartitioning" not in rest
    assert found.suspects().count() == 200


def test_line_numbers_of_one_file_several_and_parts(spark, tmp_path):
    lines = [",".join([f"a{n}"] + ["x"] * (len(config.RAW_COLUMNS) - 1)) for n in range(500)]
    head = ",".join(config.RAW_COLUMNS)
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "b.csv").write_text("\n".join([head, *lines]) + "\n")
    (tmp_path / "many").mkdir()
    for name, part in (("b", lines[100:103]), ("c", lines[103:]), ("a", lines[:100])):
        (tmp_path / "many" / f"{name}.csv").write_text("\n".join([head, *part]) + "\n")
    want = [(n, f"a{n}") for n in range(500)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "2k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for folder in ("one", "many"):
                got = events.read_events(spark, str(tmp_path / folder))
                assert sorted((r.row_index, r.admission_id) for r in got.collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert events.read_events(spark, str(tmp_path / "many")).columns == [*config.RAW_COLUMNS, "row_index"]


def test_tolerant_times_only_for_texts_that_nothing_else_reads(spark):
    rows = [(1, "3rd March 2026 14:05", 7), (2, "10/02/2026 08:00", 7), (3, "10-02-2026 08:00", 7), (4, "2026-02-10T08:00", 7), (5, "not recorded", 7), (6, None, 7), (7, "4.5.2026 1:02 PM", 7), (8, "3rd March 2026 14:05", 7), (9, "2 Jan 2026 10:00+02:00", 7)]
    df = frame(spark, rows, "row_index long, charttime string, text int")
    got = {r.row_index: r.charttime for r in datetimes.parse_times(df, tolerant=True).collect()}
    assert got == {1: dt.datetime(2026, 3, 3, 14, 5), 2: AT, 3: AT, 4: None, 5: None, 6: None, 7: dt.datetime(2026, 5, 4, 13, 2), 8: dt.datetime(2026, 3, 3, 14, 5), 9: dt.datetime(2026, 1, 2, 10)}
    assert datetimes.parse_times(df).filter("charttime is not null").count() == 2 and datetimes.parse_times(df, tolerant=True).columns == df.columns
    plain = datetimes.parse_times(df.filter("row_index in (2, 3)"), tolerant=True)
    assert "Arrow" not in plain._jdf.queryExecution().toString() and plain.count() == 2


# Value, mask, decay
def stays(spark, *series):
    rows = [(f"A{n}", dt.datetime(2026, 1, 1) + dt.timedelta(hours=h), h, x) for n, s in enumerate(series) for h, x in enumerate(s)]
    return frame(spark, rows, "admission_id string, hour timestamp_ntz, hours_since_admission int, heart_rate double")


MEAN = "mean_heart_rate double"


def expanded(spark, series, mean=75.0):
    out = vmd.value_mask_decay(stays(spark, series), ["heart_rate"], means=frame(spark, [(mean,)], MEAN)).orderBy("hours_since_admission").collect()
    return {k: [r[f"heart_rate_{k}"] for r in out] for k in ("value", "mask", "decay", "gap_hours", "fill_kind", "next_value", "backward_gap_hours", "backward_decay")}


def test_value_mask_decay_literals(spark):
    x = None
    got = expanded(spark, [80.0, x, x, 85.0])
    assert got["value"] == [80, 80, 80, 85] and got["mask"] == [1, 0, 0, 1] and got["decay"] == [1, 0.75, 0.5625, 1]
    assert expanded(spark, [80.0] + [x] * 6)["decay"] == [round(0.75**k, 6) for k in range(7)]
    got = expanded(spark, [x, x, 80.0, x, 90.0, x])
    assert got["value"] == [75, 75, 80, 80, 90, 90] and got["gap_hours"] == [2, 1, 0, 1, 0, 1]
    assert [k[0] for k in got["fill_kind"]] == list("nnolol")
    assert got["next_value"] == [75, 75, 80, 90, 90, 90] and got["backward_gap_hours"] == [2, 1, 0, 1, 0, 1]
    got = expanded(spark, [x, x, x])
    assert got["value"] == [75] * 3 and got["gap_hours"] == [3, 2, 1] and got["next_value"] == [75] * 3 and got["backward_gap_hours"] == [3, 2, 1]


def test_never_observed_and_constant_channels(spark):
    got = expanded(spark, [None, None], None)
    assert got["value"] == [None, None]
    flat = vmd.standardise(vmd.value_mask_decay(stays(spark, [5.0, None, 5.0]), ["heart_rate"]), ["heart_rate"])
    assert {r.heart_rate_z for r in flat.collect()} == {0.0}
    assert vmd.standardise(flat.drop("heart_rate_z", "heart_rate_next_z"), ["heart_rate"], frame(spark, [(5.0, 0.0)], "mu_heart_rate double, sd_heart_rate double")).filter("heart_rate_z <> 0").count() == 0
    filled = vmd.neutral_fill(stays(spark, [None, None, 80.0, None], [70.0]), "heart_rate").filter("admission_id = 'A0'").orderBy("hours_since_admission").collect()
    assert [r.heart_rate for r in filled] == [75.0, 75.0, 80.0, None]


# Hourly grid
EVENT = "row_index long, admission_id string, intime timestamp_ntz, outtime timestamp_ntz, charttime timestamp_ntz, heart_rate double, gender string"


def test_grid_bounds_cap_and_statics(spark):
    t = lambda d, h=0, m=0: dt.datetime(2026, 1, d, h, m)
    rows = [
        (1, "A", t(1, 8, 30), t(1, 11, 5), t(1, 9, 10), 80.0, None), (2, "A", t(1, 8, 30), t(1, 11, 5), t(1, 9, 50), 90.0, "Male"), (3, "A", t(1, 8, 30), t(1, 11, 5), t(1, 10), None, "Female"),
        (4, "B", t(2), t(1), t(1, 12), 60.0, "Male"), (5, None, t(1), t(2), t(1), 60.0, "Male"), (6, "C", t(1), dt.datetime(2031, 1, 1), t(1, 1), 70.0, "Male"), (7, "D", t(1), t(1), t(1), 70.0, None),
    ]
    df = frame(spark, rows, EVENT)
    got = [tuple(r) for r in hourly.build_hourly(df).filter("admission_id = 'A'").orderBy("hour").select("hour", "heart_rate", "gender", "hours_since_admission").collect()]
    assert got == [(t(1, 8), None, "Male", 0), (t(1, 9), 85.0, "Male", 1), (t(1, 10), None, "Female", 2), (t(1, 11), None, "Female", 3), (t(1, 12), None, "Female", 4)]
    sizes = {r.admission_id: r["count"] for r in hourly.hour_grid(df).groupBy("admission_id").count().collect()}
    assert sizes == {"A": 5, "C": 336, "D": 1}
    audit = hourly.expansion_audit(df).first()
    assert (audit.rows_before, audit.rows_after, audit.admissions, audit.merged_observations, audit.truncated_admissions) == (6, 342, 3, 1, 1)
    assert validate.grid_assertions(hourly.build_hourly(df)).filter("not passed").count() == 0
    broken = hourly.build_hourly(df).filter("hours_since_admission <> 2")
    assert validate.grid_assertions(broken).filter("not passed").count() == 1 and validate.gap_starts(broken).count() == 2


# Hold-out and refinement
def test_block_holdout_is_made_of_runs(spark):
    series = [[float(h) if h % 3 else None for h in range(60)] for _ in range(20)] + [[1.0, None, 2.0]]
    table = stays(spark, *series)
    for c in config.CHANNELS[1:]:
        table = table.withColumn(c, F.lit(None).cast("double"))
    held = {(r.admission_id, r.hours_since_admission) for r in holdout.holdout(table, "block").collect()}
    assert held and not any(a == "A20" for a, _ in held)
    observed = [h for h in range(60) if h % 3]
    for n in range(20):
        flags = [(f"A{n}", h) in held for h in observed]
        runs = [len(r) for r in "".join("x" if f else " " for f in flags).split()]
        assert all(r >= 3 for r in runs)
    assert 0.08 < len(held) / (20 * len(observed)) < 0.25
    left = holdout.hide(table, holdout.holdout(table, "block"))
    assert left.filter("heart_rate is not null").count() == 20 * len(observed) + 2 - len(held)


@pytest.mark.parametrize("mode", ["random", "block"])
def test_exact_holdout_meets_its_share(spark, mode):
    series = [[float(h) if (h + n) % 3 else None for h in range(40 + n)] for n in range(25)] + [[1.0, None, 2.0]]
    table = stays(spark, *series)
    for c in config.CHANNELS[1:]:
        table = table.withColumn(c, F.lit(None).cast("double"))
    observed = sum(x is not None for s in series for x in s)
    want = None
    for parts in (1, 7):
        held = sorted(map(tuple, holdout.holdout(table.repartition(parts), mode, exact=True).collect()))
        want = want or held
        assert held == want
    n = int(config.HOLDOUT_FRACTION * observed + 0.5)
    assert len(held) == n if mode == "random" else n <= len(held) <= n + 2
    assert holdout.holdout(table.limit(0), mode, exact=True).count() == 0


@needs_data
def test_bucketed_events_need_no_shuffle(spark):
    table = events.store_by_admission(registry.stored_events(spark, SF), 4)
    plan = hourly.build_hourly(table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan


def test_ridge_solves_its_normal_equations(spark):
    draw = np.random.default_rng(0)
    x, w = draw.normal(size=(200, 43)), draw.normal(size=43)
    y = x @ w + draw.normal(size=200) * 0.1
    rows = frame(spark, [("sbp", a.tolist(), float(b)) for a, b in zip(x, y, strict=True)] + [("dbp", x[0].tolist(), 1.0)] * 5, "channel string, x array<double>, y double").repartition(4)
    got = refine.fit_refiner(rows)
    assert set(got) == {"sbp"} and got["sbp"]["rows"] == 200 and got["sbp"]["n_features"] == 43
    weights = np.array(got["sbp"]["weights"])
    assert np.allclose(weights, np.linalg.solve(x.T @ x + np.eye(43), x.T @ y))
    r2 = 1 - ((y - x @ weights) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert abs(got["sbp"]["r2"] - r2) < 1e-4


# Profile
def test_profile_of_awkward_columns(spark):
    df = frame(spark, [(1, None, "a "), (2, None, "A"), (3, None, "b")], "row_index long, heart_rate string, gender string")
    rows = {r.column: r for r in profile.column_profile(df).collect()}
    assert rows["heart_rate"].missing == 3 and rows["heart_rate"].missing_pct == 100.0
    assert [tuple(r) for r in profile.categorical_variants(df).collect()] == [("gender", 3, 2)]
    assert profile.column_profile(df.limit(0)).filter("rows > 0 or missing_pct > 0").count() == 0
    assert [r.column for r in profile.top_missing(profile.column_profile(df)).collect()] == ["heart_rate"]
    assert profile.numeric_summary(df).count() == 0


def test_everything_follows_from_the_dictionary(spark):
    df = frame(spark, [(1, "80", "a ", "2026-01-01 08:00"), (2, "80 bpm", "A", None), (3, "999", None, "x"), (4, None, "b", "x"), (4, None, "b", "x")], "row_index long, heart_rate string, gender string, charttime string")
    counts = profile.value_counts(df, rows=True)
    assert {(r.column, r.value): r.n for r in counts.filter("column = 'gender'").collect()} == {("gender", "a "): 1, ("gender", "A"): 1, ("gender", None): 1, ("gender", "b"): 2}
    same = lambda f: sorted(map(tuple, f(counts).collect())) == sorted(map(tuple, f(df).collect()))
    for f in (profile.date_formats, profile.unit_tokens, profile.implausible_values, profile.categorical_variants, profile.numeric_summary):
        assert same(f)
    rows = {r.column: (r.rows, r.missing) for r in profile.column_profile(counts, ["heart_rate", "gender", "charttime"]).collect()}
    assert rows == {"heart_rate": (5, 2), "gender": (5, 1), "charttime": (5, 1)} and profile.redundant_rows(counts).first().redundant == 1


@needs_data
def test_a_plan_reads_the_table_once(spark, tmp_path):
    registry.stored_raw(spark, SF).write.parquet(f"{tmp_path}/raw")
    raw = spark.read.parquet(f"{tmp_path}/raw")
    assert profile.value_counts(raw, rows=True)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    plan = pipeline.plan_steps(raw)._jdf.queryExecution().executedPlan().toString()
    assert "value-counts" in plan and f"{tmp_path}/raw" not in plan


def test_medians_by_histograms_and_sketches(spark):
    draw = random.Random(4)
    series = {"even": [draw.uniform(-9, 9) for _ in range(400)], "odd": [draw.choice([-1e300, 1e-300, 5.0, 7.5, 1e300]) * draw.random() for _ in range(301)], "ties": [1.0] * 90 + [2.0] * 90, "one": [3.5]}
    df = frame(spark, [(c, float(x)) for c, xs in series.items() for x in xs], "column string, x double").groupBy("column", "x").agg(F.count(F.lit(1)).alias("n"))
    for most in (10**6, 7, 1):
        got = {r.column: r.median for r in profile.medians(df, most).collect()}
        assert all(got[c] == pytest.approx(np.median(xs), rel=1e-12) for c, xs in series.items())
    wide = frame(spark, [(i, str(x)) for i, x in enumerate(draw.sample(range(10**6), 3000))], "row_index long, heart_rate string")
    xs = sorted(float(r.heart_rate) for r in wide.collect())
    for accuracy in (20, 1000):
        rank = np.searchsorted(xs, profile.numeric_summary(wide, accuracy=accuracy).first().median)
        assert abs(rank - len(xs) / 2) <= len(xs) / accuracy + 1


def test_columns_of_many_values_are_left_out_by_a_sketch(spark):
    df = spark.range(4000).select(F.col("id").alias("row_index"), F.concat(F.lit("v"), F.col("id")).alias("patient_id"), F.when(F.col("id") % 2 == 0, "a ").otherwise("A").alias("gender"))
    exact, quick = profile.categorical_variants(df).collect(), profile.categorical_variants(df, rsd=0.05).collect()
    assert list(map(tuple, exact)) == list(map(tuple, quick)) == [("gender", 2, 1)]
    assert profile.categorical_variants(df.select("row_index", "patient_id"), rsd=0.05).count() == 0


def test_value_lists_of_an_audit_are_bounded(spark):
    df = spark.range(3000).select(F.col("id").alias("row_index"), F.when(F.col("id") < 5, "m").otherwise(F.concat(F.lit("w"), F.col("id"))).alias("gender"), F.lit(None).cast("string").alias("diagnosis"))
    rows = {r.column: r for r in cells.category_audit(df, shown=3).collect()}
    assert rows["gender"].distinct_before == 2996 and rows["gender"].values_before == "m|w10|w100|… and 2993 more" and rows["gender"].cells_changed == 5
    assert rows["diagnosis"].values_before == "" and rows["diagnosis"].distinct_after == 0


@needs_data
def test_a_saved_model_serves_other_tables(spark, tmp_path):
    table, known = registry.with_parameters(spark, SF)
    weights = {c: f["weights"] for c, f in refine.fit(table, known).items()}
    path = str(tmp_path / "model")
    assert refine.save_model(spark, path, known, {}) == 1 and refine.save_model(spark, path, known, weights) == 2
    model = refine.load_model(spark, path)
    assert model["version"] == 2 and model["weights"] == weights and refine.load_model(spark, path, 1)["weights"] == {}
    some = table.filter("admission_id < 'ADM00005'")
    key = lambda df: sorted(map(tuple, df.select("admission_id", "hours_since_admission", "sbp_z", "sbp_refined").collect()))
    together = refine.refine(vmd.standardise(vmd.value_mask_decay(table, means=known), stats=known), weights, stats=known)
    assert key(refine.serve(some, model)) == key(together.filter("admission_id < 'ADM00005'")) != []


@needs_data
def test_fitting_in_one_stage_equals_fitting_rows(spark):
    table, known = registry.with_parameters(spark, SF)
    one, rows = refine.fit(table, known), refine.fit_refiner(refine.training_rows(table, known))
    assert set(one) == set(rows) and all(np.allclose(one[c]["weights"], rows[c]["weights"]) and one[c]["rows"] == rows[c]["rows"] for c in one)


def test_matrices_of_many_tasks_are_added_in_levels(spark, monkeypatch):
    monkeypatch.setattr(refine, "FAN", 2)
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=(90, 43)), draw.normal(size=90)
    rows = frame(spark, [("sbp", a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "channel string, x array<double>, y double").repartition(9)
    assert np.allclose(refine.fit_refiner(rows)["sbp"]["weights"], np.linalg.solve(x.T @ x + np.eye(43), x.T @ y))


def test_scratch_tables_go_and_kept_ones_stay(spark):
    from clinprep.sources import shared

    with shared.scratch(spark):
        gone, kept = shared.store(spark.range(3), "gone"), shared.store(spark.range(4), "kept", keep=True)
        assert gone.count() == 3
    assert kept.count() == 4
    with pytest.raises(Exception, match="(?i)not exist|not found|FILE"):
        gone.count()


def test_histogram_edges(spark):
    df = frame(spark, [(float(x),) for x in (30, 31, 45, 45, 99)], "x double")
    assert {r.bin: r.n for r in review.histogram(df, "x", 30.0, 45.0).collect()} == {0: 1, 2: 1, 43: 2}
    assert {r.bin: r.n for r in review.histogram(df.filter("x = 45"), "x", 30.0, 45.0).collect()} == {0: 2}


# Planning and gates
def test_unknown_step_is_rejected_and_order_is_fixed():
    with pytest.raises(ValueError):
        pipeline.ordered(["drop_the_whole_table"])
    assert pipeline.ordered(["refine_missing_values", "remove_duplicates"]) == ["remove_duplicates", "refine_missing_values"]


@needs_data
def test_gate_halts_on_unmapped_categories(spark):
    raw = events.raw_events(spark, SF)
    with pytest.raises(pipeline.PostconditionFailed, match="categories_all_known"):
        pipeline.clean(raw, gated=True)
    assert [r.step for r in pipeline.plan_steps(raw).orderBy("position").collect()] == pipeline.STEPS


@needs_data
def test_a_run_without_duplicates_and_with_a_part_of_the_steps(spark, tmp_path):
    raw = dedup.remove_duplicates(events.raw_events(spark, SF)).filter("row_index % 3 = 0")
    steps = ["standardise_datetimes", "convert_units", "standardise_categories", "validate_ranges", "build_hourly_timeseries"]
    out = pipeline.run(raw, steps, registry.VOCABULARIES, report=str(tmp_path))
    assert out.processed is None and out.hourly.count() > 0 and "refine_missing_values" not in out.audits
    assert [t[1] for t in out.trace] == steps and all(t[3] for t in out.trace)
    found = pipeline.assertions(raw, out)
    assert found.count() == 4 + 13 + 2 and found.filter("not passed").count() == 0
    assert spark.read.json(f"{tmp_path}/trace").count() == 5 and spark.read.json(f"{tmp_path}/assertions").count() == 19
    assert out.audits["remove_duplicates"].first().removed == 0
    with pytest.raises(ValueError, match="needs"):
        pipeline.run(raw, ["build_hourly_timeseries"])
    texts = pipeline.run(raw, ["convert_units"])
    assert dict(texts.cleaned.dtypes)["charttime"] == "string" and texts.hourly is None


def test_repairs_are_tried_once_and_checked_again(spark):
    rows = [(1, 99.5), (2, 37.0), (3, None)]
    df = frame(spark, rows, "row_index long, temperature double")
    gates = pipeline.Gates()
    fixed = gates.passed("convert_units", df, pipeline.check_units)
    assert {r.row_index: r.temperature for r in fixed.collect()} == {1: 37.5, 2: 37.0, 3: None}
    assert [t[2:4] for t in gates.trace] == [(1, False), (2, True)]
    twice = frame(spark, [(1, "a"), (2, "a")], "row_index long, gender string")
    assert gates.passed("remove_duplicates", twice, pipeline.check_duplicates).count() == 1
    wide = frame(spark, [(float(h),) for h in (80, 90, 999)], "heart_rate double")
    inside = gates.passed("validate_ranges", wide, lambda t: pipeline.check_ranges(t, cells.range_audit(wide)))
    assert inside.filter("heart_rate is null").count() == 1
    lost = frame(spark, [(999.0,)] * 30, "heart_rate double")
    with pytest.raises(pipeline.PostconditionFailed, match="no_column_lost_most_values"):
        gates.passed("validate_ranges", lost, lambda t: pipeline.check_ranges(t, cells.range_audit(lost)))
    assert gates.trace[-1][2:4] == (1, False)  # nothing can repair it


@needs_data
def test_the_grid_is_never_shuffled(spark):
    plan = hourly.build_hourly(registry.stored_events(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # bins by admission and hour, and by admission
    assert "Join" not in plan and plan.index("Generate") < plan.index("Exchange hashpartitioning")


@needs_data
def test_features_of_a_batch_are_the_design(spark):
    import pyarrow as pa

    df = registry.standardised(spark, SF).limit(50)
    batch = pa.Table.from_pandas(df.drop("hour").toPandas(), preserve_index=False).combine_chunks().to_batches()[0]
    stored = spark.createDataFrame(pa.Table.from_batches([batch]))
    for c in ("heart_rate", "sbp", "glucose"):
        want = np.array([list(r) for r in stored.select(*[x.alias(f"x{i}") for i, x in enumerate(refine.design(stored, c))]).collect()])
        assert np.allclose(refine.Features(batch, config.CHANNELS).of(c), want) and want.shape[1] == refine.N_FEATURES


@needs_data
def test_result_does_not_depend_on_partitions_or_order(spark):
    raw = registry.events.raw_events(spark, SF).filter("row_index % 7 < 3")
    rows = raw.collect()
    random.Random(1).shuffle(rows)
    shuffled = spark.createDataFrame(rows, raw.schema)
    want = None
    for parts in (1, 17):
        table = hourly.build_hourly(pipeline.clean(shuffled.repartition(parts))[0])
        got = sorted(map(tuple, registry.rounded(table).collect()), key=repr)
        want = want or got
        assert got == want


@needs_data
def test_csv_round_trip(spark):
    assert sorted(map(repr, registry.QUERIES["s1_read_events"](spark, SF).collect())) == sorted(map(repr, events.raw_events(spark, SF).drop("row_index").collect()))


@needs_data
def test_refinement_leaves_observed_cells_alone(spark):
    audit = registry.QUERIES["f7_refinement_audit"](spark, SF).collect()
    assert len(audit) == 8 and all(r.observed_modified == 0 and r.refined > 0 and r.mean_adjustment > 0 for r in audit)


@needs_data
@pytest.mark.parametrize("name", ["d1_remove_duplicates", "p4_unit_tokens", "p8_numeric_summary", "t3_parse_audit", "t5_reconcile_windows", "u6_unit_paths", "c3_category_audit", "r2_range_audit", "h6_expansion_audit", "w2_heart_rate_value_mask_decay", "v9_channel_audit", "b2_block_holdout", "a6_verdict", "a10_evidence", "s1_line_numbers", "t2_parse_tolerantly", "t3_parse_audit_of_other_forms", "r2_range_audit_of_texts", "r3_rejections_of_texts", "p1_profile_of_dictionary", "p8_exact_medians", "v8_serve", "b1_exact_holdout", "b2_exact_holdout", "h5_from_buckets", "n6_order_ablation", "a7_schema", "h3_align_in_place", "a11_trace"])
def test_sql_twin(spark, name):
    import duckdb

    con = duckdb.connect(config={"threads": 2})
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = con.sql(registry.ORACLES[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    text = lambda df: sorted(df[names].astype(str).itertuples(index=False, name=None))
    assert text(got) == text(want)


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and registry.FLAGSHIP in registry.QUERIES


def test_long_numbers_keep_all_digits_in_ids(spark):
    duckdb = pytest.importorskip("duckdb")
    # the ids' own expressions, as both engines run them
    sql = f"SELECT {events._COLUMNS['admission_id']} AS a, {events._COLUMNS['patient_id']} AS p FROM (VALUES (7, 3), (12345, 99), (123456, 3), (123457, 121)) AS t(u, s)"
    want = [("ADM00007-03", "P00007"), ("ADM12345-99", "P12345"), ("ADM123456-03", "P123456"), ("ADM123457-121", "P123457")]
    assert sorted(map(tuple, spark.sql(sql).collect())) == sorted(want)
    assert sorted(duckdb.sql(sql).fetchall()) == sorted(want)


def test_tasks_of_a_spread_table_grow_in_number_not_in_rows(spark):
    parts = lambda n: shared.spread(spark.range(n), "id", rows=100).rdd.getNumPartitions()
    assert parts(1000) == 10 and parts(4000) == 40
    assert "Exchange" not in shared.spread(spark.range(90), "id", rows=100)._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize("make", [registry.stored_raw, registry.channel_events, lambda s, d: registry.with_parameters(s, d)[0], registry.stored_hourly])
def test_tasks_that_deal_out_a_stored_table_read_a_bounded_number_of_rows(spark, monkeypatch, make):
    for module in (shared, registry):
        monkeypatch.setattr(module, "FILE_ROWS", 20)
    rows = [r[0] for r in make(spark, SF).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(rows) <= 20 * 32 and sum(rows) >= 1000  # files of 20 rows, 4 MB counted for each in a task of 128 MB


@needs_data
@pytest.mark.parametrize("name", ["v7_backward_context", "a4_channel_assertions"])
def test_tasks_that_deal_out_the_given_events_read_a_bounded_number_of_rows(spark, monkeypatch, name):
    rows = lambda: sorted(map(tuple, registry.QUERIES[name](spark, SF).collect()), key=repr)
    want, dealt = rows(), []

    def spread(df, *keys, **more):
        dealt.append([r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()])
        return shared.spread(df, *keys, **more)

    for what, x in {"UNSORTED_PARTS": 4, "SPREAD_EVENTS": 100, "FILE_ROWS": 10, "spread": spread}.items():
        monkeypatch.setattr(events, what, x, raising=False)
    assert rows() == want
    assert max(dealt[0]) <= 10 * 32 and sum(dealt[0]) == 1000


@needs_data
def test_windows_of_channels_are_dealt_out_by_number_of_hours(spark, monkeypatch):
    monkeypatch.setattr(registry, "spread", functools.partial(shared.spread, rows=500))
    monkeypatch.setattr(registry, "SPREAD_EVENTS", 500)
    table = registry.expanded(spark, SF)
    plan = table.agg(*validate.channel_claims(table)[0])._jdf.queryExecution().executedPlan().toString()
    assert [int(n) for n in re.findall(r"Exchange hashpartitioning\(admission_id.*?, (\d+)\)", plan)] == [-(-table.count() // 500)]


@needs_data
def test_statics_are_filled_before_hours_are_made(spark):
    plan = hourly.build_hourly(registry.stored_events(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Window")  # the plan is printed from its last step down


def test_a_window_is_computed_once_for_all_columns_that_need_it(spark):
    table = frame(spark, [("a", 0, 1.0), ("a", 1, None)], "admission_id string, hours_since_admission int, heart_rate double")
    plan = vmd.value_mask_decay(table, ["heart_rate"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("windowspecdefinition") - plan.count("Window [") <= 5  # four of the channel, one of the stay


@needs_data
def test_weights_are_applied_to_the_rows_and_columns_that_are_read(spark):
    served = refine.serve(registry.stored_hourly(spark, SF), {"parameters": registry.with_parameters(spark, SF)[1], "weights": registry.FROZEN})
    plan = served.select("heart_rate_refined_z")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "heart_rate_fill_kind" not in plan
    errors = refine.benchmark_errors(registry.stored_hourly(spark, SF))
    plan = errors._jdf.queryExecution().optimizedPlan().toString()
    assert "any_held" in plan and "MapInArrow" not in plan


@needs_data
def test_a_run_writes_the_wide_table_once(spark, monkeypatch):
    tags = []
    monkeypatch.setattr(pipeline, "store", lambda df, tag, **more: tags.append(tag) or shared.store(df, tag, **more))
    out = pipeline.run(events.raw_events(spark, SF).filter("row_index % 3 = 0"), [*pipeline.STEPS[:1], "standardise_datetimes", "convert_units", "standardise_categories", "validate_ranges", "build_hourly_timeseries", "build_value_mask_decay", "refine_missing_values"], registry.VOCABULARIES)
    assert tags.count("processed") == 1 and "standardised" not in tags
    assert [t[1] for t in out.trace] == pipeline.STEPS and all(t[3] for t in out.trace)


@needs_data
def test_rows_of_windows_and_of_repeated_digests_are_dealt_out_by_number(spark, monkeypatch):
    distinct = registry.distinct_events(spark, SF)
    for module in (datetimes, dedup):
        monkeypatch.setattr(module, "spread", functools.partial(shared.spread, rows=20))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    tasks = lambda df: [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\)", plan(df))]
    windowed = datetimes.reconcile_windows(datetimes.parse_times(distinct))
    assert tasks(windowed) == [50]  # a thousand events
    raw = registry.stored_raw(spark, SF)
    found = dedup.Repeats(raw)
    assert tasks(found.kept("first")) == [10] and found.rows == 200
    assert sorted(map(tuple, found.distinct().collect()), key=repr) == sorted(map(tuple, distinct.collect()), key=repr)


@needs_data
def test_rows_that_meet_digests_too_many_to_broadcast_are_dealt_out_by_number(spark, monkeypatch):
    raw = registry.stored_raw(spark, SF)
    want = sorted(map(tuple, dedup.remove_duplicates(raw).collect()), key=repr)
    audit = tuple(dedup.dedup_audit(raw).first())
    monkeypatch.setattr(dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(dedup, "spread", functools.partial(shared.spread, rows=20))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        others = dedup.Repeats(raw).others()
        tasks = [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\)", others._jdf.queryExecution().executedPlan().toString())]
        assert tasks == [55, 55]  # 1,100 rows, and the digests that they meet
        assert sorted(map(tuple, dedup.remove_duplicates(raw).collect()), key=repr) == want
        assert tuple(dedup.dedup_audit(raw).first()) == audit
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@needs_data
def test_hours_of_channels_carry_no_other_column_and_are_dealt_out_once(spark):
    hours = registry.channel_hours(spark, SF)
    assert hours.columns == ["hour", "admission_id", *config.CHANNELS, "hours_since_admission"]
    plan = hours._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1 and "SortAggregate" not in plan
    rows = lambda df: sorted(map(tuple, registry.rounded(df.select(*hours.columns)).collect()), key=repr)
    assert rows(hours) == rows(registry.hourly_table(spark, SF))


def test_audits_of_channels_copy_no_rows(spark):
    table = vmd.standardise(vmd.value_mask_decay(frame(spark, [("a", 0, 1.0), ("a", 1, None)], "admission_id string, hours_since_admission int, heart_rate double"), ["heart_rate"]), ["heart_rate"])
    refined = refine.refine(table, {}, ["heart_rate"])
    for audit in (vmd.channel_audit(table, ["heart_rate"]), vmd.neutral_check(table, ["heart_rate"]), refine.refinement_audit(refined, ["heart_rate"])):
        plan = audit._jdf.queryExecution().optimizedPlan().toString()
        assert "explode" not in plan and audit.first().channel == "heart_rate"


@needs_data
def test_runs_make_the_same_hours_as_windows_over_the_grid(spark):
    """Of every hour, all columns; a cap and chart times outside the window leave bins outside of the grid."""
    cleaned = registry.stored_events(spark, SF)
    outside = cleaned.withColumn("charttime", F.when(F.col("row_index") % 5 == 0, F.col("charttime") - F.expr("interval 2 days")).otherwise(F.col("charttime")))
    known = {f"{k}_{c}": x for c in config.CHANNELS for k, x in (("mean", 80.0), ("mu", 79.0), ("sd", 12.0))}
    rows = lambda df: sorted(map(tuple, registry.rounded(df).collect()), key=repr)
    for table, cap in ((cleaned, config.MAX_HOURS), (outside, 30)):
        grid = hourly.build_hourly(table, cap)
        runs = vmd.seen_by_runs(hourly.stay_runs(table, cap))
        assert runs.agg(F.sum(hourly.run_rows())).first()[0] == grid.count() > 5 * runs.count() / 2
        expanded = vmd.expand_runs(runs, known)
        assert expanded.dtypes == vmd.value_mask_decay(grid, means=known).dtypes
        assert rows(expanded) == rows(vmd.value_mask_decay(grid, means=known))
    plan = vmd.expand_runs(shared.store(runs, "runs"), known)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


@needs_data
def test_a_fit_needs_the_observed_cells_only(spark):
    table, known = registry.with_parameters(spark, SF)
    runs = hourly.stay_runs(registry.stored_events(spark, SF)).filter(F.coalesce(*config.CHANNELS).isNotNull())
    every, few = refine.hidden_rows(table)[0], refine.hidden_rows(runs, length="hours")[0]
    rows = lambda df: sorted(map(tuple, registry.rounded(df.select(*every.columns)).collect()), key=repr)
    assert rows(few) == rows(every) != []


@needs_data
def test_a_run_encodes_no_grid_and_reads_it_once_for_gates_and_audits(spark, monkeypatch, tmp_path):
    """Tables that a run writes have a row for an event or a run at most, and its audits come with the gates' one reading."""
    rows = {}
    monkeypatch.setattr(pipeline, "store", lambda df, tag, **more: rows.setdefault(tag, shared.store(df, tag, **more)))
    out = pipeline.run(events.raw_events(spark, SF), vocabularies=registry.VOCABULARIES, report=str(tmp_path))
    assert max(t.count() for t in rows.values() if "column" not in t.columns) == 1100 and "windowed" not in rows
    assert out.processed.count() == out.hourly.count() > 5 * rows["processed"].count() / 2
    for step, audit in (("build_value_mask_decay", vmd.channel_audit), ("refine_missing_values", refine.refinement_audit)):
        assert "FileScan" not in out.audits[step]._jdf.queryExecution().executedPlan().toString()
        assert sorted(out.audits[step].collect()) == sorted(audit(out.processed).collect())
    assert set(rows["value-counts"].select("column").distinct().toPandas()["column"]) <= set(config.RAW_COLUMNS) - {*config.TIME_COLUMNS, "admission_id"}


@needs_data
def test_sql_twin_of_a_report(spark):
    test_sql_twin(spark, "s3_report_of_a_run")
