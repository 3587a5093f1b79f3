"""SQL twins of the queries, for DuckDB over the same tables.

Each is a chain of common table expressions from the raw text table to the stage that a query shows, written for SQL
on its own: nothing here is generated from the Spark expressions but the raw table itself.
"""

from __future__ import annotations

from clinprep import config
from clinprep.sources.events import INJECTED_SQL, RAW_SQL

CH, RG, UC, TIMES, VOC, STATIC, RAW = config.CHANNELS, config.RANGES, config.UNIT_COLUMNS, config.TIME_COLUMNS, config.VOCABULARIES, config.STATIC_COLUMNS, config.RAW_COLUMNS
WAYS = config.PATHS
FROM_F, FROM_MMOL = f"'{WAYS['fahrenheit']}', '{WAYS['likely_fahrenheit']}'", f"'{WAYS['mmol']}', '{WAYS['likely_mmol']}'"


def cols(names, template="{0}", sep=", ") -> str:
    return sep.join(template.format(n) for n in names)


def rint(x: str, k: int) -> str:
    return f"(round_even(({x}) * 1e{k}, 0) / 1e{k})"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def number(x: str) -> str:
    return f"TRY_CAST(NULLIF(regexp_extract({x}, '(-?\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE)"


MEASURE = config.MEASUREMENT


def magnitude(x: str) -> str:
    return f"TRY_CAST(NULLIF(regexp_extract({x}, '{MEASURE}', 1), '') AS DOUBLE)"


def unit(x: str) -> str:
    return f"coalesce(lower(regexp_extract({x}, '{MEASURE}', 2)), '')"


def spelling(x: str) -> str:
    rules = " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{n}'" for n, p in config.SPELLINGS)
    return f"CASE {rules} ELSE '{config.UNRECOGNISED}' END"


FORMS = ["%Y-%m-%d %H:%M", "%Y/%m/%d %H:%M", "%d/%m/%Y %H:%M", "%b %d %Y %H:%M"]


def instant(x: str) -> str:
    s = strip(x)
    return "CASE " + " ".join(f"WHEN regexp_matches({s}, '{p}') THEN try_strptime({s}, '{f}')" for (_, p), f in zip(config.SPELLINGS, FORMS, strict=True)) + " END"


def path(c: str) -> str:
    x, u = magnitude(c), unit(c)
    if c == "temperature":
        ways = f"WHEN {u} LIKE 'f%' THEN '{WAYS['fahrenheit']}' WHEN {u} LIKE 'c%' THEN '{WAYS['celsius']}' WHEN {x} BETWEEN 77 AND 113 THEN '{WAYS['likely_fahrenheit']}' ELSE '{WAYS['bare_temperature']}'"
    elif c == "glucose":
        ways = f"WHEN {u} LIKE '%mmol%' THEN '{WAYS['mmol']}' WHEN {u} LIKE '%mg%' THEN '{WAYS['mg']}' WHEN {x} BETWEEN 1 AND 35 THEN '{WAYS['likely_mmol']}' ELSE '{WAYS['bare_glucose']}'"
    else:
        ways = f"WHEN {u} <> '' THEN '{WAYS['suffix']}' ELSE '{WAYS['bare']}'"
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {x} IS NULL THEN '{WAYS['unparseable']}' {ways} END"


def converted(c: str) -> str:
    x = magnitude(c)
    if c == "temperature":
        x = f"CASE WHEN {path(c)} IN ({FROM_F}) THEN ({x} - 32.0) * 5.0 / 9.0 ELSE {x} END"
    elif c == "glucose":
        x = f"CASE WHEN {path(c)} IN ({FROM_MMOL}) THEN {x} * CAST(18.0182 AS DOUBLE) ELSE {x} END"
    return rint(x, 2)


def mapped(c: str, x: str | None = None) -> str:
    x = x or c
    return f"CASE lower({strip(x)}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VOC[c].items()) + f" ELSE {x} END"


def unknown(c: str) -> str:
    words = ", ".join(f"'{k}'" for k in VOC[c])
    return f"{c} IS NOT NULL AND lower({strip(c)}) NOT IN ({words})"


def per(names, template: str) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in names)


UP = "OVER (PARTITION BY admission_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"
DOWN = "OVER (PARTITION BY admission_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
SEED = config.SEED


def stays(cap: int) -> str:
    return f"""SELECT admission_id, i, o, date_trunc('hour', i) AS s, CASE WHEN date_trunc('hour', o) = o THEN o ELSE date_trunc('hour', o) + INTERVAL 1 HOUR END AS t
    FROM (SELECT admission_id, min(intime) AS i, max(outtime) AS o FROM usable GROUP BY admission_id)"""


def grid(cap: int) -> str:
    return f"""SELECT admission_id, truncated, pos, s + pos * INTERVAL 1 HOUR AS hour FROM (
    SELECT admission_id, s, date_diff('hour', s, t) + 1 > {cap} AS truncated, unnest(generate_series(0, CAST(least(date_diff('hour', s, t), {cap - 1}) AS BIGINT))) AS pos FROM stays WHERE t >= s)"""


def expand(c: str) -> str:
    value, gap = f"coalesce({c}_last, {c}_mean)", f"CASE WHEN {c}_p IS NULL THEN coalesce({c}_n, hours) - pos ELSE pos - {c}_p END"
    back = f"coalesce({c}_n, hours) - pos"
    return (
        f"{rint(value, 3)} AS {c}_value, CAST({c} IS NOT NULL AS INTEGER) AS {c}_mask, {rint(f'power(0.75::DOUBLE, {gap})', 6)} AS {c}_decay, CAST({gap} AS INTEGER) AS {c}_gap_hours, "
        f"CASE WHEN {c} IS NOT NULL THEN 'observed' WHEN {c}_p IS NOT NULL THEN 'locf' ELSE 'neutral_fill' END AS {c}_fill_kind, "
        f"{rint(f'CASE WHEN {c}_p IS NULL THEN {c}_mean ELSE coalesce({c}_next, {c}_last) END', 3)} AS {c}_next_value, CAST({back} AS INTEGER) AS {c}_backward_gap_hours, {rint(f'power(0.75::DOUBLE, {back})', 6)} AS {c}_backward_decay"
    )


def vmd_ctes(source: str, tag: str = "") -> list[tuple[str, str]]:
    """Value, mask and decay of ``source``, and its standardised twin."""
    seen = cols(CH, f"max(CASE WHEN {{0}} IS NOT NULL THEN pos END) {UP} AS {{0}}_p, min(CASE WHEN {{0}} IS NOT NULL THEN pos END) {DOWN} AS {{0}}_n, last_value({{0}} IGNORE NULLS) {UP} AS {{0}}_last, first_value({{0}} IGNORE NULLS) {DOWN} AS {{0}}_next")
    return [
        (f"means{tag}", f"SELECT {cols(CH, 'avg({0}) AS {0}_mean')} FROM {source}"),
        (f"seen{tag}", f"SELECT *, count(*) OVER (PARTITION BY admission_id) AS hours, {seen} FROM {source}, means{tag}"),
        (f"vmd{tag}", f"SELECT admission_id, pos AS hours_since_admission, hour, {cols(CH)}, {', '.join(map(expand, CH))} FROM seen{tag}"),
        (f"stats{tag}", f"SELECT {cols(CH, 'avg({0}_value) FILTER ({0}_mask = 1) AS {0}_mu, CASE WHEN stddev_pop({0}_value) FILTER ({0}_mask = 1) > 0 THEN stddev_pop({0}_value) FILTER ({0}_mask = 1) ELSE 1.0 END AS {0}_sd')} FROM vmd{tag}"),
        (f"std{tag}", f"SELECT *, {', '.join(f'{rint(f'({c}_value - {c}_mu) / {c}_sd', 4)} AS {c}_z, {rint(f'({c}_next_value - {c}_mu) / {c}_sd', 4)} AS {c}_next_z' for c in CH)} FROM vmd{tag}, stats{tag}"),
    ]


def drawn(share: float, seed: int = SEED) -> str:
    return f"substr(md5('{seed}|' || channel || '|' || admission_id || '|' || CAST(pos AS VARCHAR)), 1, 4) < '{int(round(share * 65536)):04x}'"


BLOCK_SHARE = 1 - (1 - config.HOLDOUT_FRACTION) ** (1 / 3)
SERIES = "(PARTITION BY admission_id, channel ORDER BY pos"

CTES: list[tuple[str, str]] = [
    ("raw", RAW_SQL.format(events="events")),
    ("ev", f"SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY {cols(RAW)} ORDER BY row_index) AS nth FROM raw) WHERE nth = 1"),
    ("parsed", f"SELECT * REPLACE ({', '.join(f'{instant(c)} AS {c}' for c in TIMES)}) FROM ev"),
    *[(f"vote_{c}", f"SELECT admission_id, {c} AS w_{c} FROM (SELECT admission_id, {c}, row_number() OVER (PARTITION BY admission_id ORDER BY n DESC, {c}) AS nth FROM (SELECT admission_id, {c}, count(*) AS n FROM parsed WHERE {c} IS NOT NULL GROUP BY ALL)) WHERE nth = 1") for c in ("intime", "outtime")],
    ("voted", "SELECT * EXCLUDE (w_intime, w_outtime) REPLACE (coalesce(w_intime, intime) AS intime, coalesce(w_outtime, outtime) AS outtime), charttime AS charted FROM parsed LEFT JOIN vote_intime USING (admission_id) LEFT JOIN vote_outtime USING (admission_id)"),
    ("windowed", f"SELECT * REPLACE (CASE WHEN charttime < intime THEN intime WHEN charttime > outtime THEN outtime ELSE charttime END AS charttime), {rint('epoch(outtime - intime) / 3600.0', 2)} AS length_of_stay_hours FROM voted"),
    ("united", f"SELECT * EXCLUDE (charted) REPLACE ({', '.join(f'{converted(c)} AS {c}' for c in UC)}) FROM windowed"),
    ("cleaned", f"SELECT * REPLACE ({', '.join(f'{mapped(c)} AS {c}' for c in VOC)}, {', '.join(f'CASE WHEN {c} BETWEEN {lo} AND {hi} THEN {c} END AS {c}' for c, (lo, hi) in RG.items())}) FROM united"),
    ("usable", f"SELECT *, date_trunc('hour', charttime) AS hour FROM cleaned WHERE {cols(['admission_id', *TIMES], '{0} IS NOT NULL', ' AND ')}"),
    ("bins", f"SELECT admission_id, hour, {cols(CH, 'avg({0}) AS {0}')}, {cols(STATIC, 'arg_min({0}, row_index) FILTER ({0} IS NOT NULL) AS {0}')}, count(*) AS events FROM usable GROUP BY admission_id, hour"),
    ("stays", stays(config.MAX_HOURS)),
    ("grid", grid(config.MAX_HOURS)),
    ("short_grid", grid(48)),
    ("aligned", "SELECT grid.*, bins.* EXCLUDE (admission_id, hour) FROM grid LEFT JOIN bins ON grid.admission_id = bins.admission_id AND grid.hour = bins.hour"),
    ("hourly", f"SELECT admission_id, hour, pos, {cols(CH)}, {cols(STATIC, f'coalesce(last_value({{0}} IGNORE NULLS) {UP}, first_value({{0}} IGNORE NULLS) {DOWN}) AS {{0}}')} FROM aligned"),
    *vmd_ctes("hourly"),
    ("cells", per(CH, "SELECT admission_id, pos, '{c}' AS channel, {c} AS truth FROM hourly WHERE {c} IS NOT NULL")),
    ("b_random", f"SELECT * FROM cells WHERE {drawn(config.HOLDOUT_FRACTION)}"),
    ("b_starts", f"SELECT *, {drawn(BLOCK_SHARE)} AND row_number() OVER {SERIES}) + 2 <= count(*) OVER (PARTITION BY admission_id, channel) AS start FROM cells"),
    ("b_block", f"SELECT admission_id, pos, channel, truth FROM (SELECT *, bool_or(start) OVER {SERIES} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS held FROM b_starts) WHERE held"),
    ("b_flags", f"SELECT admission_id, pos, {cols(CH, "bool_or(channel = '{0}') AS h_{0}")} FROM b_block GROUP BY ALL"),
    ("b_left", f"SELECT hourly.* REPLACE ({cols(CH, 'CASE WHEN h_{0} THEN NULL ELSE {0} END AS {0}')}) FROM hourly LEFT JOIN b_flags USING (admission_id, pos)"),
    *vmd_ctes("b_left", "_b"),
    ("b_values", per(CH, "SELECT admission_id, hours_since_admission AS pos, '{c}' AS channel, {c}_value AS locf FROM vmd_b")),
    ("errors", "SELECT * FROM b_block JOIN b_values USING (admission_id, pos, channel)"),
]


def basis() -> list[str]:
    return ["1.0"] + [f"{f}({k}.0 * pi() * hours_since_admission / 72.0)" for k in (1, 2, 3, 4) for f in ("sin", "cos")]


def design(target: str) -> list[str]:
    t = target
    near = f"CASE WHEN {t}_gap_hours + {t}_backward_gap_hours > 0 THEN {t}_backward_gap_hours::DOUBLE / ({t}_gap_hours + {t}_backward_gap_hours) ELSE 1.0 END"
    own = [f"{t}_z", f"{t}_next_z", f"{t}_decay", f"{t}_backward_decay", f"({near}) * {t}_z + (1.0 - ({near})) * {t}_next_z", f"{t}_mask"]
    return own + [f"{c}_{s}" for c in CH if c != t for s in ("z", "next_z", "mask", "decay")] + basis()


def frozen(k: int) -> str:
    """The prediction with the fixed weights of channel k."""
    return " + ".join(f"({x})::DOUBLE * ({((7 * i + k) % 11 - 5) / 50.0})" for i, x in enumerate(design(CH[k])))


CTES += [
    ("exact", f"SELECT *, {', '.join(f'CASE WHEN {c}_mask = 1 THEN {c}_z ELSE {c}_decay * {c}_z + (1.0 - {c}_decay) * ({frozen(k)}) END AS {c}_e' for k, c in enumerate(CH))} FROM std"),
    ("refined", f"SELECT *, {', '.join(f'{rint(f'{c}_e', 4)} AS {c}_refined_z, CASE WHEN {c}_mask = 1 THEN {c}_value ELSE {rint(f'{c}_e * {c}_sd + {c}_mu', 3)} END AS {c}_refined' for c in CH)} FROM exact"),
]


def after(stage: str, select: str) -> str:
    """``select`` after the chain up to ``stage``."""
    names = [n for n, _ in CTES]
    # materialised: the chain's stages are read several times
    chain = ", ".join(f"{n} AS MATERIALIZED ({sql})" for n, sql in CTES[: names.index(stage) + 1])
    return f"WITH {chain} {select}"


def texts(names) -> str:
    return cols(names, "CAST({0} AS VARCHAR) AS {0}")


K = "admission_id, hours_since_admission"
EVENT = f"SELECT row_index, {cols(RAW)} FROM ev"
_states = per(RG, "SELECT row_index, admission_id, CAST(charttime AS VARCHAR) AS charttime, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, {c} AS x FROM united")
BOUNDS = "CASE \"column\" " + " ".join(f"WHEN '{c}' THEN {lo}" for c, (lo, _) in RG.items()) + " END", "CASE \"column\" " + " ".join(f"WHEN '{c}' THEN {hi}" for c, (_, hi) in RG.items()) + " END"
OUT = f"x IS NOT NULL AND NOT x BETWEEN {BOUNDS[0]} AND {BOUNDS[1]}"
_audit = f"""SELECT "column", count(*) FILTER ({OUT}) AS rejected, count(*) FILTER ({OUT}) AS out_of_range, CAST(0 AS BIGINT) AS unparseable, count(x) AS observed_before,
 count(x) - count(*) FILTER ({OUT}) AS observed_after, count(*) AS total FROM ({_states}) GROUP BY "column" """


def profile_rows() -> str:
    return " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS \"column\", 'string' AS dtype, count(*) AS rows, count(*) - count({c}) AS missing, {rint(f'100.0::DOUBLE * (count(*) - count({c})) / greatest(count(*), 1)', 2)} AS missing_pct FROM raw" for i, c in enumerate(RAW))


def counted(source: str, names, template: str, label: str) -> str:
    return f"SELECT \"column\", {label}, count(*) AS n FROM ({per(names, template)}) WHERE {label} IS NOT NULL GROUP BY ALL"


def audit_rows(table: str) -> str:
    parts = per(VOC, "SELECT '{c}' AS \"column\", {c} AS v, @{c}@ AS w FROM " + table)
    for c in VOC:
        parts = parts.replace(f"@{c}@", mapped(c))
    return parts


def fields(stage: str, *names: str) -> str:
    return after(stage, f"SELECT {K}, {', '.join(f'{c}_{f}' for c in CH for f in names)} FROM {stage}")


def token(c: str) -> str:
    found = f"regexp_extract({strip(c)}, '{config.UNIT_SUFFIX}', 1)"
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {found} = '' THEN '<bare number>' ELSE {found} END"


def hist(source: str, lo: float, hi: float) -> str:
    return f"SELECT CAST(CASE WHEN b > a THEN least(floor((x - a) / (b - a) * 44), 43) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM (SELECT x, min(x) OVER () AS a, max(x) OVER () AS b FROM ({source}) WHERE x BETWEEN {lo} AND {hi}) GROUP BY ALL"


def grid_rows() -> str:
    return f"""SELECT admission_id, string_agg(CAST(m AS VARCHAR), '' ORDER BY pos) AS mask, 100.0::DOUBLE * sum(m) / 48 AS observed_pct FROM (
      SELECT a.admission_id, h.pos, coalesce(heart_rate_mask, 0) AS m FROM (SELECT DISTINCT admission_id FROM vmd ORDER BY 1 LIMIT 30) a CROSS JOIN (SELECT unnest(generate_series(0, 47)) AS pos) h
      LEFT JOIN vmd ON vmd.admission_id = a.admission_id AND vmd.hours_since_admission = h.pos) GROUP BY admission_id"""


P4 = "SELECT \"column\", token, n FROM (SELECT *, count(*) OVER (PARTITION BY \"column\") AS k FROM (SELECT \"column\", token, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {token(c)} AS token FROM raw" for c in CH) + ") WHERE token IS NOT NULL GROUP BY ALL)) WHERE k > 1"
P6 = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {lo}::DOUBLE AS low, {hi}::DOUBLE AS high, count(*) FILTER (NOT {number(c)} BETWEEN {lo} AND {hi}) AS out_of_range, count(*) FILTER ({c} IS NOT NULL AND {number(c)} IS NULL) AS unparseable FROM raw" for c, (lo, hi) in RG.items()) + ") WHERE out_of_range + unparseable > 0"
P7 = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_raw, count(DISTINCT lower({strip(c)})) AS distinct_casefold FROM raw" for c in RAW if c not in RG and c not in TIMES) + ") WHERE distinct_raw <= 25 AND distinct_raw > distinct_casefold"
ERR = "abs(locf - truth)"
OK2 = "expected, observed"
ORACLES: dict[str, str] = {
    "s1_read_events": after("raw", f"SELECT {cols(RAW)} FROM raw"),
    "s2_write_table": after("cleaned", f"SELECT * REPLACE ({texts(TIMES)}) FROM cleaned"),
    "s3_write_report": after("ev", "SELECT 'keep_first' AS strategy, (SELECT count(*) FROM raw) AS rows_before, (SELECT count(*) FROM ev) AS rows_after, (SELECT count(*) FROM raw) - (SELECT count(*) FROM ev) AS removed, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM ev GROUP BY " + cols(RAW) + ")) AS remaining, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM raw GROUP BY " + cols(RAW) + ") WHERE n > 1) AS involved"),
    "p1_column_profile": after("raw", profile_rows()),
    "p2_duplicate_profile": after("raw", f"SELECT CAST(sum(n - 1) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS involved FROM (SELECT count(*) AS n FROM raw GROUP BY {cols(RAW)})"),
    "p3_date_formats": after("raw", f"SELECT \"column\", {spelling('value')} AS spelling, count(*) AS n FROM ({per(TIMES, 'SELECT {c} AS value, ' + chr(39) + '{c}' + chr(39) + ' AS \"column\" FROM raw WHERE {c} IS NOT NULL')}) GROUP BY ALL"),
    "p4_unit_tokens": after("raw", P4),
    "p5_numeric_view": after("raw", f"SELECT row_index, {', '.join(f'{number(c)} AS {c}' for c in RG)} FROM raw"),
    "p6_implausible_values": after("raw", P6),
    "p7_categorical_variants": after("raw", P7),
    "p8_numeric_summary": after("raw", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {rint(f'min({number(c)})', 2)} AS min, {rint(f'median({number(c)})', 2)} AS median, {rint(f'max({number(c)})', 2)} AS max, count({number(c)}) AS observed FROM raw" for c in CH)),
    "p9_top_missing": after("raw", f"SELECT \"column\", missing, missing_pct FROM ({profile_rows()}) WHERE missing > 0 ORDER BY missing DESC, position LIMIT 10"),
    "d1_remove_duplicates": after("ev", EVENT),
    "d2_remove_key_duplicates": after("raw", "SELECT row_index, admission_id, charttime FROM (SELECT *, row_number() OVER (PARTITION BY admission_id, charttime ORDER BY row_index DESC) AS nth FROM raw) WHERE nth = 1"),
    "d3_dropped_rows": after("ev", "SELECT row_index FROM raw WHERE row_index NOT IN (SELECT row_index FROM ev)"),
    "d5_verify_dropped": after("ev", f"SELECT raw.row_index, count(ev.row_index) AS n_matches FROM raw LEFT JOIN ev ON {cols(RAW, 'raw.{0} IS NOT DISTINCT FROM ev.{0}', ' AND ')} WHERE raw.row_index NOT IN (SELECT row_index FROM ev) GROUP BY raw.row_index"),
    "t1_parse_datetimes": after("parsed", f"SELECT row_index, {texts(TIMES)} FROM parsed"),
    "t2_parse_with_fallback": after("parsed", "SELECT row_index, CAST(charttime AS VARCHAR) AS charttime FROM parsed"),
    "t3_parse_audit": after("parsed", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {spelling(strip(f'ev.{c}'))}) FILTER ({spelling(strip(f'ev.{c}'))} <> 'Unrecognised') AS spellings, count(*) FILTER ({spelling(strip(f'ev.{c}'))} = 'Unrecognised' AND parsed.{c} IS NOT NULL) AS fallback_parsed, count(*) FILTER (parsed.{c} IS NULL) AS unparseable FROM ev JOIN parsed USING (row_index) WHERE ev.{c} IS NOT NULL" for c in TIMES) + ") JOIN (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {spelling(strip(c))} AS spelling, count(*) AS n FROM ev WHERE {c} IS NOT NULL GROUP BY ALL" for c in TIMES) + ") USING (\"column\")"),
    "t4_naive_disagreements": after("parsed", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (parsed.{c} IS NOT NULL AND regexp_matches(ev.{c}, '^\\d\\d/\\d\\d/\\d{{4}} \\d\\d:\\d\\d$') AND day(parsed.{c}) <= 12 AND day(parsed.{c}) <> month(parsed.{c})) AS n FROM ev JOIN parsed USING (row_index)" for c in TIMES)),
    "t5_reconcile_windows": after("windowed", f"SELECT row_index, admission_id, {texts(['intime', 'outtime'])} FROM windowed"),
    "t6_window_audit": after("windowed", "SELECT (SELECT CAST(sum(CAST(a > 1 AS INT) + CAST(b > 1 AS INT)) AS BIGINT) FROM (SELECT count(DISTINCT intime) AS a, count(DISTINCT outtime) AS b FROM parsed GROUP BY admission_id)) AS conflicting_windows, (SELECT count(*) FROM windowed WHERE outtime <= intime) AS inverted_windows"),
    "t7_clamp_charttime": after("windowed", "SELECT row_index, CAST(charttime AS VARCHAR) AS charttime FROM windowed"),
    "t7_clamp_audit": after("windowed", "SELECT count(*) FILTER (charted < intime) AS clamped_before, count(*) FILTER (charted > outtime) AS clamped_after FROM windowed"),
    "t8_length_of_stay": after("windowed", "SELECT row_index, length_of_stay_hours FROM windowed"),
    "t9_stay_summary": after("windowed", "SELECT min(length_of_stay_hours) AS min, median(length_of_stay_hours) AS median, max(length_of_stay_hours) AS max, count(DISTINCT admission_id) AS admissions FROM windowed"),
    "u1_parse_measurement": after("ev", " UNION ALL ".join(f"SELECT row_index, '{c}' AS \"column\", {magnitude(c)} AS magnitude, {unit(c)} AS unit FROM ev" for c in CH)),
    "u2_to_celsius": after("ev", f"SELECT row_index, {converted('temperature')} AS celsius FROM ev"),
    "u3_to_mg_dl": after("ev", f"SELECT row_index, {converted('glucose')} AS mg_dl FROM ev"),
    "u4_strip_unit": after("ev", f"SELECT row_index, {converted('sbp')} AS sbp, {converted('mbp')} AS mbp FROM ev"),
    "u5_convert_units": after("united", f"SELECT row_index, {cols(UC)} FROM united"),
    "u6_unit_paths": after("ev", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {path(c)} AS path, count(*) AS n FROM ev GROUP BY ALL" for c in UC) + ") WHERE path IS NOT NULL"),
    "u6_converted_totals": after("ev", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS converted FROM ev WHERE {path(c)} IN ({w})" for c, w in (("temperature", FROM_F), ("glucose", FROM_MMOL)))),
    "u7_unit_distributions": after("ev", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{s}' AS stage, count(x) AS count, {rint('min(x)', 2)} AS min, {rint('avg(x)', 2)} AS mean, {rint('max(x)', 2)} AS max FROM (SELECT {e} AS x FROM ev)" for c in UC for s, e in (("before", number(c)), ("after", converted(c))))),
    "c1_standardise_categories": after("ev", f"SELECT row_index, {', '.join(f'{mapped(c)} AS {c}' for c in VOC)} FROM ev"),
    "c2_unmapped_values": after("ev", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM ev WHERE {unknown(c)} GROUP BY ALL" for c in VOC)),
    "c3_category_audit": after("ev", f"SELECT \"column\", count(DISTINCT v) AS distinct_before, count(DISTINCT w) AS distinct_after, string_agg(DISTINCT v, '|' ORDER BY v) AS values_before, string_agg(DISTINCT w, '|' ORDER BY w) AS values_after, count(*) FILTER (v IS DISTINCT FROM w) AS cells_changed FROM ({audit_rows('ev')}) GROUP BY ALL"),
    "r1_validate_ranges": after("cleaned", f"SELECT row_index, {cols(RG)} FROM cleaned"),
    "r2_range_audit": after("united", _audit),
    "r3_rejections": after("united", f"SELECT row_index, admission_id, charttime, \"column\", value, 'out_of_range' AS reason FROM ({_states}) WHERE {OUT}"),
    "r3_rejection_log": after("united", "SELECT row_index, admission_id, charttime, \"column\", value, 'out_of_range' AS reason FROM (" + " UNION ALL ".join(f"SELECT {i} AS p, row_index, admission_id, CAST(charttime AS VARCHAR) AS charttime, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM united WHERE NOT {c} BETWEEN {lo} AND {hi}" for i, (c, (lo, hi)) in enumerate(RG.items())) + ") ORDER BY p, row_index LIMIT 200"),
    "r4_channel_loss": after("united", f"SELECT \"column\", {rint('1 - observed_after::DOUBLE / greatest(observed_before, 1)', 4)} AS lost, observed_before < 20 OR {rint('1 - observed_after::DOUBLE / greatest(observed_before, 1)', 4)} <= 0.5 AS passed FROM ({_audit})"),
    "h1_bin_hours": after("bins", f"SELECT admission_id, CAST(hour AS VARCHAR) AS hour, {', '.join(f'{rint(c, 6)} AS {c}' for c in CH)}, {', '.join(f'{rint(c, 6)} AS {c}' if c in RG or c == 'length_of_stay_hours' else c for c in STATIC)}, events FROM bins"),
    "h2_hour_grid": after("grid", "SELECT admission_id, truncated, CAST(pos AS INTEGER) AS hours_since_admission, CAST(hour AS VARCHAR) AS hour FROM grid"),
    "h2_capped_grid": after("short_grid", "SELECT admission_id, count(*) AS hours, bool_or(truncated) AS truncated FROM short_grid GROUP BY admission_id"),
    "h3_align": after("aligned", f"SELECT admission_id, CAST(hour AS VARCHAR) AS hour, {', '.join(f'{rint(c, 6)} AS {c}' for c in CH)} FROM aligned"),
    "h4_spread_statics": after("hourly", f"SELECT admission_id, CAST(hour AS VARCHAR) AS hour, {cols(STATIC)} FROM hourly"),
    "h5_hours_since_admission": after("hourly", "SELECT admission_id, CAST(hour AS VARCHAR) AS hour, CAST(pos AS INTEGER) AS hours_since_admission FROM hourly"),
    "h6_expansion_audit": after("grid", f"SELECT *, {rint('rows_after::DOUBLE / greatest(rows_before, 1)', 2)} AS factor FROM (SELECT (SELECT count(*) FROM usable) AS rows_before, (SELECT CAST(sum(events) - count(*) AS BIGINT) FROM bins) AS merged_observations, CAST(sum(n) AS BIGINT) AS rows_after, count(*) AS admissions, count(*) FILTER (t) AS truncated_admissions, min(n) AS hours_min, median(n) AS hours_median, max(n) AS hours_max FROM (SELECT count(*) AS n, bool_or(truncated) AS t FROM grid GROUP BY admission_id))"),
    "h7_missing_before_after": after("hourly", " UNION ALL ".join(f"SELECT '{c}' AS channel, (SELECT {rint(f'100.0::DOUBLE * avg(CAST({c} IS NULL AS DOUBLE))', 2)} FROM usable) AS before, (SELECT {rint(f'100.0::DOUBLE * avg(CAST({c} IS NULL AS DOUBLE))', 2)} FROM hourly) AS \"after\"" for c in CH)),
    "v1_population_means": after("means", f"SELECT {', '.join(f'{rint(f'{c}_mean', 6)} AS mean_{c}' for c in CH)} FROM means"),
    "v2_neutral_fill": after("seen", f"SELECT admission_id, CAST(pos AS INTEGER) AS hours_since_admission, {rint('CASE WHEN heart_rate_p IS NULL THEN heart_rate_mean ELSE heart_rate END', 6)} AS heart_rate FROM seen"),
    "v3_value": fields("vmd", "value"),
    "v4_mask": fields("vmd", "mask"),
    "v5_decay": fields("vmd", "gap_hours", "decay"),
    "v6_fill_kind": fields("vmd", "fill_kind"),
    "v7_backward_context": fields("vmd", "next_value", "backward_gap_hours", "backward_decay"),
    "v8_standardise": fields("std", "z", "next_z"),
    "v9_channel_audit": after("vmd", " UNION ALL ".join(f"SELECT '{c}' AS channel, count(*) FILTER ({c}_fill_kind = 'observed') AS observed, count(*) FILTER ({c}_fill_kind = 'locf') AS locf, count(*) FILTER ({c}_fill_kind = 'neutral_fill') AS neutral, {rint(f'100.0::DOUBLE * avg({c}_mask)', 2)} AS observed_pct, max({c}_gap_hours) AS max_gap, {rint(f'avg({c}_decay) FILTER ({c}_mask = 0)', 4)} AS mean_decay_imputed, {rint(f'avg({c}_value) FILTER ({c}_mask = 1)', 3)} AS mean_used FROM vmd" for c in CH)),
    "v10_neutral_check": after("std", " UNION ALL ".join(f"SELECT '{c}' AS channel, coalesce(max(abs({c}_z)) FILTER ({c}_fill_kind = 'neutral_fill'), 0.0) AS worst FROM std" for c in CH)),
    "w2_heart_rate_value_mask_decay": after("vmd", "SELECT admission_id, CAST(hour AS VARCHAR) AS hour, heart_rate_value AS value, heart_rate_mask AS mask, heart_rate_decay AS decay FROM vmd"),
    "f1_temporal_basis": after("vmd", f"SELECT {K}, {', '.join(f'{rint(x, 6)} AS basis_{i}' for i, x in enumerate(basis()))} FROM vmd"),
    "f2_design": after("std", f"SELECT {K}, {', '.join(f'{rint(f'({x})::DOUBLE', 6)} AS x_{i}' for i, x in enumerate(design('heart_rate')))} FROM std"),
    "f3_mask_cells": after("cells", f"SELECT admission_id, CAST(pos AS INTEGER) AS hours_since_admission, channel, {rint('truth', 6)} AS truth FROM cells WHERE {drawn(config.MASK_FRACTION, SEED + 1)} AND channel IN (SELECT channel FROM cells GROUP BY channel HAVING count(*) >= 40)"),
    "f5_refine": fields("refined", "refined_z"),
    "f6_natural_units": fields("refined", "refined"),
    "f7_refinement_audit": after("refined", " UNION ALL ".join(f"SELECT '{c}' AS channel, count(*) FILTER ({c}_mask = 0) AS refined, count(*) FILTER ({c}_mask = 1) AS protected, {rint(f'avg(abs({c}_refined_z - {c}_z)) FILTER ({c}_mask = 0)', 4)} AS mean_adjustment, {rint(f'max(abs({c}_refined_z - {c}_z)) FILTER ({c}_mask = 0)', 4)} AS max_adjustment, count(*) FILTER ({c}_mask = 1 AND {c}_refined IS DISTINCT FROM {c}_value) AS observed_modified FROM refined" for c in CH)),
    **{f"b{n}_{m}_holdout": after(f"b_{m}", f"SELECT admission_id, CAST(pos AS INTEGER) AS hours_since_admission, channel, {rint('truth', 6)} AS truth FROM b_{m}") for n, m in ((1, "random"), (2, "block"))},
    "b3_score_carried": after("errors", f"SELECT channel, count(*) AS n, {rint(f'avg({ERR})', 4)} AS mae_locf, {rint('sqrt(avg((locf - truth) * (locf - truth)))', 4)} AS rmse_locf FROM errors GROUP BY channel"),
    "b4_pooled_carried": after("errors", f"SELECT CAST(sum(n) AS BIGINT) AS cells, {rint('sum(e / sd) / sum(n)', 4)} AS pooled_mae_locf, count(*) AS channels_tested FROM (SELECT count(*) AS n, CASE WHEN stddev_pop(truth) > 0 THEN stddev_pop(truth) ELSE 1.0 END AS sd, sum({ERR}) AS e FROM errors GROUP BY channel)"),
    "a2_range_assertions": after("cleaned", " UNION ALL ".join(f"SELECT '{c}_in_range' AS name, n = 0 AS passed, '0' AS expected, CAST(n AS VARCHAR) AS observed, 'allowed {lo}-{hi}' AS note FROM (SELECT count(*) FILTER (NOT {c} BETWEEN {lo} AND {hi}) AS n FROM cleaned)" for c, (lo, hi) in RG.items())),
    "a3_grid_assertions": after("hourly", "SELECT 'hours_not_doubled' AS name, n = 0 AS passed, '0' AS expected, CAST(n AS VARCHAR) AS observed, '' AS note FROM (SELECT count(*) - count(DISTINCT (admission_id, hour)) AS n FROM hourly) UNION ALL SELECT 'hours_without_gaps', w = k, 'all admissions', CAST(w AS VARCHAR) || '/' || CAST(k AS VARCHAR), '' FROM (SELECT count(*) FILTER (g) AS w, count(*) AS k FROM (SELECT count(DISTINCT hour) = date_diff('hour', min(hour), max(hour)) + 1 AS g FROM hourly GROUP BY admission_id))"),
    "a4_channel_assertions": after("vmd", " UNION ALL ".join(f"SELECT '{c}_{w}' AS name, n = 0 AS passed, '0' AS expected, CAST(n AS VARCHAR) AS observed, '' AS note FROM (SELECT count(*) FILTER (NOT coalesce({t}, false)) AS n FROM vmd)" for c in CH for w, t in (("values_present", f"{c}_value IS NOT NULL"), ("mask_is_0_or_1", f"{c}_mask IN (0, 1)"), ("decay_from_0_to_1", f"{c}_decay BETWEEN 0 AND 1")))),
    "a5_fabrication_assertions": after("refined", " UNION ALL ".join(f"SELECT '{c}_observed_values_unchanged' AS name, d < 1e-6 AS passed, '0 (exact)' AS expected, CAST(d AS VARCHAR) AS observed, '' AS note FROM (SELECT coalesce(max(abs({c}_refined - {c}_value)) FILTER ({c}_mask = 1), 0.0::DOUBLE) AS d FROM refined)" for c in CH)
        + f" UNION ALL SELECT 'refinement_reports_no_observed_change', n = 0, '0', CAST(n AS VARCHAR), '' FROM (SELECT count(*) FILTER ({cols(CH, '({0}_mask = 1 AND {0}_refined IS DISTINCT FROM {0}_value)', ' OR ')}) AS n FROM refined)"),
    "a1_table_assertions": after("cleaned", f"""SELECT * FROM (WITH o AS (SELECT (SELECT count(*) FROM cleaned) AS n, (SELECT count(*) FROM ev) AS kept, (SELECT count(DISTINCT admission_id) FROM cleaned) AS a, (SELECT count(DISTINCT admission_id) FROM raw) AS b,
      (SELECT min(length_of_stay_hours) FROM cleaned) AS stay, (SELECT CAST(sum(k - 1) AS BIGINT) FROM (SELECT count(*) AS k FROM cleaned GROUP BY {cols([*RAW, 'length_of_stay_hours'])})) AS twice)
      SELECT 'rows_kept_as_audited' AS name, n = kept AS passed, CAST(kept AS VARCHAR) AS expected, CAST(n AS VARCHAR) AS observed FROM o UNION ALL SELECT 'cleaned_rows_are_distinct', twice = 0, '0', CAST(twice AS VARCHAR) FROM o
      UNION ALL SELECT 'all_admissions_kept', a = b, CAST(b AS VARCHAR), CAST(a AS VARCHAR) FROM o UNION ALL SELECT 'stays_last_some_time', stay > 0, '> 0 hours', CAST(stay AS VARCHAR) FROM o)"""),
    "a3_gap_starts": after("bins", "SELECT admission_id, CAST(hour AS VARCHAR) AS hour, step_hours FROM (SELECT admission_id, hour, epoch(hour - lag(hour) OVER (PARTITION BY admission_id ORDER BY hour)) / 3600.0::DOUBLE AS step_hours FROM bins) WHERE step_hours <> 1"),
    "a8_recovery": after("ev", f"""SELECT * FROM (WITH i AS ({INJECTED_SQL.format(events='events')}), r AS (
      SELECT 'duplicate_rows' AS defect, (SELECT count(*) FROM raw) - (SELECT count(*) FROM ev) AS recovered UNION ALL SELECT 'fahrenheit_cells', count(*) FROM ev WHERE {path('temperature')} IN ({FROM_F})
      UNION ALL SELECT 'category_noise_cells', count(*) FROM ({audit_rows('ev')}) WHERE v IS DISTINCT FROM w)
      SELECT defect, injected, recovered, CASE WHEN injected > 0 THEN {rint('100.0::DOUBLE * recovered / injected', 1)} END AS pct FROM i JOIN r USING (defect))"""),
    "a10_plan": after("raw", f"""SELECT * FROM (SELECT 0 AS position, 'remove_duplicates' AS step, (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM raw GROUP BY {cols(RAW)})) AS evidence
      UNION ALL SELECT 2, 'convert_units', (SELECT count(*) FROM ({P4}))
      UNION ALL SELECT 3, 'standardise_categories', (SELECT count(*) FROM ({P7}))
      UNION ALL SELECT 4, 'validate_ranges', (SELECT CAST(sum(out_of_range + unparseable) AS BIGINT) FROM ({P6}))) WHERE evidence > 0
      UNION ALL SELECT * FROM (VALUES (1, 'standardise_datetimes', CAST(0 AS BIGINT)), (5, 'build_hourly_timeseries', 0), (6, 'build_value_mask_decay', 0), (7, 'refine_missing_values', 0))"""),
    "a6_verdict": after("united", "SELECT count(*) AS total, count(*) FILTER (n > 0) AS failed, coalesce(string_agg(name, ',' ORDER BY name) FILTER (n > 0), '') AS failed_names FROM (" + " UNION ALL ".join(f"SELECT '{c}_in_range' AS name, count(*) FILTER (NOT {c} BETWEEN {lo} AND {hi}) AS n FROM united" for c, (lo, hi) in RG.items()) + ")"),
    "a7_before_after_statistics": after("cleaned", " UNION ALL ".join(f"SELECT '{c}' AS channel, '{s}' AS stage, count(x) AS n, {rint('avg(x)', 9)} AS mean, {rint('stddev_pop(x)', 9)} AS sd, min(x) AS min, max(x) AS max FROM (SELECT {e} AS x FROM {t})" for c in CH for s, e, t in (("before", number(c), "ev"), ("after", c, "cleaned")))),
    "a7_record_counts": after("hourly", "SELECT 'raw' AS stage, count(*) AS records FROM raw UNION ALL SELECT 'cleaned', count(*) FROM cleaned UNION ALL SELECT 'hourly', count(*) FROM hourly"),
    "a7_observed_shares": after("vmd", " UNION ALL ".join(f"SELECT '{c}' AS channel, {rint(f'100.0::DOUBLE * avg({c}_mask)', 2)} AS observed_pct FROM vmd" for c in CH)),
    "n1_temperature_raw": after("raw", hist(f"SELECT {magnitude('temperature')} AS x FROM raw", 20, 120)),
    "n1_temperature_converted": after("united", hist("SELECT temperature AS x FROM united", 30, 45)),
    "n1_temperature_bands": after("raw", f"SELECT count(*) FILTER ({number('temperature')} BETWEEN 30 AND 45) AS celsius, count(*) FILTER ({number('temperature')} BETWEEN 90 AND 115) AS fahrenheit FROM raw"),
    "n2_observation_grid": after("vmd", grid_rows()),
    "n3_trajectory": after("refined", f"SELECT {K}, heart_rate_value AS value, heart_rate_mask AS mask, heart_rate_decay AS decay, heart_rate_refined AS refined FROM refined WHERE hours_since_admission < 48 AND admission_id = (SELECT admission_id FROM refined GROUP BY admission_id ORDER BY sum(heart_rate_mask) DESC, admission_id LIMIT 1)"),
    "n4_missing_by_stage": after("vmd", " UNION ALL ".join(f"SELECT '{c}' AS channel, (SELECT {rint(f'100.0::DOUBLE * avg(CAST({c} IS NULL AS DOUBLE))', 2)} FROM usable) AS raw, (SELECT {rint(f'100.0::DOUBLE * avg(CAST({c} IS NULL AS DOUBLE))', 2)} FROM hourly) AS hourly, (SELECT {rint(f'100.0::DOUBLE * avg(CAST({c}_value IS NULL AS DOUBLE))', 2)} FROM vmd) AS final" for c in CH)),
    "n6_order_ablation": after("ev", " UNION ALL ".join(f"SELECT '{c}' AS channel, count(*) FILTER ({converted(c)} BETWEEN {RG[c][0]} AND {RG[c][1]}) AS right_order, count(*) FILTER (TRY_CAST({c} AS DOUBLE) BETWEEN {RG[c][0]} AND {RG[c][1]}) AS wrong_order FROM ev" for c in CH)),
    "p3_stripped_spellings": after("raw", f"SELECT {spelling(strip('charttime'))} AS spelling, count(*) AS n FROM raw GROUP BY ALL"),
    "a10_concerns": after("raw", f"SELECT \"column\", missing_pct FROM ({profile_rows()}) WHERE missing_pct > 15.0"),
}
ORACLES["d4_dedup_audit"] = ORACLES["s3_write_report"]


def _type(stage: str, c: str, kind: str, suffix: str) -> str:
    return f"SELECT '{c}_{suffix}' AS name, coalesce((SELECT any_value(typeof({c})) FROM {stage}) LIKE '{kind}%', false) AS passed"


def _any(name: str, condition: str) -> str:
    return f"SELECT '{name}' AS name, {condition} AS passed"


_LOSS = f"SELECT count(*) FROM ({_audit}) WHERE observed_before >= 20 AND 1 - observed_after::DOUBLE / greatest(observed_before, 1) > 0.5"
ORACLES["a9_postconditions"] = after("refined", " UNION ALL ".join([
    _any("rows_are_distinct", f"(SELECT max(n) FROM (SELECT count(*) AS n FROM ev GROUP BY {cols(RAW)})) = 1"),
    *[_type("windowed", c, "TIMESTAMP", "is_timestamp") for c in TIMES],
    _any("windows_end_after_they_start", "(SELECT count(*) FROM windowed WHERE outtime <= intime) = 0"),
    _any("stay_is_positive", "(SELECT min(length_of_stay_hours) FROM windowed) > 0"),
    *[_type("united", c, "DOUBLE", "is_a_number") for c in ("temperature", "glucose", "sbp", "mbp")],
    _any("no_stray_fahrenheit", "(SELECT count(*) FROM united WHERE temperature BETWEEN 90 AND 115) = 0"),
    _any("categories_all_known", "(SELECT count(*) FROM united WHERE " + " OR ".join(f"({unknown(c)})" for c in VOC) + ") = 0"),
    _any("all_values_in_range", "(SELECT count(*) FROM cleaned WHERE " + " OR ".join(f"NOT {c} BETWEEN {lo} AND {hi}" for c, (lo, hi) in RG.items()) + ") = 0"),
    _any("no_column_lost_most_values", f"({_LOSS}) = 0"),
    _any("hours_not_doubled", "(SELECT count(*) - count(DISTINCT (admission_id, hour)) FROM hourly) = 0"),
    _any("hours_without_gaps", "(SELECT bool_and(g) FROM (SELECT count(DISTINCT hour) = date_diff('hour', min(hour), max(hour)) + 1 AS g FROM hourly GROUP BY admission_id))"),
    _any("grid_has_more_rows", "(SELECT count(*) FROM hourly) > (SELECT count(*) FROM usable)"),
    *[_any(f"{c}_{w}", f"(SELECT count(*) FROM vmd WHERE NOT coalesce({t}, false)) = 0") for c in CH for w, t in (("values_present", f"{c}_value IS NOT NULL"), ("mask_is_0_or_1", f"{c}_mask IN (0, 1)"), ("decay_from_0_to_1", f"{c}_decay BETWEEN 0 AND 1"))],
    _any("neutral_fill_is_zero", "(SELECT coalesce(max(w), 0) FROM (" + " UNION ALL ".join(f"SELECT max(abs({c}_z)) AS w FROM std WHERE {c}_fill_kind = 'neutral_fill'" for c in CH) + ")) < 0.01"),
    _any("observed_cells_unchanged", f"(SELECT count(*) FROM refined WHERE {cols(CH, '({0}_mask = 1 AND {0}_refined IS DISTINCT FROM {0}_value)', ' OR ')}) = 0"),
]))

_ALL = " UNION ALL ".join(f"SELECT name, passed FROM ({ORACLES[q]})" for q in ("a1_table_assertions", "a2_range_assertions", "a3_grid_assertions", "a4_channel_assertions", "a5_fabrication_assertions"))
ORACLES["s3_report_of_a_run"] = _ALL
ORACLES["a11_run"] = f"SELECT count(*) AS total, count(*) FILTER (NOT passed) AS failed, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT passed), '') AS failed_names FROM ({_ALL})"

# Twins of what runs on texts before units and forms are settled
_raw_states = per(RG, "SELECT row_index, admission_id, charttime, '{c}' AS \"column\", {c} AS value, TRY_CAST({c} AS DOUBLE) AS x FROM ev")
_BAD = f"CASE WHEN value IS NULL THEN NULL WHEN x IS NULL OR isnan(x) THEN 'unparseable' WHEN NOT x BETWEEN {BOUNDS[0]} AND {BOUNDS[1]} THEN 'out_of_range' ELSE 'plausible' END"
ORACLES["r2_range_audit_of_texts"] = after("ev", f"""SELECT "column", count(*) FILTER (state IN ('out_of_range', 'unparseable')) AS rejected, count(*) FILTER (state = 'out_of_range') AS out_of_range, count(*) FILTER (state = 'unparseable') AS unparseable,
 count(state) AS observed_before, count(*) FILTER (state = 'plausible') AS observed_after, count(*) AS total FROM (SELECT "column", {_BAD} AS state FROM ({_raw_states})) GROUP BY "column" """)
ORACLES["r3_rejections_of_texts"] = after("ev", f"SELECT row_index, admission_id, charttime, \"column\", value, state AS reason FROM (SELECT *, {_BAD} AS state FROM ({_raw_states})) WHERE state IN ('out_of_range', 'unparseable')")
_dotted = lambda c: f"regexp_replace({c}, '^(\\d\\d)/(\\d\\d)/(\\d{{4}})', '\\1.\\2.\\3')"
ORACLES["t3_parse_audit_of_other_forms"] = after("parsed", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT s) FILTER (s <> 'Unrecognised') AS spellings, count(*) FILTER (s = 'Unrecognised' AND t IS NOT NULL) AS fallback_parsed, count(*) FILTER (t IS NULL) AS unparseable
    FROM (SELECT {spelling('x')} AS s, coalesce({instant('x')}, CASE WHEN {spelling('x')} = 'Unrecognised' THEN try_strptime(x, '%d.%m.%Y %H:%M') END) AS t FROM (SELECT {strip(_dotted(c))} AS x FROM ev WHERE {c} IS NOT NULL))""" for c in TIMES))
ORACLES["h3_align_in_place"] = ORACLES["h3_align"]
ORACLES["t2_parse_tolerantly"] = ORACLES["t2_parse_with_fallback"]
ORACLES["s1_line_numbers"] = after("raw", "SELECT row_number() OVER (ORDER BY row_index) - 1 AS row_index, row_index AS written FROM raw")
ORACLES["p1_profile_of_dictionary"] = ORACLES["p1_column_profile"]
ORACLES["p8_exact_medians"] = after("raw", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {rint(f'median({number(c)})', 2)} AS median FROM raw" for c in CH))
ORACLES["v8_serve"] = after("refined", f"SELECT {K}, {', '.join(f'{c}_z, {c}_refined_z' for c in CH)} FROM refined")
_tokens = "SELECT \"column\", token, n FROM (" + P4 + ")"
ORACLES["a10_evidence"] = after("raw", f"""SELECT 'remove_duplicates' AS step, CAST(NULL AS VARCHAR) AS "column", n AS evidence, 'rows equal to an earlier one' AS detail FROM (SELECT CAST(sum(k - 1) AS BIGINT) AS n FROM (SELECT count(*) AS k FROM raw GROUP BY {cols(RAW)})) WHERE n > 0
  UNION ALL SELECT 'convert_units', "column", CAST(sum(n) AS BIGINT), string_agg(token, ', ' ORDER BY token) FROM ({_tokens}) GROUP BY "column"
  UNION ALL SELECT 'standardise_categories', "column", distinct_raw, CAST(distinct_raw AS VARCHAR) || ' spellings of ' || CAST(distinct_casefold AS VARCHAR) FROM ({P7})
  UNION ALL SELECT 'validate_ranges', "column", out_of_range + unparseable, 'outside ' || CAST(low AS VARCHAR) || ' to ' || CAST(high AS VARCHAR) FROM ({P6})""")

ORACLES["h5_from_buckets"] = ORACLES["h5_hours_since_admission"]
_md5 = f"md5('{SEED}|' || channel || '|' || admission_id || '|' || CAST(pos AS VARCHAR))"
_least = {
    "random": f"SELECT *, {_md5} AS h FROM cells",
    "block": f"SELECT * EXCLUDE (s), min(s) OVER {SERIES} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS h FROM (SELECT *, CASE WHEN row_number() OVER {SERIES}) + 2 <= count(*) OVER (PARTITION BY admission_id, channel) THEN {_md5} END AS s FROM cells)",
}
for _n, _m in ((1, "random"), (2, "block")):
    ORACLES[f"b{_n}_exact_holdout"] = after("cells", f"""SELECT admission_id, CAST(pos AS INTEGER) AS hours_since_admission, channel, {rint('truth', 6)} AS truth FROM (
      SELECT *, rank() OVER (PARTITION BY channel ORDER BY h NULLS LAST) AS nth, count(*) OVER (PARTITION BY channel) AS n FROM ({_least[_m]})) WHERE h IS NOT NULL AND nth <= floor({config.HOLDOUT_FRACTION}::DOUBLE * n + 0.5)""")


# The fit: hidden cells, their features, X'X in long form, and Gauss-Jordan elimination, a column a step
SIZE = len(design(CH[0]))


def fit_ctes(hourly: str, std: str, tag: str) -> list[tuple[str, str]]:
    """``examples``: features and standardised truth of the cells hidden in ``hourly``; ``matrix``: X'X plus the ridge, and X'y as a last column."""
    cells = f"cells{tag}"
    examples = " UNION ALL ".join(
        f"SELECT '{c}' AS channel, row_number() OVER () AS id, [{', '.join(f'({x})::DOUBLE' for x in design(c))}] AS x, {rint(f'({rint("truth", 3)} - mu) / sd', 4)} AS y FROM hidden{tag} JOIN std{tag} ON std{tag}.admission_id = hidden{tag}.admission_id AND hours_since_admission = pos, (SELECT any_value({c}_mu) AS mu, any_value({c}_sd) AS sd FROM {std}) WHERE channel = '{c}'"
        for c in CH)
    return [
        (cells, per(CH, "SELECT admission_id, pos, '{c}' AS channel, {c} AS truth FROM " + hourly + " WHERE {c} IS NOT NULL")),
        (f"hidden{tag}", f"SELECT * FROM {cells} WHERE {drawn(config.MASK_FRACTION, SEED + 1)} AND channel IN (SELECT channel FROM {cells} GROUP BY channel HAVING count(*) >= 40)"),
        (f"flags{tag}", f"SELECT admission_id, pos, {cols(CH, "bool_or(channel = '{0}') AS h_{0}")} FROM hidden{tag} GROUP BY ALL"),
        (f"left{tag}", f"SELECT {hourly}.* REPLACE ({cols(CH, 'CASE WHEN h_{0} THEN NULL ELSE {0} END AS {0}')}) FROM {hourly} LEFT JOIN flags{tag} USING (admission_id, pos)"),
        *vmd_ctes(f"left{tag}", tag),
        (f"examples{tag}", examples),
        (f"long{tag}", f"SELECT channel, id, y, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM examples{tag}"),
        (f"entries{tag}", f"SELECT a.channel, a.i, b.i AS j, sum(a.v * b.v) + CASE WHEN a.i = b.i THEN 1.0 ELSE 0.0 END AS v FROM long{tag} a JOIN long{tag} b ON a.channel = b.channel AND a.id = b.id GROUP BY a.channel, a.i, b.i UNION ALL SELECT channel, i, {SIZE + 1}, sum(v * y) FROM long{tag} GROUP BY channel, i"),
        (f"matrix{tag}", f"SELECT channel, list(r ORDER BY i) AS m FROM (SELECT channel, i, list(v ORDER BY j) AS r FROM entries{tag} GROUP BY channel, i) GROUP BY channel"),
    ]


def solved(tag: str) -> str:
    """(channel, w): the weights of channels with enough rows."""
    return f"""SELECT * FROM (WITH RECURSIVE steps AS (
      SELECT channel, 1 AS k, m FROM matrix{tag} WHERE channel IN (SELECT channel FROM examples{tag} GROUP BY channel HAVING count(*) >= 30)
      UNION ALL SELECT channel, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN p ELSE list_transform(r, lambda v, j: v - r[k] * p[j]) END)
      FROM (SELECT channel, k, m, list_transform(m[k], lambda v: v / m[k][k]) AS p FROM steps WHERE k <= {SIZE})
    ) SELECT channel, list_transform(m, lambda r: r[{SIZE + 1}]) AS w FROM steps WHERE k = {SIZE + 1})"""


CTES += [*fit_ctes("hourly", "std", "_f"), ("weights_f", solved("_f")), *fit_ctes("b_left", "std_b", "_g"), ("weights_g", solved("_g"))]
CTES += [("refined_errors", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS channel, truth, {c}_value AS locf, {rint(f'({c}_decay * {c}_z + (1.0 - {c}_decay) * coalesce(list_dot_product([{", ".join(f"({x})::DOUBLE" for x in design(c))}], w), {c}_z)) * {c}_sd + {c}_mu', 3)} AS refined
    FROM b_block JOIN std_b ON std_b.admission_id = b_block.admission_id AND hours_since_admission = pos LEFT JOIN weights_g ON weights_g.channel = '{c}' WHERE b_block.channel = '{c}'""" for c in CH) + ")")]
ORACLES["f4_fit_refiner"] = after("weights_f", f"""SELECT e.channel, count(*) AS rows, {SIZE} AS n_features, {rint('1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*))', 4)} AS r2, list_transform(any_value(w), lambda v: {rint('v', 4)} + 0.0) AS weights
  FROM (SELECT channel, y, w, list_dot_product(x, w) AS p FROM examples_f JOIN weights_f USING (channel)) e GROUP BY e.channel""")
_score = f"""SELECT channel, n, mae_locf, mae_refined, rmse_locf, rmse_refined, CASE WHEN mae_locf > 0 THEN {rint('100.0::DOUBLE * (mae_locf - mae_refined) / mae_locf', 2)} END AS improvement_pct FROM (
  SELECT channel, count(*) AS n, {', '.join(f"{rint(f'avg(abs({m} - truth))', 4)} AS mae_{m}, {rint(f'sqrt(avg(({m} - truth) * ({m} - truth)))', 4)} AS rmse_{m}" for m in ('locf', 'refined'))} FROM refined_errors GROUP BY channel)"""
ORACLES["b3_score_refined"] = ORACLES["n5_ranked_channels"] = after("refined_errors", _score)
ORACLES["b4_pooled_refined"] = after("refined_errors", f"""SELECT CAST(sum(n) AS BIGINT) AS cells, {', '.join(f"{rint(f'sum({m} / sd) / sum(n)', 4)} AS pooled_mae_{m}" for m in ('locf', 'refined'))}, count(*) FILTER (refined < locf) AS channels_improved, count(*) AS channels_tested FROM (
  SELECT count(*) AS n, CASE WHEN stddev_pop(truth) > 0 THEN stddev_pop(truth) ELSE 1.0 END AS sd, sum(abs(locf - truth)) AS locf, sum(abs(refined - truth)) AS refined FROM refined_errors GROUP BY channel)""")

# Types as the twin's own chain gives them, by their names in Spark
_NAMES = {"VARCHAR": "string", "DOUBLE": "double", "TIMESTAMP": "timestamp_ntz", "INTEGER": "int", "BIGINT": "bigint"}
_dtype = "CASE any_value(typeof({0})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items()) + " ELSE any_value(typeof({0})) END"
ORACLES["a7_schema"] = after("hourly", " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", {_dtype.format(x)} AS dtype, count({x}) AS observed FROM hourly"
    for i, (c, x) in enumerate([*((c, c) for c in ("hour", "admission_id", *CH, *STATIC)), ("hours_since_admission", "CAST(pos AS INTEGER)")])))

# The trace of a run: the steps of the plan, each checked once, with what its claims say (a job whose claims failed would have halted or gone on to a second check)
_CLAIMS = {
    "remove_duplicates": ("rows_are_distinct",),
    "standardise_datetimes": ("is_timestamp", "windows_end_after_they_start", "stay_is_positive"),
    "convert_units": ("is_a_number", "no_stray_fahrenheit"),
    "standardise_categories": ("categories_all_known",),
    "validate_ranges": ("all_values_in_range", "no_column_lost_most_values"),
    "build_hourly_timeseries": ("hours_not_doubled", "hours_without_gaps", "grid_has_more_rows"),
    "build_value_mask_decay": ("values_present", "mask_is_0_or_1", "decay_from_0_to_1", "neutral_fill_is_zero"),
    "refine_missing_values": ("observed_cells_unchanged",),
}
_hospice = "count(*) FILTER (" + " OR ".join(f"({unknown(c)}" + (f" AND lower({strip(c)}) <> 'hospice'" if c == "admission_type" else "") + ")" for c in VOC) + ")"
_claims = f"SELECT name, passed FROM ({ORACLES['a9_postconditions']}) WHERE name <> 'categories_all_known' UNION ALL SELECT 'categories_all_known', n = 0 FROM ({after('united', f'SELECT {_hospice} AS n FROM united')})"
_step_of = "CASE " + " ".join(f"WHEN ends_with(name, '{n}') THEN '{s}'" for s, names in _CLAIMS.items() for n in names) + " END"
ORACLES["a11_trace"] = f"""SELECT CAST(p.position AS INTEGER) AS position, p.step, 1 AS attempt, c.passed, coalesce(c.failed, '') AS failed FROM ({ORACLES['a10_plan']}) p
  JOIN (SELECT {_step_of} AS step, bool_and(passed) AS passed, string_agg(name, '; ' ORDER BY name) FILTER (NOT passed) AS failed FROM ({_claims}) GROUP BY 1) c ON c.step = p.step"""
