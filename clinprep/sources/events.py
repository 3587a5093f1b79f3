"""Reading the raw event text table, and writing tables and reports.

``raw_events`` derives the 24-column text table, with its defects, from the driver's ``events`` by one SQL text that
other engines can run as well.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinprep import config
from clinprep.sources.shared import FILE_ROWS, SPREAD_EVENTS, UNSORTED_PARTS, compiled_methods, spread, store, store_bucketed


def _t(x: str) -> str:
    """A number kept in tenths, written with one decimal."""
    return f"CAST(CAST(floor(({x}) / 10) AS BIGINT) AS STRING) || '.' || CAST(({x}) % 10 AS STRING)"


def _pad(x: str) -> str:
    return f"lpad(CAST({x} AS STRING), 2, '0')"


def _id(x: str, width: int) -> str:
    """A number with leading zeros up to ``width``; lpad alone would cut a longer one."""
    return f"lpad(CAST({x} AS STRING), CAST(greatest({width}, length(CAST({x} AS STRING))) AS INT), '0')"


def _stamp(form: str, day: str, hour: str, minute: str) -> str:
    y, m, d = f"CAST(year({day}) AS STRING)", _pad(f"month({day})"), _pad(f"day({day})")
    clock = f"{_pad(hour)} || ':' || {_pad(minute)}"
    name = f"substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month({day}) * 3 - 2 AS INT), 3)"
    return (
        f"CASE {form} WHEN 0 THEN {y} || '-' || {m} || '-' || {d} || ' ' || {clock} WHEN 1 THEN {y} || '/' || {m} || '/' || {d} || ' ' || {clock} "
        f"WHEN 2 THEN {d} || '/' || {m} || '/' || {y} || ' ' || {clock} ELSE {name} || ' ' || {d} || ' ' || {y} || ' ' || {clock} END"
    )


def _case(*rules: tuple[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in rules) + f" ELSE {otherwise} END"


_F, _MMOL = "(CAST(floor(temp * 9 / 5) AS BIGINT) + 320)", "CAST(floor(glu * 10 / 180) AS BIGINT)"
_TEMPERATURE = _case(("e % 7 = 0", "NULL"), ("e % 41 = 1", "'61.0 C'"), ("e % 5 IN (1, 3)", f"{_t(_F)} || CASE WHEN e % 11 = 0 THEN '' ELSE ' F' END"), otherwise=f"{_t('temp')} || CASE WHEN e % 11 = 0 THEN '' ELSE ' C' END")

_COLUMNS = {
    "admission_id": f"'ADM' || {_id('u', 5)} || '-' || {_id('s', 2)}",
    "patient_id": f"'P' || {_id('u', 5)}",
    "intime": _stamp("fi", "ind", "inh", "inm"),
    "outtime": _stamp("fi", "outd", "outh", "0"),
    "charttime": _case(("e % 211 = 0", "'not recorded'"), ("e % 223 = 0", f"{_stamp('0', 'cd', 'ch', 'cm')} || ':30'"), otherwise=_stamp("fc", "cd", "ch", "cm")),
    "age": _case(("e % 20 = 0", "NULL"), ("e % 67 = 1", "'unknown'"), ("e % 71 = 1", "'150.0'"), otherwise="CAST(19 + u % 73 AS STRING) || '.0'"),
    "gender": _case(("u % 2 = 0 AND e % 6 = 0", "'M'"), ("u % 2 = 0 AND e % 6 = 1", "'male'"), ("u % 2 = 0", "'Male'"), ("e % 6 = 0", "'f'"), ("e % 6 = 1", "'FEMALE'"), otherwise="'Female'"),
    "ethnicity": _case(("u % 3 = 0 AND e % 5 = 0", "'AA'"), ("u % 3 = 0", "'African-American'"), ("u % 3 = 1 AND e % 5 = 0", "' african'"), ("u % 3 = 1", "'African'"), otherwise="'Other'"),
    "heart_rate": _case(("e % 7 = 0", "NULL"), ("e % 43 = 1", "'480.0'"), otherwise=_t("hr")),
    "sbp": _case(("e % 5 = 0", "NULL"), ("e % 47 = 1", "'340.0'"), ("e % 8 = 2", f"{_t('sbp')} || ' mmHg'"), otherwise=_t("sbp")),
    "dbp": _case(("e % 5 = 0", "NULL"), ("e % 53 = 1", "'210.0'"), otherwise=_t("dbp")),
    "mbp": _case(("e % 7 = 0", "NULL"), ("e % 59 = 1", "'8.0'"), ("e % 8 = 3", f"{_t('mbp')} || ' mmHg'"), otherwise=_t("mbp")),
    "temperature": _TEMPERATURE,
    "spo2": _case(("e % 10 = 0", "NULL"), ("e % 61 = 1", "'118.0'"), otherwise=_t("spo2")),
    "resp_rate": _case(("e % 7 = 0", "NULL"), ("e % 73 = 1", "'95.0'"), otherwise=_t("rr")),
    "glucose": _case(("e % 5 = 0", "NULL"), ("e % 79 = 1", "'1200.0'"), ("e % 8 = 5", f"{_t(_MMOL)} || ' mmol/L'"), ("e % 8 = 6", _t(_MMOL)), otherwise=_t("glu")),
    "creatinine": _case(("e % 5 = 0", "NULL"), ("e % 83 = 1", "'99.0'"), otherwise=_t("cr")),
    "wbc_count": _case(("e % 4 = 0", "NULL"), ("e % 89 = 1", "'0.0'"), otherwise=_t("wbc")),
    "platelet_count": _case(("e % 7 = 0", "NULL"), ("e % 101 = 1", "'2.0'"), otherwise=_t("plt")),
    "admission_type": _case(("u % 4 = 0 AND e % 4 = 0", "'ER'"), ("u % 4 = 0 AND e % 4 = 1", "' emergency'"), ("u % 4 = 0", "'Emergency'"), ("u % 4 = 1 AND e % 4 = 0", "'ICU transfer'"), ("u % 4 = 1", "'ICU'"), ("u % 4 = 2 AND e % 50 = 7", "'hospice'"), ("u % 4 = 2", "'Ward'"), otherwise="'outpatient'"),
    "diagnosis": _case(("sev = 4 AND e % 4 = 0", "'SEPSIS'"), ("sev = 4", "'Sepsis'"), ("sev = 3 AND e % 4 = 0", "'Cardiac'"), ("sev = 3", "'Cardiac Failure'"), ("sev = 2", "'Pneumonia'"), ("sev = 1", "'trauma'"), otherwise="'Stroke'"),
    "medication": "CASE e % 6 WHEN 0 THEN 'NO MEDICATION' WHEN 1 THEN 'none' WHEN 2 THEN 'antibiotic' WHEN 3 THEN 'Insulin' WHEN 4 THEN 'Vasopressor' ELSE 'sedative' END",
    "sofa_score": _case(("e % 10 = 0", "NULL"), otherwise="CAST(4 + 3 * sev AS STRING) || '.0'"),
    "data_source": "CASE e % 4 WHEN 0 THEN 'MONITOR' WHEN 1 THEN 'Lab' WHEN 2 THEN 'Nurse entry' ELSE 'Laboratory' END",
}

#: Runs unchanged in Spark and DuckDB; {events} is the table.
RAW_SQL = f"""
WITH f0 AS (
  SELECT CAST(event_id AS BIGINT) AS e, CAST(user_id AS BIGINT) AS u, CAST(floor((dayofyear(ts) - 1) / 3) AS BIGINT) AS s,
         CAST(ts AS DATE) AS cd, CAST(hour(ts) AS BIGINT) AS ch, CAST(minute(ts) AS BIGINT) AS cm FROM {{events}}
), f1 AS (
  SELECT *, (u * 7 + s) % 5 AS sev, DATE '2024-01-01' + CAST(3 * s AS INT) AS ind, u % 6 AS inh, CASE WHEN e % 97 = 0 THEN 30 ELSE 0 END AS inm,
         DATE '2024-01-01' + CAST(3 * s + 2 AS INT) AS outd, 20 - u % 5 AS outh, (u + s) % 4 AS fi, e % 4 AS fc FROM f0
), f2 AS (
  SELECT *, 700 + 60 * sev + (37 * e) % 80 AS hr, 1350 - 50 * sev + (29 * e) % 120 AS sbp, 366 + 3 * sev + (13 * e) % 9 AS temp, 985 - 11 * sev + (17 * e) % 15 AS spo2,
         140 + 20 * sev + (19 * e) % 30 AS rr, 1000 + 90 * sev + (23 * e) % 200 AS glu, 8 + 3 * sev + (5 * e) % 4 AS cr, 70 + 15 * sev + (11 * e) % 20 AS wbc,
         2600 - 180 * sev + (31 * e) % 300 AS plt FROM f1
), f3 AS (
  SELECT *, CAST(floor(sbp * 62 / 100) AS BIGINT) + (3 * e) % 20 AS dbp, CAST(floor(sbp * 75 / 100) AS BIGINT) + (7 * e) % 20 AS mbp FROM f2
), f4 AS (
  SELECT e AS row_index, {", ".join(f"{expression} AS {name}" for name, expression in _COLUMNS.items())} FROM f3
)
SELECT * FROM f4 UNION ALL SELECT (SELECT greatest(100000000, max(e) + 1) FROM f0) + row_index AS row_index, {", ".join(_COLUMNS)} FROM f4 WHERE row_index % 10 = 3
"""


#: What the rules above put in, by defect; from the numbers of the events alone.
_NOISE = [
    "e % 6 IN (0, 1)",  # gender
    "u % 3 IN (0, 1) AND e % 5 = 0",  # ethnicity
    "u % 4 = 3 OR u % 4 = 0 AND e % 4 IN (0, 1) OR u % 4 = 1 AND e % 4 = 0",  # admission type
    "sev = 1 OR sev IN (3, 4) AND e % 4 = 0",  # diagnosis
    "e % 6 IN (0, 1, 2, 5)",  # medication
    "e % 4 <> 3",  # data source
]
INJECTED_SQL = f"""
WITH f0 AS (
  SELECT CAST(event_id AS BIGINT) AS e, CAST(user_id AS BIGINT) AS u, (CAST(user_id AS BIGINT) * 7 + CAST(floor((dayofyear(ts) - 1) / 3) AS BIGINT)) % 5 AS sev FROM {{events}}
)
SELECT 'duplicate_rows' AS defect, CAST(coalesce(sum(CASE WHEN e % 10 = 3 THEN 1 ELSE 0 END), 0) AS BIGINT) AS injected FROM f0
UNION ALL SELECT 'fahrenheit_cells', CAST(coalesce(sum(CASE WHEN e % 7 <> 0 AND e % 41 <> 1 AND e % 5 IN (1, 3) THEN 1 ELSE 0 END), 0) AS BIGINT) FROM f0
UNION ALL SELECT 'category_noise_cells', CAST(coalesce(sum({" + ".join(f"CASE WHEN {rule} THEN 1 ELSE 0 END" for rule in _NOISE)}), 0) AS BIGINT) FROM f0
"""


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(defect, injected): the truth that a recovery of raw_events is held against."""
    return spark.sql(INJECTED_SQL, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    compiled_methods(spark)
    return spark.sql(RAW_SQL, events=_dealt(spark.read.parquet(f"{sf_dir}/events.parquet")))


def _dealt(events: DataFrame) -> DataFrame:
    """The columns that the raw table is made of. A file of few row groups is read by few tasks, so they are dealt out before they become wide
    texts. Where tasks that do so would hold them in memory, they are written in files of few rows first: parts of the given file are cut by
    bytes, and hold any number of rows."""
    columns = events.select("event_id", "user_id", "ts")
    n = columns.count()
    if n > UNSORTED_PARTS * SPREAD_EVENTS:
        columns = store(columns, "narrow-events", file_rows=FILE_ROWS)
    return spread(columns, "event_id", rows=SPREAD_EVENTS, n=n)


RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in config.RAW_COLUMNS])


#: Parts of files whose first line numbers are broadcast; beyond, rows are shuffled to meet them.
BROADCAST_PARTS = 1_000_000


def read_events(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """A CSV of events, every column as text, with ``row_index``: the place of the row in the files, from 0, headers not counted.

    Files follow one another by name, and files may be read in parts: a first pass counts the rows of each part, and the sums of the parts
    before it give its first number. For one file that is the line that a log of dropped rows points to.
    """
    compiled_methods(spark)
    rows = spark.read.schema(RAW_SCHEMA).option("header", header).csv(path)
    numbered = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    # a part is read by one task from its first row to its last, so its ids have no gaps
    parts = store(numbered.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "file-parts")
    found = parts.orderBy("file", "block").select("file", "block", "first", "n").toArrow()  # a row for each part of a file
    n = found.column("n").to_numpy()
    starts = spark.createDataFrame(found.append_column("start", pa.array(n.cumsum() - n)).drop_columns(["n"]))
    joined = numbered.join(F.broadcast(starts) if len(n) <= BROADCAST_PARTS else starts, ["file", "block"])
    return joined.select(*rows.columns, (F.col("start") + F.col("id") - F.col("first")).alias("row_index"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", key: str | None = "admission_id") -> None:
    """The rows of an admission go to one task, so a reader finds them in one file."""
    if key in df.columns:
        df = df.repartition(key)
    writer = df.write.mode("overwrite")
    if fmt == "csv":  # texts are kept as they stand, blanks at their ends included
        writer = writer.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    writer.format(fmt).save(path)


def store_by_admission(df: DataFrame, buckets: int) -> DataFrame:
    """S2 for what comes after: events in hash buckets of their admission, so that bins and windows of an admission need no shuffle."""
    return store_bucketed(df.repartition(buckets, "admission_id"), "events", "admission_id", buckets)[0]


def write_report(audits: dict[str, DataFrame], path: str) -> None:
    """S3: one JSON table for each audit."""
    for name, audit in audits.items():
        audit.write.mode("overwrite").json(f"{path}/{name}")
