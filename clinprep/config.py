"""Names, ranges and vocabularies of the clinical event tables."""

from __future__ import annotations

# Column names, plausible ranges and vocabularies are part of the data's semantics.
ADMISSION_COLUMNS = ["admission_id", "patient_id", "intime", "outtime", "charttime"]
TIME_COLUMNS = ["intime", "outtime", "charttime"]
DEMOGRAPHIC_COLUMNS = ["age", "gender", "ethnicity"]
CHANNELS = ["heart_rate", "sbp", "dbp", "mbp", "temperature", "spo2", "resp_rate", "glucose"]
LAB_COLUMNS = ["creatinine", "wbc_count", "platelet_count"]
CONTEXT_COLUMNS = ["admission_type", "diagnosis", "medication", "sofa_score", "data_source"]
RAW_COLUMNS = ADMISSION_COLUMNS + DEMOGRAPHIC_COLUMNS + CHANNELS + LAB_COLUMNS + CONTEXT_COLUMNS

RANGES = {
    "age": (0.0, 120.0),
    "heart_rate": (20.0, 250.0),
    "sbp": (50.0, 250.0),
    "dbp": (20.0, 150.0),
    "mbp": (30.0, 180.0),
    "temperature": (30.0, 43.0),
    "spo2": (50.0, 100.0),
    "resp_rate": (4.0, 60.0),
    "glucose": (20.0, 600.0),
    "creatinine": (0.1, 15.0),
    "wbc_count": (0.5, 60.0),
    "platelet_count": (5.0, 800.0),
    "sofa_score": (0.0, 24.0),
}

VOCABULARIES = {
    "gender": {"m": "Male", "male": "Male", "f": "Female", "female": "Female"},
    "ethnicity": {"african": "African", "aa": "African-American", "african-american": "African-American", "african american": "African-American", "other": "Other"},
    "admission_type": {"er": "Emergency", "emergency": "Emergency", "emergency admission": "Emergency", "icu": "ICU", "icu transfer": "ICU", "ward": "Ward", "outpatient": "Outpatient"},
    "diagnosis": {"sepsis": "Sepsis", "pneumonia": "Pneumonia", "trauma": "Trauma", "stroke": "Stroke", "cardiac failure": "Cardiac Failure", "cardiac": "Cardiac Failure"},
    "medication": {"no medication": "No Medication", "none": "No Medication", "antibiotic": "Antibiotic", "insulin": "Insulin", "vasopressor": "Vasopressor", "sedative": "Sedative"},
    "data_source": {"monitor": "Monitor", "nurse entry": "Nurse Entry", "laboratory": "Laboratory", "lab": "Laboratory"},
}

#: Attributes that hold for a whole stay.
STATIC_COLUMNS = ["patient_id", "gender", "ethnicity", "age", "admission_type", "diagnosis", "medication", "sofa_score", "length_of_stay_hours"]

SPELLINGS = [
    ("ISO (YYYY-MM-DD HH:MM)", r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}"),
    ("Slash ISO (YYYY/MM/DD HH:MM)", r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}"),
    ("Day-first (DD/MM/YYYY HH:MM)", r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}"),
    ("Month name (Mon DD YYYY HH:MM)", r"^[A-Za-z]{3} \d{2} \d{4} \d{2}:\d{2}"),
]
UNRECOGNISED = "Unrecognised"

#: A cell that is a number and at most a unit; the unit behind a number.
MEASUREMENT = r"^\s*(-?\d+(?:\.\d+)?)\s*([A-Za-z/%°]*)\s*$"
UNIT_SUFFIX = r"^\s*-?\d+(?:\.\d+)?\s*([A-Za-z/%°]+)\s*$"

MG_PER_MMOL = 18.0182
FAHRENHEIT_BAND = (77.0, 113.0)
MMOL_BAND = (1.0, 35.0)
STRAY_FAHRENHEIT_BAND = (90.0, 115.0)
#: Ways that a cell goes when units are settled, by what it says and what is inferred of a bare number.
PATHS = {
    "fahrenheit": "fahrenheit_explicit",
    "celsius": "celsius_explicit",
    "likely_fahrenheit": "inferred_fahrenheit",
    "bare_temperature": "unitless_kept_as_celsius",
    "mmol": "mmol_per_l_explicit",
    "mg": "mg_per_dl_explicit",
    "likely_mmol": "inferred_mmol_per_l",
    "bare_glucose": "bare_mg_per_dl",
    "suffix": "suffix_stripped",
    "bare": "bare_number",
    "unparseable": "unparseable",
}
UNIT_COLUMNS = ["temperature", "glucose", "sbp", "dbp", "mbp", "heart_rate", "spo2", "resp_rate", "creatinine", "wbc_count", "platelet_count", "age", "sofa_score"]

DECAY_BASE = 0.75
MAX_HOURS = 336
HOLDOUT_FRACTION = 0.15
MASK_FRACTION = 0.25
SEED = 2026
MAX_CHANNEL_LOSS = 0.5
MIN_OBSERVATIONS = 20

STEPS = [
    "remove_duplicates",
    "standardise_datetimes",
    "convert_units",
    "standardise_categories",
    "validate_ranges",
    "build_hourly_timeseries",
    "build_value_mask_decay",
    "refine_missing_values",
]
# End of fixed values.
