"""Cleaning: column expressions and schema decisions for raw flow records."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings that mean "missing", and label spellings that mean "benign".
MISSING = ("", "-", "nan", "none", "null", "nat")
BENIGN = ("0", "benign", "normal", "no", "false")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
# Column names that are never features, lower-cased, as flow tables spell them.
NOT_FEATURES = frozenset({
    "label", "label_full", "label1", "label2", "label3", "label4", "id", "type", "class", "flow id", "source ip", "destination ip", "src ip", "dst ip",
    "timestamp", "timestamp_start", "timestamp_end", "date", "time", "device_name", "device_mac",
})
#: Columns that with_provenance() and the splits add.
OWN_COLUMNS = frozenset({"source_file", "source_day", "row_index", "line", "split_role"})
# Label columns in order of preference, per data set; and other names of the data sets.
LABEL_COLUMNS = {"generic": ("label", "label1", "type", "class"), "swat": ("label1", "label", "type"), "ton_iot": ("label", "type"), "cicids2017": ("label",)}
DATASET_NAMES = {"cicids": "cicids2017", "cicids_2017": "cicids2017", "cic_ids_2017": "cicids2017", "unsw": "unsw_nb15", "unsw15": "unsw_nb15", "ton": "ton_iot", "toniot": "ton_iot", "ton_lot": "ton_iot"}
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def finite(c: Column) -> Column:
    """c, null where it is NaN or infinite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), c)


def _floating(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]


def drop_nonfinite_rows(df: DataFrame) -> DataFrame:
    """Rows without a null, NaN or infinity in any column."""
    return df.withColumns({c: finite(F.col(f"`{c}`")) for c in _floating(df)}).na.drop("any")


def zero_fill_nonfinite(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.withColumns({c: F.coalesce(finite(F.col(f"`{c}`")), F.lit(0.0)) for c in (cols or _floating(df))})


def clean_names(names: Iterable[str]) -> list[str]:
    """Header names without padding and byte order mark."""
    return [n.replace("﻿", "").strip() for n in names]


def dataset_name(name: str) -> str:
    """A data set's usual name; unknown ones stay, lower-cased with underscores."""
    key = name.strip().lower().replace("-", "_")
    return DATASET_NAMES.get(key, key)


def pick_label_col(cols: Sequence[str], dataset: str = "generic", preferred: Sequence[str] | None = None) -> str:
    """The first preferred label column among cols, whatever its case and padding; an error if none is there. preferred replaces the data set's list."""
    by_lower = {c.strip().lower(): c for c in cols}
    for want in preferred or LABEL_COLUMNS.get(dataset_name(dataset), LABEL_COLUMNS["generic"]):
        if want.strip().lower() in by_lower:
            return by_lower[want.strip().lower()]
    raise ValueError(f"no label column among {list(cols)}")


def binary_label(c: Column, numeric: bool) -> Column:
    """1 for an anomaly: a number other than 0 (null is 0), or a word that doesn't mean benign."""
    if numeric:
        return (F.coalesce(c.cast("double"), F.lit(0.0)) != 0).cast("int")
    return (~F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin(*BENIGN)).cast("int")


def feature_columns(schema: T.StructType, excluded: Iterable[str] = ()) -> list[str]:
    """Numeric columns that are neither labels, identities, times nor provenance; nor `excluded`, the label columns and others of a table that NOT_FEATURES lacks."""
    never = NOT_FEATURES | OWN_COLUMNS | {c.strip().lower() for c in excluded}
    return [f.name for f in schema if isinstance(f.dataType, _NUMERIC) and f.name.strip().lower() not in never]


def select_features(df: DataFrame, keep: Sequence[str] = (), excluded: Iterable[str] = ()) -> DataFrame:
    return df.select(*keep, *[F.col(f"`{c}`") for c in feature_columns(df.schema, excluded) if c not in keep])


def common_features(schemas: Sequence[T.StructType], excluded: Iterable[str] = ()) -> list[str]:
    """Features that all schemas have, in the first one's order."""
    excluded = tuple(excluded)
    rest = [set(feature_columns(s, excluded)) for s in schemas[1:]]
    return [c for c in feature_columns(schemas[0], excluded) if all(c in r for r in rest)]


def normalize_text(c: Column) -> Column:
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(t).isin(*MISSING), F.lit("")).otherwise(t)


def normalize_category(c: Column) -> Column:
    t = normalize_text(c)
    return F.when(t == "", F.lit("MISSING")).otherwise(F.lower(t))


def coerce_numeric(c: Column) -> Column:
    return normalize_text(c).try_cast("double")


def sanitize_token(c: Column) -> Column:
    t = F.btrim(F.regexp_replace(c, r"[^a-zA-Z0-9_]+", "_"), F.lit("_"))
    return F.when(t == "", F.lit("token")).otherwise(t)


def source_day(c: Column) -> Column:
    """The weekday in a file's name, else the name without its suffix."""
    day = F.regexp_extract(F.lower(c), "|".join(WEEKDAYS), 0)
    return F.when(day != "", F.initcap(day)).otherwise(F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"\.[^.]*$", ""))


def sanitize(token: str) -> str:
    return re.sub(r"[^a-zA-Z0-9_]+", "_", token).strip("_") or "token"


def drop_contaminated_benign(df: DataFrame, roles: Sequence[str], role: str = "split_role", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(df without anomaly rows in the given roles, per role rows_before and dropped)."""
    bad = F.col(role).isin(*roles) & (F.col(label) != 0)
    report = df.where(F.col(role).isin(*roles)).groupBy(role).agg(F.count("*").alias("rows_before"), F.count(F.when(bad, 1)).alias("dropped"))
    return df.where(~bad), report
