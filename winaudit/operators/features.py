"""Transforms that are fitted on training rows and applied everywhere.

Fits are one-row aggregates; their few numbers become literals of the plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winaudit.functions.clean import normalize_category, sanitize
from winaudit.functions.radix import quantiles

Fit = dict[str, tuple[float, float]]
#: One-hot columns that a vocabulary may ask for.
MAX_TOKENS = 10_000


def fit_minmax(df: DataFrame, cols: Sequence[str], benign_only: bool = False, file: str = "source_file", label: str = "label") -> Fit:
    """(min, max) per column. benign_only: of a file's benign rows if it has any, else of all its rows."""
    if benign_only:
        per = df.groupBy(file).agg(
            F.count(F.when(F.col(label) == 0, 1)).alias("__b"),
            *[f(c).alias(f"__a{n}{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))],
            *[f(F.when(F.col(label) == 0, F.col(c))).alias(f"__b{n}{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))],
        )
        df = per.select(*[F.when(F.col("__b") > 0, F.col(f"__b{n}{c}")).otherwise(F.col(f"__a{n}{c}")).alias(f"{n}{c}") for c in cols for n in ("lo", "hi")])
        row = df.agg(*[F.min(f"lo{c}").alias(f"lo{c}") for c in cols], *[F.max(f"hi{c}").alias(f"hi{c}") for c in cols]).first()
    else:
        row = df.agg(*[F.min(c).alias(f"lo{c}") for c in cols], *[F.max(c).alias(f"hi{c}") for c in cols]).first()
    return {c: (row[f"lo{c}"], row[f"hi{c}"]) for c in cols}


def fit_standard(df: DataFrame, cols: Sequence[str]) -> Fit:
    """(mean, mean + population deviation) per column, so that apply_scaler serves both fits."""
    row = df.agg(*[F.avg(c).alias(f"m{c}") for c in cols], *[F.stddev_pop(c).alias(f"s{c}") for c in cols]).first()
    return {c: (row[f"m{c}"], row[f"m{c}"] + row[f"s{c}"]) for c in cols}


def apply_scaler(df: DataFrame, fit: Fit, clip: bool = False) -> DataFrame:
    """(x - lo) / (hi - lo); a range of zero divides by 1; clip to [0, 1]."""
    out: dict[str, Column] = {}
    for c, (lo, hi) in fit.items():
        x = (F.col(c) - F.lit(float(lo))) / F.lit(float(hi - lo) or 1.0)
        out[c] = F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)) if clip else x
    return df.withColumns(out)


def _stacked(df: DataFrame, cols: Sequence[str], kind: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(kind).alias("value")) for c in cols])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def numeric_screen(df: DataFrame, cols: Sequence[str], most_missing: float = 0.995) -> DataFrame:
    """column, missing_ratio, keep, reason. More than one value is told by min <> max: no distinct count is shuffled."""
    v = F.when(~F.isnan("value"), F.col("value"))  # NaN is missing, no value
    per = _stacked(df, cols, "double").groupBy("column").agg(F.avg(F.when(v.isNull(), 1.0).otherwise(0.0)).alias("missing_ratio"), (F.coalesce(F.min(v) != F.max(v), F.lit(False))).alias("varies"))
    reason = F.when(F.col("missing_ratio") > most_missing, "near_all_missing").when(~F.col("varies"), "constant_or_single_value").otherwise("")
    return per.select("column", "missing_ratio", (reason == "").alias("keep"), reason.alias("reason"))


def fit_median_impute(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact median per column, all columns from the same readings; null and NaN are no values, and a column without any has the median None."""
    v = F.when(~F.isnan("value"), F.col("value"))
    found = quantiles(_stacked(df, cols, "double").select("column", v.alias("value")), ["column"], "value", {"median": 0.5}).collect()  # a row a column
    by = {r.column: r["median"] for r in found}
    return {c: by.get(c) for c in cols}


def apply_impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0 if m is None else float(m))) for c, m in medians.items()})


def fit_vocab(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, token): the sorted distinct categories of training rows, with UNK."""
    tokens = reduce(DataFrame.unionAll, [df.select(F.lit(c).alias("column"), normalize_category(F.col(c)).alias("token")) for c in cols])
    unknown = df.sparkSession.createDataFrame([(c, "UNK") for c in cols], "column string, token string")
    return tokens.distinct().unionAll(unknown).distinct()


def one_hot(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """One float column `column__token` per token; what the vocabulary lacks is UNK. Names that collide are refused."""
    rows = vocab.orderBy("column", "token").limit(MAX_TOKENS + 1).collect()
    if len(rows) > MAX_TOKENS:
        raise ValueError(f"more than {MAX_TOKENS} tokens")
    by: dict[str, list[str]] = {}
    for r in rows:
        by.setdefault(r.column, []).append(r.token)
    out: dict[str, Column] = {}
    for c, tokens in by.items():
        known = normalize_category(F.col(c))
        known = F.when(known.isin(*tokens), known).otherwise(F.lit("UNK"))
        for t in tokens:
            name = f"{c}__{sanitize(t)}"
            if name in out:
                raise ValueError(f"two tokens give the column {name}")
            out[name] = (known == t).cast("float")
    return df.withColumns(out)


def encode_codes(df: DataFrame, col: str, always: Sequence[str] = ("BENIGN",)) -> DataFrame:
    """Add `col`_code: the value's 0-based place among the sorted distinct values and `always`."""
    from winaudit.functions.ordering import with_position

    extra = df.sparkSession.createDataFrame([(a,) for a in always], f"{col} string")
    codes = with_position(df.select(col).where(F.col(col).isNotNull()).distinct().unionAll(extra).distinct(), [], [col], f"{col}_code")
    return df.join(codes, col, "left")
