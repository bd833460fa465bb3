"""Stand-in data: flow records from `events`, their windows and scores; with the same views in SQL for the oracle.

One "file" is a day; rows are ordered by time in it. Days up to 18 are for
training and up to 22 for calibration, both benign rows only; the rest is test.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winaudit.functions.ordering import EVERY, with_position, with_positions
from winaudit.functions.scratch import materialize
from winaudit.operators import features, scoring, splits, windows
from winaudit.operators.calibrate import threshold_from_benign_fpr

W, STRIDE, RATIO, FPR = 16, 4, 0.4, 0.25
ROLES = [splits.TRAIN, splits.CALIBRATION, splits.TEST]
SEGMENT = ["split_role", "source_file"]
SCALED = ["value", "k", "hour"]
#: Runs: seeds with the weights of the features in the embedding's distance, models with their alpha.
SEEDS = {0: (1, 1, 1), 1: (1, 1, 0), 2: (0, 1, 1)}
MODELS = {"near": 0.24, "peak": 0.76}
DIGITS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    benign = F.col("event_type").isin("view", "click", "purchase")
    day = F.dayofmonth("ts")
    role = F.when(day <= 18, splits.TRAIN).when(day <= 22, splits.CALIBRATION).otherwise(splits.TEST)
    return e.select(
        "event_id", "ts", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', date_trunc('SECOND', ts))").alias("ts_s"), F.date_format("ts", "yyyy-MM-dd").alias("source_file"),
        F.when(benign, "BENIGN").otherwise(F.col("event_type")).alias("anomaly_type"), F.when(benign, 0).otherwise(1).alias("label"), "value",
        F.regexp_extract("props", r'"k": (\d+)', 1).cast("double").alias("k"), F.hour("ts").cast("double").alias("hour"), "user_id", (F.col("user_id") % 7).alias("dst"), F.col("event_type").alias("service"), role.alias("split_role"),
    )


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_position(_records(spark, sf_dir), ["source_file"], ["ts", "event_id"], "row_index").drop("ts")


def records(spark: SparkSession, sf_dir: str, cols: Sequence[str] | None = None) -> DataFrame:
    """raw_records() without contaminated rows, with pos and seg_rows as segment_positions() gives them: a file has one role here, so both come from one sort. cols: those wanted beside SEGMENT."""
    kept = (F.col("split_role") == splits.TEST) | (F.col("label") == 0)
    all_ = _records(spark, sf_dir)
    all_ = all_ if cols is None else all_.select("event_id", "ts", "label", *SEGMENT, *cols)
    placed = with_positions(all_, ["source_file"], ["ts", "event_id"], {"row_index": EVERY, "pos": kept}, {"pos": "seg_rows"})
    return placed.where(kept).drop("ts")


def clean_roles(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    from winaudit.functions.clean import drop_contaminated_benign

    return drop_contaminated_benign(raw, [splits.TRAIN, splits.CALIBRATION])


def scaled(rec: DataFrame) -> DataFrame:
    """rec with value, k and hour scaled by the training rows' minimum and maximum."""
    return features.apply_scaler(rec, features.fit_minmax(rec.where(F.col("split_role") == splits.TRAIN), SCALED))


def window_means(rec: DataFrame) -> DataFrame:
    """Per window: labels, mean scaled features (the embedding) and the largest scaled value."""
    s = scaled(rec)
    sums = {"n_anomaly": F.col("label"), **{f"sum_{c}": F.col(c) for c in SCALED}}
    win = windows.with_label(windows.sliding_windows(s, SEGMENT, W, STRIDE, sums, maxs={"max_value": F.col("value")}), W, RATIO)
    return win.withColumns({f"m_{c}": F.col(f"sum_{c}") / W for c in SCALED})


def _normed(win: DataFrame, runs: list[Column], by: str) -> DataFrame:
    """Each window with each run's distances, and sd and sf, normalized over the training windows of a run named by `by`. runs: structs with the features' weights."""
    train = F.col("split_role") == splits.TRAIN
    mean = win.where(train).agg(*[F.avg(f"m_{c}").alias(c) for c in SCALED]).first()
    wide = win.select("*", F.explode(F.array(*runs)).alias("r")).select("*", "r.*")
    wide = wide if by in wide.columns else wide.withColumn(by, F.concat("model", F.lit("-"), F.col("seed").cast("string")))
    total = F.lit(0.0)
    for c in SCALED:
        total = total + F.col(f"x_{c}") * F.pow(F.col(f"m_{c}") - F.lit(mean[c]), 2)
    wide = wide.withColumns({"sf_raw": F.round(F.sqrt(total), 9), "sd_raw": F.round("max_value", 9)})
    norm = scoring.minmax_norm(wide, {"sd_raw": "sd", "sf_raw": "sf"}, train, [by])
    return norm.withColumns({c: F.round(c, DIGITS).cast("float") for c in ("sd", "sf")})


def _weights(seed: int) -> list[Column]:
    return [F.lit(seed).alias("seed"), *[F.lit(float(x)).alias(f"x_{c}") for c, x in zip(SCALED, SEEDS[seed], strict=True)]]


def seed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seed, split_role, label, sd, sf): what scores() fuses. Models differ by their alpha only, so each seed's windows come once."""
    win = materialize(window_means(records(spark, sf_dir, SCALED)).select("split_role", "label", "max_value", *[f"m_{c}" for c in SCALED]), "windows")
    return _normed(win, [F.struct(*_weights(s)) for s in SEEDS], "seed").select("seed", "split_role", "label", "sd", "sf")


def runs(spark: SparkSession) -> DataFrame:
    """(seed, run_id) of all runs."""
    return spark.createDataFrame([(s, f"{m}-{s}") for m in MODELS for s in SEEDS], "seed int, run_id string")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run and window, with threshold, prediction and family."""
    rec = records(spark, sf_dir)
    win = window_means(rec)
    fam = windows.dominant_family(rec, SEGMENT, W, STRIDE)
    win = win.join(fam, [*SEGMENT, "w"], "left").withColumn("family", F.when(F.col("label") == 1, F.coalesce("family", F.lit("BENIGN"))).otherwise("BENIGN"))
    win = windows.numbered(materialize(win, "windows"), "split_role", ROLES, "source_file", "w", "window")
    norm = _normed(win, [F.struct(F.lit(m).alias("model"), F.lit(a).alias("alpha"), *_weights(s)) for m, a in MODELS.items() for s in SEEDS], "run_id")
    norm = norm.withColumn("fused", F.round(scoring.fuse(F.col("sd"), F.col("sf"), F.col("alpha")), DIGITS).cast("float"))
    norm = norm.select("model", "seed", "run_id", "alpha", *SEGMENT, "w", "window_id", "window_index", "label", "family", "sd_raw", "sf_raw", "sd", "sf", F.col("fused").alias("score"))
    norm = materialize(norm, "scores")
    th = materialize(threshold_from_benign_fpr(norm.where(F.col("split_role") == splits.CALIBRATION), FPR, ["run_id"]), "thresholds")
    return norm.join(th, "run_id").withColumn("prediction", (F.col("score") >= F.col("threshold")).cast("int"))


# The same in SQL.

_BENIGN = "event_type in ('view', 'click', 'purchase')"
RAW = f"""raw as (select event_id, cast(floor(epoch(ts)) as bigint) as ts_s, strftime(ts, '%Y-%m-%d') as source_file,
  row_number() over (partition by strftime(ts, '%Y-%m-%d') order by ts, event_id) - 1 as row_index,
  case when {_BENIGN} then 'BENIGN' else event_type end as anomaly_type, case when {_BENIGN} then 0 else 1 end as label, value,
  cast(regexp_extract(props, '"k": (\\d+)', 1) as double) as k, cast(hour(ts) as double) as hour, user_id, user_id % 7 as dst, event_type as service,
  case when day(ts) <= 18 then '{splits.TRAIN}' when day(ts) <= 22 then '{splits.CALIBRATION}' else '{splits.TEST}' end as split_role from events)"""
REC = f"""{RAW}, rec as (select *, row_number() over (partition by split_role, source_file order by row_index) - 1 as pos,
  count(*) over (partition by split_role, source_file) as seg_rows from raw where split_role = '{splits.TEST}' or label = 0)"""


def spread(window: int = W, stride: int = STRIDE) -> str:
    """The windows that hold a row."""
    return f"unnest(range(cast(greatest(0, ceil((pos - {window - 1}) / {stride}.0)) as bigint), 1 + cast(least(floor(pos / {stride}.0), floor((seg_rows - {window}) / {stride}.0)) as bigint)))"


SCALED_SQL = f"""{REC}, fit as (select {", ".join(f"min({c}) as lo_{c}, max({c}) - min({c}) as r_{c}" for c in SCALED)} from rec where split_role = '{splits.TRAIN}'),
sc as (select rec.* exclude (value, k, hour), {", ".join(f"(rec.{c} - lo_{c}) / (case when r_{c} = 0 then 1 else r_{c} end) as {c}" for c in SCALED)} from rec, fit)"""
WIN = f"""{SCALED_SQL}, held as (select *, {spread()} as w from sc),
win as (select split_role, source_file, w, w * {STRIDE} as start_pos, w * {STRIDE} + {W - 1} as end_pos, sum(label) as n_anomaly, sum(label) / {W}.0 as anomaly_ratio, case when sum(label) / {W}.0 >= {RATIO} then 1 else 0 end as label,
  {", ".join(f"sum({c}) / {W} as m_{c}" for c in SCALED)}, max(value) as max_value, min(row_index) as start_row, max(row_index) as end_row, min(ts_s) as start_ts, max(ts_s) as end_ts from held group by all),
fams as (select split_role, source_file, w, anomaly_type, count(*) as n from held where anomaly_type <> 'BENIGN' group by all),
fam as (select split_role, source_file, w, anomaly_type as family from fams qualify row_number() over (partition by split_role, source_file, w order by n desc, anomaly_type) = 1),
ordered as (select win.*, case when label = 1 then coalesce(fam.family, 'BENIGN') else 'BENIGN' end as family,
  row_number() over (order by case win.split_role when '{ROLES[0]}' then 1 when '{ROLES[1]}' then 2 else 3 end, win.source_file, win.w) - 1 as n_all from win left join fam using (split_role, source_file, w)),
named as (select *, split_role || ':' || printf('%06d', n_all) as window_id, n_all - min(n_all) over (partition by split_role) as window_index from ordered)"""
_RUNS = ", ".join(f"('{m}', {a}, {s}, '{m}-{s}', {', '.join(str(x) for x in ws)})" for m, a in MODELS.items() for s, ws in SEEDS.items())
SCORES = f"""{WIN}, ref as (select {", ".join(f"avg(m_{c}) as r_{c}" for c in SCALED)} from named where split_role = '{splits.TRAIN}'),
runs(model, alpha, seed, run_id, {", ".join(f"x_{c}" for c in SCALED)}) as (values {_RUNS}),
rawsc as (select named.*, model, cast(alpha as double) as alpha, seed, run_id, round(sqrt({" + ".join(f"x_{c} * (m_{c} - r_{c}) ** 2" for c in SCALED)}), 9) as sf_raw, round(max_value, 9) as sd_raw from named, ref, runs),
lim as (select run_id, min(sd_raw) as sdl, max(sd_raw) as sdh, min(sf_raw) as sfl, max(sf_raw) as sfh from rawsc where split_role = '{splits.TRAIN}' group by run_id),
nsc as (select rawsc.*, cast(round(greatest(0.0, least(1.0, (sd_raw - sdl) / greatest(sdh - sdl, 1e-12))), {DIGITS}) as float) as sd, cast(round(greatest(0.0, least(1.0, (sf_raw - sfl) / greatest(sfh - sfl, 1e-12))), {DIGITS}) as float) as sf from rawsc join lim using (run_id)),
fsc as (select *, cast(round(alpha * sd + (1 - alpha) * sf, {DIGITS}) as float) as score from nsc),
th as (select run_id, cast(quantile_cont(cast(score as double), {1 - FPR}) as float) as threshold from fsc where split_role = '{splits.CALIBRATION}' group by run_id),
scores as (select model, seed, run_id, alpha, split_role, source_file, w, window_id, window_index, label, family, sd_raw, sf_raw, sd, sf, score, threshold, case when score >= threshold then 1 else 0 end as prediction from fsc join th using (run_id)),
test as (select * from scores where split_role = '{splits.TEST}'), cal as (select * from scores where split_role = '{splits.CALIBRATION}')"""
