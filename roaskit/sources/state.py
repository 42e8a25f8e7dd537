"""Model state as tables, run history, and the written results."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roaskit import params as P
from roaskit.functions.attach import attach
from roaskit.sources.storage import read_text, remove_folder, replace_text


class StateError(RuntimeError):
    """The stored model state is absent or not what it should be."""


# Columns a state table must have. Loading checks them and raises.
STATE_TABLES = {
    "entity_model": ("dimension_type", "dimension_value", "rows", "total_revenue", "has_model",
                     "revenue_mean", "revenue_weekday", "revenue_month", "revenue_std",
                     "spend_mean", "spend_weekday", "spend_month", "spend_std"),
    "entity_baseline": ("dimension_type", "dimension_value", "daily_revenue", "daily_spend",
                        "revenue_trend_per_day", "spend_trend_per_day"),
    "portfolio_seasonal": ("dimension_type", "dimension_value", "first_date", "last_date",
                           "revenue_beta", "spend_beta"),
    "portfolio_spread": ("dimension_type", "dimension_value", "revenue_std", "spend_std"),
    "campaign_map": ("campaign_name", "channel", "channel_share"),
    "fallback_scale": ("dimension_type", "scale"),
    "params": ("name", "value"),
}
# Tables that only an ensemble with tree members has; both or none.
TREE_TABLES = {
    "portfolio_trees": ("dimension_type", "dimension_value", "member", "depth", "base", "feature",
                        "threshold", "value"),
    "portfolio_newest": ("dimension_type", "dimension_value"),
}
# What a state that lacks a parameter means by it.
PARAM_DEFAULTS = {"model_blend_weight": P.MODEL_WEIGHT_REVENUE,
                  "spend_blend_weight": P.MODEL_WEIGHT_SPEND,
                  "interval_calibration_scale": P.INTERVAL_SCALE,
                  "top_down_weight": P.TOP_DOWN_WEIGHT}
MANIFEST = "manifest.json"


def params_table(spark: SparkSession, **values: float) -> DataFrame:
    rows = [(k, float(v)) for k, v in {**PARAM_DEFAULTS, **values}.items()]
    return spark.createDataFrame(rows, "name string, value double")


def params_of(params: DataFrame) -> dict[str, float]:
    """The parameters by name; one that is not there has its default."""
    found = {r["name"]: r["value"] for r in params.filter(
        F.col("name").isin(*PARAM_DEFAULTS)).dropDuplicates(["name"]).collect()}
    return {**PARAM_DEFAULTS, **found}


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """version, tables (name -> rows and columns) and extra of the state at `path`; None without one."""
    try:
        text = read_text(spark, f"{path}/{MANIFEST}")
        return None if text is None else json.loads(text)
    except (ValueError, PySparkException, Py4JJavaError) as e:
        raise StateError(f"the manifest at {path} cannot be read: {e}") from e


def write_version(spark: SparkSession, tables: dict[str, DataFrame], path: str, base: str | None = None, **extra) -> dict:
    """The tables in a folder of their own, then the manifest that names it, swapped at once.

    Whoever loads sees the version before or this one, never a part. `base` is the version
    this one goes back to, the present one if not given. Versions that are neither are
    removed; a reader of the base can go on.
    """
    old = read_manifest(spark, path) or {}
    base = base or old.get("version")
    version = f"version-{uuid.uuid4().hex}"
    entry = {}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
        stored = spark.read.parquet(f"{path}/{version}/{name}")
        entry[name] = {"rows": stored.count(), "columns": stored.schema.simpleString()}
    manifest = {"version": version, "before": base, "tables": entry, "extra": extra}
    replace_text(spark, f"{path}/{MANIFEST}", json.dumps(manifest))
    for gone in {old.get("version"), old.get("before")} - {base, None}:
        remove_folder(spark, f"{path}/{gone}")
    return manifest


def read_version(spark: SparkSession, path: str, manifest: dict, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of a version. Each must have the rows and columns the manifest says."""
    out = {}
    for name, said in manifest["tables"].items():
        where = f"{path}/{version or manifest['version']}/{name}"
        try:
            df = spark.read.parquet(where)
            found = {"rows": df.count(), "columns": df.schema.simpleString()}
        except (PySparkException, Py4JJavaError) as e:
            raise StateError(f"cannot read state table {name} at {where}: {e}") from e
        if version in (None, manifest["version"]) and found != said:
            raise StateError(f"state table {name} at {where} is damaged: {found} instead of {said}")
        out[name] = df
    return out


def save_state(tables: dict[str, DataFrame], path: str) -> str:
    """A new version of the model state under `path`; its name. All tables must be there."""
    lacking = set(STATE_TABLES) - set(tables)
    if lacking:
        raise StateError(f"state tables not given: {sorted(lacking)}")
    if len(set(TREE_TABLES) & set(tables)) == 1:
        raise StateError("tree members need both of their tables")
    return write_version(next(iter(tables.values())).sparkSession, tables, path)["version"]


def load_state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The state tables. Absent or damaged state raises; nothing is fitted instead."""
    manifest = read_manifest(spark, path)
    if manifest is None:
        raise StateError(f"no model state at {path}")
    out = read_version(spark, path, manifest)
    for name, wanted in {**STATE_TABLES, **{t: c for t, c in TREE_TABLES.items() if t in out}}.items():
        if name not in out:
            raise StateError(f"the state at {path} has no table {name}")
        lacking = [c for c in wanted if c not in out[name].columns]
        if lacking:
            raise StateError(f"state table {name} lacks {lacking}")
    return out


RUN_SCHEMA = ("run_label string, parameters_json string, summary_json string, "
              "created_at timestamp")


def files_state(*tables: DataFrame) -> str:
    """What the files behind tables are like now: their number, and a sum over path, size and time of change.

    Reads no columns. Of each file one row is left after the partial aggregate.
    """
    out = []
    for df in tables:
        files = df.select(*[F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_size", "file_modification_time")]).distinct()
        r = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)")).alias("sum")).first()
        out.append(f"{r.n}:{r.sum}")
    return " ".join(out)


def save_ledger(ledger: DataFrame, path: str, inputs: str) -> None:
    """Stores the ledger of an ingest beside what its inputs were like."""
    write_version(ledger.sparkSession, {"ledger": ledger}, path, inputs=inputs)


def load_ledger(spark: SparkSession, path: str, inputs: str) -> DataFrame | None:
    """The stored ledger, or None if there is none or its inputs have changed since."""
    manifest = read_manifest(spark, path)
    if manifest is None or manifest["extra"].get("inputs") != inputs:
        return None
    return read_version(spark, path, manifest)["ledger"]


def append_run(run: DataFrame, path: str) -> None:
    """Append run rows (label, parameters and summary as JSON, time)."""
    run.select("run_label", "parameters_json", "summary_json", "created_at").write.mode(
        "append").parquet(path)


def run_row(summary: DataFrame, label: str, parameters: list[str], figures: list[str]) -> DataFrame:
    """A run row out of a one-row summary table."""
    return summary.select(
        F.lit(label).alias("run_label"), F.to_json(F.struct(*parameters)).alias("parameters_json"),
        F.to_json(F.struct(*figures)).alias("summary_json"),
        F.current_timestamp().alias("created_at"))


def recent_runs(runs: DataFrame, n: int = 10, parameters: str = "map<string,string>",
                summary: str = "map<string,string>") -> DataFrame:
    """The newest n runs with their JSON read; a top-n, not a sort of the history."""
    return (runs.orderBy(F.col("created_at").desc(), F.col("run_label").desc()).limit(n)
            .select("run_label", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
                    F.from_json("parameters_json", parameters).alias("parameters"),
                    F.from_json("summary_json", summary).alias("summary")))


def log_datasets(facts: DataFrame, quality: DataFrame, source: str, path: str) -> None:
    """Append one row for each channel: name, source, records, quality, time."""
    rows = facts.groupBy("channel").agg(F.count("*").alias("record_count"))
    attach(rows, quality, "quality_score").select(
        F.col("channel").alias("channel_name"), F.lit(source).alias("file_path"), "record_count",
        F.col("quality_score").alias("data_quality_score"),
        F.current_timestamp().alias("uploaded_at")).write.mode("append").parquet(path)


PREDICTION_SCHEMA = ("forecast_period string, dimension_type string, dimension_value string, "
                     "metric string, p10 double, p50 double, p90 double")
SCORECARD_SCHEMA = ("origin_date date, dimension_type string, dimension_value string, "
                    "forecast_period string, metric string, actual double, p10 double, p50 double, "
                    "p90 double, absolute_error double, ape double, smape double, "
                    "covered_by_interval boolean")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_document(document: DataFrame, path: str) -> None:
    """The one row of `document` as one JSON file; fields stand in the order of the columns, nulls too.

    Readers see the file before or this one. A document holds breakdowns and segments, not facts.
    """
    every = F.to_json(F.struct(*document.columns), {"ignoreNullFields": "false", "pretty": "true"})
    rows = document.select(every.alias("text")).head(2)
    if len(rows) != 1:
        raise StateError(f"a document is one row, not {len(rows)}")
    replace_text(document.sparkSession, path, rows[0]["text"])


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The row written by `write_document`; absent or other than `schema` raises StateError."""
    text = read_text(spark, path)
    if text is None:
        raise StateError(f"no document at {path}")
    row = spark.createDataFrame([(text,)], "text string")
    try:
        json.loads(text)
        got = row.select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("d")).select("d.*")
        got.collect()
    except (ValueError, PySparkException, Py4JJavaError) as e:
        raise StateError(f"the document at {path} is not of its schema: {e}") from e
    return got


def write_predictions(predictions: DataFrame, path: str) -> None:
    write_csv(predictions.select("forecast_period", "dimension_type", "dimension_value", "metric",
                                 "p10", "p50", "p90"), path)


def write_backtest(scorecard: DataFrame, naive: DataFrame, summary: DataFrame, path: str) -> None:
    write_csv(scorecard, f"{path}/scorecard")
    write_csv(naive, f"{path}/naive_scorecard")
    write_json(summary, f"{path}/summary")


def read_backtest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(scorecard, summary); raises StateError when there is none."""
    try:
        return (spark.read.csv(f"{path}/scorecard", header=True, schema=SCORECARD_SCHEMA,
                               enforceSchema=False),
                spark.read.json(f"{path}/summary"))
    except AnalysisException as e:
        raise StateError(f"no backtest at {path}: {e}") from e


def read_features(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Enriched facts written before; raises StateError when absent."""
    try:
        df = (spark.read.parquet(path) if fmt == "parquet"
              else spark.read.csv(path, header=True, inferSchema=True))
    except AnalysisException as e:
        raise StateError(f"no features at {path}: {e}") from e
    if "date" not in df.columns:
        raise StateError(f"features at {path} have no date")
    return df.withColumn("date", F.to_date("date"))
