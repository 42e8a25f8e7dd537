"""Finding and reading the CSV exports of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words in a file name that tell the platform, first match counts.
PLATFORM_WORDS = {
    "google": ("google",),
    "meta": ("meta",),
    "bing": ("bing", "ms_ads", "msads", "microsoft"),
}
CORRUPT = "_corrupt"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name of every file in the folder; reads names only, never content."""
    return (spark.read.format("binaryFile").load(folder)
            .select("path", F.element_at(F.split("path", "/"), -1).alias("name")))


def tag_platforms(files: DataFrame) -> DataFrame:
    """CSV files with the platforms their name speaks of (one row per match)."""
    low = F.lower("name")
    hits = [F.when(low.rlike("|".join(words)), F.lit(p)) for p, words in PLATFORM_WORDS.items()]
    return (files.filter(low.endswith(".csv"))
            .select("path", "name", F.array_compact(F.array(*hits)).alias("platforms")))


def discover_exports(files: DataFrame, first_only: bool = False) -> DataFrame:
    """platform, path of every file that a platform claims; with `first_only` the
    smallest path of each platform, the others being listed by `left_out_exports`."""
    claimed = tag_platforms(files).select(F.explode("platforms").alias("platform"), "path")
    return claimed.groupBy("platform").agg(F.min("path").alias("path")) if first_only else claimed


def left_out_exports(files: DataFrame) -> DataFrame:
    """platform, path of the files that `discover_exports(first_only=True)` doesn't read."""
    return discover_exports(files).join(discover_exports(files, True), ["platform", "path"], "left_anti")


def headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, header: the first line of each file, read by the tasks that hold its first split."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    return lines.filter("block = 0").groupBy("path").agg(F.min(F.struct("at", "line"))["line"].alias("header"))


def unrecognized_exports(files: DataFrame) -> DataFrame:
    """CSV files that no platform claims."""
    tagged = tag_platforms(files)
    known = tagged.filter(F.size("platforms") > 0).select("path")
    return tagged.select("path", "name").join(known, "path", "left_anti")


def missing_platforms(spark: SparkSession, found: DataFrame) -> DataFrame:
    wanted = spark.createDataFrame([(p,) for p in PLATFORM_WORDS], "platform string")
    return wanted.join(found, "platform", "left_anti")


def file_audit(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Ledger rows of the folder itself: platforms without a file (20 each) and
    unclaimed CSV files (10 once, with their number and the first name; the others
    are rows of `unrecognized_exports`)."""
    missing = missing_platforms(spark, discover_exports(files).select("platform").distinct()).select(
        F.col("platform"), F.lit("file_missing").alias("check"),
        F.lit(1).cast("long").alias("affected"), F.lit(20.0).alias("penalty"),
        F.concat(F.lit("no export found for "), "platform").alias("message"))
    named = F.struct("name", "path")
    unknown = (unrecognized_exports(files)
               .agg(F.count("*").alias("affected"), F.min(named)["name"].alias("names"))
               .filter("affected > 0")
               .select(F.lit("folder").alias("platform"),
                       F.lit("file_unrecognized").alias("check"), "affected",
                       F.lit(10.0).alias("penalty"),
                       F.concat(F.lit("files of no known platform, the first is "), "names").alias("message")))
    return missing.unionByName(unknown)


# Texts that mean a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
           "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_export(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files of one header as text columns, with corrupt lines marked and row order kept.

    `_file`, `_block` and `_pos` order the rows: a block is a split of the file and
    is always read from front to back by one task. Missing-value texts become null.
    """
    one = path if isinstance(path, str) else path[0]
    header = spark.read.csv(one, header=True, inferSchema=False).schema
    if not header.fields or not any(ch.isalpha() for f in header.fields for ch in f.name):
        raise ValueError(f"export {one} has no header")
    schema = T.StructType([*header.fields, T.StructField(CORRUPT, T.StringType())])
    # Whole lines are parsed: with fewer columns a line that is too long goes unseen,
    # and an export has few columns that are not used.
    rows = spark.read.option("columnPruning", False).csv(
        path, header=True, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT,
        enforceSchema=True)
    return rows.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"), CORRUPT,
        *[F.when(~F.col(f"`{f.name}`").isin(*MISSING), F.col(f"`{f.name}`")).alias(f.name)
          for f in header.fields])
