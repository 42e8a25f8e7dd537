"""The ingest of a folder as one operation: from its files to facts, ledger and score."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roaskit.operators import ingest as I
from roaskit.sources import exports as X
from roaskit.sources.storage import materialize

#: Charged for a platform of which no file can be read.
UNREADABLE = 15.0


@dataclass(frozen=True)
class Ingested:
    """facts: a row for each date, channel and campaign, by date; ledger; score: one row of the quality score."""

    facts: DataFrame
    ledger: DataFrame
    score: DataFrame


def _entry(spark: SparkSession, platform: str, check: str, affected: int, penalty: float, message: str) -> DataFrame:
    return spark.createDataFrame([(platform, check, affected, penalty, message)], I.LEDGER_SCHEMA)


def ingest_folder(spark: SparkSession, folder: str, first_only: bool = False) -> Ingested:
    """Reads every export of a folder; with `first_only` one file of each platform.

    The ledger charges platforms without a file (20 each), files that no platform
    claims (10 once), a platform that can't be read (15; the others go on), what
    the audits find, and repeated keys (3). Files of one platform may have
    different headers. Only names and headers come to the driver. A file of no bytes
    isn't listed by Spark, so its platform counts as missing.
    """
    files = X.list_files(spark, folder)
    ledger = [X.file_audit(spark, files)]
    chosen = X.discover_exports(files, first_only)
    if first_only:
        left = X.left_out_exports(files).groupBy("platform").agg(F.count(F.lit(1)).alias("affected"))
        ledger.append(left.select("platform", F.lit("file_left_out").alias("check"), "affected", F.lit(0.0).alias("penalty"),
                                  F.lit("files left out as only the first is read").alias("message")))
    by_platform: dict[str, list[str]] = defaultdict(list)
    for r in chosen.orderBy("platform", "path").collect():
        by_platform[r.platform].append(r.path)
    given: dict[str, list[DataFrame]] = {}
    for platform, paths in by_platform.items():
        try:
            groups: dict[str, list[str]] = defaultdict(list)
            for r in X.headers(spark, paths).orderBy("path").collect():
                groups[r.header].append(r.path)
            if not groups:
                raise ValueError("no file has a line")
            parts = [materialize(X.read_export(spark, same), "export") for same in groups.values()]
        except (PySparkException, ValueError) as e:
            ledger.append(_entry(spark, platform, "unreadable", len(paths), UNREADABLE, f"can't be read: {str(e)[:200]}"))
            continue
        given[platform] = parts
        ledger += [I.corrupt_lines(p, platform) for p in parts]
    facts, audits = I.ingest(**given)
    ledger = materialize(reduce(DataFrame.unionByName, [*ledger, audits]), "ledger")
    merged = materialize(I.merge_duplicates(facts), "facts").orderBy("date", "channel", "campaign_id")
    return Ingested(merged, ledger, I.quality_score(ledger))
