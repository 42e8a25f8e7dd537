"""Events to campaign rows as a stream: daily totals, deduplication, anchor refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roaskit import params as P
from roaskit.operators.anchor import anchors_of, index_of_means, means_of_months, refresh_anchors
from roaskit.operators.entities import last_rows
from roaskit.sources import state
from roaskit.sources.storage import materialize, new_folder
from roaskit.sources.tables import event_ad_rows

WATERMARK = "2 days"
EVENT_SCHEMA = ("event_id bigint, ts timestamp, user_id bigint, event_type string, "
                "value double, props string")
MEASURES = ("spend", "revenue", "clicks", "impressions", "conversions")


def stream_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet",
                  files_per_batch: int = 100) -> DataFrame:
    """A file source over the event files of a folder."""
    return (spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def stream_facts(events: DataFrame) -> DataFrame:
    """Ad rows of the events; stateless."""
    return event_ad_rows(events)


def stream_dedup(rows: DataFrame) -> DataFrame:
    """An event that comes again within the watermark is dropped; state ends with it."""
    return rows.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["event_id"])


def daily_windows(rows: DataFrame) -> DataFrame:
    """date, channel and summed measures; on a stream, rows later than the watermark drop."""
    return (rows.withWatermark("ts", WATERMARK)
            .groupBy(F.window("ts", "1 day"), "channel")
            .agg(*[F.sum(m).alias(m) for m in MEASURES])
            .select(F.to_date("window.start").alias("date"), "channel", *MEASURES))


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str,
                  label: str, progress: str | None = None) -> int:
    """Everything that is there now through `sink`, batch by batch; the rows read.

    Progress is kept under the folder `progress`: a later call with the same one reads only
    what came since. Without it the call stands for itself.
    """
    spark = stream.sparkSession
    query = (stream.writeStream.outputMode(mode).foreachBatch(sink)
             .option("checkpointLocation", f"{progress or new_folder(spark, label)}/progress")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def to_batches(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to its own folder: a batch done again overwrites."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
    return sink


def latest_batch(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Of an updating stream's batches, the newest row for each key."""
    rows = spark.read.parquet(folder)
    cols = [c for c in rows.columns if c not in (*keys, "batch")]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("v"))
            .select(*keys, "v.*"))


def stream_daily(events: DataFrame, progress: str | None = None) -> DataFrame:
    """Daily totals of all events there are now, through the streaming path.

    With a `progress` folder the sums, the watermark and what was written go on from call to call.
    """
    spark = events.sparkSession
    progress = progress or new_folder(spark, "daily")
    run_available(daily_windows(stream_facts(events)), to_batches(f"{progress}/batches"), "update", "daily", progress)
    return latest_batch(spark, f"{progress}/batches", ["date", "channel"])


def stream_append(rows: DataFrame, label: str, progress: str | None = None) -> DataFrame:
    """All rows a stateless or deduplicated stream has given up to now, as a table.

    With a `progress` folder a later call adds only what came since.
    """
    spark = rows.sparkSession
    progress = progress or new_folder(spark, label)
    run_available(rows, to_batches(f"{progress}/batches"), "append", label, progress)
    return spark.read.parquet(f"{progress}/batches").drop("batch")


def channel_series(daily: DataFrame) -> DataFrame:
    return daily.select(F.lit(P.CHANNEL).alias("dimension_type"),
                        F.col("channel").alias("dimension_value"), "date",
                        F.col("revenue").cast("double").alias("revenue"),
                        F.col("spend").cast("double").alias("spend"))


class AnchorRefresher:
    """Keeps the anchors of channels current as ad rows stream in, without their history.

    The state is two small tables: a channel's 60 newest days, and its sums by month with a bit
    for each day seen. A batch is reduced to its days, merged, and written as the next version,
    which names its batch. A batch done again starts from the version before, so it gives the
    same. A day that has left the 60 can't come back, so a late row of it counts in its month
    alone. Nothing else is read: the cost of a batch is that of its rows and of the state.
    """

    KEYS = ["dimension_type", "dimension_value"]

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        manifest = state.read_manifest(spark, self.folder)
        base = manifest and (manifest["before"] if manifest["extra"]["batch"] >= batch_id else manifest["version"])
        money = {m: F.sum(m).cast("decimal(28,6)").alias(m) for m in ("revenue", "spend")}
        days = (batch.groupBy(F.col("channel").alias("dimension_value"), F.to_date("ts").alias("date")).agg(*money.values())
                .select(F.lit(P.CHANNEL).alias("dimension_type"), "dimension_value", "date", "revenue", "spend"))
        days = materialize(days, "batch-days")
        months = days.groupBy(*self.KEYS, F.year("date").alias("year"), F.month("date").alias("month")).agg(
            *money.values(), F.bit_or(F.call_function("shiftleft", F.lit(1), F.dayofmonth("date"))).alias("seen"))
        if base:
            old = state.read_version(spark, self.folder, manifest, base)
            days = days.unionByName(old["days"]).groupBy(*self.KEYS, "date").agg(*money.values())
            months = months.unionByName(old["months"]).groupBy(*self.KEYS, "year", "month").agg(*money.values(), F.bit_or("seen").alias("seen"))
        state.write_version(spark, {"days": last_rows(days, P.MOMENTUM_ROWS).drop("age"), "months": months}, self.folder, base, batch=batch_id)

    def anchors(self) -> DataFrame | None:
        """The anchors of every channel up to the last batch; None before the first."""
        manifest = state.read_manifest(self.spark, self.folder)
        if manifest is None:
            return None
        tables = state.read_version(self.spark, self.folder, manifest)
        recent = last_rows(tables["days"], P.MOMENTUM_ROWS).withColumns({m: F.col(m).cast("double") for m in ("revenue", "spend")})
        months = tables["months"].withColumn("days", F.bit_count("seen"))
        return anchors_of(recent, index_of_means(means_of_months(months, self.KEYS), self.KEYS), self.KEYS)


def stream_refresh(events: DataFrame, stored: DataFrame | None = None, progress: str | None = None) -> DataFrame:
    """Anchors of all channels after the events there are now, put over the `stored` ones.

    With a `progress` folder a later call reads the new files only, and goes on from the kept state.
    """
    spark = events.sparkSession
    progress = progress or new_folder(spark, "refresh")
    refresher = AnchorRefresher(spark, f"{progress}/state")
    run_available(stream_facts(events), refresher, "append", "refresh", progress)
    fresh = refresher.anchors()
    if fresh is None:
        if stored is None:
            raise state.StateError("no events yet, and no stored anchors")
        return stored
    return refresh_anchors(stored, fresh) if stored is not None else fresh
