"""Structured Streaming jobs over the change feed.

The functions take and return streaming DataFrames; ``run_available`` and
``start`` connect them to a sink. State lives in the RocksDB provider, and every
stateful step has a watermark, so state stays bounded by the retention time. Tables
and last actions per key are kept in a ``store``, one row per key, of which a batch
rewrites only the parts that it touches.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.operators import changes as C
from lorekeep.operators.activity import spam_flags
from lorekeep.sources.catalog import Catalog
from lorekeep.sources.files import normalize_feed
from lorekeep.sources.schemas import SCHEMAS
from lorekeep.streaming.store import KeyedStore, id_range, key_hash

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare_streaming(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", files_per_batch: int = 100
) -> DataFrame:
    """Files of a landing folder, in the order of their arrival."""
    prepare_streaming(spark)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("recursiveFileLookup", True).format(fmt).load(path)


def read_changes(spark: SparkSession, path: str, table: str = "recentchanges", **options) -> DataFrame:
    """A landed feed with the declared schema and second-precise timestamps."""
    return normalize_feed(read_stream(spark, path, SCHEMAS[table], **options), table)


def with_event_time(stream: DataFrame, column: str, delay: str) -> DataFrame:
    """Watermarked event time; events later than ``delay`` are dropped by stateful steps."""
    return stream.withColumn("event_time", F.col(column).cast("timestamp")).withWatermark("event_time", delay)


def deduplicated(stream: DataFrame, key: Collection[str], column: str, delay: str = "7 days") -> DataFrame:
    """Each event once, although overlapping parts of the feed are read again."""
    return with_event_time(stream, column, delay).dropDuplicatesWithinWatermark(list(key))


def daily_counts(stream: DataFrame, column: str, delay: str = "90 days", by: Collection[str] = ()) -> DataFrame:
    """Tumbling counts per day."""
    keyed = with_event_time(stream, column, delay)
    counts = keyed.groupBy(F.window("event_time", "1 day"), *by).agg(F.count(F.lit(1)).alias("events"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("day"), *by, "events")


def sliding_counts(daily: DataFrame, days: int = 30, by: Collection[str] = ()) -> DataFrame:
    """Counts of the last ``days`` days, for every day, from the rows of :func:`daily_counts`.

    The stream counts each event once; only its daily rows are spread over the windows.
    """
    spread = F.sequence(F.lit(1), F.lit(days))
    rows = daily.select("day", *by, "events", F.explode(spread).alias("_ahead"))
    until = F.col("day") + F.make_dt_interval(days="_ahead")
    return rows.groupBy(until.alias("until"), *by).agg(F.sum("events").alias("events"))


def sessions(stream: DataFrame, user: str, column: str, gap: str = "1 day", delay: str = "90 days") -> DataFrame:
    """Edit sessions per user: runs without a pause of ``gap`` or more.

    The streaming cousin of streaks; the exact rule on calendar days is
    ``operators.activity.streaks``. In append mode a session is written once, when the
    watermark has passed its end by ``gap``; until then it is state.
    """
    keyed = with_event_time(stream, column, delay)
    counts = keyed.groupBy(F.session_window("event_time", gap), user).agg(
        F.count(F.lit(1)).alias("edits"), F.max("event_time").alias("last")
    )
    return counts.select(
        user, F.col("session_window.start").cast("timestamp_ntz").alias("start"),
        F.col("last").cast("timestamp_ntz").alias("end"), "edits",
    )


def last_actions(stream: DataFrame, key: Collection[str], path: str, checkpoint: str) -> DataFrame:
    """Last event per key of ``tag_events`` or ``page_events`` that has landed so far, by ``log_id``.

    Kept as one row per key, in parts by id where the key has one; an event that comes late loses
    against a later one that came before it.
    """
    part = id_range("id") if "id" in key else key_hash(key)
    return KeyedStore(stream.sparkSession, path, stream.schema, key, part, "log_id").run_available(stream, checkpoint)


def spam_alerts(
    stream: DataFrame, title: str, text: str, phrases: Collection[str], threshold: int = 5
) -> DataFrame:
    """Changes that look like spam. Stateless: alerts leave with the batch they came in."""
    return spam_flags(stream, title, text, phrases, threshold).where("is_spam")


def enriched(stream: DataFrame, cat: Catalog) -> DataFrame:
    """Log events with namespace name, current page id and user name from the tables."""
    names = cat["namespace_starname"].select(F.col("nss_id").alias("log_namespace"), "nss_name")
    users = cat["users"].select(F.col("user_id").alias("log_user"), "user_name")
    page = cat["page"].select(
        F.col("page_namespace").alias("log_namespace"), F.col("page_title").alias("log_title"), "page_id"
    )
    return stream.join(names, "log_namespace", "left").join(users, "log_user", "left").join(
        page, ["log_namespace", "log_title"], "left"
    )


# ---- sinks --------------------------------------------------------------------------------


def batch_writer(path: str, reduce: Callable[[DataFrame], DataFrame] | None = None):
    """Write each micro-batch, reduced if asked for, to its own partition; a repeated batch replaces itself."""

    def write(df: DataFrame, batch: int) -> None:
        df = reduce(df) if reduce else df
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch").parquet(path)

    return write


def start(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", every: str = "1 minute"):
    """Run continuously into ``path``."""
    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(processingTime=every).foreachBatch(batch_writer(path)).start()
    )


def run_available(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
    reduce: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Process everything that has landed, then stop; returns all written rows with ``batch``."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(batch_writer(path, reduce)).start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return stream.sparkSession.read.schema(schema).parquet(path)


def latest_rows(written: DataFrame, key: Collection[str]) -> DataFrame:
    """Current row per key of an update-mode sink: the one of the last batch."""
    key = list(key)
    rest = [x for x in written.columns if x not in key and x != "batch"]
    return written.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(*key, "_row.*")


def first_rows(written: DataFrame, key: Collection[str]) -> DataFrame:
    """First row per key of an append sink: inserts that ignore known keys."""
    key = list(key)
    rest = [x for x in written.columns if x not in key and x != "batch"]
    return written.groupBy(*key).agg(F.min_by(F.struct(*rest), "batch").alias("_row")).select(*key, "_row.*")


def ingest(changes: DataFrame, log: DataFrame, root: str) -> dict[str, DataFrame]:
    """Ingest both feeds as they land and return the tables as they stand now.

    Repeated events are ignored. A batch rewrites only the id ranges that it brings rows for; visibility,
    patrol and tag events are applied on reading to the rows they name, one net change each.
    """

    def stored(stream: DataFrame, table: str, key: str) -> DataFrame:
        store = KeyedStore(stream.sparkSession, f"{root}/{table}", stream.schema, [key], id_range(key))
        return store.run_available(stream, f"{root}/_{table}")

    rc, le = stored(changes, "recentchanges", "rc_id"), stored(log, "logging", "log_id")
    visible = C.apply_bitmask(rc, "rc_this_oldid", "rc_deleted", C.bitmask_changes(le, "revision"))
    visible = C.apply_bitmask(visible, "rc_logid", "rc_deleted", C.bitmask_changes(le, "event"))
    return {
        "recentchanges": C.apply_patrol(visible, le),
        "logging": C.apply_bitmask(le, "log_id", "log_deleted", C.bitmask_changes(le, "event")),
        "tag_actions": C.tag_actions(le),
    }
