"""Structured Streaming jobs: bars from ticks, idempotent upsert, live confirmation, and a stateful trade tracker.

Jobs run to the end of what is available and return the resulting table, which makes them usable as batch queries and
testable; for a live stream start the same pipelines with another trigger. State and output live under the shared
scratch folder, so a lost executor is replayed from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlespan.config import Settings
from candlespan.operators.confirm import confirmed
from candlespan.operators.maintain import upsert
from candlespan.session import scratch_dir, stored
from candlespan.streaming.stateful import ExpiringWatchlist, InOrder, TradeTracker, rocksdb


def _stage(spark: SparkSession, df: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """Writes a table as files and opens it as a stream.

    With `key`, all rows of a key go to one file and hence into one batch, as order across files is not defined.
    """
    path = scratch_dir(spark, name)
    (df.repartition(key) if key else df).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 64).parquet(path)


def _finish(writer, spark: SparkSession) -> None:
    writer.option("checkpointLocation", scratch_dir(spark, "stream")).trigger(availableNow=True).start().awaitTermination()


def _open(spark: SparkSession, feed: DataFrame, path: str) -> DataFrame:
    """A stream over a folder that `_in_parts` will fill with rows of `feed`."""
    feed.limit(0).write.parquet(path)
    return spark.readStream.schema(feed.schema).parquet(path)


def _in_parts(spark: SparkSession, feed: DataFrame, by: str, parts: int, path: str, writer) -> list[dict]:
    """Feeds a stream over `path` in parts of ascending `by`: each part is written and worked off before the next one.

    The query is started anew for every part with the same checkpoint, so state is read back between them. Give it a stored feed: it
    is read once for every part. Returns the progress reports of all batches.
    """
    place = scratch_dir(spark, "stream")
    number = F.col(by).cast("double") if dict(feed.dtypes)[by] != "date" else F.unix_date(by).cast("double")
    cuts = feed.select(number.alias("x")).approxQuantile("x", [k / parts for k in range(1, parts)], 0.01) if parts > 1 else []
    edges, done = [None, *sorted(set(cuts)), None], []
    for low, high in zip(edges, edges[1:]):
        part = feed if low is None else feed.filter(number > low)
        (part if high is None else part.filter(number <= high)).write.mode("append").parquet(path)
        query = writer.option("checkpointLocation", place).trigger(availableNow=True).start()
        query.awaitTermination()
        done += query.recentProgress
    return done


def tick_bars(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling OHLCV bars of an event stream; ticks later than `late` are dropped."""
    at = F.struct("ts", "event_id")
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("symbol"))
        .agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
             F.max_by("value", at).alias("close"), F.count("*").alias("volume"))
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def _newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last version of every key among versioned rows."""
    rows = spark.read.parquet(path)
    body = [c for c in rows.columns if c not in (*keys, "version")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*body), "version").alias("r")).select(*keys, "r.*")


def stream_event_bars(spark: SparkSession, folder: str, width: str = "1 hour") -> DataFrame:
    """Bars of the events table read as a stream; each batch appends its changed bars, the newest version counts."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    out = scratch_dir(spark, "bars")

    def save(batch: DataFrame, version: int) -> None:
        batch.withColumn("version", F.lit(version)).write.mode("append").parquet(out)

    _finish(tick_bars(events, width).writeStream.outputMode("update").foreachBatch(save), spark)
    return _newest(spark, out, ["symbol", "ts"])


def resent_bars(
    spark: SparkSession, incoming: DataFrame, batches: int = 1, within: str = "30 days", by: str = "arrival"
) -> tuple[DataFrame, DataFrame]:
    """The newest version of every bar of a stream of re-sent bars, and what became of the rows: (read, late, repeated, kept).

    `arrival` is the day number on which a message was sent, its event time. A message sent again as it was, with the same arrival, is
    dropped if it comes while event time is at most `within` past it; one that comes later still is dropped as late, repeated or not. So the
    state holds the messages of that time alone. The counts are those of the streaming engine. `by` is the column the feed is cut by.
    """
    keys, body = ["symbol", "date"], [c for c in incoming.columns if c not in ("symbol", "date", "arrival", by)]
    feed = incoming if "arrival" in incoming.columns else incoming.withColumn("arrival", F.lit(0).cast("long"))
    feed = feed.withColumn("arrival", F.coalesce("arrival", F.lit(0)).cast("long"))
    feed = stored(feed.withColumn("sent", F.timestamp_seconds(F.col("arrival") * 86400)), "resent")
    path, out = scratch_dir(spark, "feed"), scratch_dir(spark, "late")

    def save(batch: DataFrame, version: int) -> None:
        newest = batch.groupBy(*keys).agg(F.max(F.struct("arrival", *body)).alias("r")).select(*keys, "r.*")
        newest.write.mode("overwrite").parquet(f"{out}/version={version}")

    stream = _open(spark, feed, path).withWatermark("sent", within).dropDuplicatesWithinWatermark([*keys, "arrival", *body])
    with rocksdb(spark):
        done = _in_parts(spark, feed, by, batches, path, stream.writeStream.foreachBatch(save))
    rows = spark.read.parquet(out)
    newest = rows.groupBy(*keys).agg(F.max(F.struct("arrival", *body)).alias("r")).select(*keys, *[f"r.{c}" for c in body])
    read = sum(p["numInputRows"] for p in done)
    late = sum(o["numRowsDroppedByWatermark"] for p in done for o in p["stateOperators"])
    repeated = sum(o["customMetrics"].get("numDroppedDuplicateRows", 0) for p in done for o in p["stateOperators"])
    counts = spark.createDataFrame([(read, late, repeated, read - late - repeated)], "read long, late long, repeated long, kept long")
    return newest, counts


def stream_upsert(spark: SparkSession, table: DataFrame, incoming: DataFrame, batches: int = 1, within: str = "30 days") -> DataFrame:
    """Applies a stream of re-sent bars to a table. Re-running a batch writes the same version, so it is idempotent.

    Of bars sent again, the one with the greatest `arrival` wins, in one batch or over several; ties, and feeds without that
    column, go by the values, so every run picks the same row. The feed is cut into `batches` by arrival; repeated messages are dropped
    before the merge, and so are those more than `within` behind (see `resent_bars`).
    """
    newest, _ = resent_bars(spark, incoming, batches, within)
    return upsert(table, newest, ["symbol", "date"])


def stream_confirm(spark: SparkSession, live: DataFrame, watch: DataFrame, least: float = 1.5) -> DataFrame:
    """Stream-static join: live bars against the watchlist, keeping confirmed crossings after the watch date."""
    stream = _stage(spark, live, "live")
    out = scratch_dir(spark, "confirmed")
    hits = stream.join(watch.select("symbol", "breakout_date", "breakout_level"), "symbol").filter(
        (F.col("date") >= F.col("breakout_date")) & confirmed(F.col("close"), F.col("breakout_level"), F.col("vr"), least)
    ).select("symbol", "date", "close", "breakout_level")
    _finish(hits.writeStream.format("parquet").option("path", out).outputMode("append"), spark)
    return spark.read.schema(hits.schema).parquet(out)


def _replayed(spark: SparkSession, feed: DataFrame, key: str, work: InOrder, batches: int) -> DataFrame:
    """What a stateful operator puts out over a feed with a column `day`, arriving in `batches` parts by day.

    After the last part a row without a key, one day later, lets event time pass that part's last day as well.
    """
    feed = stored(feed.filter("day is not null").withColumn("ts", F.timestamp_seconds(F.col("day") * 86400)), "feed")
    path, out = scratch_dir(spark, "parts"), scratch_dir(spark, "moves")
    stream = _open(spark, feed, path).withWatermark("ts", "1 day")
    rows = stream.groupBy(key).transformWithStateInPandas(work, work.OUT, "append", "EventTime")
    writer = rows.writeStream.format("parquet").option("path", out).outputMode("append")
    end = feed.agg((F.max("day") + 1).cast("int").alias("day")).filter("day is not null")
    clock = stored(end.withColumn("ts", F.timestamp_seconds(F.col("day") * 86400)), "clock")
    for c in feed.columns:
        if c not in clock.columns:
            clock = clock.withColumn(c, F.lit("" if c == key else 0).cast(feed.schema[c].dataType))
    with rocksdb(spark):
        _in_parts(spark, feed.unionByName(clock), "day", batches, path, writer)
    return spark.read.schema(rows.schema).parquet(out)


def track_trades(spark: SparkSession, trades: DataFrame, bars: DataFrame, s: Settings = Settings(), batches: int = 3) -> DataFrame:
    """Transitions of every trade as trades and bars arrive, in `batches` parts by date.

    State is one row per open trade, and the bars and trades that event time has not passed; an ended trade leaves none.
    """
    bar = bars.select(
        "symbol", F.unix_date("date").alias("day"), F.lit(True).alias("is_bar"), F.lit("").alias("id"),
        *[F.col(c).cast("double").alias(x) for c, x in zip(("open", "high", "low", "close"), "abcd")])
    entered = trades.select(
        "symbol", F.unix_date("entry_date").alias("day"), F.lit(False).alias("is_bar"), "id",
        *[F.col(c).cast("double").alias(x) for c, x in zip(("entry_price", "stop_loss", "target_1", "target_2"), "abcd")])
    got = _replayed(spark, bar.unionByName(entered), "symbol", TradeTracker(s.paper.hold_max_days), batches)
    return got.select("symbol", "entry_date", "state", "date", "price")


def stream_watchlist(spark: SparkSession, adds: DataFrame, removals: DataFrame, days: int, batches: int = 3) -> DataFrame:
    """The change log (symbol, date, turn, change, breakout_date, breakout_level, original_score) of a watchlist fed by a stream.

    `adds` is (symbol, date, breakout_date, breakout_level, original_score), `removals` (symbol, date). An entry lives until `days`
    days after its breakout date, unless another add replaces it or a removal ends it. One that is older when it is added expires at
    once; undated ones are left out. The log ends with the last date of the feed.
    """
    number = lambda c: F.unix_date(c)
    added = adds.filter("breakout_date is not null").select(
        "symbol", number("date").alias("day"), F.lit(False).alias("removes"), number("breakout_date").alias("breakout_day"),
        F.col("breakout_level").cast("double").alias("level"), F.col("original_score").cast("double").alias("score"))
    gone = removals.select(
        "symbol", number("date").alias("day"), F.lit(True).alias("removes"), F.lit(0).alias("breakout_day"), F.lit(0.0).alias("level"), F.lit(0.0).alias("score"))
    return _replayed(spark, added.unionByName(gone), "symbol", ExpiringWatchlist(days), batches)


def watchlist_on(log: DataFrame, as_of) -> DataFrame:
    """The watchlist at the end of a day, from its change log."""
    entry = F.struct("change", "breakout_date", "breakout_level", "original_score")
    newest = log.filter(F.col("date") <= as_of).groupBy("symbol").agg(F.max_by(entry, F.struct("date", "turn")).alias("c"))
    return newest.filter("c.change = 'added'").select("symbol", "c.breakout_date", "c.breakout_level", "c.original_score")
