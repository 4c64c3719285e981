"""File sources and sinks: bars, universe, event calendar, holidays, alerts, tables."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlespan.session import stored

BARS = ("open", "high", "low", "close", "volume")
ALERT_FIELDS = (
    "alert_type", "symbol", "score", "pattern", "breakout_level", "entry_price", "stop_loss", "target_1", "target_2",
    "position_size", "volume_ratio", "stage", "rs_rank", "tightness", "sector", "notes",
)
ALERT_ROUNDED = (
    "score", "breakout_level", "entry_price", "stop_loss", "target_1", "target_2", "volume_ratio", "rs_rank", "tightness",
)


def normalise_bars(raw: DataFrame) -> DataFrame:
    """Lower-case names, numeric columns, dates without time zone, no bar without a close.

    Raises on missing columns. Text that is not a number and NaN both become NULL.
    """
    df = raw.toDF(*[c.lower() for c in raw.columns])
    missing = [c for c in ("symbol", "date", *BARS) if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")

    def num(c):
        x = F.expr(f"try_cast({c} AS double)")
        return F.when(~F.isnan(x), x)

    return df.select(
        "symbol", F.to_date("date").alias("date"), *[num(c).alias(c) for c in BARS[:4]], num("volume").cast("long").alias("volume"),
    ).filter(F.col("close").isNotNull())


def read_prices(bars: DataFrame, lookback: int | None = None) -> DataFrame:
    """The last `lookback` bars of every symbol, from the bar numbers and so without a sort."""
    if lookback is None:
        return bars
    return bars.filter(F.col("bar_no") > F.col("n_bars") - lookback)


def unpivot_feed(wide: DataFrame, sep: str = "|") -> DataFrame:
    """Long bars from a feed frame with one column per `ticker|field` pair; all-empty rows are dropped."""
    pairs = [c.split(sep) for c in wide.columns if sep in c]
    tickers = sorted({t for t, _ in pairs})
    have = {tuple(p) for p in pairs}

    def cell(t, f):
        return (F.col(f"`{t}{sep}{f}`") if (t, f) in have else F.lit(None)).cast("double").alias(f)

    rows = F.array(*[F.struct(F.lit(t).alias("symbol"), *[cell(t, f) for f in BARS]) for t in tickers])
    return wide.select("date", F.inline(rows)).dropna("all", subset=list(BARS))


def canonical_symbol(s: Column) -> Column:
    """Upper case, without exchange suffix or series tag."""
    base = F.upper(F.replace(F.replace(s, F.lit(".NS"), F.lit("")), F.lit(".BO"), F.lit("")))
    return F.regexp_replace(base, "-EQ$", "")


def ticker(s: Column, suffix: str = ".NS") -> Column:
    return F.when(F.endswith(s, F.lit(suffix)), s).otherwise(F.concat(s, F.lit(suffix)))


def universe_csv(spark: SparkSession, path: str) -> DataFrame:
    """Universe file with either header style; blank symbols are skipped. A file without any symbol is an error."""
    raw = spark.read.option("header", True).csv(path)

    def first(*names):
        cols = [F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names if n in raw.columns]
        return F.trim(F.coalesce(*cols, F.lit("")))

    rows = raw.select(
        first("Symbol", "symbol").alias("symbol"), first("Company Name", "company_name").alias("company_name"),
        first("Industry", "sector").alias("sector"), first("Industry", "industry").alias("industry"),
        F.lit(None).cast("double").alias("market_cap_cr"),
    ).filter(F.col("symbol") != "")
    if rows.isEmpty():
        raise ValueError(f"no symbols in {path}")
    return rows


def events_csv(spark: SparkSession, path: str, as_of: Column, back_days: int = 60) -> DataFrame:
    """Announcement dates not older than `back_days`; unreadable dates are skipped."""
    raw = spark.read.option("header", True).csv(path)
    day = F.expr("try_to_date(date)")
    return raw.select(F.upper(F.trim("symbol")).alias("symbol"), day.alias("date")).filter(
        F.col("date") >= F.date_sub(as_of, back_days)
    )


def holidays_text(spark: SparkSession, path: str) -> DataFrame:
    """One ISO date per line; blanks, comments and bad lines are skipped."""
    line = F.trim("value")
    return (
        spark.read.text(path).filter((line != "") & ~line.startswith("#"))
        .select(F.expr("try_to_date(substr(trim(value), 1, 10), 'yyyy-MM-dd')").alias("date"))
        .filter("date is not null").distinct()
    )


def holidays_json(spark: SparkSession, path: str) -> DataFrame:
    """Holiday master: the cash segment `CM`, or the first list found; unreadable dates are skipped."""
    raw = spark.read.option("multiLine", True).json(path)
    lists = [f.name for f in raw.schema.fields if f.dataType.typeName() == "array"]
    pick = "CM" if "CM" in lists else lists[0]
    return (
        raw.select(F.explode(pick).alias("r"))
        .select(F.expr("try_to_date(r.tradingDate, 'dd-MMM-yyyy')").alias("date"))
        .filter("date is not null").distinct()
    )


def write_alerts(alerts: DataFrame, path: str, run: str = "scan", dates: DataFrame | None = None) -> None:
    """Adds the alerts of a run as CSV, numbers rounded to two places, so that each alert is there once however often the run is repeated.

    The rows go to a folder of this attempt's own, one subfolder per run date. Once all are written, one more small write commits them:
    (run_date, run, attempt, version), of which `read_alerts` takes the newest of each run and date. So what a failed attempt
    leaves is never read, a repeated run replaces its earlier rows, and another run of the same date adds to them. `dates` (run_date)
    names the dates that the run covers; those without alerts lose the ones an earlier attempt had. By default the alerts' own dates.
    """
    spark, attempt = alerts.sparkSession, uuid.uuid4().hex
    cols = [F.round(F.col(c), 2).alias(c) if c in ALERT_ROUNDED else F.col(c) for c in ALERT_FIELDS]
    place = f"{path}/data/attempt={attempt}"
    alerts.select("run_date", *cols).write.partitionBy("run_date").option("header", True).csv(place)
    covered = alerts.select("run_date") if dates is None else dates.select("run_date")
    done = covered.select(F.col("run_date").cast("string").alias("run_date")).distinct().withColumns({
        "run": F.lit(run), "attempt": F.lit(attempt), "version": F.lit(time.time_ns()),
    })
    done.coalesce(1).write.mode("append").parquet(f"{path}/commits")


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The committed alerts: run_date, run and the alert fields as text."""
    commits = spark.read.schema("run_date string, run string, attempt string, version long").parquet(f"{path}/commits")
    newest = commits.groupBy("run_date", "run").agg(F.max_by("attempt", "version").alias("attempt"))
    schema = ", ".join(f"{c} string" for c in [*ALERT_FIELDS, "attempt", "run_date"])
    rows = spark.read.schema(schema).option("header", True).csv(f"{path}/data")
    return rows.join(newest, ["attempt", "run_date"]).select("run_date", "run", *ALERT_FIELDS)


def _dealt(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumns({"bucket": F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int"), "month": F.date_format("date", "yyyy-MM")})


def write_bar_store(bars: DataFrame, path: str, buckets: int = 8) -> None:
    """A table of bars in folders by bucket of symbols and month, one file each, so that later merges rewrite few of them."""
    rows = _dealt(bars, buckets).repartition("bucket", "month")
    rows.write.mode("overwrite").partitionBy("bucket", "month").parquet(path)


def read_bar_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket", "month")


def merge_bar_store(spark: SparkSession, path: str, incoming: DataFrame, buckets: int = 8) -> int:
    """Upserts bars on (symbol, date) into the store, rewriting only the folders in which a row really changes; returns how many those are.

    Incoming rows equal to the stored ones change nothing, so a repeated merge writes nothing. Only the folders that incoming rows
    fall into are read. The merged folders are worked out and stored beside first, then put in place by Spark's dynamic
    partition overwrite: a merge that fails leaves the table as it was or, folder by folder, in part merged, and repeating it completes it.
    Of several incoming rows of one key the greatest by value stays.
    """
    table = spark.read.parquet(path)
    names = [c for c in table.columns if c not in ("bucket", "month")]
    body = [c for c in names if c not in ("symbol", "date")]
    incoming = incoming.groupBy("symbol", "date").agg(F.max(F.struct(*body)).alias("r")).select("symbol", "date", "r.*").select(*names)
    new = stored(_dealt(incoming, buckets), "incoming")
    near = table.join(new.select("bucket", "month").distinct(), ["bucket", "month"], "left_semi")
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*names, "bucket", "month"]]
    changed = stored(new.alias("n").join(near.alias("o"), same, "left_anti"), "changed")
    folders = changed.select("bucket", "month").distinct()
    count = folders.count()
    if count:
        old = table.join(folders, ["bucket", "month"], "left_semi").join(changed.select("symbol", "date"), ["symbol", "date"], "left_anti")
        merged = stored(old.unionByName(changed), "merged").repartition("bucket", "month")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "month").parquet(path)
    return count


def replace_table(df: DataFrame, path: str, columns: list[str], defaults: dict[str, Column] | None = None) -> None:
    """Overwrites a table with its fixed columns; others are dropped, defaults fill NULLs."""
    defaults = defaults or {}
    out = [F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults else F.col(c) for c in columns]
    df.select(*out).write.mode("overwrite").parquet(path)
