"""Performance statistics of settled trades, overall and by pattern, score band, sector and feature bucket."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlespan.config import CATEGORICAL_FEATURES, NUMERIC_FEATURES, SCORE_BANDS
from candlespan.operators.ranking import tercile_cuts

MIN_MEANINGFUL_N = 10
STATS = ["n", "wins", "losses", "win_rate", "avg_r", "profit_factor", "avg_days_held", "net_inr", "gross_inr", "costs_inr"]


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def perf(r: str = "pnl_r") -> list[Column]:
    """Aggregates over rows; only rows with a realised result count. An empty group gives zeros."""
    ok = F.col(r).isNotNull()
    n = F.count_if(ok)
    inr, days = F.when(ok, F.col("pnl_inr")), F.when(ok, F.col("days_held").cast("double"))
    wins = F.count_if(F.col(r) > 0)
    up, down = _zero(F.sum(F.when(inr > 0, inr))), -_zero(F.sum(F.when(inr < 0, inr)))
    net, costs = _zero(F.sum(inr)), _zero(F.sum(F.when(ok, F.col("costs_inr"))))
    gross = _zero(F.sum(F.when(ok, F.col("gross_pnl_inr"))))
    return [
        n.alias("n"), wins.alias("wins"), (n - wins).alias("losses"),
        F.when(n > 0, wins / n * 100.0).otherwise(0.0).alias("win_rate"),
        _zero(F.avg(r)).alias("avg_r"),
        F.when(down > 0, up / down).when(up > 0, float("inf")).alias("profit_factor"),
        _zero(F.avg(days)).alias("avg_days_held"),
        net.alias("net_inr"), F.when(gross != 0, gross).otherwise(net + costs).alias("gross_inr"), costs.alias("costs_inr"),
    ]


def _named(col: str) -> Column:
    return F.coalesce(F.nullif(F.col(col).cast("string"), F.lit("")), F.lit("unknown"))


def settled(trades: DataFrame) -> DataFrame:
    return trades.filter(F.col("pnl_r").isNotNull())


def overall(trades: DataFrame) -> DataFrame:
    return trades.agg(*perf())


def digest(trades: DataFrame) -> DataFrame:
    """Overall and by pattern in one pass over grouping sets; the overall row has pattern NULL and scope 'overall'."""
    rows = settled(trades).withColumn("pattern", _named("pattern"))
    return rows.rollup("pattern").agg(F.grouping("pattern").alias("_g"), *perf()).select(
        F.when(F.col("_g") == 1, "overall").otherwise("pattern").alias("scope"),
        F.when(F.col("_g") == 0, F.col("pattern")).alias("pattern"), *STATS,
    )


def historic(trades: DataFrame) -> DataFrame:
    return overall(trades).select("n", "wins", "losses", "win_rate", "avg_r", "profit_factor", "avg_days_held", "net_inr")


def band_table(spark, bands=SCORE_BANDS) -> DataFrame:
    return spark.createDataFrame(
        [(float(lo), float(hi), f"{lo}-{min(hi - 1, 100)}") for lo, hi in bands], "lo double, hi double, band string"
    )


def by_score_band(trades: DataFrame, bands=SCORE_BANDS) -> DataFrame:
    """One row per band, empty bands included; scores outside all bands do not count.

    Trades are reduced to one row per band before the band table is joined, so nothing fans out.
    """
    band = None
    for lo, hi in bands:
        hit = (F.col("score") >= lo) & (F.col("score") < hi)
        label = f"{lo}-{min(hi - 1, 100)}"
        band = F.when(hit, label) if band is None else band.when(hit, label)
    found = settled(trades).withColumn("band", band).filter("band is not null").groupBy("band").agg(*perf())
    empty = {c: (F.coalesce(c, F.lit(0)) if c in ("n", "wins", "losses") else _zero(F.col(c))) for c in STATS if c != "profit_factor"}
    return band_table(trades.sparkSession, bands).select("band").join(found, "band", "left").withColumns(empty).select("band", *STATS)


def with_sector(trades: DataFrame, universe: DataFrame) -> DataFrame:
    """Lookup join; no hint, so the dimension is broadcast only while it is small."""
    dim = universe.select("symbol", "sector")
    return trades.drop("sector").join(dim, "symbol", "left").withColumn("sector", _named("sector"))


def by_sector(trades: DataFrame, universe: DataFrame) -> DataFrame:
    return with_sector(settled(trades), universe).groupBy("sector").agg(*perf())


def by_category(trades: DataFrame, feature: str) -> DataFrame:
    return settled(trades).groupBy(_named(feature).alias("bucket")).agg(*perf())


def _long(rows: DataFrame, features, kind: str) -> DataFrame:
    keep = ["pnl_r", "pnl_inr", "days_held", "costs_inr", "gross_pnl_inr"]
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast(kind).alias("value")) for f in features])
    return rows.select(*keep, F.inline(cells))


def terciles(trades: DataFrame, features=NUMERIC_FEATURES) -> DataFrame:
    """Every numeric feature cut at its own sorted values n//3 and 2n//3, in one grouped pass over unpivoted rows.

    Fewer than six values, no spread or equal cuts give a single bucket 'all'.
    """
    long = _long(settled(trades), features, "double").filter("value is not null and not isnan(value)")
    cuts = tercile_cuts(long, ["feature"], "value")
    bucket = (
        F.when(F.col("lo").isNull(), "all").when(F.col("value") < F.col("lo"), "low")
        .when(F.col("value") >= F.col("hi"), "high").otherwise("mid")
    )
    # one row of cuts per feature, so this side is broadcast
    return long.join(F.broadcast(cuts), "feature").groupBy("feature", bucket.alias("bucket")).agg(*perf())


def by_numeric_feature(trades: DataFrame, feature: str) -> DataFrame:
    return terciles(trades, [feature])


def feature_report(trades: DataFrame, numeric=NUMERIC_FEATURES, categorical=CATEGORICAL_FEATURES) -> DataFrame:
    """Terciles of the numeric features and groups of the categorical ones that take more than one value."""
    num = terciles(trades, numeric).withColumn("kind", F.lit("numeric"))
    long = _long(settled(trades), categorical, "string").withColumn("value", _named("value"))
    cat = long.groupBy("feature", F.col("value").alias("bucket")).agg(*perf())
    many = cat.groupBy("feature").agg(F.count("*").alias("_k")).filter("_k > 1").select("feature")
    cat = cat.join(F.broadcast(many), "feature", "left_semi").withColumn("kind", F.lit("categorical"))
    return num.unionByName(cat).withColumn("thin", F.col("n") < MIN_MEANINGFUL_N)


def full_report(trades: DataFrame, universe: DataFrame, numeric=NUMERIC_FEATURES, categorical=CATEGORICAL_FEATURES) -> DataFrame:
    """All breakdowns as tagged rows: section, grp, bucket, statistics."""
    none = F.lit(None).cast("string")
    parts = [
        digest(trades).select(
            F.when(F.col("scope") == "overall", "overall").otherwise("by_pattern").alias("section"), none.alias("grp"),
            F.col("pattern").alias("bucket"), *STATS),
        by_score_band(trades).select(F.lit("by_score_band").alias("section"), none.alias("grp"), F.col("band").alias("bucket"), *STATS),
        by_sector(trades, universe).select(F.lit("by_sector").alias("section"), none.alias("grp"), F.col("sector").alias("bucket"), *STATS),
        feature_report(trades, numeric, categorical).select(
            F.lit("by_feature").alias("section"), F.col("feature").alias("grp"), "bucket", *STATS),
    ]
    return reduce(DataFrame.unionByName, parts)


def filter_period(trades: DataFrame, as_of: Column, period: str | None) -> DataFrame:
    """Trades closed within the last N days, e.g. '30d'; None or 'all' keeps everything."""
    if not period or period == "all":
        return trades
    return trades.filter(F.col("exit_date") >= F.date_sub(as_of, int(period.rstrip("dD"))))


def alerts_with_outcomes(features: DataFrame, trades: DataFrame) -> DataFrame:
    """Every alert's features next to its trade's outcome; open trades keep NULL outcomes."""
    out = trades.select(F.col("id").alias("trade_id"), "state", "pnl_r", "pnl_inr", "days_held", "exit_date")
    return features.join(out, "trade_id", "left")
