"""One query per operator over the given tables. Each takes (spark, folder of parquet tables) and returns rows.

Results are tidied for comparison with other engines: doubles rounded to six places, dates as ISO text.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlespan.config import PATTERN_ORDER, Regime, Settings, Thresholds
from candlespan.functions import scoring as M
from candlespan.functions import session_clock as C
from candlespan.functions import sizing as Z
from candlespan.operators import confirm as K
from candlespan.operators import crosssection as X
from candlespan.operators import indicators as I
from candlespan.operators import maintain as T
from candlespan.operators import patterns as P
from candlespan.operators import pivots as V
from candlespan.operators import quality as Q
from candlespan.operators import ranking as R
from candlespan.operators import reports as A
from candlespan.operators import trades as TR
from candlespan.operators.calendar import business_days_between, calendar, last_completed_session, monday_after, volume_profile
from candlespan.operators.kernels import Rolling, Smooth, lagged, reseeded, rolling, run_kernels, smoothing, smoothing_panel, year_high_kernel
from candlespan.operators.panel import own_rows, panel, series, warm
from candlespan.operators.stage import peaks, slope_kernel, with_stage
from candlespan.plans import days as DY
from candlespan.plans import scan as S
from candlespan.session import scratch_dir, stored
from candlespan.sources import files as IO
from candlespan.sources import walk as B
from candlespan.streaming import jobs as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Turnover in the test tables is far below real markets, so the liquidity floor is lowered to bind there.
TEST_SETTINGS = Settings(thresholds=Thresholds(min_adv_cr=0.004))
AS_OF = "1998-06-30"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tidy(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType.typeName()
        if t in ("double", "float"):
            c = F.round(c, 6) + F.lit(0.0)
        elif t == "date":
            c = c.cast("string")
        elif t == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif t in ("integer", "short", "byte"):
            c = c.cast("long")
        elif t == "array":
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), ";")
        out.append(c.alias(f.name))
    return df.select(*out)


class Tables:
    """The given tables and the inputs derived from them, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d
        self._trades: DataFrame | None = None
        self._bars: DataFrame | None = None
        self._candidates: DataFrame | None = None

    def __getattr__(self, name: str) -> DataFrame:
        return B.table(self.spark, self.d, name)

    def bars(self) -> DataFrame:
        return B.walk_bars(self.lineitem) if self._bars is None else self._bars

    def stored_bars(self) -> DataFrame:
        """The bars, worked out once: for plans that read them several times. From then on `bars` gives these."""
        if self._bars is None:
            self._bars = stored(self.bars(), "bars")
        return self._bars

    def gap_bars(self) -> DataFrame:
        return B.walk_bars(self.lineitem, gap_open=True)

    def panel(self) -> DataFrame:
        return panel(self.bars(), even=self._bars is not None)

    def gap_panel(self) -> DataFrame:
        return panel(self.gap_bars(), even=False)

    def universe(self) -> DataFrame:
        return B.universe(self.supplier, self.nation, self.region)

    def events_cal(self) -> DataFrame:
        return B.event_calendar(self.orders, self.lineitem)

    def holidays(self) -> DataFrame:
        """Days with an unusually large number of dear orders stand in for exchange holidays."""
        return (
            self.orders.groupBy(F.to_date("o_orderdate").alias("date"))
            .agg(F.count_if(F.col("o_totalprice") > 400000).alias("n")).filter("n >= 3").select("date")
        )

    def calendar(self) -> DataFrame:
        span = self.lineitem.agg(
            F.date_sub(F.to_date(F.min("l_shipdate")), 60).alias("lo"), F.date_add(F.to_date(F.max("l_shipdate")), 60).alias("hi")
        )
        return calendar(span, self.holidays())

    def signals(self) -> DataFrame:
        """Bars within 2 % of their 252-bar high, as signals for the trade operators (not yet labelled).

        The grouped map hands back only these bars, as only they need the bars after them.
        """
        extremes = rolling([Rolling("_top", "high", 252, "max", False), Rolling("_low", "low", 126, "min", False)])

        def near(pdf):
            gap = (pdf["_top"] - pdf["close"]) / pdf["_top"]
            return (pdf["own"] & (pdf["bar_no"] >= 252) & (gap <= 0.02)).to_numpy(bool)

        p = TR.ahead_of(I.with_standard(self.panel(), [extremes, TR.future_kernel(near)], near))
        return near_high(p.withColumn("cir", I.close_in_range())).filter("own")

    def trades(self) -> DataFrame:
        """Non-overlapping labelled signals, worked out once; symbol and entry bar identify a trade, so ids need no numbering pass."""
        if self._trades is None:
            labelled = stored(TR.label_outcomes(self.signals()).select(*trade_columns()), "labelled")
            self._trades = TR.non_overlapping(labelled).withColumn("id", F.concat_ws("-", "symbol", "entry_no"))
        return self._trades


def near_high(p: DataFrame) -> DataFrame:
    """A pluggable signal: close within 2 % of the 252-bar high, measured move down to the 126-bar low."""
    gap = F.try_divide(F.col("_top") - F.col("close"), F.col("_top"))
    return p.filter((F.col("bar_no") >= 252) & (gap <= 0.02)).withColumns({
        "level": F.col("_top"), "base_height": F.col("_top") - F.col("_low"),
        "pattern": F.when(F.col("close") > F.col("open"), "up_bar").when(F.col("close") < F.col("open"), "down_bar"),
        "score": F.coalesce(F.col("cir") * 40.0 + 58.0, F.lit(58.0)),
        "alert_type": F.when(F.col("volume") % 2 == 0, "BREAKOUT").otherwise("PULLBACK_ENTRY"),
    })


def trade_columns() -> list:
    return [
        "symbol", F.col("entry_no").cast("long").alias("entry_no"), F.col("exit_no").cast("long").alias("exit_no"),
        "entry_date", "exit_date", "entry_price", "exit_price", "stop_loss", "target_1", "target_2",
        F.col("level").alias("breakout_level"), "base_height", "pattern", "score", "state", "shares", "gross_pnl_inr",
        "costs_inr", "pnl_inr", "pnl_r", F.col("bars_held").cast("long").alias("bars_held"),
        F.col("days_held").cast("long").alias("days_held"), F.col("volume_ratio_20").alias("volume_ratio"),
        F.col("cir").alias("close_in_range"), (F.try_divide("atr_14", "close") * 100.0).alias("atr_pct"), "alert_type",
    ]


# ── sources and sinks ────────────────────────────────────────────────────


@query
def flagship_leaders(spark, d):
    """Each date's strongest 63-bar performers (percentile 90 and up) that close above their 50-bar mean."""
    rows = S.prepass(Tables(spark, d).bars()).filter("continuous")
    ranked = R.percentile_ranks(rows.select("symbol", "date", "close", "sma_50", "ret_63"), ["date"], "ret_63")
    best = ranked.filter((F.col("close") > F.col("sma_50")) & (F.col("rs_percentile") >= 90.0))
    return tidy(best.select("symbol", "date", "close", "ret_63", "rs_percentile"))


@query
def s1_bar_scan(spark, d):
    return tidy(IO.read_prices(Tables(spark, d).bars(), 60).select("symbol", "date", "close", "volume", "bar_no"))


@query
def s2_normalise_bars(spark, d):
    b = Tables(spark, d).bars()
    text = F.when(F.col("volume") % 7 == 0, "NaN").when(F.col("volume") % 11 == 0, "n/a").otherwise(F.col("close").cast("string"))
    raw = b.select(
        "symbol", F.col("date").cast("timestamp").alias("Date"), F.col("open").cast("string").alias("Open"),
        F.col("high").alias("HIGH"), F.col("low").alias("Low"), text.alias("Close"), F.col("volume").alias("Volume"),
    )
    return tidy(IO.normalise_bars(raw))


@query
def s3_unpivot_feed(spark, d):
    day = B.event_bars(Tables(spark, d).events, "1 day").select("symbol", F.to_date("ts").alias("date"), *IO.BARS)
    kinds = ["click", "error", "purchase", "signup", "view"]
    wide = day.groupBy("date").pivot("symbol", kinds).agg(*[F.first(c).alias(c) for c in IO.BARS])
    wide = wide.select("date", *[F.col(f"{k}_{c}").alias(f"{k}|{c}") for k in kinds for c in IO.BARS])
    return tidy(IO.unpivot_feed(wide))


@query
def s4_universe_csv(spark, d):
    u = Tables(spark, d).universe()
    path = scratch_dir(spark, "universe")
    u.select(F.concat(F.lit(" "), "symbol").alias("Symbol"), F.col("company_name").alias("Company Name"),
             F.col("industry").alias("Industry")).write.option("header", True).csv(path)
    return tidy(IO.universe_csv(spark, path).select("symbol", "company_name", "sector", "industry"))


@query
def s5_events_csv(spark, d):
    path = scratch_dir(spark, "events")
    e = Tables(spark, d).events_cal()
    e.select(F.concat(F.lit("sup"), "symbol").alias("symbol"),
             F.when(F.dayofmonth("date") == 1, "soon").otherwise(F.col("date").cast("string")).alias("date")
             ).write.option("header", True).csv(path)
    return tidy(IO.events_csv(spark, path, F.lit(AS_OF).cast("date")))


@query
def s6_holidays_text(spark, d):
    path = scratch_dir(spark, "holidays")
    days = Tables(spark, d).holidays()
    lines = days.select(F.explode(F.array(
        F.concat(F.col("date").cast("string"), F.lit("  closed")), F.concat(F.lit("# "), F.col("date").cast("string")), F.lit("not a date"), F.lit("")
    )).alias("value"))
    lines.write.text(path)
    return tidy(IO.holidays_text(spark, path))


@query
def s7_holidays_json(spark, d):
    path = scratch_dir(spark, "holidays")
    row = F.struct(F.date_format("date", "dd-MMM-yyyy").alias("tradingDate"))
    # one document holding one entry per holiday, so its size is bounded by the calendar
    Tables(spark, d).holidays().agg(F.to_json(F.struct(
        F.array(F.struct(F.lit("01-Jan-1990").alias("tradingDate"))).alias("FO"), F.collect_list(row).alias("CM")
    )).alias("value")).write.text(path)
    return tidy(IO.holidays_json(spark, path))


@query
def s8_symbols(spark, d):
    s = F.col("s_name")
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(s, F.lit("-EQ"))).when(F.col("s_suppkey") % 3 == 1, F.concat(s, F.lit(".NS"))).otherwise(s)
    rows = Tables(spark, d).supplier.select(name.alias("raw"))
    return tidy(rows.select("raw", IO.canonical_symbol(F.col("raw")).alias("symbol"), IO.ticker(F.col("raw")).alias("ticker")))


def _alerts(t: Tables) -> DataFrame:
    return _featured(t).select(
        F.col("entry_date").alias("run_date"), "alert_type", "symbol", "score", F.coalesce("pattern", F.lit("none")).alias("pattern"),
        "breakout_level", "entry_price", "stop_loss", "target_1", "target_2", F.col("shares").alias("position_size"), "volume_ratio",
        "stage", F.col("rs_percentile").alias("rs_rank"), "close_in_range", "tightness", "sector", F.lit(None).cast("string").alias("notes"),
    )


@query
def s9_alert_sink(spark, d):
    path = scratch_dir(spark, "alerts")
    alerts = stored(_alerts(Tables(spark, d)), "alerts")
    for _ in range(2):  # a repeated run leaves each alert once
        IO.write_alerts(alerts, path)
    back = IO.read_alerts(spark, path)
    return tidy(back.select(
        F.col("run_date").cast("string").alias("run_date"), "symbol", "alert_type", "pattern", F.col("position_size").cast("long").alias("position_size"),
        *[F.col(c).cast("double").alias(c) for c in ("entry_price", "target_1", "target_2")], "stage", "sector",
        F.round(F.col("rs_rank").cast("double"), 2).alias("rs_rank"),
    ))


@query
def s10_replace_table(spark, d):
    path = scratch_dir(spark, "table")
    t = Tables(spark, d)
    IO.replace_table(t.universe().select("symbol", "sector"), path, ["symbol", "sector"])
    rows = t.universe().withColumn("detected_date", F.when(F.length("symbol") == 1, F.lit("1999-01-01")))
    IO.replace_table(rows, path, ["symbol", "industry", "detected_date"], {"detected_date": F.lit(AS_OF)})
    return tidy(spark.read.parquet(path))


def _late(b: DataFrame) -> DataFrame:
    """Re-sent bars: the last ten of every symbol, with another close."""
    return b.filter(F.col("bar_no") > F.col("n_bars") - 10).withColumn("close", F.col("close") + 1.0).withColumn("bar_no", F.col("bar_no"))


@query
def s11_upsert(spark, d):
    b = Tables(spark, d).bars()
    return tidy(T.upsert(b.filter(F.col("bar_no") <= F.col("n_bars") - 5), _late(b), ["symbol", "date"]).select("symbol", "date", "close", "volume"))


@query
def s11_merge_store(spark, d):
    """The same upsert into a stored table, of which only the folders that change are rewritten."""
    b, path = stored(Tables(spark, d).bars(), "bars"), scratch_dir(spark, "bar-store")
    columns = ("symbol", "date", "open", "high", "low", "close", "volume")
    IO.write_bar_store(b.filter(F.col("bar_no") <= F.col("n_bars") - 5).select(*columns), path)
    IO.merge_bar_store(spark, path, _late(b).select(*columns))
    return tidy(IO.read_bar_store(spark, path).select("symbol", "date", "close", "volume"))


@query
def s12_delete(spark, d):
    t = Tables(spark, d)
    gone = t.universe().filter(F.col("sector") == "ASIA").select("symbol")
    return tidy(T.delete(t.bars(), gone, ["symbol"]).select("symbol", "date", "close"))


@query
def s13_patch(spark, d):
    t = Tables(spark, d)
    base = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("notes"), F.col("s_acctbal").alias("balance"), F.lit("OPEN").alias("state"))
    sold = t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(F.sum("l_quantity").alias("balance"), F.count("*").alias("n"))
    changes = sold.select("id", F.when(F.col("n") % 2 == 0, F.col("balance")).alias("balance"),
                          F.when(F.col("n") % 3 == 0, "CLOSED").alias("state"), F.lit(None).cast("string").alias("notes"))
    return tidy(T.patch(base, changes, "id"))


@query
def s14_assign_ids(spark, d):
    o = Tables(spark, d).orders
    new = o.filter(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    old = o.filter(F.col("o_orderpriority") != "1-URGENT").select(F.col("o_orderkey").alias("id"))
    return tidy(T.assign_ids(new, old, ["date", "o_orderkey"], block=F.struct("date", F.floor(F.col("o_orderkey") / 65536))))


@query
def s15_prune(spark, d):
    e = Tables(spark, d).events_cal().withColumn("date", F.when(F.dayofmonth("date") > 2, F.col("date")))
    return tidy(T.prune(e, "date", F.lit(AS_OF).cast("date"), 100))


# ── filters and gates ────────────────────────────────────────────────────


@query
def f1_freshness(spark, d):
    t = Tables(spark, d)
    b = t.bars()
    as_of = b.agg(F.max("date").alias("as_of")).withColumn("required", F.date_sub("as_of", 3))
    return tidy(Q.freshness(Q.latest_dates(b), as_of))


@query
def f1_stale_days(spark, d):
    """The sessions on which a symbol's newest bar is an older one."""
    t = Tables(spark, d)
    return tidy(Q.stale_days(S.prepass(t.stored_bars()).select("symbol", "date", "next_date"), t.calendar()))


@query
def f2_discontinuities(spark, d):
    return tidy(Q.discontinuities(Tables(spark, d).panel(), 0.03, 0.03))


@query
def f3_continuity_gate(spark, d):
    p = Tables(spark, d).panel().withColumn("bad", Q.bad_move(0.035, 0.035))
    return tidy(own_rows(p.withColumn("ok", Q.continuous(300))).select("symbol", "date", "ok"))


def _quality_rows(t: Tables) -> DataFrame:
    rows = own_rows(t.panel().withColumn("adv_cr", I.adv_crores()))
    u = t.universe().select("symbol", "market_cap_cr", "sector")
    first = F.date_sub("date", (F.col("bar_no") * 2).cast("int"))
    return rows.join(u, "symbol", "left").withColumns({
        "listed_days": F.when(F.col("bar_no") % 5 != 0, F.datediff("date", first)),
        "pledge": F.when(F.col("volume") % 4 == 0, F.col("volume").cast("double")),
    })


@query
def f4_quality_floor(spark, d):
    th = Thresholds(min_adv_cr=0.003)
    rows = _quality_rows(Tables(spark, d))
    bad = Q.quality(F.col("adv_cr"), F.col("market_cap_cr"), F.col("listed_days"), F.col("pledge"), th)
    return tidy(rows.select("symbol", "date", bad.alias("failed"), (F.size(bad) == 0).alias("passed")))


@query
def f5_adv(spark, d):
    return tidy(own_rows(Tables(spark, d).panel().withColumn("adv_cr", I.adv_crores())).select(
        "symbol", "date", (F.col("adv_cr") * 1e7).alias("adv")))


@query
def f6_min_history(spark, d):
    b = Tables(spark, d).bars()
    return tidy(b.filter(F.col("bar_no") >= Thresholds().min_history).groupBy("symbol").agg(F.count("*").alias("n"), F.min("date").alias("since")))


def _levels(t: Tables) -> DataFrame:
    """Every bar with the highest high of the 60 bars before it as its level."""
    return own_rows(t.panel().withColumns({
        "level": F.max("high").over(series().rowsBetween(-60, -1)), "vr": I.volume_ratio_prior(), "cir": I.close_in_range(),
    }))


@query
def f7_near_level(spark, d):
    rows = _levels(Tables(spark, d))
    return tidy(rows.filter(K.near_level(F.col("close"), F.col("level"))).select("symbol", "date", "close", "level"))


@query
def f8_confirmed(spark, d):
    rows = _levels(Tables(spark, d))
    return tidy(rows.filter(K.confirmed(F.col("close"), F.col("level"), F.col("vr"))).select("symbol", "date", "close", "level", "vr"))


@query
def f9_has_bar(spark, d):
    latest = Q.latest_dates(Tables(spark, d).bars())
    newest = latest.agg(F.max("latest")).scalar()
    return tidy(latest.select("symbol", (F.col("latest") == newest).alias("has_bar")))


@query
def f10_drop_partial(spark, d):
    """As of 13:05 on the newest day, that day's bars are partial."""
    e = Tables(spark, d).events
    day = B.event_bars(e, "1 day").withColumn("date", F.to_date("ts")).withColumn("now", e.agg(F.max("ts")).scalar())
    at = F.to_timestamp(F.concat(F.to_date("now").cast("string"), F.lit(" 13:05:00")))
    return tidy(day.filter(~C.is_partial(F.col("date"), at)).select("symbol", "date", "close", "volume"))


def _blackout(t: Tables) -> DataFrame:
    return Q.blackout(t.bars().select("symbol", "date"), t.events_cal(), t.calendar())


@query
def f11_blackout(spark, d):
    return tidy(_blackout(Tables(spark, d)))


def _watch(t: Tables) -> DataFrame:
    """Confirmed crossings as a watchlist: the newest per symbol."""
    rows = _levels(t).filter(K.confirmed(F.col("close"), F.col("level"), F.col("vr"), 1.2))
    newest = rows.groupBy("symbol").agg(F.max_by(F.struct("date", "level", "close", "bar_no"), "bar_no").alias("w"))
    return newest.select("symbol", F.col("w.date").alias("breakout_date"), F.col("w.level").alias("breakout_level"),
                         (F.col("w.close") / 20.0).alias("original_score"))


def _bars_after(t: Tables, k: int, watch: DataFrame | None = None) -> DataFrame:
    """Each symbol's bar `k` bars after its newest confirmed crossing."""
    w = (_watch(t) if watch is None else watch).select("symbol", "breakout_date")
    b = t.bars()
    at = b.join(w, ["symbol"]).filter(F.col("date") == F.col("breakout_date")).select("symbol", (F.col("bar_no") + k).alias("bar_no"))
    return b.join(at, ["symbol", "bar_no"]).select("symbol", "date", "close")


@query
def f12_failed_level(spark, d):
    t = Tables(spark, d)
    rows = _levels(t).select("symbol", "date", "close", "level", F.date_sub("date", (F.col("volume") % 6).cast("int") - 1).alias("since"))
    return tidy(rows.select("symbol", "date", K.failed_level(F.col("since"), F.col("level"), F.col("date"), F.col("close")).alias("failed")))


@query
def f13_retest(spark, d):
    rows = own_rows(Tables(spark, d).panel().withColumn("level", F.min("low").over(series().rowsBetween(-10, -1))))
    return tidy(rows.filter(K.retest(F.col("level"))).select("symbol", "date", "level", "close"))


@query
def f14_not_fired(spark, d):
    t = Tables(spark, d)
    cands = t.signals().select("symbol", "date", "level")
    return tidy(K.not_fired(cands, t.trades()))


@query
def f16_level_validity(spark, d):
    rows = _levels(Tables(spark, d)).filter("level is not null")
    stop = F.col("low") - (F.col("volume") % 3) * 2.0
    reason = Z.level_problem(F.col("close"), stop, F.col("high"), F.col("level"))
    return tidy(rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n")))


@query
def f17_period(spark, d):
    return tidy(A.filter_period(Tables(spark, d).trades(), F.lit("2000-06-30").cast("date"), "120d").filter(
        F.col("exit_date") <= F.lit("2000-06-30").cast("date")).select("symbol", "exit_date", "pnl_r"))


def _live(t: Tables) -> DataFrame:
    """Trades as the table looked on AS_OF: later ones absent, those not yet closed open."""
    day = F.lit("1999-06-30").cast("date")
    rows = t.trades().filter(F.col("entry_date") <= day)
    shut = F.col("exit_date") <= day
    blank = {c: F.when(shut, F.col(c)) for c in ("exit_date", "exit_price", "pnl_inr", "pnl_r", "gross_pnl_inr", "costs_inr", "days_held")}
    state = F.when(shut, F.col("state")).when(F.col("volume_ratio") > 1, "TARGET_1_HIT").otherwise("ENTERED")
    return rows.withColumns({**blank, "state": state})


@query
def f18_states(spark, d):
    return tidy(TR.open_trades(_live(Tables(spark, d))).select("symbol", "entry_date", "state"))


# ── joins ────────────────────────────────────────────────────────────────


def _context(t: Tables) -> DataFrame:
    """What the market looked like on each date: stress, mood, breadth, trend and regime."""
    return _regime_rows(t).select(
        "date", "vix", "market_mood", "regime", "regime_score", "breadth_pct", F.col("index_trend").alias("nifty_trend"), "risk_multiplier")


def _featured(t: Tables) -> DataFrame:
    """Trades with every feature known when they were entered; `volume_ratio_morning` is that of the session before."""
    keys = ["symbol", "entry_date"]
    t.stored_bars()
    trades = t.trades()
    bar = S.analysed(t.stored_bars(), extra_kernels=[lagged(("_volume", "volume", 1), ("_average", "vol_avg_20", 1))])
    bar = own_rows(bar.withColumn("volume_ratio_morning", F.try_divide("_volume", "_average"))).select(
        "symbol", F.col("date").alias("entry_date"), "stage", "tightness", "adv_cr", F.col("best")["confidence"].alias("pattern_confidence"), "volume_ratio_morning")
    rank = R.percentile_ranks(S.prepass(t.stored_bars()).select("symbol", "date", "ret_63"), ["date"], "ret_63").withColumnRenamed("date", "entry_date")
    rows = trades.join(bar, keys).join(rank.select(*keys, F.coalesce("rs_percentile", F.lit(0.0)).alias("rs_percentile")), keys)
    rows = rows.join(t.universe().select("symbol", "sector"), "symbol", "left")
    trends = _sector_trend_rows(t).select(F.col("date").alias("entry_date"), "sector", "sector_trend")
    rows = rows.join(trends, ["entry_date", "sector"], "left").join(_context(t).withColumnRenamed("date", "entry_date"), "entry_date", "left")
    dates = Q.blackout(trades.select("symbol", F.col("entry_date").alias("date")), t.events_cal(), t.calendar())
    rows = rows.join(dates.select("symbol", F.col("date").alias("entry_date"), F.col("blackout").alias("earnings_blackout")), keys, "left")
    return rows.withColumns({
        "sector_trend": F.coalesce("sector_trend", F.lit("flat")), "rs_points": M.rs_points(F.col("rs_percentile")),
        "extension_pct": Z.extension_pct(F.col("entry_price"), F.col("breakout_level")),
        "distance_pct": F.try_divide(F.col("breakout_level") - F.col("entry_price"), F.col("breakout_level")) * 100.0,
    })


def _snapshot(t: Tables) -> DataFrame:
    return _featured(t).select(
        F.col("id").alias("trade_id"), "symbol", F.col("entry_date").alias("alert_date"), "alert_type", "pattern", "score", "pattern_confidence",
        "stage", "rs_percentile", "rs_points", "tightness", "volume_ratio", "volume_ratio_morning", "sector", "sector_trend", "distance_pct",
        "extension_pct", "close_in_range", "atr_pct", "adv_cr", "earnings_blackout", "vix", "market_mood", "regime", "regime_score", "breadth_pct",
        "nifty_trend", "risk_multiplier", "breakout_level", "entry_price", "base_height",
    )


@query
def j1_alerts_with_outcomes(spark, d):
    t = Tables(spark, d)
    rows = A.alerts_with_outcomes(_snapshot(t).select("trade_id", "symbol", "alert_type", "extension_pct"), _live(t))
    return tidy(rows.withColumn("days_held", F.col("days_held").cast("double")))


@query
def j2_overlap(spark, d):
    b = Tables(spark, d).bars()
    return tidy(T.overlap(b.filter(F.col("bar_no") % 2 == 0), _late(b)))


@query
def j3_events_in_reach(spark, d):
    """How many rows of each symbol stand in a blackout when past announcements count too."""
    t = Tables(spark, d)
    rows = Q.blackout(t.bars().select("symbol", "date"), t.events_cal(), t.calendar(), allow_post=False)
    return tidy(rows.groupBy("symbol").agg(F.count_if("blackout").alias("n_blackout"), F.count("*").alias("n")))


@query
def j4_trade_bars(spark, d):
    t = Tables(spark, d)
    t.stored_bars()
    rows = TR.holding_bars(t.trades(), t.bars(), True)
    return tidy(rows.groupBy("symbol", "entry_date").agg(F.count("*").alias("n"), F.max("high").alias("high"), F.min("low").alias("low")))


@query
def j5_last_bar(spark, d):
    b = Tables(spark, d).bars()
    last = b.groupBy("symbol").agg(F.max_by(F.struct("date", "close"), "date").alias("l"))
    return tidy(last.select("symbol", "l.date", "l.close"))


@query
def j6_sector_lookup(spark, d):
    t = Tables(spark, d)
    u = t.universe().filter(F.col("sector") != "EUROPE")
    return tidy(A.with_sector(t.trades(), u).groupBy("sector").agg(F.count("*").alias("n")))


@query
def j7_market_wide(spark, d):
    t = Tables(spark, d)
    pre = S.prepass(t.bars())
    daily = X.breadth(pre).join(_moods(t).select("date", "vix"), "date", "full").join(_regime_rows(t).select("date", "regime", "risk_multiplier"), "date", "full")
    return tidy(pre.join(daily, "date", "left").select("symbol", "date", "close", "breadth_pct", "vix", "regime", "risk_multiplier"))


@query
def j8_semi_anti(spark, d):
    t = Tables(spark, d)
    fresh = Q.latest_dates(t.bars()).filter(F.col("latest") >= F.lit("2001-10-15").cast("date"))
    broken = Q.discontinuities(t.panel(), 0.04, 0.04)
    return tidy(t.bars().join(fresh, "symbol", "left_semi").join(broken, "symbol", "left_anti").select("symbol", "date", "close"))


def _returns(t: Tables) -> DataFrame:
    return own_rows(t.panel().withColumn("ret_1", I.daily_return())).select("symbol", "date", "bar_no", "ret_1")


def _candidates(t: Tables) -> DataFrame:
    """The day's signals with their sectors, worked out once: allocations read them several times."""
    if t._candidates is None:
        rows = t.signals().join(t.universe().select("symbol", "sector"), "symbol", "left")
        t._candidates = stored(rows.select("date", "symbol", "score", "sector", "bar_no", "close"), "candidates")
    return t._candidates


def _occupied(t: Tables) -> DataFrame:
    """Positions already held per date and sector, for the allocation queries."""
    return _candidates(t).groupBy("date", "sector").agg((F.count("*") % 3).alias("n_open"))


def _cohorts(t: Tables) -> DataFrame:
    got = K.allocate(_candidates(t).select("date", "symbol", "score", "sector"), _occupied(t))
    return got.filter("accepted").select("date", "symbol")


@query
def j9_pair_join(spark, d):
    """Pairs of positions opened on the same date; a book is bounded by the position limit."""
    c = _cohorts(Tables(spark, d))
    a, b = c.withColumnRenamed("symbol", "a"), c.withColumnRenamed("symbol", "b")
    return tidy(a.join(b, "date").filter(F.col("a") < F.col("b")).groupBy("date").agg(F.count("*").alias("pairs")))


@query
def j10_precedence_merge(spark, d):
    t = Tables(spark, d)
    proxy = _sector_trend_rows(t).select("date", "sector", "sector_trend")
    real = X.index_trends(_sector_index(t)).select("date", F.col("index_symbol").alias("sector"), F.col("trend").alias("sector_trend"))
    return tidy(X.prefer(real.filter("sector in ('ASIA', 'AFRICA')"), proxy, ["date", "sector"], "sector_trend"))


# ── aggregations ─────────────────────────────────────────────────────────


@query
def a1_performance(spark, d):
    return tidy(A.overall(Tables(spark, d).trades()))


@query
def a2_digest(spark, d):
    return tidy(A.digest(Tables(spark, d).trades()))


@query
def a3_score_bands(spark, d):
    return tidy(A.by_score_band(Tables(spark, d).trades()))


@query
def a4_by_sector(spark, d):
    t = Tables(spark, d)
    return tidy(A.by_sector(t.trades(), t.universe()))


@query
def a5_terciles(spark, d):
    return tidy(A.terciles(Tables(spark, d).trades(), ["volume_ratio"]))


@query
def a6_by_category(spark, d):
    return tidy(A.by_category(Tables(spark, d).trades(), "pattern"))


@query
def a7_feature_report(spark, d):
    return tidy(A.feature_report(stored(_featured(Tables(spark, d)), "featured")))


@query
def a8_full_report(spark, d):
    t = Tables(spark, d)
    return tidy(A.full_report(stored(_featured(t), "featured").drop("sector"), t.universe()))


@query
def a9_historic(spark, d):
    return tidy(A.historic(_live(Tables(spark, d))))


@query
def a10_breadth(spark, d):
    return tidy(X.breadth(S.prepass(Tables(spark, d).bars())))


def _sector_trend_rows(t: Tables) -> DataFrame:
    rows = S.prepass(t.bars()).join(t.universe().select("symbol", "sector"), "symbol", "left")
    return X.sector_trends(rows, "ret_63")


def _sector_index(t: Tables) -> DataFrame:
    rows = t.bars().join(t.universe().select("symbol", "sector"), "symbol")
    return rows.groupBy(F.col("sector").alias("index_symbol"), "date").agg(F.avg("close").alias("close"))


@query
def a11_sector_trends(spark, d):
    return tidy(_sector_trend_rows(Tables(spark, d)))


@query
def a12_mean_correlation(spark, d):
    t = Tables(spark, d)
    t.stored_bars()
    return tidy(X.mean_abs_correlation(_returns(t), _candidates(t).select("date", "symbol")))


@query
def a13_sector_exposure(spark, d):
    t = Tables(spark, d)
    u = t.universe().withColumn("sector", F.when(F.col("sector") != "AFRICA", F.col("sector")))
    return tidy(TR.sector_exposure(_live(t), u))


@query
def a14_portfolio_health(spark, d):
    t = Tables(spark, d)
    return tidy(TR.portfolio_health(t.trades(), t.bars().select("date").distinct()))


@query
def a15_gate_audit(spark, d):
    t = Tables(spark, d)
    th = Thresholds(min_adv_cr=0.004)
    u = t.universe().withColumns({"listing_date": F.lit(None).cast("date"), "promoter_pledge_pct": F.lit(None).cast("double")})
    last = own_rows(t.panel().withColumn("adv_cr", I.adv_crores())).filter("bar_no = n_bars")
    ev = t.events_cal().select("symbol").distinct().withColumn("has_event", F.lit(True))
    checked = last.join(ev, "symbol", "left").select(
        (F.col("adv_cr") < th.min_adv_cr).alias("adv_rejected"), F.coalesce("has_event", F.lit(False)).alias("has_event"))
    return tidy(Q.gate_audit(u, checked, th))


def _scan(t: Tables) -> DataFrame:
    """The whole morning scan, with sessions without a bar and with announcements."""
    return S.morning_scan(t.stored_bars(), t.universe(), TEST_SETTINGS, t.calendar(), t.events_cal())


@query
def a16_skip_funnel(spark, d):
    """First failing gate of every (symbol, session) of the morning scan, counted per year."""
    rows = _scan(Tables(spark, d)).withColumn("year", F.year("date").cast("long"))
    return tidy(Q.funnel(rows, F.col("gate"), ["year"]))


def _resent(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Cached bars, and a feed that re-sends the last ten bars of every tenth symbol after a 1:2 split."""
    b = t.bars()
    feed = b.filter((F.col("bar_no") > F.col("n_bars") - 10) & (F.col("symbol").cast("long") % 10 == 0)).withColumns({
        "open": F.col("open") * 0.5, "high": F.col("high") * 0.5, "low": F.col("low") * 0.5, "close": F.col("close") * 0.5,
        "volume": F.col("volume") * 2,
    })
    return b.filter(F.col("bar_no") <= F.col("n_bars") - 4), feed


@query
def a17_adjustment_ratio(spark, d):
    cached, feed = _resent(Tables(spark, d))
    return tidy(T.adjustment_factors(cached, feed))


@query
def a18_excursions(spark, d):
    t = Tables(spark, d)
    tr = t.trades()
    return tidy(TR.excursions(tr, t.bars()).join(tr.select("id", "symbol", "entry_date"), "id").drop("id"))


@query
def a19_latest(spark, d):
    return tidy(Tables(spark, d).bars().groupBy("symbol").agg(
        F.max("date").alias("latest"), F.datediff(F.lit("2002-01-01").cast("date"), F.max("date")).alias("age_days")))


# ── moving indicators ────────────────────────────────────────────────────


def _show(p: DataFrame, *cols) -> DataFrame:
    return tidy(own_rows(p).select("symbol", "date", *cols))


@query
def w1_sma(spark, d):
    return _show(Tables(spark, d).panel().withColumns({"sma_50": I.sma("close", 50), "sma_200": I.sma("close", 200)}), "sma_50", "sma_200")


@query
def w2_ema(spark, d):
    specs = [I.ema_spec("ema_12", "close", 12), I.ema_spec("ema_200", "close", 200)]
    return _show(run_kernels(smoothing_panel(Tables(spark, d).bars(), specs), [smoothing(specs)]), "ema_12", "ema_200")


@query
def w3_true_range(spark, d):
    return _show(Tables(spark, d).panel().withColumn("tr", I.true_range()), "tr")


@query
def w4_atr(spark, d):
    specs = [*I.atr_specs(14, 50, 100), Smooth("atr_raw", "tr", 1 / 14)]
    p = run_kernels(smoothing_panel(Tables(spark, d).bars(), specs).withColumn("tr", I.true_range()), [smoothing(specs)])
    p = p.withColumn("atr_14_seeded_60", warm(reseeded("atr_raw", "tr", 1 / 14, 60), 14))
    return _show(p, "atr_14", "atr_50", "atr_100", "atr_14_seeded_60")


@query
def w5_rsi(spark, d):
    p = run_kernels(I.direction_inputs(Tables(spark, d).panel()), [smoothing(I.rsi_specs())])
    return _show(p.withColumn("rsi", I.rsi()), "rsi")


@query
def w6_macd(spark, d):
    p = run_kernels(Tables(spark, d).panel(), [smoothing(I.macd_specs())])
    return _show(p.withColumns({"macd": I.macd_line(), "hist": I.macd_line() - F.col("macd_signal")}), "macd", "macd_signal", "hist")


@query
def w7_bollinger(spark, d):
    up, mid, low = I.bollinger()
    return _show(Tables(spark, d).panel().withColumns({"upper": up, "middle": mid, "lower": low}), "upper", "middle", "lower")


@query
def w8_band_width(spark, d):
    up, mid, low = I.bollinger()
    return _show(Tables(spark, d).panel().withColumns({"u": up, "m": mid, "l": low}).withColumn("width", (F.col("u") - F.col("l")) / F.col("m")), "width")


@query
def w9_volume_ratio(spark, d):
    return _show(Tables(spark, d).panel().withColumn("ratio", I.volume_ratio()), "ratio")


@query
def w10_volume_ratio_prior(spark, d):
    """The newest bar of each symbol counts as partial at 15:00 and is projected."""
    frac = C.volume_fraction(F.lit(345))
    v = F.when(F.col("bar_no") == F.col("n_bars"), C.projected_volume(F.col("volume"), frac)).otherwise(F.col("volume").cast("double"))
    return _show(Tables(spark, d).panel().withColumn("ratio", I.volume_ratio_prior(v)), "ratio")


@query
def w11_adx(spark, d):
    p = run_kernels(I.direction_inputs(Tables(spark, d).panel()), [smoothing(I.adx_specs())])
    return _show(p, "adx")


@query
def w12_standard_indicators(spark, d):
    cols = ["sma_50", "sma_150", "sma_200", "atr_14", "atr_10", "atr_50", "vol_avg_20", "volume_ratio_20"]
    return _show(I.with_standard(Tables(spark, d).panel()), *cols)


@query
def w13_period_return(spark, d):
    return _show(Tables(spark, d).panel().withColumn("ret_63", I.period_return(63)), "ret_63")


@query
def w14_tightness(spark, d):
    return _show(I.with_standard(Tables(spark, d).panel()).withColumn("tightness", I.tightness()), "tightness")


@query
def w15_index_trend(spark, d):
    t = Tables(spark, d)
    return tidy(X.index_trends(_sector_index(t).unionByName(B.index_series(t.bars()))))


@query
def w16_stage(spark, d):
    return _show(with_stage(Tables(spark, d).panel()), "stage")


def _moods(t: Tables) -> DataFrame:
    return X.moods(X.stress_gauge(S.prepass(t.bars())))


@query
def w17_vix_mood(spark, d):
    return tidy(_moods(Tables(spark, d)))


@query
def w18_pivots(spark, d):
    return tidy(V.pivots(Tables(spark, d).gap_panel(), 5).select("symbol", "date", "kind", "price"))


@query
def w19_pivot_strength(spark, d):
    b = Tables(spark, d).gap_bars()
    return tidy(V.pivot_strength(panel(b), b, 5).select("symbol", "date", "kind", "price", "strength"))


@query
def w20_last_pivots(spark, d):
    return tidy(V.last_pivots(V.pivots(Tables(spark, d).gap_panel(), 5), 3).select("symbol", "kind", "back", "date", "price"))


@query
def w21_confirmed_pivots(spark, d):
    """Pivots with the date on which they became known."""
    return tidy(V.pivots(Tables(spark, d).gap_panel(), 3).select("symbol", "date", "kind", "confirmed_on"))


@query
def w22_daily_progress(spark, d):
    t = Tables(spark, d)
    tr = t.trades()
    rows = TR.daily_progress(tr, t.bars()).join(tr.select("id", "symbol", "entry_date"), "id")
    total = F.aggregate("moves", F.lit(0.0), lambda s, m: s + m)
    return tidy(rows.select("symbol", "entry_date", "days_in_trade", F.get("moves", F.lit(0)).alias("first_move"), total.alias("sum_moves"), "daily_moves"))


@query
def w23_close_in_range(spark, d):
    return _show(Tables(spark, d).panel().withColumn("cir", I.close_in_range()), "cir")


# ── ranking ──────────────────────────────────────────────────────────────


@query
def r1_rs_percentile(spark, d):
    rows = S.prepass(Tables(spark, d).bars()).select("symbol", "date", "ret_63")
    return tidy(R.percentile_ranks(rows, ["date"], "ret_63"))


@query
def r2_relative_strength(spark, d):
    t = Tables(spark, d)
    ix = panel(B.index_series(t.bars()).withColumnRenamed("index_symbol", "symbol")).withColumn("bench", I.period_return(63))
    rows = S.prepass(t.bars()).join(own_rows(ix).select("date", "bench"), "date", "left")
    return tidy(rows.select("symbol", "date", X.relative_strength(F.col("ret_63"), F.col("bench")).alias("rs")))


@query
def r3_best_pattern(spark, d):
    p = P.with_patterns(Tables(spark, d).panel()).withColumn("best", P.best_pattern())
    return _show(p.filter("best is not null"), "best.pattern", "best.confidence", "best.breakout_level")


@query
def r4_slot_allocation(spark, d):
    t = Tables(spark, d)
    return tidy(K.allocate(_candidates(t).select("date", "symbol", "score", "sector"), _occupied(t), 8, 3))


@query
def r5_capacity_by_priority(spark, d):
    """Fresh crossings come before retests in the same book."""
    c = _candidates(Tables(spark, d)).select("date", "symbol", "score", "sector", (F.col("bar_no") % 2).alias("priority"))
    none = c.select("date", "sector").limit(0).withColumn("n_open", F.lit(0))
    return tidy(K.allocate(c, none, 5, 2))


@query
def r5_living_book(spark, d):
    """A book of three positions, one per sector, that lives from day to day: what the replay's trades would find room for."""
    t = Tables(spark, d)
    c = t.trades().join(t.universe().select("symbol", "sector"), "symbol", "left")
    return tidy(K.living_book(c.select(F.col("entry_date").alias("date"), "symbol", "score", "sector", "exit_date"), 3, 1))


@query
def daily_runs(spark, d):
    """Pre-close and end-of-day runs of all days: crossings of the highest high of 20 bars as setups, sizes scaled by the day's stress."""
    t = Tables(spark, d)
    t.stored_bars()
    before = series().rowsBetween(-20, -1)
    # windows over the plain bars go before the grouped map, whose exchange they share
    p, top = t.panel().withColumn("bad", Q.bad_move()), F.max("high").over(before)
    p = p.withColumns({
        "continuous": Q.continuous(), "level": F.when(F.col("bar_no") > 20, top), "base_height": top - F.min("low").over(before),
        "volume_ratio": F.when(F.col("bar_no") > 20, F.try_divide(F.col("volume"), F.avg("volume").over(before))),
    }).drop("bad")
    rows = own_rows(I.with_standard(p)).withColumns({
        "pattern": F.lit("channel"), "score": F.coalesce(I.close_in_range() * 40.0 + 38.0, F.lit(38.0)),
    })
    days = stored(_regime_rows(t).select("date", F.col("stress_multiplier").alias("risk_multiplier")), "stress")

    def facts(some):
        some = some.join(t.universe().select("symbol", "sector"), "symbol", "left").join(monday_after(t.calendar()), "date", "left")
        return some.join(days, "date", "left")

    return tidy(DY.trading_days(rows, TEST_SETTINGS, facts=facts, bars=t.bars()))


@query
def r6_latest_k(spark, d):
    return tidy(IO.read_prices(Tables(spark, d).bars(), 5).select("symbol", "date", (F.col("n_bars") - F.col("bar_no") + 1).alias("back")))


# ── patterns ─────────────────────────────────────────────────────────────


def _pattern(p: DataFrame, name: str, *notes) -> DataFrame:
    rows = P.pattern_rows(P.with_patterns(p, [name]), [name])
    return tidy(rows.select("symbol", "date", "confidence", "breakout_level", "base_start_no", "base_height",
                            *[F.col("notes")[n].alias(n) for n in notes]))


@query
def p1_fifty_two_week_high(spark, d):
    b = Tables(spark, d).bars()
    rows = P.with_base_start(P.pattern_rows(P.with_patterns(panel(b), ["fifty_two_week_high"]), ["fifty_two_week_high"]), b)
    return tidy(rows.select("symbol", "date", "confidence", "breakout_level", "base_start_date", "base_height",
                            F.col("notes")["touches_in_6mo"].alias("touches")))


@query
def p2_darvas_box(spark, d):
    return _pattern(Tables(spark, d).panel(), "darvas_box", "touches", "window_len", "floor")


@query
def p3_nr7(spark, d):
    return _pattern(Tables(spark, d).gap_panel(), "nr7", "near_pivot_high", "volume_contraction")


@query
def p4_inside_bar(spark, d):
    return _pattern(Tables(spark, d).panel(), "inside_bar", "inside_ratio", "also_nr7")


@query
def p5_bollinger_squeeze(spark, d):
    return _pattern(Tables(spark, d).panel(), "bollinger_squeeze", "bb_width", "median_width_6mo")


@query
def p6_ascending_triangle(spark, d):
    return _pattern(Tables(spark, d).gap_panel(), "ascending_triangle", "support_r2", "n_resistance_touches", "n_high_pivots", "n_low_pivots")


@query
def p7_vcp(spark, d):
    return _pattern(Tables(spark, d).gap_panel(), "vcp", "volume_decreasing", "n_contractions")


@query
def p8_cup_and_handle(spark, d):
    return _pattern(Tables(spark, d).panel(), "cup_and_handle", "left_lip", "bottom", "handle_len")


@query
def p9_flag(spark, d):
    return _pattern(Tables(spark, d).panel(), "flag", "pole_len", "flag_len", "pole_move")


@query
def p10_detect_all(spark, d):
    """All enabled patterns as rows; names that do not exist are ignored."""
    names = ["unknown_pattern", *PATTERN_ORDER]
    return tidy(P.pattern_rows(P.with_patterns(Tables(spark, d).panel(), names), names).select("symbol", "date", "pattern", "confidence"))


# ── scoring and sizing expressions ───────────────────────────────────────


@query
def m1_rs_points(spark, d):
    rows = R.percentile_ranks(S.prepass(Tables(spark, d).bars()).select("symbol", "date", "ret_63"), ["date"], "ret_63")
    return tidy(rows.select("symbol", "date", M.rs_points(F.col("rs_percentile")).alias("points")))


@query
def m2_tightness_points(spark, d):
    p = I.with_standard(Tables(spark, d).panel())
    return _show(p.withColumn("points", M.tightness_points(I.tightness())), "points")


@query
def m3_volume_points(spark, d):
    return _show(Tables(spark, d).panel().withColumn("points", M.volume_points(F.coalesce(I.volume_ratio(), F.lit(1.0)))), "points")


@query
def m4_extension_penalty(spark, d):
    rows = _levels(Tables(spark, d))
    return tidy(rows.select("symbol", "date", M.extension_penalty(Z.extension_pct(F.col("close"), F.col("level"))).alias("penalty")))


@query
def m5_close_points(spark, d):
    return _show(Tables(spark, d).panel().withColumn("points", M.close_points(I.close_in_range())), "points")


def _scored(t: Tables) -> DataFrame:
    """52-week-high matches with all score inputs of their bar."""
    t.stored_bars()
    pre = S.prepass(t.bars()).select("symbol", "date", "ret_63").join(t.universe().select("symbol", "sector"), "symbol", "left")
    pct = R.percentile_ranks(pre.select("symbol", "date", "ret_63"), ["date"], "ret_63").select("symbol", "date", "rs_percentile")
    trend = X.sector_trends(pre, "ret_63").select("date", "sector", "sector_trend")
    # one grouped map, which hands back the matches only
    p = I.with_standard(peaks(t.panel()), [slope_kernel(), year_high_kernel()], lambda f: f["own"].to_numpy(bool) & f["year_confidence"].notna().to_numpy())
    p = with_stage(P.fifty_two_week_high(p))
    p = p.withColumns({"tightness": I.tightness(), "cir": I.close_in_range()})
    rows = own_rows(p).withColumn("m", F.col("p_fifty_two_week_high")).filter("m is not null")
    rows = rows.join(t.universe().select("symbol", "sector"), "symbol", "left")
    rows = rows.join(pct, ["symbol", "date"], "left").join(trend, ["date", "sector"], "left")
    return rows.withColumns({
        "rs_pts": M.rs_points(F.col("rs_percentile")), "vr": F.coalesce("volume_ratio_20", F.lit(1.0)),
        "conf": F.col("m.confidence"), "level": F.col("m.breakout_level"),
    })


@query
def m6_composite_score(spark, d):
    rows = _scored(Tables(spark, d))
    null = F.lit(None).cast("double")
    c = F.col
    score = M.composite_score(c("conf"), c("rs_pts"), c("vr"), c("tightness"), c("sector_trend"), null, null, c("stage") == "STAGE_2")
    return tidy(rows.select("symbol", "date", score.alias("score")))


@query
def m7_rescore(spark, d):
    """The score at confirmation: extension above the level and the close's place in the bar now count."""
    rows = _scored(Tables(spark, d))
    c = F.col
    score = M.composite_score(c("conf"), c("rs_pts"), c("vr"), c("tightness"), c("sector_trend"),
                              Z.extension_pct(c("close"), c("level")), c("cir"), F.lit(True))
    return tidy(rows.select("symbol", "date", score.alias("score")))


@query
def m8_classify_sector(spark, d):
    docs = Tables(spark, d).documents
    return tidy(docs.select("doc_id", M.classify_sector(F.col("text")).alias("sector")))


def _regime_rows(t: Tables, r: Regime = Regime()) -> DataFrame:
    pre = S.prepass(t.bars())
    trends = X.index_trends(B.index_series(t.bars()), r.index_sma, r.index_slope_lookback)
    return X.regimes(pre.select("date").distinct(), trends, X.breadth(pre), _moods(t), r)


@query
def m9_regime(spark, d):
    return tidy(_regime_rows(Tables(spark, d)).select("date", "index_trend", "market_mood", "regime_score", "regime", "risk_multiplier"))


@query
def m10_stress_multiplier(spark, d):
    return tidy(_regime_rows(Tables(spark, d)).select("date", "stress_multiplier"))


@query
def f19_market_tradeable(spark, d):
    return tidy(_moods(Tables(spark, d)).select("date", "tradeable"))


@query
def m11_sector_multiplier(spark, d):
    held = _candidates(Tables(spark, d)).groupBy("date", "sector").agg(F.count("*").alias("n"))
    return tidy(held.select("date", "sector", M.sector_multiplier(F.col("n")).alias("multiplier")))


@query
def m12_correlated_size(spark, d):
    t = Tables(spark, d)
    t.stored_bars()
    corr = X.mean_abs_correlation(_returns(t), _cohorts(t))
    held = _occupied(t).select(F.col("date").alias("entry_date"), "sector", "n_open")
    rows = t.trades().join(corr, F.col("entry_date") == F.col("date")).join(t.universe().select("symbol", "sector"), "symbol", "left")
    rows = rows.join(held, ["entry_date", "sector"], "left")
    size = M.correlated_size(F.col("shares"), F.col("avg_correlation"), M.sector_multiplier(F.col("n_open")))
    return tidy(rows.select("symbol", "entry_date", size.alias("size")))


@query
def m13_stop_targets(spark, d):
    s = Tables(spark, d).signals().withColumn("stop", Z.stop_level(F.col("level"), F.col("atr_14"), 1.5))
    t1, t2 = Z.targets(F.col("close"), F.col("stop"), F.col("base_height"))
    return tidy(s.select("symbol", "date", "stop", t1.alias("target_1"), t2.alias("target_2")))


@query
def m14_position_size(spark, d):
    s = Tables(spark, d).signals()
    stop = Z.stop_level(F.col("level"), F.col("atr_14"), 1.5)
    return tidy(s.select("symbol", "date", Z.position_size(F.col("close"), stop).alias("shares"),
                         Z.position_size(F.col("close"), stop, multiplier=0.5).alias("half")))


@query
def m15_gap_aware_stop(spark, d):
    t = Tables(spark, d)
    rows = t.signals().join(monday_after(t.calendar()), "date", "left")
    mult = Z.stop_multiplier(F.col("date"), F.coalesce("monday_open", F.lit(True)))
    return tidy(rows.select("symbol", "date", mult.alias("multiplier"), Z.stop_level(F.col("level"), F.col("atr_14"), mult).alias("stop")))


@query
def m16_costs(spark, d):
    li = Tables(spark, d).lineitem
    entry, exit_ = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")
    cost = Z.round_trip_cost(entry, exit_, F.col("l_quantity"))
    share = Z.round_trip_cost(entry, exit_, F.lit(1.0))
    return tidy(li.groupBy("l_suppkey").agg(F.sum(F.round(cost, 4).cast("decimal(20,4)")).cast("double").alias("cost"),
                                            F.max(share).alias("max_share")))


@query
def m17_settlement(spark, d):
    return tidy(Tables(spark, d).trades().select("symbol", "entry_date", "gross_pnl_inr", "costs_inr", "pnl_inr", "pnl_r"))


@query
def m18_extension_atr_pct(spark, d):
    return tidy(_snapshot(Tables(spark, d)).select("symbol", "alert_date", "extension_pct", "atr_pct"))


# ── calendar and session ─────────────────────────────────────────────────


@query
def d1_trading_days(spark, d):
    return tidy(Tables(spark, d).calendar().select("date", "trading"))


@query
def d2_previous_trading_day(spark, d):
    return tidy(Tables(spark, d).calendar().select("date", "prev_trading"))


@query
def d3_last_completed_session(spark, d):
    t = Tables(spark, d)
    now = F.to_timestamp(F.concat(F.col("date").cast("string"), F.format_string(" %02d:45:00", F.dayofyear("date") % 24)))
    cal = t.calendar().withColumn("now", now)
    return tidy(cal.select("now", last_completed_session(F.hour("now") * 60 + F.minute("now")).alias("session")))


@query
def d4_business_days(spark, d):
    t = Tables(spark, d)
    cal = t.calendar().select("date", "biz_no")
    o = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    ship = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.min("l_shipdate")).alias("ship"))
    rows = o.join(ship, "o_orderkey").join(cal.withColumnRenamed("biz_no", "a"), "date").join(
        cal.select(F.col("date").alias("ship"), F.col("biz_no").alias("b")), "ship")
    return tidy(rows.select("o_orderkey", business_days_between(F.col("a"), F.col("b")).alias("days")))


@query
def d5_volume_fraction(spark, d):
    at = C.local_time(F.col("ts"))
    return tidy(Tables(spark, d).events.select("event_id", C.volume_fraction(C.minutes_into_session(at)).alias("fraction")))


@query
def d6_projected_volume(spark, d):
    frac = C.volume_fraction(C.minutes_into_session(C.local_time(F.col("ts"))))
    return tidy(Tables(spark, d).events.select("event_id", C.projected_volume(F.col("value"), frac).alias("projected")))


@query
def d7_volume_profile(spark, d):
    ticks = Tables(spark, d).events.select(F.col("event_type").alias("symbol"), "ts", F.lit(1).alias("size"))
    return tidy(volume_profile(ticks))


# ── sorts and sets ───────────────────────────────────────────────────────


@query
def k1_watchlist_order(spark, d):
    return tidy(_candidates(Tables(spark, d)).select("date", "symbol", "score").orderBy(F.desc("score"), "symbol", "date"))


@query
def k2_universe_order(spark, d):
    return tidy(Tables(spark, d).universe().select("symbol", "company_name", "industry").orderBy("symbol"))


@query
def k4_top_matches(spark, d):
    """Three most confident matches per symbol."""
    rows = P.pattern_rows(P.with_patterns(Tables(spark, d).panel()))
    best = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "bar_no", "pattern")))
    part = rows.groupBy("symbol", F.floor(F.col("bar_no") / 64).alias("b")).agg(F.slice(best, 1, 3).alias("t"))
    top = part.groupBy("symbol").agg(F.slice(F.array_sort(F.flatten(F.collect_list("t"))), 1, 3).alias("t"))
    return tidy(top.select("symbol", F.inline("t")).select("symbol", (-F.col("c")).alias("confidence"), "bar_no", "pattern"))


@query
def u1_union_aligned(spark, d):
    t = Tables(spark, d)
    types = {"symbol": "string", "date": "date", "close": "double", "note": "string"}
    a = T.align(t.bars(), list(types), types)
    e = T.align(t.events_cal().withColumn("note", F.lit("event")), list(types), types)
    return tidy(a.unionByName(e))


@query
def u2_difference_intersection(spark, d):
    t = Tables(spark, d)
    ship = t.lineitem.select(F.to_date("l_shipdate").alias("date")).distinct()
    order = t.orders.select(F.to_date("o_orderdate").alias("date")).distinct()
    only = ship.exceptAll(order).withColumn("side", F.lit("only_ship"))
    return tidy(only.unionByName(ship.intersect(order).withColumn("side", F.lit("both"))))


@query
def u3_union_distinct(spark, d):
    t = Tables(spark, d)
    return tidy(t.holidays().union(t.events_cal().select("date")).distinct())


# ── table maintenance ────────────────────────────────────────────────────


@query
def t1_rebase_prices(spark, d):
    cached, feed = _resent(Tables(spark, d))
    return tidy(T.upsert_prices(cached, feed).select("symbol", "date", "open", "high", "low", "close", "volume"))


@query
def t2_rebase_trades(spark, d):
    t = Tables(spark, d)
    t.stored_bars()
    cached, feed = _resent(t)
    return tidy(T.rebase_trades(_live(t), T.adjustment_factors(cached, feed)).select(
        "symbol", "entry_date", "state", "entry_price", "stop_loss", "target_2", "shares"))


@query
def t3_repair_scan(spark, d):
    t = Tables(spark, d)
    t.stored_bars()
    return tidy(T.needs_repair(Q.discontinuities(t.panel(), 0.035, 0.035), _live(t)))


@query
def t4_backfill_progress(spark, d):
    """Progress columns of every trade, written back onto the table."""
    t = Tables(spark, d)
    tr = t.trades()
    got = T.patch(tr.withColumns({"days_in_trade": F.lit(None).cast("string"), "max_favorable": F.lit(None).cast("double")}),
                  TR.daily_progress(tr, t.bars()).select("id", "days_in_trade").join(
                      TR.excursions(tr, t.bars()).select("id", "max_favorable"), "id", "full"), "id")
    return tidy(got.select("symbol", "entry_date", "days_in_trade", "max_favorable"))


@query
def t5_flag_failed(spark, d):
    t = Tables(spark, d)
    t.stored_bars()
    watch = stored(_watch(t), "watch")
    failed, rest = T.flag_failed(watch, _bars_after(t, 1, watch))
    none = F.lit(None).cast("string")
    return tidy(failed.select("symbol", "breakout_date", F.col("failure_date").cast("string").alias("failure_date")).unionByName(
        rest.select("symbol", "breakout_date", none.alias("failure_date"))))


@query
def t6_feature_snapshot(spark, d):
    return tidy(_snapshot(Tables(spark, d)))


# ── state and streams ────────────────────────────────────────────────────


@query
def x1_settle(spark, d):
    """Every open trade against its symbol's bar two bars after entry."""
    t = Tables(spark, d)
    t.stored_bars()
    tr = t.trades().withColumn("state", F.when(F.col("entry_no") % 3 == 0, "TARGET_1_HIT").otherwise("ENTERED"))
    tr = tr.withColumns({"symbol": F.concat_ws("@", "symbol", "entry_no"), "key": F.col("symbol")}).drop(
        "exit_price", "exit_date", "days_held", "gross_pnl_inr", "costs_inr", "pnl_inr", "pnl_r")
    at = tr.select(F.col("key").alias("symbol"), (F.col("entry_no") + 2).alias("bar_no"), F.col("symbol").alias("trade"))
    day = t.bars().join(at, ["symbol", "bar_no"]).drop("symbol").withColumnRenamed("trade", "symbol")
    return tidy(TR.settle(tr, day).select(F.col("key").alias("symbol"), "entry_date", "new_state", "exit_price",
                                           F.col("days_held").cast("double").alias("days_held"), "pnl_inr", "pnl_r"))


@query
def x2_label_outcomes(spark, d):
    rows = TR.label_outcomes(Tables(spark, d).signals())
    return tidy(rows.select("symbol", "entry_date", "exit_date", "state", "exit_price", "bars_held", "shares", "pnl_r"))


@query
def x3_replay(spark, d):
    return tidy(Tables(spark, d).trades().select("symbol", "entry_date", "exit_date", "state", "exit_price"))


@query
def x3_replay_default_signal(spark, d):
    """The full scanner's own signal, all nine patterns, replayed over every bar."""
    tr = S.replay(S.analysed(Tables(spark, d).bars(), TEST_SETTINGS), s=TEST_SETTINGS)
    return tidy(tr.select("symbol", "entry_date", "exit_date", "pattern", "score", "state", "exit_price", "pnl_r"))


@query
def morning_scan_gates(spark, d):
    """Gate and score of the whole scan for every (symbol, session)."""
    return tidy(_scan(Tables(spark, d)).select("symbol", "date", "stage", "gate", "score", "rs_percentile", "earnings_blackout"))


@query
def x4_stream_tracker(spark, d):
    t = Tables(spark, d)
    bars = t.stored_bars()
    return tidy(ST.track_trades(spark, t.trades(), bars))


@query
def x5_stream_bars(spark, d):
    return tidy(ST.stream_event_bars(spark, d))


def _messages(b: DataFrame) -> DataFrame:
    """Re-sent bars as messages, a third of them sent twice."""
    sent = _late(b).withColumn("arrival", F.unix_date("date").cast("long"))
    return sent.unionByName(sent.filter(F.col("volume") % 3 == 0))


@query
def x6_stream_upsert(spark, d):
    b = Tables(spark, d).bars()
    return tidy(ST.stream_upsert(spark, b.filter(F.col("bar_no") <= F.col("n_bars") - 5), _messages(b), batches=3).select("symbol", "date", "close", "volume"))


@query
def x6_stream_counts(spark, d):
    """What became of the messages of the stream above."""
    return tidy(ST.resent_bars(spark, _messages(Tables(spark, d).bars()), batches=3)[1])


@query
def x7_stream_confirm(spark, d):
    t = Tables(spark, d)
    rows = _levels(t).select("symbol", "date", "close", "vr")
    return tidy(ST.stream_confirm(spark, rows, _watch(t)))


@query
def x8_expiring_watchlist(spark, d):
    return tidy(T.prune(_watch(Tables(spark, d)), "breakout_date", F.lit("2000-03-31").cast("date"), 400))


@query
def x8_stream_watchlist(spark, d):
    """Change log of a watchlist over the stream of confirmed crossings, whose entries live 20 days unless the symbol falls 10 % below its level."""
    rows = stored(_levels(Tables(spark, d)).select("symbol", "date", "close", "level", "vr"), "levels")
    adds = rows.filter(K.confirmed(F.col("close"), F.col("level"), F.col("vr"), 1.2)).select(
        "symbol", "date", F.col("date").alias("breakout_date"), F.col("level").alias("breakout_level"), (F.col("close") / 20.0).alias("original_score"))
    gone = rows.filter(F.col("close") < 0.9 * F.col("level")).select("symbol", "date")
    return tidy(ST.stream_watchlist(spark, adds, gone, 20).drop("turn"))
