"""Independent SQL statements of the queries, for DuckDB over the same tables.

Shared building blocks are common table expressions; a statement pulls in only those it names. Nothing here is used
by the library.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}
BODIES: dict[str, str] = {}
COLUMNS: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def _order(sql: str) -> list[str]:
    """The building blocks a statement uses, each after those it builds on."""
    done: list[str] = []

    def visit(text: str, stack: tuple) -> None:
        for name in CTES:
            if name in done or name in stack or not re.search(rf"\b{name}\b", text):
                continue
            visit(CTES[name], (*stack, name))
            done.append(name)

    visit(sql, ())
    return done


def oracle(name: str, cols: str, body: str) -> None:
    """`cols` lists output columns with a kind: plain text, :f double, :d date, :i integer, :b boolean, :t timestamp."""
    BODIES[name], COLUMNS[name] = body, cols


def statement(name: str) -> str:
    out = []
    for c in COLUMNS[name].split():
        n, _, kind = c.partition(":")
        out.append({
            "": n, "f": f"round(CAST({n} AS DOUBLE), 6) + 0.0 AS {n}", "d": f"CAST(CAST({n} AS DATE) AS VARCHAR) AS {n}",
            "i": f"CAST({n} AS BIGINT) AS {n}", "b": f"CAST({n} AS BOOLEAN) AS {n}",
            "t": f"strftime({n}, '%Y-%m-%d %H:%M:%S') AS {n}",
        }[kind])
    used = _order(BODIES[name])
    head = "WITH RECURSIVE " + ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in used) + " " if used else ""
    return f"{head}SELECT {', '.join(out)} FROM ({BODIES[name]}) AS result"


W = "PARTITION BY symbol ORDER BY bar_no"


def over(lo: int, hi: int = 0) -> str:
    a = f"{-lo} PRECEDING" if lo < 0 else ("CURRENT ROW" if lo == 0 else f"{lo} FOLLOWING")
    b = f"{-hi} PRECEDING" if hi < 0 else ("CURRENT ROW" if hi == 0 else f"{hi} FOLLOWING")
    return f"OVER ({W} ROWS BETWEEN {a} AND {b})"


def last(n: int) -> str:
    return over(-(n - 1))


def warm(expr: str, n: int) -> str:
    return f"CASE WHEN bar_no >= {n} THEN {expr} END"


def ema(x: str, alpha: str, start: int = 1, since: int | None = None) -> str:
    """Closed form of exponential smoothing started at bar `start`, shown from bar `since` on."""
    k = f"(bar_no - {start})"
    body = (
        f"pow(1 - {alpha}, {k}) * sum(CASE WHEN bar_no = {start} THEN {x} WHEN bar_no > {start} "
        f"THEN {alpha} * {x} * pow(1 - {alpha}, -{k}) END) OVER ({W} ROWS UNBOUNDED PRECEDING)"
    )
    return warm(body, since or start)


# ── building blocks ──────────────────────────────────────────────────────

cte("lines_", """SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, l_quantity AS q,
 row_number() OVER w AS rn, 1500 + sum(l_quantity - 25.5) OVER (w ROWS UNBOUNDED PRECEDING) AS p FROM lineitem
 WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity)""")
cte("days_", """SELECT symbol, date, arg_min(p - q + 25.5, rn) AS o, arg_min(p, rn) AS o2, max(p) AS mx, min(p) AS mn,
 arg_max(p, rn) AS close, CAST(sum(q) AS BIGINT) AS volume FROM lines_ GROUP BY symbol, date""")
cte("bars", """SELECT symbol, date, o AS open, greatest(o, mx) AS high, least(o, mn) AS low, close, volume,
 row_number() OVER (PARTITION BY symbol ORDER BY date) AS bar_no, count(*) OVER (PARTITION BY symbol) AS n_bars FROM days_""")
cte("gbars", """SELECT symbol, date, o2 AS open, mx AS high, mn AS low, close, volume,
 row_number() OVER (PARTITION BY symbol ORDER BY date) AS bar_no, count(*) OVER (PARTITION BY symbol) AS n_bars FROM days_""")
cte("uni", """SELECT CAST(s_suppkey AS VARCHAR) AS symbol, s_name AS company_name, r_name AS sector, n_name AS industry,
 s_acctbal AS market_cap_cr FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
cte("evcal", """SELECT CAST(l_suppkey AS VARCHAR) AS symbol, min(CAST(o_orderdate AS DATE)) AS date FROM lineitem
 JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY l_suppkey, date_trunc('month', o_orderdate)""")
cte("hols", """SELECT CAST(o_orderdate AS DATE) AS date FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_totalprice > 400000) >= 3""")
cte("cal0", """SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT
 CAST(CAST(min(l_shipdate) AS DATE) - 60 AS TIMESTAMP) AS lo, CAST(CAST(max(l_shipdate) AS DATE) + 60 AS TIMESTAMP) AS hi FROM lineitem)""")
cte("cal1", """SELECT date, isodow(date) < 6 AS weekday, isodow(date) < 6 AND date NOT IN (SELECT date FROM hols) AS trading FROM cal0""")
cte("cal", """SELECT date, weekday, trading, coalesce(max(CASE WHEN trading THEN date END) OVER (ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
 date - 1) AS prev_trading, coalesce(sum(CASE WHEN weekday THEN 1 ELSE 0 END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS biz_no FROM cal1""")
RET63 = f"CASE WHEN lag(close, 63) OVER ({W}) > 0 THEN close / lag(close, 63) OVER ({W}) - 1.0 END"
cte("base", f"""SELECT *, lag(close) OVER ({W}) AS pc, {RET63} AS ret_63,
 CASE WHEN lag(close) OVER ({W}) > 0 THEN close / lag(close) OVER ({W}) - 1.0 END AS ret_1,
 {warm(f'avg(close) {last(50)}', 50)} AS sma_50, {warm(f'avg(close) {last(150)}', 150)} AS sma_150,
 {warm(f'avg(close) {last(200)}', 200)} AS sma_200, {warm(f'avg(volume) {last(20)}', 20)} AS vol_avg_20,
 greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) AS tr,
 CASE WHEN high > low THEN (close - low) / (high - low) END AS cir,
 coalesce({warm(f'avg(close * volume) {last(20)}', 20)} / 1e7, 0) AS adv_cr FROM bars""")
cte("atrs", f"""SELECT *, {ema('tr', '(1.0/14)', 1, 14)} AS atr_14, {ema('tr', '(1.0/10)', 1, 10)} AS atr_10,
 {ema('tr', '(1.0/50)', 1, 50)} AS atr_50, volume / vol_avg_20 AS volume_ratio_20 FROM base""")
cte("ranks", """SELECT *, CASE WHEN ret_63 IS NOT NULL THEN CASE WHEN count(ret_63) OVER (PARTITION BY date) = 1 THEN 50.0 ELSE
 (rank() OVER (PARTITION BY date ORDER BY ret_63 NULLS LAST) - 1 + (count(*) OVER (PARTITION BY date, ret_63) - 1) / 2.0)
 / (count(ret_63) OVER (PARTITION BY date) - 1) * 100.0 END END AS rs_percentile FROM base""")
cte("secmed", """SELECT date, sector, median(ret_63) AS median_return, CASE WHEN median(ret_63) > 0.02 THEN 'up'
 WHEN median(ret_63) < -0.02 THEN 'down' ELSE 'flat' END AS sector_trend FROM base JOIN uni USING (symbol)
 WHERE ret_63 IS NOT NULL GROUP BY date, sector""")
cte("breadth", """SELECT date, avg(CASE WHEN sma_50 IS NOT NULL THEN CASE WHEN close > sma_50 THEN 1.0 ELSE 0.0 END END) * 100 AS breadth_pct FROM base GROUP BY date""")
cte("gauge", "SELECT date, stddev_pop(ret_1) * 2000 AS vix FROM base GROUP BY date HAVING count(ret_1) > 0")
cte("moods", """SELECT date, vix, va AS vix_avg, CASE WHEN va <= 0 THEN 'neutral' WHEN vix >= va * 1.25 THEN 'risk_off' WHEN vix <= va * 0.85 THEN 'risk_on'
 ELSE 'neutral' END AS market_mood, vix <= 25 AS tradeable FROM (SELECT *, avg(vix) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS va FROM gauge)""")
cte("stg0", f"""SELECT *, lag(sma_150, 49) OVER ({W}) AS prior_, lag(sma_150, 149) OVER ({W}) AS older_,
 max(close) {last(50)} AS pk, max(close) {over(-99, -50)} AS pk0 FROM atrs""")
cte("stg", """SELECT *, CASE WHEN bar_no < 200 THEN 'UNKNOWN' WHEN close > sma_150 AND sl > 0.0005 AND pk > pk0 THEN 'STAGE_2'
 WHEN close <= sma_150 AND sl < -0.0005 THEN 'STAGE_4' WHEN abs(sl) <= 0.0005 THEN CASE WHEN older_ IS NOT NULL AND older_ <= prior_ THEN 'STAGE_3' ELSE 'STAGE_1' END
 WHEN close > sma_150 THEN 'STAGE_3' ELSE 'STAGE_4' END AS stage FROM (SELECT *, (sma_150 - prior_) / prior_ / 50 AS sl FROM stg0)""")
cte("lev", f"""SELECT *, max(high) {over(-60, -1)} AS level, CASE WHEN bar_no > 20 THEN volume / avg(volume) {over(-20, -1)} END AS vr FROM base""")


def index_trends(name: str, src: str, n: int, k: int) -> None:
    w = "PARTITION BY index_symbol ORDER BY date"
    cte(name, f"""SELECT *, CASE WHEN rn < {n + k} OR past_ IS NULL OR past_ <= 0 THEN 'flat' WHEN close > sma AND (sma - past_) / past_ > 0.005 THEN 'up'
 WHEN close <= sma AND (sma - past_) / past_ < -0.005 THEN 'down' ELSE 'flat' END AS trend FROM (SELECT *, lag(sma, {k}) OVER ({w}) AS past_ FROM
 (SELECT *, row_number() OVER ({w}) AS rn, CASE WHEN row_number() OVER ({w}) >= {n} THEN avg(close) OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS sma FROM {src}))""")


cte("allix", "SELECT 'ALL' AS index_symbol, date, avg(close) AS close FROM bars GROUP BY date")
cte("secix", "SELECT sector AS index_symbol, date, avg(close) AS close FROM bars JOIN uni USING (symbol) GROUP BY sector, date")
cte("bothix", "SELECT * FROM allix UNION ALL SELECT * FROM secix")
index_trends("ixall", "bothix", 50, 20)
index_trends("ix200", "allix", 200, 20)
cte("reg", """SELECT *, CASE WHEN regime_score >= 2 THEN 'risk_on' WHEN regime_score <= -2 THEN 'risk_off' ELSE 'neutral' END AS regime,
 CASE WHEN regime_score = -3 THEN 0.25 WHEN regime_score = -2 THEN 0.5 ELSE 1.0 END AS risk_multiplier FROM (
 SELECT b.date, x.trend AS index_trend, coalesce(m.market_mood, 'neutral') AS market_mood, m.vix, b.breadth_pct,
 CASE x.trend WHEN 'up' THEN 1 WHEN 'down' THEN -1 ELSE 0 END + CASE WHEN b.breadth_pct >= 60 THEN 1 WHEN b.breadth_pct <= 40 THEN -1 ELSE 0 END
 + CASE m.market_mood WHEN 'risk_on' THEN 1 WHEN 'risk_off' THEN -1 ELSE 0 END AS regime_score
 FROM breadth b JOIN ix200 x USING (date) LEFT JOIN moods m USING (date))""")

# signals, labels and the sequential choice
cte("sig", f"""SELECT *, top_ AS level, top_ - low_ AS base_height, CASE WHEN close > open THEN 'up_bar' WHEN close < open THEN 'down_bar' END AS pattern,
 coalesce(cir * 40 + 58, 58) AS score, CASE WHEN volume % 2 = 0 THEN 'BREAKOUT' ELSE 'PULLBACK_ENTRY' END AS alert_type, top_ - 1.5 * atr_14 AS stop_loss
 FROM (SELECT *, max(high) {last(252)} AS top_, min(low) {last(126)} AS low_ FROM atrs) WHERE bar_no >= 252 AND (top_ - close) / top_ <= 0.02""")
cte("lab0", """SELECT *, close + 2.0 * abs(close - stop_loss) AS target_1, close + base_height AS target_2,
 least(CAST(floor(500000.0 * (1.0 * 1.0 / 100) / abs(close - stop_loss)) AS BIGINT), CAST(floor(62500.0 / close) AS BIGINT)) AS shares,
 least(bar_no + 30, n_bars) AS last_no FROM sig WHERE close > stop_loss AND bar_no < n_bars""")
cte("lab1", """SELECT s.symbol, s.bar_no, min(b.bar_no) FILTER (WHERE b.low <= s.stop_loss) AS j_stop, min(b.bar_no) FILTER (WHERE b.high >= s.target_2) AS j_t2,
 min(b.bar_no) FILTER (WHERE b.high >= s.target_1) AS j_t1 FROM lab0 s JOIN bars b ON b.symbol = s.symbol AND b.bar_no > s.bar_no AND b.bar_no <= s.last_no GROUP BY 1, 2""")
cte("lab2", """SELECT s.symbol, s.bar_no, min(b.bar_no) AS j_be FROM lab0 s JOIN lab1 l ON l.symbol = s.symbol AND l.bar_no = s.bar_no
 JOIN bars b ON b.symbol = s.symbol AND b.bar_no > l.j_t1 AND b.bar_no <= s.last_no AND b.low <= s.close GROUP BY 1, 2""")
cte("lab3", """SELECT s.*, CASE WHEN l.j_t1 IS NOT NULL AND (l.j_stop IS NULL OR l.j_t1 < l.j_stop) THEN m.j_be ELSE l.j_stop END AS js,
 CASE WHEN l.j_t1 IS NOT NULL AND (l.j_stop IS NULL OR l.j_t1 < l.j_stop) THEN s.close ELSE s.stop_loss END AS live_stop, l.j_t2
 FROM lab0 s JOIN lab1 l ON l.symbol = s.symbol AND l.bar_no = s.bar_no LEFT JOIN lab2 m ON m.symbol = s.symbol AND m.bar_no = s.bar_no""")
cte("lab4", """SELECT *, CASE WHEN js IS NOT NULL AND (j_t2 IS NULL OR js <= j_t2) THEN 'STOPPED_OUT' WHEN j_t2 IS NOT NULL THEN 'TARGET_HIT' ELSE 'TIME_EXIT' END AS state,
 CASE WHEN js IS NOT NULL AND (j_t2 IS NULL OR js <= j_t2) THEN js WHEN j_t2 IS NOT NULL THEN j_t2 ELSE last_no END AS exit_no FROM lab3""")
cte("lab5", """SELECT l.*, b.date AS exit_date, CASE l.state WHEN 'STOPPED_OUT' THEN least(l.live_stop, b.open) WHEN 'TARGET_HIT' THEN l.target_2 ELSE b.close END AS exit_price,
 l.date AS entry_date, l.close AS entry_price, l.bar_no AS entry_no, l.exit_no - l.bar_no AS bars_held, date_diff('day', l.date, b.date) AS days_held
 FROM lab4 l JOIN bars b ON b.symbol = l.symbol AND b.bar_no = l.exit_no""")


def leg(t: str, buy: bool) -> str:
    stamp = f" + {t} * 0.015 / 100.0" if buy else ""
    return (
        f"(least({t} * 0.1 / 100.0, 20.0) + {t} * 0.00297 / 100.0 + {t} * 0.0001 / 100.0 + {t} * 0.1 / 100.0 "
        f"+ (least({t} * 0.1 / 100.0, 20.0) + {t} * 0.00297 / 100.0 + {t} * 0.0001 / 100.0) * 18.0 / 100.0 + {t} * 0.05 / 100.0{stamp})"
    )


def trip(e: str, x: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN {leg(f'({e} * {n})', True)} + {leg(f'({x} * {n})', False)} ELSE 0 END"


cte("lab", f"""SELECT *, gross_pnl_inr - costs_inr AS pnl_inr, ((exit_price - entry_price) - per_share) / greatest(1e-9, abs(entry_price - stop_loss)) AS pnl_r,
 level AS breakout_level, volume_ratio_20 AS volume_ratio, cir AS close_in_range, atr_14 / close * 100 AS atr_pct FROM (SELECT *, (exit_price - entry_price) * shares AS gross_pnl_inr,
 {trip('entry_price', 'exit_price', 'shares')} AS costs_inr, {trip('entry_price', 'exit_price', '1.0')} AS per_share FROM lab5)""")
cte("nxt", """SELECT l.symbol, l.entry_no, min(n.entry_no) AS next_no FROM lab l LEFT JOIN lab n ON n.symbol = l.symbol AND n.entry_no > l.exit_no GROUP BY 1, 2""")
cte("pick", """SELECT symbol, min(entry_no) AS entry_no FROM lab GROUP BY symbol UNION ALL
 SELECT p.symbol, n.next_no FROM pick p JOIN nxt n ON n.symbol = p.symbol AND n.entry_no = p.entry_no WHERE n.next_no IS NOT NULL""")
cte("trades", """SELECT l.*, l.symbol || '-' || l.entry_no AS id, (entry_price - breakout_level) / breakout_level * 100 AS extension_pct
 FROM lab l JOIN pick p ON p.symbol = l.symbol AND p.entry_no = l.entry_no""")
cte("live", """SELECT id, symbol, entry_no, entry_date, entry_price, stop_loss, target_1, target_2, shares, volume_ratio, shut, CASE WHEN shut THEN state WHEN volume_ratio > 1 THEN 'TARGET_1_HIT' ELSE 'ENTERED' END AS state,
 CASE WHEN shut THEN exit_date END AS exit_date, CASE WHEN shut THEN pnl_r END AS pnl_r, CASE WHEN shut THEN pnl_inr END AS pnl_inr, CASE WHEN shut THEN gross_pnl_inr END AS gross_pnl_inr,
 CASE WHEN shut THEN costs_inr END AS costs_inr, CASE WHEN shut THEN days_held END AS days_held FROM (SELECT *, exit_date <= DATE '1999-06-30' AS shut FROM trades WHERE entry_date <= DATE '1999-06-30')""")
cte("tbars", "SELECT t.*, b.date AS bdate, b.high AS bh, b.low AS bl, b.close AS bc FROM trades t JOIN bars b ON b.symbol = t.symbol AND b.date >= t.entry_date AND b.date <= t.exit_date")
PERF = """count(pnl_r) AS n, count(*) FILTER (WHERE pnl_r > 0) AS wins, count(*) FILTER (WHERE pnl_r <= 0) AS losses,
 CASE WHEN count(pnl_r) > 0 THEN 100.0 * count(*) FILTER (WHERE pnl_r > 0) / count(pnl_r) ELSE 0 END AS win_rate, coalesce(avg(pnl_r), 0) AS avg_r,
 CASE WHEN coalesce(sum(pnl_inr) FILTER (WHERE pnl_inr < 0), 0) < 0 THEN coalesce(sum(pnl_inr) FILTER (WHERE pnl_inr > 0), 0) / -sum(pnl_inr) FILTER (WHERE pnl_inr < 0)
 WHEN coalesce(sum(pnl_inr) FILTER (WHERE pnl_inr > 0), 0) > 0 THEN CAST('Infinity' AS DOUBLE) END AS profit_factor,
 coalesce(avg(days_held), 0) AS avg_days_held, coalesce(sum(pnl_inr), 0) AS net_inr,
 CASE WHEN coalesce(sum(gross_pnl_inr), 0) <> 0 THEN sum(gross_pnl_inr) ELSE coalesce(sum(pnl_inr), 0) + coalesce(sum(costs_inr), 0) END AS gross_inr, coalesce(sum(costs_inr), 0) AS costs_inr"""
PCOLS = "n:i wins:i losses:i win_rate:f avg_r:f profit_factor:f avg_days_held:f net_inr:f gross_inr:f costs_inr:f"
cte("cand", "SELECT s.date, s.symbol, s.score, u.sector, s.bar_no FROM sig s LEFT JOIN uni u USING (symbol)")
cte("occ", "SELECT date, sector, count(*) % 3 AS n_open FROM cand GROUP BY date, sector")


def allocation(name: str, cands: str, occ: str, total: int, per: int) -> None:
    """The slot rule as two row numbers; `occ` holds the positions already open per date and sector."""
    cte(f"{name}_a", f"""SELECT c.*, coalesce(o.n_open, 0) AS os, coalesce(t.ot, 0) AS ot, row_number() OVER (PARTITION BY c.date, c.sector ORDER BY c.priority, c.score DESC, c.symbol) AS rs
 FROM {cands} c LEFT JOIN {occ} o ON o.date = c.date AND o.sector IS NOT DISTINCT FROM c.sector LEFT JOIN (SELECT date, sum(n_open) AS ot FROM {occ} GROUP BY date) t ON t.date = c.date""")
    cte(name, f"""SELECT *, rs <= {per} - os AS surv, count(*) FILTER (WHERE rs <= {per} - os) OVER (PARTITION BY date ORDER BY priority, score DESC, symbol
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_, {total} - ot AS free_ FROM {name}_a""")


cte("cand0", "SELECT date, symbol, score, sector, 0 AS priority FROM cand")
cte("cand1", "SELECT date, symbol, score, sector, bar_no % 2 AS priority FROM cand")
cte("occ0", "SELECT date, sector, 0 AS n_open FROM cand WHERE false")
allocation("alloc", "cand0", "occ", 8, 3)
allocation("alloc1", "cand1", "occ0", 5, 2)
ALLOC = """SELECT *, surv AND before_ < free_ AS accepted, CASE WHEN surv AND before_ < free_ THEN 'taken' WHEN before_ >= free_ THEN 'position_limit' ELSE 'sector_limit' END AS reason FROM {0}"""
cte("cohort", "SELECT date, symbol FROM alloc WHERE surv AND before_ < free_")
CORRS = """SELECT date, avg(abs(c)) AS m FROM (SELECT a.date, a.symbol AS s1, b.symbol AS s2, corr(x.ret_1, y.ret_1) AS c FROM {0} a JOIN {0} b ON a.date = b.date AND a.symbol < b.symbol
 JOIN base ab ON ab.symbol = a.symbol AND ab.date = a.date JOIN base bb ON bb.symbol = b.symbol AND bb.date = b.date
 JOIN base x ON x.symbol = a.symbol AND x.bar_no BETWEEN ab.bar_no - 62 AND ab.bar_no JOIN base y ON y.symbol = b.symbol AND y.date = x.date AND y.bar_no BETWEEN bb.bar_no - 62 AND bb.bar_no
 WHERE x.ret_1 IS NOT NULL AND y.ret_1 IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 10) WHERE c IS NOT NULL AND NOT isnan(c) GROUP BY date"""
cte("corrs", CORRS.format("cohort"))
cte("corrall", CORRS.format("cand"))
cte("avgcorr", "SELECT d.date, coalesce(c.m, 0) AS avg_correlation FROM (SELECT DISTINCT date FROM cohort) d LEFT JOIN corrs c USING (date)")
cte("late", "SELECT symbol, date, close + 1 AS close, volume FROM bars WHERE bar_no > n_bars - 10")
cte("cached", "SELECT * FROM bars WHERE bar_no <= n_bars - 4")
cte("feed", "SELECT symbol, date, open * 0.5 AS open, high * 0.5 AS high, low * 0.5 AS low, close * 0.5 AS close, volume * 2 AS volume FROM bars WHERE bar_no > n_bars - 10 AND CAST(symbol AS BIGINT) % 10 = 0")
cte("factor", """SELECT symbol, count(*) AS n, median(f.close / c.close) AS price_factor, median(CASE WHEN f.volume > 0 AND c.volume > 0 THEN f.volume / c.volume END) AS volume_factor
 FROM cached c JOIN feed f USING (symbol, date) GROUP BY symbol HAVING count(*) >= 3 AND abs(median(f.close / c.close) - 1) > 0.005""")
cte("watch", """SELECT symbol, arg_max(date, bar_no) AS breakout_date, arg_max(level, bar_no) AS breakout_level, arg_max(close, bar_no) / 20.0 AS original_score, max(bar_no) AS bn
 FROM lev WHERE close > level AND vr >= 1.2 GROUP BY symbol""")


def bad(x: float) -> str:
    return f"CASE WHEN close / pc - 1 <= -{x} OR close / pc - 1 >= {x} THEN close / pc - 1 END"


def discont(name: str, x: float) -> None:
    cte(name, f"""SELECT symbol, arg_max(date, (abs(m), -bar_no)) AS date, arg_max(m, (abs(m), -bar_no)) AS move FROM (SELECT *, {bad(x)} AS m FROM base) WHERE m IS NOT NULL GROUP BY symbol""")


discont("bad3", 0.03)
discont("bad35", 0.035)
discont("bad4", 0.04)
cte("evreach", """SELECT k.date AS event_date, e.symbol, k.biz_no AS event_no FROM evcal e JOIN cal k ON k.date = e.date""")


# ── sources, sinks, filters ──────────────────────────────────────────────

oracle("flagship_leaders", "symbol date:d close:f ret_63:f rs_percentile:f", "SELECT * FROM ranks WHERE close > sma_50 AND rs_percentile >= 90")
oracle("s1_bar_scan", "symbol date:d close:f volume:i bar_no:i", "SELECT * FROM bars WHERE bar_no > n_bars - 60")
oracle("s2_normalise_bars", "symbol date:d open:f high:f low:f close:f volume:i", "SELECT * FROM bars WHERE volume % 7 <> 0 AND volume % 11 <> 0")
oracle("s3_unpivot_feed", "date:d symbol open:f high:f low:f close:f volume:f", """SELECT event_type AS symbol, CAST(ts AS DATE) AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
 min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2""")
oracle("s4_universe_csv", "symbol company_name sector industry", "SELECT symbol, company_name, industry AS sector, industry FROM uni")
oracle("s5_events_csv", "symbol date:d", "SELECT 'SUP' || symbol AS symbol, date FROM evcal WHERE day(date) <> 1 AND date >= DATE '1998-06-30' - 60")
oracle("s6_holidays_text", "date:d", "SELECT date FROM hols")
oracle("s7_holidays_json", "date:d", "SELECT date FROM hols")
oracle("s8_symbols", "raw symbol ticker", """SELECT raw, regexp_replace(upper(replace(replace(raw, '.NS', ''), '.BO', '')), '-EQ$', '') AS symbol,
 CASE WHEN raw LIKE '%.NS' THEN raw ELSE raw || '.NS' END AS ticker FROM (SELECT CASE s_suppkey % 3 WHEN 0 THEN s_name || '-EQ' WHEN 1 THEN s_name || '.NS' ELSE s_name END AS raw FROM supplier)""")
oracle("s9_alert_sink", "run_date:d symbol alert_type pattern position_size:i entry_price:f target_1:f target_2:f stage sector rs_rank:f", """SELECT entry_date AS run_date, symbol, alert_type, stage, sector, round(rs_percentile, 2) AS rs_rank, coalesce(pattern, 'none') AS pattern,
 shares AS position_size, round(entry_price, 2) AS entry_price, round(target_1, 2) AS target_1, round(target_2, 2) AS target_2 FROM feat""")
oracle("s10_replace_table", "symbol industry detected_date", "SELECT symbol, industry, CASE WHEN length(symbol) = 1 THEN '1999-01-01' ELSE '1998-06-30' END AS detected_date FROM uni")
oracle("s11_upsert", "symbol date:d close:f volume:i", """SELECT symbol, date, CASE WHEN bar_no > n_bars - 10 THEN close + 1 ELSE close END AS close, volume FROM bars""")
oracle("s11_merge_store", "symbol date:d close:f volume:i", """SELECT symbol, date, CASE WHEN bar_no > n_bars - 10 THEN close + 1 ELSE close END AS close, volume FROM bars""")
oracle("s12_delete", "symbol date:d close:f", "SELECT * FROM bars WHERE symbol NOT IN (SELECT symbol FROM uni WHERE sector = 'ASIA')")
oracle("s13_patch", "id:i notes balance:f state", """SELECT s_suppkey AS id, s_name AS notes, CASE WHEN n % 2 = 0 THEN b ELSE s_acctbal END AS balance,
 CASE WHEN n % 3 = 0 THEN 'CLOSED' ELSE 'OPEN' END AS state FROM supplier LEFT JOIN (SELECT l_suppkey, sum(l_quantity) AS b, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""")
oracle("s14_assign_ids", "o_orderkey:i date:d id:i", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey)
 + (SELECT max(o_orderkey) FROM orders WHERE o_orderpriority <> '1-URGENT') AS id FROM orders WHERE o_orderpriority = '1-URGENT'""")
oracle("s15_prune", "symbol date:d", "SELECT * FROM evcal WHERE day(date) > 2 AND date >= DATE '1998-06-30' - 100")
oracle("f1_freshness", "symbol latest:d age_days:i needs_refetch:b usable:b age_bucket", """SELECT symbol, latest, a AS age_days, a >= 1 AS needs_refetch, a <= 3 AS usable,
 CASE WHEN a <= 3 THEN 'fresh' WHEN a >= 7 THEN 'very_stale' WHEN a >= 1 THEN 'stale' ELSE 'today' END AS age_bucket
 FROM (SELECT symbol, max(date) AS latest, date_diff('day', max(date), (SELECT max(date) FROM bars)) AS a FROM bars GROUP BY symbol)""")
oracle("f2_discontinuities", "symbol date:d move:f", "SELECT * FROM bad3")
oracle("f3_continuity_gate", "symbol date:d ok:b", f"SELECT symbol, date, count(m) {last(299)} = 0 AS ok FROM (SELECT *, {bad(0.035)} AS m FROM base)")
oracle("f4_quality_floor", "symbol date:d failed passed:b", """SELECT symbol, date, coalesce(array_to_string(list_filter([CASE WHEN adv_cr < 0.003 THEN 'adv_below_floor' END, CASE WHEN market_cap_cr < 500 THEN 'market_cap_below_floor' END,
 CASE WHEN bar_no % 5 <> 0 AND bar_no * 2 < 365 THEN 'too_recent_listing' END, CASE WHEN volume % 4 = 0 AND volume >= 30 THEN 'high_promoter_pledge' END], lambda x: x IS NOT NULL), ';'), '') AS failed,
 NOT (adv_cr < 0.003 OR market_cap_cr < 500 OR (bar_no % 5 <> 0 AND bar_no * 2 < 365) OR (volume % 4 = 0 AND volume >= 30)) AS passed FROM base LEFT JOIN uni USING (symbol)""")
oracle("f5_adv", "symbol date:d adv:f", "SELECT symbol, date, adv_cr * 1e7 AS adv FROM base")
oracle("f6_min_history", "symbol n:i since:d", "SELECT symbol, count(*) AS n, min(date) AS since FROM bars WHERE bar_no >= 200 GROUP BY symbol")
oracle("f7_near_level", "symbol date:d close:f level:f", "SELECT * FROM lev WHERE level > 0 AND (level - close) / level <= 0.02")
oracle("f8_confirmed", "symbol date:d close:f level:f vr:f", "SELECT * FROM lev WHERE close > level AND vr >= 1.5")
oracle("f9_has_bar", "symbol has_bar:b", "SELECT symbol, max(date) = (SELECT max(date) FROM bars) AS has_bar FROM bars GROUP BY symbol")
oracle("f10_drop_partial", "symbol date:d close:f volume:i", """SELECT event_type AS symbol, CAST(ts AS DATE) AS date, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events
 WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) AS DATE) FROM events) GROUP BY 1, 2""")
BLK = """SELECT b.symbol, b.date, EXISTS (SELECT 1 FROM evreach e WHERE e.symbol = b.symbol AND abs(e.event_no - k.biz_no) <= CASE WHEN month(b.date) IN (1, 4, 7, 10) THEN 7 ELSE 5 END {0}) AS blackout
 FROM bars b JOIN cal k ON k.date = b.date"""
oracle("f11_blackout", "symbol date:d blackout:b", BLK.format("AND e.event_date >= b.date"))
oracle("j3_events_in_reach", "symbol n_blackout:i n:i", f"SELECT symbol, count(*) FILTER (WHERE blackout) AS n_blackout, count(*) AS n FROM ({BLK.format('')}) GROUP BY symbol")
oracle("f12_failed_level", "symbol date:d failed:b", "SELECT symbol, date, coalesce(volume % 6 - 1 BETWEEN 0 AND 3 AND close < level, false) AS failed FROM lev")
oracle("f13_retest", "symbol date:d level:f close:f", f"""SELECT * FROM (SELECT *, min(low) {over(-10, -1)} AS level FROM bars) WHERE level <= low AND low <= level * 1.01 AND close > level
 AND (least(open, close) - low > abs(close - open) OR close > open) AND (CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0 END >= 0.5 OR close - level >= level * 0.01)""")
oracle("f14_not_fired", "symbol date:d level:f", """SELECT s.symbol, s.date, s.level FROM sig s WHERE NOT EXISTS (SELECT 1 FROM trades t WHERE t.symbol = s.symbol AND t.alert_type = 'PULLBACK_ENTRY'
 AND abs(t.breakout_level - s.level) < 0.01 AND t.entry_date < s.date)""")
oracle("f16_level_validity", "reason n:i", """SELECT CASE WHEN close <= 0 OR st <= 0 OR high <= 0 OR level <= 0 THEN 'non_positive_price' WHEN st >= close THEN 'stop_not_below_entry' WHEN high <= close THEN 'target_1_not_above_entry'
 WHEN level <= close THEN 'target_2_not_above_entry' WHEN (close - st) / close * 100 < 0.05 THEN 'stop_too_close' ELSE 'OK' END AS reason, count(*) AS n
 FROM (SELECT *, low - (volume % 3) * 2.0 AS st FROM lev WHERE level IS NOT NULL) GROUP BY 1""")
oracle("f17_period", "symbol exit_date:d pnl_r:f", "SELECT * FROM trades WHERE exit_date BETWEEN DATE '2000-06-30' - 120 AND DATE '2000-06-30'")
oracle("f18_states", "symbol entry_date:d state", "SELECT * FROM live WHERE NOT shut")
oracle("f19_market_tradeable", "date:d tradeable:b", "SELECT * FROM moods")

# ── joins ────────────────────────────────────────────────────────────────

oracle("j1_alerts_with_outcomes", "trade_id symbol alert_type extension_pct:f state pnl_r:f pnl_inr:f days_held:f exit_date:d", """SELECT t.id AS trade_id, t.symbol, t.alert_type, t.extension_pct,
 l.state, l.pnl_r, l.pnl_inr, l.days_held, l.exit_date FROM trades t LEFT JOIN live l ON l.id = t.id""")
oracle("j2_overlap", "symbol date:d close_old:f volume_old:i close_new:f volume_new:i", "SELECT b.symbol, b.date, b.close AS close_old, b.volume AS volume_old, l.close AS close_new, l.volume AS volume_new FROM bars b JOIN late l USING (symbol, date) WHERE b.bar_no % 2 = 0")
oracle("j4_trade_bars", "symbol entry_date:d n:i high:f low:f", "SELECT symbol, entry_date, count(*) AS n, max(bh) AS high, min(bl) AS low FROM tbars GROUP BY symbol, entry_date")
oracle("j5_last_bar", "symbol date:d close:f", "SELECT * FROM bars WHERE bar_no = n_bars")
oracle("j6_sector_lookup", "sector n:i", "SELECT coalesce(u.sector, 'unknown') AS sector, count(*) AS n FROM trades t LEFT JOIN (SELECT * FROM uni WHERE sector <> 'EUROPE') u USING (symbol) GROUP BY 1")
oracle("j7_market_wide", "symbol date:d close:f breadth_pct:f vix:f regime risk_multiplier:f", "SELECT b.symbol, b.date, b.close, h.breadth_pct, m.vix, r.regime, r.risk_multiplier FROM bars b LEFT JOIN breadth h USING (date) LEFT JOIN moods m USING (date) LEFT JOIN reg r USING (date)")
oracle("j8_semi_anti", "symbol date:d close:f", "SELECT * FROM bars b WHERE symbol IN (SELECT symbol FROM bars GROUP BY symbol HAVING max(date) >= DATE '2001-10-15') AND symbol NOT IN (SELECT symbol FROM bad4)")
oracle("j9_pair_join", "date:d pairs:i", "SELECT a.date, count(*) AS pairs FROM cohort a JOIN cohort b ON a.date = b.date AND a.symbol < b.symbol GROUP BY a.date")
oracle("j10_precedence_merge", "date:d sector sector_trend", """SELECT coalesce(r.date, p.date) AS date, coalesce(r.index_symbol, p.sector) AS sector, coalesce(r.trend, p.sector_trend) AS sector_trend
 FROM (SELECT * FROM ixall WHERE index_symbol IN ('ASIA', 'AFRICA')) r FULL JOIN secmed p ON p.date = r.date AND p.sector = r.index_symbol""")

# ── aggregations ─────────────────────────────────────────────────────────

oracle("a1_performance", PCOLS, f"SELECT {PERF} FROM trades")
DIG = f"""SELECT CASE WHEN grouping(p) = 1 THEN 'overall' ELSE 'pattern' END AS scope, p AS pattern, {PERF} FROM (SELECT *, coalesce(pattern, 'unknown') AS p FROM trades) GROUP BY GROUPING SETS ((), (p))"""
oracle("a2_digest", f"scope pattern {PCOLS}", DIG)
BANDS = f"""SELECT lo || '-' || least(hi - 1, 100) AS band, {PERF} FROM (VALUES (60, 70), (70, 80), (80, 90), (90, 101)) AS b(lo, hi) LEFT JOIN trades ON score >= lo AND score < hi GROUP BY lo, hi"""
oracle("a3_score_bands", f"band {PCOLS}", BANDS)
SECT = f"SELECT coalesce(sector, 'unknown') AS sector, {PERF} FROM trades LEFT JOIN uni USING (symbol) GROUP BY 1"
oracle("a4_by_sector", f"sector {PCOLS}", SECT)
def rs_pts(p: str) -> str:
    return f"CASE WHEN {p} IS NULL OR {p} <= 50 THEN 0 WHEN {p} >= 75 THEN 15 ELSE ({p} - 50) / 25.0 * 15 END"


FEATS = ("pattern_confidence", "rs_percentile", "tightness", "volume_ratio", "distance_pct", "extension_pct", "close_in_range", "atr_pct", "vix", "breadth_pct", "regime_score")
CATS = ("sector_trend", "market_mood", "stage", "alert_type", "regime", "nifty_trend")
cte("bestp", "SELECT symbol, date, confidence AS pattern_confidence FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY confidence DESC, ix) AS r FROM plain) WHERE r = 1")
cte("morning", f"SELECT symbol, date, bar_no, adv_cr, CASE WHEN bar_no >= 51 AND atr_50 > 0 THEN 1 - atr_10 / atr_50 ELSE 0 END AS tightness, lag(volume_ratio_20) OVER ({W}) AS volume_ratio_morning FROM atrs")
cte("blk", BLK.format("AND e.event_date >= b.date"))
cte("feat", f"""SELECT t.*, id AS trade_id, t.entry_date AS alert_date, p.pattern_confidence, g.stage, coalesce(k.rs_percentile, 0) AS rs_percentile, {rs_pts('coalesce(k.rs_percentile, 0)')} AS rs_points, a.tightness, a.volume_ratio_morning, u.sector,
 coalesce(s.sector_trend, 'flat') AS sector_trend, (t.breakout_level - t.entry_price) / t.breakout_level * 100 AS distance_pct, a.adv_cr, x.blackout AS earnings_blackout, r.vix, r.market_mood, r.regime, r.regime_score, r.breadth_pct,
 r.index_trend AS nifty_trend, r.risk_multiplier FROM (SELECT id, symbol, alert_type, pattern, score, volume_ratio, close_in_range, atr_pct, extension_pct, breakout_level, entry_price, entry_date, base_height, stop_loss, target_1, target_2, shares,
 pnl_r, pnl_inr, days_held, costs_inr, gross_pnl_inr FROM trades) t JOIN morning a ON a.symbol = t.symbol AND a.date = t.entry_date JOIN stg g ON g.symbol = t.symbol AND g.date = t.entry_date LEFT JOIN bestp p ON p.symbol = t.symbol AND p.date = t.entry_date
 LEFT JOIN ranks k ON k.symbol = t.symbol AND k.date = t.entry_date LEFT JOIN uni u ON u.symbol = t.symbol LEFT JOIN secmed s ON s.date = t.entry_date AND s.sector = u.sector LEFT JOIN reg r ON r.date = t.entry_date
 LEFT JOIN blk x ON x.symbol = t.symbol AND x.date = t.entry_date""")
cte("flong", " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, pnl_r, pnl_inr, days_held, costs_inr, gross_pnl_inr FROM feat WHERE {f} IS NOT NULL" for f in FEATS))
cte("fsort", "SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY feature) AS nn FROM flong")
cte("fcut", "SELECT feature, max(value) FILTER (WHERE k = nn // 3) AS lo, max(value) FILTER (WHERE k = 2 * nn // 3) AS hi, min(value) AS a, max(value) AS b, max(nn) AS nn FROM fsort GROUP BY feature")
cte("tert", f"""SELECT f.feature, CASE WHEN nn < 6 OR a = b OR lo = hi THEN 'all' WHEN value < lo THEN 'low' WHEN value >= hi THEN 'high' ELSE 'mid' END AS bucket, {PERF} FROM flong f JOIN fcut USING (feature) GROUP BY 1, 2""")
cte("cats", " UNION ALL ".join(f"SELECT '{f}' AS feature, coalesce({f}, 'unknown') AS bucket, pnl_r, pnl_inr, days_held, costs_inr, gross_pnl_inr FROM feat" for f in CATS))
cte("catr", f"SELECT * FROM (SELECT feature, bucket, {PERF}, count(*) OVER (PARTITION BY feature) AS kk FROM cats GROUP BY 1, 2) WHERE kk > 1")
oracle("a5_terciles", f"feature bucket {PCOLS}", "SELECT * FROM tert WHERE feature = 'volume_ratio'")
oracle("a6_by_category", f"bucket {PCOLS}", f"SELECT coalesce(pattern, 'unknown') AS bucket, {PERF} FROM trades GROUP BY 1")
STAT = "n, wins, losses, win_rate, avg_r, profit_factor, avg_days_held, net_inr, gross_inr, costs_inr"
oracle("a7_feature_report", f"feature bucket {PCOLS} kind thin:b", f"SELECT feature, bucket, {STAT}, 'numeric' AS kind, n < 10 AS thin FROM tert UNION ALL SELECT feature, bucket, {STAT}, 'categorical', n < 10 FROM catr")
oracle("a8_full_report", f"section grp bucket {PCOLS}", f"""SELECT CASE scope WHEN 'overall' THEN 'overall' ELSE 'by_pattern' END AS section, NULL::VARCHAR AS grp, pattern AS bucket, {STAT} FROM ({DIG})
 UNION ALL SELECT 'by_score_band', NULL, band, {STAT} FROM ({BANDS}) UNION ALL SELECT 'by_sector', NULL, sector, {STAT} FROM ({SECT})
 UNION ALL SELECT 'by_feature', feature, bucket, {STAT} FROM tert UNION ALL SELECT 'by_feature', feature, bucket, {STAT} FROM catr""")
oracle("a9_historic", "n:i wins:i losses:i win_rate:f avg_r:f profit_factor:f avg_days_held:f net_inr:f", f"SELECT {PERF} FROM live")
oracle("a10_breadth", "date:d breadth_pct:f", "SELECT * FROM breadth")
oracle("a11_sector_trends", "date:d sector median_return:f sector_trend", "SELECT * FROM secmed")
oracle("a12_mean_correlation", "date:d avg_correlation:f", "SELECT d.date, coalesce(c.m, 0) AS avg_correlation FROM (SELECT DISTINCT date FROM cand) d LEFT JOIN corrall c USING (date)")
oracle("a13_sector_exposure", "sector n_open:i", "SELECT CASE WHEN sector = 'AFRICA' THEN 'unknown' ELSE sector END AS sector, count(*) AS n_open FROM live JOIN uni USING (symbol) WHERE NOT shut GROUP BY 1")
oracle("a14_portfolio_health", "date:d daily_pct:f monthly_pct:f n_open:i reasons healthy:b", """SELECT *, array_to_string(list_filter([CASE WHEN daily_pct < -3 THEN 'daily_loss' END, CASE WHEN monthly_pct < -10 THEN 'monthly_loss' END,
 CASE WHEN n_open >= 8 THEN 'position_limit' END], lambda x: x IS NOT NULL), ';') AS reasons, NOT coalesce(daily_pct < -3, false) AND NOT coalesce(monthly_pct < -10, false) AND n_open < 8 AS healthy FROM (
 SELECT d.date, dp / 500000 * 100 AS daily_pct, sum(dp) OVER (PARTITION BY date_trunc('month', d.date) ORDER BY d.date) / 500000 * 100 AS monthly_pct,
 coalesce(sum(op) OVER (ORDER BY d.date), 0) - coalesce(sum(cl) OVER (ORDER BY d.date), 0) AS n_open FROM (SELECT DISTINCT date FROM bars) d
 LEFT JOIN (SELECT exit_date AS date, sum(pnl_inr) AS dp, count(*) AS cl FROM trades GROUP BY 1) c USING (date) LEFT JOIN (SELECT entry_date AS date, count(*) AS op FROM trades GROUP BY 1) o USING (date))""")
oracle("a15_gate_audit", "gate state n:i of:i pct:f", """SELECT g.gate, g.state, g.n, g.of, CASE WHEN g.of > 0 THEN g.n * 100.0 / g.of ELSE 0 END AS pct FROM (
 SELECT (SELECT count(*) FROM base WHERE bar_no = n_bars) AS nc, (SELECT count(*) FROM base WHERE bar_no = n_bars AND adv_cr < 0.004) AS ar, (SELECT count(*) FROM uni) AS nu, (SELECT count(market_cap_cr) FROM uni) AS nm,
 (SELECT count(*) FROM base WHERE bar_no = n_bars AND symbol IN (SELECT symbol FROM evcal)) AS ne) f, LATERAL (VALUES ('adv', 'ACTIVE', ar, nc),
 ('market_cap', CASE WHEN nm > 0 THEN 'ACTIVE' ELSE 'REDUNDANT' END, nm, nu), ('listing_age', 'REDUNDANT', 0, nu), ('promoter_pledge', 'INERT', 0, nu), ('earnings_blackout', CASE WHEN ne > 0 THEN 'ACTIVE' ELSE 'INERT' END, ne, nc)) AS g(gate, state, n, of)""")
cte("hi52", f"""SELECT *, max(high) {last(252)} AS top_ FROM stg""")
cte("m52", """SELECT h.*, (SELECT count(*) FROM bars b WHERE b.symbol = h.symbol AND b.bar_no BETWEEN h.bar_no - 125 AND h.bar_no AND b.high >= h.top_ * (1 - 0.015)) AS touches,
 coalesce((SELECT min(b.bar_no) FROM bars b WHERE b.symbol = h.symbol AND b.bar_no BETWEEN h.bar_no - 125 AND h.bar_no AND b.high >= h.top_ * (1 - 0.015)), h.bar_no - 125) AS start_no
 FROM hi52 h WHERE h.bar_no >= 252 AND (h.top_ - h.close) / h.top_ <= 0.02""")
cte("p52", """SELECT m.*, least(100, 50 + greatest(touches - 1, 0) * 5.0) AS confidence, top_ AS breakout_level, top_ - (SELECT min(b.low) FROM bars b WHERE b.symbol = m.symbol AND b.bar_no BETWEEN m.start_no AND m.bar_no) AS base_height,
 (SELECT b.date FROM bars b WHERE b.symbol = m.symbol AND b.bar_no = m.start_no) AS base_start_date FROM m52 m""")
cte("gaps", """SELECT g.symbol, g.date, b.date AS latest, date_diff('day', b.date, g.date) AS age_days FROM (SELECT s.symbol, c.date FROM (SELECT symbol, min(date) AS f, (SELECT max(date) FROM bars) AS t FROM bars GROUP BY symbol) s
 JOIN cal c ON c.trading AND c.date > s.f AND c.date <= s.t) g ASOF JOIN bars b ON b.symbol = g.symbol AND g.date >= b.date WHERE b.date < g.date""")
oracle("f1_stale_days", "symbol date:d latest:d age_days:i", "SELECT * FROM gaps")
oracle("a17_adjustment_ratio", "symbol n:i price_factor:f volume_factor:f", "SELECT * FROM factor")
oracle("a18_excursions", "symbol entry_date:d max_favorable:f max_adverse:f", """SELECT symbol, entry_date, greatest(0, max((bh - entry_price) / abs(entry_price - stop_loss))) AS max_favorable,
 least(0, min((bl - entry_price) / abs(entry_price - stop_loss))) AS max_adverse FROM tbars WHERE bdate > entry_date GROUP BY symbol, entry_date""")
oracle("a19_latest", "symbol latest:d age_days:i", "SELECT symbol, max(date) AS latest, date_diff('day', max(date), DATE '2002-01-01') AS age_days FROM bars GROUP BY symbol")

# ── indicators ───────────────────────────────────────────────────────────

oracle("w1_sma", "symbol date:d sma_50:f sma_200:f", "SELECT * FROM base")
oracle("w2_ema", "symbol date:d ema_12:f ema_200:f", f"SELECT symbol, date, {ema('close', '(2.0/13)')} AS ema_12, {ema('close', '(2.0/201)')} AS ema_200 FROM bars")
oracle("w3_true_range", "symbol date:d tr:f", "SELECT * FROM base")
oracle("w4_atr", "symbol date:d atr_14:f atr_50:f atr_100:f atr_14_seeded_60:f", f"""SELECT symbol, date, atr_14, atr_50, {ema('tr', '(1.0/100)', 1, 100)} AS atr_100, CASE WHEN bar_no >= 14 THEN e - coalesce(lag(e - tr, 59) OVER ({W}), 0) * pow(13.0/14, 59) END AS atr_14_seeded_60
 FROM (SELECT *, {ema('tr', '(1.0/14)')} AS e FROM atrs)""")
cte("gl", f"""SELECT *, CASE WHEN bar_no > 1 THEN greatest(close - pc, 0) END AS gain, CASE WHEN bar_no > 1 THEN greatest(pc - close, 0) END AS loss, high - lag(high) OVER ({W}) AS up, lag(low) OVER ({W}) - low AS dn FROM base""")
oracle("w5_rsi", "symbol date:d rsi:f", f"""SELECT symbol, date, CASE WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END AS rsi FROM (SELECT *, {ema('gain', '(1.0/14)', 2, 15)} AS ag, {ema('loss', '(1.0/14)', 2, 15)} AS al FROM gl)""")
oracle("w6_macd", "symbol date:d macd:f macd_signal:f hist:f", f"""SELECT symbol, date, m AS macd, s AS macd_signal, m - s AS hist FROM (SELECT *, {ema('m', '0.2')} AS s FROM (SELECT *, {ema('close', '(2.0/13)')} - {ema('close', '(2.0/27)')} AS m FROM bars))""")
cte("boll", f"SELECT *, {warm(f'avg(close) {last(20)}', 20)} AS mid, {warm(f'stddev_pop(close) {last(20)}', 20)} AS sd FROM base")
oracle("w7_bollinger", "symbol date:d upper:f middle:f lower:f", "SELECT symbol, date, mid + 2 * sd AS upper, mid AS middle, mid - 2 * sd AS lower FROM boll")
oracle("w8_band_width", "symbol date:d width:f", "SELECT symbol, date, ((mid + 2 * sd) - (mid - 2 * sd)) / mid AS width FROM boll")
oracle("w9_volume_ratio", "symbol date:d ratio:f", "SELECT symbol, date, volume / vol_avg_20 AS ratio FROM base")
oracle("w10_volume_ratio_prior", "symbol date:d ratio:f", f"""SELECT symbol, date, CASE WHEN bar_no > 20 THEN (CASE WHEN bar_no = n_bars THEN volume / 0.851 ELSE volume END) / avg(volume) {over(-20, -1)} END AS ratio FROM bars""")
cte("dm", f"""SELECT *, CASE WHEN up > dn AND up > 0 THEN up WHEN bar_no > 1 THEN 0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn WHEN bar_no > 1 THEN 0 END AS mdm FROM gl""")
oracle("w11_adx", "symbol date:d adx:f", f"""SELECT symbol, date, {ema('dx', '(1.0/14)', 15, 28)} AS adx FROM (SELECT *, 100 * abs(100 * sp / st - 100 * sm / st) / (100 * sp / st + 100 * sm / st) AS dx FROM (
 SELECT *, {ema('tr', '(1.0/14)', 1, 14)} AS st, {ema('pdm', '(1.0/14)', 2, 15)} AS sp, {ema('mdm', '(1.0/14)', 2, 15)} AS sm FROM dm))""")
oracle("w12_standard_indicators", "symbol date:d sma_50:f sma_150:f sma_200:f atr_14:f atr_10:f atr_50:f vol_avg_20:f volume_ratio_20:f", "SELECT * FROM atrs")
oracle("w13_period_return", "symbol date:d ret_63:f", "SELECT * FROM base")
TIGHT = "CASE WHEN bar_no >= 51 AND atr_50 > 0 THEN 1 - atr_10 / atr_50 ELSE 0 END"
oracle("w14_tightness", "symbol date:d tightness:f", f"SELECT symbol, date, {TIGHT} AS tightness FROM atrs")
oracle("w15_index_trend", "index_symbol date:d close:f sma:f trend", "SELECT * FROM ixall")
oracle("w16_stage", "symbol date:d stage", "SELECT * FROM stg")
oracle("w17_vix_mood", "date:d vix:f vix_avg:f market_mood tradeable:b", "SELECT * FROM moods")


def pivots(name: str, n: int) -> None:
    cte(name, f"""SELECT symbol, date, bar_no, n_bars, CASE WHEN bar_no > {n} AND bar_no <= n_bars - {n} AND high > max(high) {over(-n, -1)} AND high > max(high) {over(1, n)} THEN high END AS ph,
 CASE WHEN bar_no > {n} AND bar_no <= n_bars - {n} AND low < min(low) {over(-n, -1)} AND low < min(low) {over(1, n)} THEN low END AS pl, lead(date, {n}) OVER ({W}) AS confirmed_on, open, high, low, close, volume FROM gbars""")
    cte(f"{name}_rows", f"""SELECT symbol, date, bar_no, n_bars, 'HIGH' AS kind, ph AS price, confirmed_on FROM {name} WHERE ph IS NOT NULL UNION ALL
 SELECT symbol, date, bar_no, n_bars, 'LOW', pl, confirmed_on FROM {name} WHERE pl IS NOT NULL""")


pivots("piv5", 5)
pivots("piv3", 3)
oracle("w18_pivots", "symbol date:d kind price:f", "SELECT * FROM piv5_rows")
oracle("w19_pivot_strength", "symbol date:d kind price:f strength:i", """SELECT p.symbol, p.date, p.kind, p.price, least(p.bar_no - coalesce(max(b.bar_no) FILTER (WHERE b.bar_no < p.bar_no), 0) - 1,
 coalesce(min(b.bar_no) FILTER (WHERE b.bar_no > p.bar_no), p.n_bars + 1) - p.bar_no - 1) AS strength FROM piv5_rows p LEFT JOIN gbars b ON b.symbol = p.symbol AND b.bar_no <> p.bar_no
 AND CASE p.kind WHEN 'HIGH' THEN b.high >= p.price ELSE b.low <= p.price END GROUP BY p.symbol, p.date, p.kind, p.price, p.bar_no, p.n_bars""")
oracle("w20_last_pivots", "symbol kind back:i date:d price:f", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY bar_no DESC) AS back FROM piv5_rows) WHERE back <= 3")
oracle("w21_confirmed_pivots", "symbol date:d kind confirmed_on:d", "SELECT * FROM piv3_rows")
oracle("w22_daily_progress", "symbol entry_date:d days_in_trade first_move:f sum_moves:f daily_moves", """SELECT symbol, entry_date, string_agg('D' || (k - 1) || ':' || printf('%.1f', round_even(mv, 1)) || '%', ',' ORDER BY k) FILTER (WHERE k > 1) AS daily_moves, 'D' || (count(*) - 1) AS days_in_trade, max(mv) FILTER (WHERE k = 2) AS first_move, coalesce(sum(mv) FILTER (WHERE k > 1), 0) AS sum_moves FROM (
 SELECT *, (bc - CASE WHEN k = 2 THEN entry_price ELSE prev END) / CASE WHEN k = 2 THEN entry_price ELSE prev END * 100 AS mv FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY bdate) AS k, lag(bc) OVER (PARTITION BY id ORDER BY bdate) AS prev FROM tbars)) GROUP BY symbol, entry_date""")
oracle("w23_close_in_range", "symbol date:d cir:f", "SELECT * FROM base")
oracle("r1_rs_percentile", "symbol date:d ret_63:f rs_percentile:f", "SELECT * FROM ranks")
oracle("r2_relative_strength", "symbol date:d rs:f", """SELECT b.symbol, b.date, CASE WHEN 1 + i.r > 0 THEN (1 + b.ret_63) / (1 + i.r) END AS rs FROM base b JOIN (SELECT date, close / lag(close, 63) OVER (ORDER BY date) - 1 AS r FROM allix) i USING (date)""")
oracle("r4_slot_allocation", "date:d symbol score:f sector accepted:b reason", ALLOC.format("alloc"))
oracle("r5_capacity_by_priority", "date:d symbol score:f sector priority:i accepted:b reason", ALLOC.format("alloc1"))
cte("bookc", """SELECT row_number() OVER (ORDER BY entry_date, score DESC, symbol) AS rn, CAST(entry_date AS DATE) AS date, symbol, score, coalesce(sector, 'unknown') AS sector, CAST(exit_date AS DATE) AS exit_date
 FROM trades LEFT JOIN uni USING (symbol)""")
cte("bookf", """SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(sector VARCHAR, fin DATE)[]) AS book, false AS taken, CAST(0 AS BIGINT) AS n_open, CAST(0 AS BIGINT) AS n_sector
 UNION ALL SELECT rn, CASE WHEN ok THEN list_append(kept, {'sector': sector, 'fin': exit_date}) ELSE kept END, ok, len(kept), same FROM (SELECT *, len(kept) < 3 AND same < 1 AS ok FROM (
 SELECT *, len(list_filter(kept, lambda x: x.sector = sector)) AS same FROM (SELECT c.*, list_filter(f.book, lambda x: x.fin >= c.date) AS kept FROM bookf f JOIN bookc c ON c.rn = f.rn + 1)))""")
oracle("r5_living_book", "date:d symbol score:f sector exit_date:d n_open:i n_sector:i", "SELECT c.*, f.n_open, f.n_sector FROM bookc c JOIN bookf f USING (rn) WHERE f.taken")
oracle("r6_latest_k", "symbol date:d back:i", "SELECT symbol, date, n_bars - bar_no + 1 AS back FROM bars WHERE bar_no > n_bars - 5")

# ── patterns ─────────────────────────────────────────────────────────────

PC = "symbol date:d confidence:f breakout_level:f"
oracle("p1_fifty_two_week_high", f"{PC} base_start_date:d base_height:f touches:f", "SELECT * FROM p52")
cte("pairs", f"""SELECT s.symbol, s.bar_no AS s, t.bar_no AS t, s.high AS sh, max(t.high) OVER w AS top_, min(t.low) OVER w AS flo FROM bars s JOIN bars t ON t.symbol = s.symbol AND t.bar_no BETWEEN s.bar_no AND s.bar_no + 79
 WINDOW w AS (PARTITION BY s.symbol, s.bar_no ORDER BY t.bar_no)""")
cte("boxc", "SELECT *, (top_ - flo) / top_ AS width, t - s + 1 AS len FROM pairs WHERE t - s + 1 >= 20 AND sh >= top_ * (1 - 0.01) AND flo > 0 AND (top_ - flo) / top_ <= 0.15")
cte("boxt", """SELECT c.symbol, c.s, c.t, c.top_, c.flo, c.width, c.len, count(*) AS touches, max(b.bar_no) AS lasthit FROM boxc c JOIN bars b ON b.symbol = c.symbol AND b.bar_no BETWEEN c.s AND c.t AND b.high >= c.top_ * (1 - 0.01) GROUP BY ALL""")
oracle("p2_darvas_box", f"{PC} base_start_no:i base_height:f touches:f window_len:f floor:f", """SELECT x.symbol, b.date, least(100, 60 + least(20, (touches - 3) * 5) + CASE WHEN width < 0.08 THEN 10 WHEN width < 0.12 THEN 5 ELSE 0 END) AS confidence, top_ AS breakout_level,
 s AS base_start_no, top_ - flo AS base_height, touches, len AS window_len, flo AS floor FROM (SELECT *, row_number() OVER (PARTITION BY symbol, t ORDER BY len DESC) AS r FROM boxt WHERE touches >= 3 AND lasthit - s >= 0.5 * (len - 1)) x
 JOIN bars b ON b.symbol = x.symbol AND b.bar_no = x.t WHERE r = 1""")
cte("nr", f"""SELECT *, list_filter(list(ph) {over(-26, -3)}, lambda x: x IS NOT NULL) AS hs, min(tr) {last(7)} AS mtr, avg(volume) {over(-19, -1)} AS av FROM (SELECT *, greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) AS tr FROM piv3)""")
NR = """SELECT *, 50 + nearp * 30 + quiet * 20 AS confidence, high AS breakout_level, bar_no - 6 AS base_start_no, high - low AS base_height, nearp AS near_pivot_high, quiet AS volume_contraction FROM (
 SELECT *, CASE WHEN len(list_filter(hs[-3:], lambda p: abs(p - high) / p <= 0.02)) > 0 THEN 1 ELSE 0 END AS nearp, CASE WHEN bar_no >= 20 AND volume < av THEN 1 ELSE 0 END AS quiet FROM {0} WHERE bar_no >= 7 AND tr = mtr)"""
oracle("p3_nr7", f"{PC} base_start_no:i base_height:f near_pivot_high:f volume_contraction:f", NR.format("nr"))
cte("inb", f"""SELECT *, bar_no >= 7 AND tr = mtr AS isnr, CASE WHEN mh > ml THEN (high - low) / (mh - ml) ELSE 1 END AS ratio FROM (SELECT *, lag(high) OVER ({W}) AS mh, lag(low) OVER ({W}) AS ml, min(tr) {last(7)} AS mtr FROM base)""")
cte("pin", """SELECT *, 55 + CASE WHEN isnr THEN 20 ELSE 0 END + CASE WHEN ratio < 0.5 THEN 10 ELSE 0 END AS confidence, mh AS breakout_level, bar_no - 1 AS base_start_no, mh - ml AS base_height, ratio AS inside_ratio,
 CASE WHEN isnr THEN 1 ELSE 0 END AS also_nr7 FROM inb WHERE high < mh AND low > ml""")
oracle("p4_inside_bar", f"{PC} base_start_no:i base_height:f inside_ratio:f also_nr7:f", "SELECT * FROM pin")
cte("sq0", "SELECT *, (mid + 2 * sd) AS bu, (mid - 2 * sd) AS bl, ((mid + 2 * sd) - (mid - 2 * sd)) / mid AS bw FROM boll")
cte("sq1", f"SELECT *, min(bw) {last(126)} AS bmin, median(bw) {last(126)} AS bmed, count(bw) {last(126)} AS bn FROM sq0")
cte("psq", """SELECT *, 60 + CASE WHEN bw / bmed < 0.6 THEN 20 WHEN bw / bmed < 0.8 THEN 10 ELSE 0 END AS confidence, bu AS breakout_level, bar_no - bn + 1 AS base_start_no, bu - bl AS base_height, bw AS bb_width, bmed AS median_width_6mo
 FROM sq1 WHERE bar_no >= 60 AND bw <= bmin * 1.001 AND close >= mid""")
oracle("p5_bollinger_squeeze", f"{PC} base_start_no:i base_height:f bb_width:f median_width_6mo:f", "SELECT * FROM psq")
TF = over(-76, -3)
cte("tri0", f"""SELECT *, list_filter(list(ph) {TF}, lambda x: x IS NOT NULL) AS hs, max(ph) {TF} AS top_, count(pl) {TF} AS nl, min(pl) {TF} AS lowest, regr_slope(pl, CASE WHEN pl IS NOT NULL THEN bar_no END) {TF} AS slope,
 regr_r2(pl, CASE WHEN pl IS NOT NULL THEN bar_no END) {TF} AS r2, regr_intercept(pl, CASE WHEN pl IS NOT NULL THEN bar_no END) {TF} AS icpt FROM piv3""")
oracle("p6_ascending_triangle", f"{PC} base_start_no:i base_height:f support_r2:f n_resistance_touches:f n_high_pivots:f n_low_pivots:f", """SELECT *, least(100, 60 + least(20, (r2 - 0.7) / (1 - 0.7) * 20) + least(10, (touch - 3) * 3)) AS confidence,
 top_ AS breakout_level, bar_no - least(80, bar_no) + 1 AS base_start_no, CASE WHEN top_ > icpt + slope * bar_no THEN top_ - (icpt + slope * bar_no) ELSE top_ - lowest END AS base_height, r2 AS support_r2, touch AS n_resistance_touches, len(hs) AS n_high_pivots, nl AS n_low_pivots
 FROM (SELECT *, len(list_filter(hs, lambda h: (top_ - h) / top_ <= 0.02)) AS touch FROM tri0 WHERE bar_no >= 20 AND len(hs) >= 4 AND nl >= 3 AND top_ > 0 AND slope > 0 AND r2 >= 0.7) WHERE touch >= 3""")
cte("cup0", f"SELECT *, unnest(range(5, 26)) AS hl FROM (SELECT symbol, date, bar_no, list(high) {last(180)} AS hs, list(low) {last(180)} AS ls FROM bars) WHERE bar_no >= 40")
cte("cup1", """SELECT *, list_max(hs[1:half]) AS left_lip, list_max(hs[half + 1:ce]) AS right_lip FROM (SELECT *, list_max(hs[ce + 1:n]) AS ht, list_min(ls[ce + 1:n]) AS hb, ce // 2 AS half FROM (SELECT *, len(hs) AS n, len(hs) - hl AS ce FROM cup0) WHERE ce >= 20)
 WHERE (ht - hb) / ht BETWEEN 0.04 AND 0.20""")
cte("cup2", """SELECT *, list_min(ls[li:ri]) AS bottom FROM (SELECT *, list_position(hs[1:half], left_lip) AS li, half + list_position(hs[half + 1:ce], right_lip) AS ri FROM cup1 WHERE abs(right_lip - left_lip) / left_lip <= 0.05 AND ht <= right_lip * 1.01) WHERE ri - li BETWEEN 20 AND 130""")
oracle("p8_cup_and_handle", f"{PC} base_start_no:i base_height:f left_lip:f bottom:f handle_len:f", """SELECT *, least(100, greatest(60, 60 + 10 * (1 - abs(right_lip - left_lip) / left_lip / 0.05) + CASE WHEN (ht - hb) / ht < 0.10 THEN 10 ELSE 0 END)) AS confidence,
 right_lip AS breakout_level, bar_no - n + li AS base_start_no, right_lip - bottom AS base_height, hl AS handle_len FROM (SELECT *, row_number() OVER (PARTITION BY symbol, bar_no ORDER BY hl) AS r FROM cup2
 WHERE bottom > 0 AND (left_lip - bottom) / left_lip BETWEEN 0.12 AND 0.35 AND hb >= (right_lip + bottom) / 2) WHERE r = 1""")
cte("flag0", f"SELECT *, unnest(range(5, 16)) AS fl FROM (SELECT symbol, date, bar_no, close AS c0, list(close) {last(60)} AS cs, list(high) {last(60)} AS hs, list(low) {last(60)} AS ls, list(volume) {last(60)} AS vs FROM bars) WHERE bar_no >= 15")
cte("flag1", """SELECT *, unnest(range(5, 20)) AS pl FROM (SELECT *, list_max(hs[n - fl + 1:n]) AS ft, list_min(ls[n - fl + 1:n]) AS fb, (c0 - cs[n - fl + 1]) / cs[n - fl + 1] AS drift FROM (SELECT *, len(cs) AS n FROM flag0) WHERE n - fl >= 5)
 WHERE ft > 0 AND (ft - fb) / ft <= 0.12 AND drift <= 0 AND drift >= -0.10""")
cte("flag2", """SELECT *, list_avg(vs[n - fl - pl + 1:n - fl]) AS pv, CASE WHEN n - fl - pl > 0 THEN list_avg(vs[1:n - fl - pl]) ELSE list_avg(vs[n - fl - pl + 1:n - fl]) END AS qv FROM (
 SELECT *, (cs[n - fl] - cs[n - fl - pl + 1]) / cs[n - fl - pl + 1] AS move FROM flag1 WHERE n - fl - pl >= 0) WHERE move >= 0.15""")
oracle("p9_flag", f"{PC} base_start_no:i base_height:f pole_len:f flag_len:f pole_move:f", """SELECT *, least(100, 60 + least(20, (move - 0.15) / 0.15 * 20) + CASE WHEN (ft - fb) / ft < 0.06 THEN 10 ELSE 0 END) AS confidence, ft AS breakout_level, bar_no - fl - pl + 1 AS base_start_no,
 cs[n - fl] - cs[n - fl - pl + 1] AS base_height, pl AS pole_len, fl AS flag_len, move AS pole_move FROM (SELECT *, row_number() OVER (PARTITION BY symbol, bar_no ORDER BY fl, pl) AS r FROM flag2 WHERE pv > qv) WHERE r = 1""")
VCP = [
    ("ev", "SELECT symbol, bar_no AS e, 0 AS kind, ph AS price FROM {p} WHERE ph IS NOT NULL UNION ALL SELECT symbol, bar_no, 1, pl FROM {p} WHERE pl IS NOT NULL"),
    ("win", """SELECT b.symbol, b.bar_no AS t, v.e, v.kind, v.price, CASE WHEN lag(v.kind) OVER (PARTITION BY b.symbol, b.bar_no ORDER BY v.e, v.kind) IS DISTINCT FROM v.kind THEN 1 ELSE 0 END AS fresh
 FROM {p} b JOIN {n}ev v ON v.symbol = b.symbol AND v.e BETWEEN greatest(b.bar_no - 249, 1) + 3 AND b.bar_no - 3 WHERE b.bar_no >= 8"""),
    ("isl", """SELECT symbol, t, k, kind, CASE kind WHEN 0 THEN max(price) ELSE min(price) END AS price, CASE kind WHEN 0 THEN arg_max(e, (price, -e)) ELSE arg_min(e, (price, e)) END AS e
 FROM (SELECT *, sum(fresh) OVER (PARTITION BY symbol, t ORDER BY e, kind) AS k FROM {n}win) GROUP BY symbol, t, k, kind"""),
    ("leg", """SELECT *, (price - low_) / price AS depth, row_number() OVER (PARTITION BY symbol, t ORDER BY k DESC) AS r FROM (SELECT *, lead(price) OVER (PARTITION BY symbol, t ORDER BY k) AS low_, lead(e) OVER (PARTITION BY symbol, t ORDER BY k) AS le
 FROM {n}isl) WHERE kind = 0 AND low_ IS NOT NULL AND price > 0 AND price > low_"""),
    ("run", """SELECT *, min(CASE WHEN holds THEN NULL ELSE r END) OVER (PARTITION BY symbol, t) AS n_run FROM (SELECT *, coalesce(depth <= lead(depth) OVER (PARTITION BY symbol, t ORDER BY r) * 0.6, false) AS holds FROM {n}leg)"""),
    ("cum", "SELECT symbol, bar_no, sum(volume) OVER (PARTITION BY symbol ORDER BY bar_no) AS cv FROM {p}"),
    ("vol", """SELECT q.*, (z.cv - coalesce(a.cv, 0)) / (q.le - q.e + 1) AS mv FROM {n}run q JOIN {n}cum z ON z.symbol = q.symbol AND z.bar_no = q.le LEFT JOIN {n}cum a ON a.symbol = q.symbol AND a.bar_no = q.e - 1 WHERE n_run >= 3 AND r <= n_run"""),
    ("sum", """SELECT symbol, t, max(n_run) AS n_run, arg_min(le, r) AS last_low, arg_min(low_, r) AS low1, arg_max(e, r) AS start_, bool_and(falls) AS falling FROM (
 SELECT *, coalesce(mv <= lead(mv) OVER (PARTITION BY symbol, t ORDER BY r), true) AS falls FROM {n}vol) GROUP BY symbol, t"""),
]


def contraction(prefix: str, pivs: str) -> str:
    """Merged pivots as islands of one kind, pullbacks as a high and the low after it, the run as the newest unbroken prefix."""
    for name, sql in VCP:
        cte(f"{prefix}{name}", sql.format(p=pivs, n=prefix))
    return f"""SELECT v.symbol, any_value(b.date) AS date, v.t AS bar_no, least(100, 60 + CASE WHEN any_value(falling) THEN 15 ELSE 0 END + least(15, (any_value(n_run) - 3) * 7.5)) AS confidence, max(h.high) AS breakout_level,
 any_value(start_) AS base_start_no, max(h.high) - any_value(low1) AS base_height, CASE WHEN any_value(falling) THEN 1 ELSE 0 END AS volume_decreasing, any_value(n_run) AS n_contractions
 FROM {prefix}sum v JOIN {pivs} b ON b.symbol = v.symbol AND b.bar_no = v.t JOIN {pivs} h ON h.symbol = v.symbol AND h.bar_no BETWEEN v.last_low AND v.t GROUP BY v.symbol, v.t"""


oracle("p7_vcp", f"{PC} base_start_no:i base_height:f volume_decreasing:f n_contractions:f", contraction("gv", "piv3"))
cte("wpiv", f"""SELECT symbol, date, bar_no, CASE WHEN bar_no > 3 AND bar_no <= n_bars - 3 AND high > max(high) {over(-3, -1)} AND high > max(high) {over(1, 3)} THEN high END AS ph,
 CASE WHEN bar_no > 3 AND bar_no <= n_bars - 3 AND low < min(low) {over(-3, -1)} AND low < min(low) {over(1, 3)} THEN low END AS pl, open, high, low, close, volume, tr FROM base""")
cte("wnr", f"SELECT *, list_filter(list(ph) {over(-26, -3)}, lambda x: x IS NOT NULL) AS hs, min(tr) {last(7)} AS mtr, avg(volume) {over(-19, -1)} AS av FROM wpiv")
cte("wtri", CTES["tri0"].replace("FROM piv3", "FROM wpiv"))
FOUND = {
    "fifty_two_week_high": "p52", "darvas_box": f"({BODIES['p2_darvas_box'].replace('b.date,', 'b.date, b.bar_no,', 1)})", "nr7": f"({NR.format('wnr')})", "inside_bar": "pin", "bollinger_squeeze": "psq",
    "ascending_triangle": f"({BODIES['p6_ascending_triangle'].replace('tri0', 'wtri')})", "vcp": f"({contraction('wv', 'wpiv')})", "cup_and_handle": f"({BODIES['p8_cup_and_handle']})", "flag": f"({BODIES['p9_flag']})",
}
cte("plain", " UNION ALL ".join(f"SELECT symbol, date, bar_no, '{name}' AS pattern, {k} AS ix, confidence, breakout_level, base_height FROM {src}" for k, (name, src) in enumerate(FOUND.items())))
oracle("p10_detect_all", "symbol date:d pattern confidence:f", "SELECT * FROM plain")
oracle("r3_best_pattern", "symbol date:d pattern confidence:f breakout_level:f", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY confidence DESC, ix) AS r FROM plain) WHERE r = 1")
oracle("k4_top_matches", "symbol confidence:f bar_no:i pattern", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY confidence DESC, bar_no, pattern) AS r FROM plain) WHERE r <= 3")

# ── scoring and sizing ───────────────────────────────────────────────────





def vol_pts(v: str) -> str:
    return f"CASE WHEN {v} <= 1.5 THEN greatest({v}, 0) / 1.5 * 7.5 ELSE least(15, 7.5 + ({v} - 1.5) / 1.5 * 7.5) END"


def ext_pen(e: str) -> str:
    return f"CASE WHEN {e} IS NULL OR {e} <= 2 THEN 0 ELSE least(10, ({e} - 2) / 6.0 * 10) END"


CLOSE_PTS = "CASE WHEN cir IS NULL THEN 5 ELSE least(5, greatest(0, cir * 5)) END"
oracle("m1_rs_points", "symbol date:d points:f", f"SELECT symbol, date, {rs_pts('rs_percentile')} AS points FROM ranks")
oracle("m2_tightness_points", "symbol date:d points:f", f"SELECT symbol, date, greatest(0, least(10, ({TIGHT}) * 10)) AS points FROM atrs")
oracle("m3_volume_points", "symbol date:d points:f", f"SELECT symbol, date, {vol_pts('v')} AS points FROM (SELECT *, coalesce(volume / vol_avg_20, 1) AS v FROM base)")
oracle("m4_extension_penalty", "symbol date:d penalty:f", f"SELECT symbol, date, {ext_pen('e')} AS penalty FROM (SELECT *, CASE WHEN level > 0 THEN (close - level) / level * 100 END AS e FROM lev)")
oracle("m5_close_points", "symbol date:d points:f", f"SELECT symbol, date, {CLOSE_PTS} AS points FROM base")
cte("scored", f"""SELECT p.symbol, p.date, p.close, p.cir, p.stage, p.confidence, p.breakout_level AS level, {rs_pts('r.rs_percentile')} AS rs, {vol_pts('coalesce(p.volume_ratio_20, 1)')} AS vp, greatest(0, least(10, (CASE WHEN p.bar_no >= 51 AND p.atr_50 > 0 THEN 1 - p.atr_10 / p.atr_50 ELSE 0 END) * 10)) AS tp,
 CASE m.sector_trend WHEN 'up' THEN 5 WHEN 'down' THEN 0 ELSE 3 END AS sp FROM p52 p LEFT JOIN ranks r ON r.symbol = p.symbol AND r.date = p.date LEFT JOIN uni u ON u.symbol = p.symbol LEFT JOIN secmed m ON m.date = p.date AND m.sector = u.sector""")
oracle("m6_composite_score", "symbol date:d score:f", "SELECT symbol, date, CASE WHEN stage = 'STAGE_2' THEN greatest(0, confidence * 0.35 + 15 + rs + vp + tp + 5 + sp) ELSE 0 END AS score FROM scored")
oracle("m7_rescore", "symbol date:d score:f", f"SELECT symbol, date, greatest(0, confidence * 0.35 + 15 + rs + vp + tp + {CLOSE_PTS} + sp - {ext_pen('((close - level) / level * 100)')}) AS score FROM scored")
cte("cont", f"SELECT *, count(CASE WHEN close / pc - 1 <= -0.25 OR close / pc - 1 >= 0.40 THEN 1 END) {last(299)} AS nbad FROM base")
cte("fair", "SELECT symbol, date, ret_63 FROM cont WHERE nbad = 0 AND ret_63 IS NOT NULL")
cte("fairrank", """SELECT *, CASE WHEN count(*) OVER (PARTITION BY date) = 1 THEN 50.0 ELSE (rank() OVER (PARTITION BY date ORDER BY ret_63) - 1 + (count(*) OVER (PARTITION BY date, ret_63) - 1) / 2.0)
 / (count(*) OVER (PARTITION BY date) - 1) * 100.0 END AS rs_percentile FROM fair""")
cte("fairsec", "SELECT date, sector, CASE WHEN median(ret_63) > 0.02 THEN 5 WHEN median(ret_63) < -0.02 THEN 0 ELSE 3 END AS sp FROM fair JOIN uni USING (symbol) GROUP BY date, sector")
cte("blk1", BLK.format("AND e.event_date >= b.date"))
cte("scan0", f"""SELECT s.symbol, s.date, s.bar_no, s.stage, s.close, c.nbad, s.adv_cr < 0.004 OR coalesce(u.market_cap_cr < 500, false) AS poor, p.confidence, p.breakout_level, coalesce(r.rs_percentile, 0) AS rs_percentile, x.blackout AS earnings_blackout,
 {rs_pts('coalesce(r.rs_percentile, 0)')} AS rs, {vol_pts('coalesce(s.volume_ratio_20, 1)')} AS vp, greatest(0, least(10, (CASE WHEN s.bar_no >= 51 AND s.atr_50 > 0 THEN 1 - s.atr_10 / s.atr_50 ELSE 0 END) * 10)) AS tp, coalesce(m.sp, 3) AS sp
 FROM stg s JOIN cont c ON c.symbol = s.symbol AND c.date = s.date LEFT JOIN uni u ON u.symbol = s.symbol LEFT JOIN blk1 x ON x.symbol = s.symbol AND x.date = s.date LEFT JOIN fairrank r ON r.symbol = s.symbol AND r.date = s.date
 LEFT JOIN fairsec m ON m.date = s.date AND m.sector = u.sector LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY confidence DESC, ix) AS r FROM plain) p ON p.symbol = s.symbol AND p.date = s.date AND p.r = 1""")
cte("scan1", "SELECT *, CASE WHEN confidence IS NOT NULL AND stage = 'STAGE_2' AND NOT poor AND NOT earnings_blackout THEN greatest(0, confidence * 0.35 + 15 + rs + vp + tp + 5 + sp) ELSE 0 END AS score FROM scan0")
cte("scan2", """SELECT symbol, date, stage, CASE WHEN nbad > 0 THEN 'discontinuous' WHEN bar_no < 200 THEN 'insufficient_data' WHEN poor THEN 'quality' WHEN stage <> 'STAGE_2' THEN 'stage' WHEN confidence IS NULL OR breakout_level <= 0 THEN 'no_pattern'
 WHEN (breakout_level - close) / breakout_level > 0.02 THEN 'far_from_breakout' WHEN score < 50 THEN 'low_score' ELSE 'passed' END AS gate, score, rs_percentile, earnings_blackout FROM scan1
 UNION ALL SELECT symbol, date, NULL, 'stale', NULL, NULL, NULL FROM gaps""")
oracle("a16_skip_funnel", "year:i gate n:i", "SELECT year(date) AS year, gate, count(*) AS n FROM scan2 GROUP BY 1, 2")
oracle("morning_scan_gates", "symbol date:d stage gate score:f rs_percentile:f earnings_blackout:b", "SELECT * FROM scan2")
KEYS = (("BANK", ("bank",)), ("IT", ("information technology", "software", " it ")), ("AUTO", ("auto", "automobile")), ("PHARMA", ("pharma", "healthcare", "drug")), ("FMCG", ("fmcg", "consumer goods", "food", "personal")),
        ("METAL", ("metal", "steel", "mining", "iron")), ("REALTY", ("realty", "real estate", "construction")), ("ENERGY", ("energy", "power", "oil", "gas", "petroleum")), ("FINANCE", ("finance", "financial", "nbfc", "insurance")))
oracle("m8_classify_sector", "doc_id:i sector", "SELECT doc_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(x, '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in KEYS) + " END AS sector FROM (SELECT doc_id, ' ' || lower(text) || ' ' AS x FROM documents)")
oracle("m9_regime", "date:d index_trend market_mood regime_score:i regime risk_multiplier:f", "SELECT * FROM reg")
oracle("m10_stress_multiplier", "date:d stress_multiplier:f", """SELECT date, least(CASE WHEN vix >= 30 THEN 0.25 WHEN vix >= 25 THEN 0.5 WHEN vix >= 20 THEN 0.75 ELSE 1 END, CASE WHEN breadth_pct < 30 THEN 0.3 WHEN breadth_pct < 40 THEN 0.6 WHEN breadth_pct < 50 THEN 0.8 ELSE 1 END,
 CASE regime WHEN 'risk_off' THEN 0.5 WHEN 'neutral' THEN 0.8 ELSE 1 END) AS stress_multiplier FROM reg""")
oracle("m11_sector_multiplier", "date:d sector multiplier:f", "SELECT date, sector, CASE WHEN count(*) >= 2 THEN 0.25 WHEN count(*) >= 1 THEN 0.5 ELSE 1 END AS multiplier FROM cand GROUP BY date, sector")
oracle("m12_correlated_size", "symbol entry_date:d size:i", "SELECT t.symbol, t.entry_date, CAST(trunc(t.shares * (CASE WHEN n_open >= 2 THEN 0.25 WHEN n_open >= 1 THEN 0.5 ELSE 1.0 END * CASE WHEN avg_correlation < 0.3 THEN 1.0 WHEN avg_correlation < 0.5 THEN 0.8 WHEN avg_correlation < 0.7 THEN 0.6 ELSE 0.5 END)) AS BIGINT) AS size FROM trades t JOIN avgcorr c ON c.date = t.entry_date LEFT JOIN uni u ON u.symbol = t.symbol LEFT JOIN occ o ON o.date = t.entry_date AND o.sector = u.sector")
oracle("m13_stop_targets", "symbol date:d stop:f target_1:f target_2:f", "SELECT symbol, date, stop_loss AS stop, close + 2 * abs(close - stop_loss) AS target_1, close + base_height AS target_2 FROM sig")
oracle("m14_position_size", "symbol date:d shares:i half:i", """SELECT symbol, date, CASE WHEN close = stop_loss THEN 0 ELSE least(floor(500000.0 * (1.0 * 1.0 / 100) / abs(close - stop_loss)), floor(62500.0 / close)) END AS shares,
 CASE WHEN close = stop_loss THEN 0 ELSE least(floor(500000.0 * (1.0 * 0.5 / 100) / abs(close - stop_loss)), floor(62500.0 / close)) END AS half FROM sig""")
oracle("m15_gap_aware_stop", "symbol date:d multiplier:f stop:f", """SELECT symbol, date, mu AS multiplier, level - mu * atr_14 AS stop FROM (SELECT s.*, CASE WHEN isodow(s.date) = 5 AND NOT k.trading THEN 3.5 WHEN isodow(s.date) = 5 THEN 2.5 ELSE 1.5 END AS mu FROM sig s LEFT JOIN cal k ON k.date = s.date + 3)""")
oracle("m16_costs", "l_suppkey:i cost:f max_share:f", f"""SELECT l_suppkey, CAST(sum(CAST(round({trip('e', 'x', 'n')}, 4) AS DECIMAL(20, 4))) AS DOUBLE) AS cost, max({trip('e', 'x', '1.0')}) AS max_share FROM (SELECT l_suppkey, l_quantity AS n, l_extendedprice / l_quantity AS e, l_extendedprice * (1 - l_discount) / l_quantity AS x FROM lineitem) GROUP BY 1""")
oracle("m17_settlement", "symbol entry_date:d gross_pnl_inr:f costs_inr:f pnl_inr:f pnl_r:f", "SELECT * FROM trades")
oracle("m18_extension_atr_pct", "symbol alert_date:d extension_pct:f atr_pct:f", "SELECT symbol, entry_date AS alert_date, extension_pct, atr_pct FROM trades")

# ── calendar and session ─────────────────────────────────────────────────

oracle("d1_trading_days", "date:d trading:b", "SELECT * FROM cal")
oracle("d2_previous_trading_day", "date:d prev_trading:d", "SELECT * FROM cal")
oracle("d3_last_completed_session", "now:t session:d", """SELECT CAST(date AS TIMESTAMP) + to_hours(CAST(dayofyear(date) % 24 AS INTEGER)) + INTERVAL 45 MINUTE AS now, CASE WHEN trading AND (dayofyear(date) % 24) * 60 + 45 >= 930 THEN date ELSE prev_trading END AS session FROM cal""")
oracle("d4_business_days", "o_orderkey:i days:i", """SELECT o.o_orderkey, abs(a.biz_no - b.biz_no) AS days FROM orders o JOIN (SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS ship FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey
 JOIN cal a ON a.date = CAST(o.o_orderdate AS DATE) JOIN cal b ON b.date = l.ship""")
PROFILE = ((0, 0.000), (15, 0.039), (45, 0.117), (75, 0.181), (105, 0.243), (135, 0.316), (165, 0.395), (195, 0.471), (225, 0.543), (255, 0.609), (285, 0.671), (315, 0.747), (345, 0.851), (375, 1.000))
cte("prof", "SELECT * FROM (VALUES " + ", ".join(f"({m0}, CAST({f0} AS DOUBLE), {m1}, CAST({f1} AS DOUBLE))" for (m0, f0), (m1, f1) in zip(PROFILE, PROFILE[1:])) + ") AS p(m0, f0, m1, f1)")
cte("mins", """SELECT event_id, value, greatest(0, least(375, hour(t) * 60 + minute(t) - 555)) AS m FROM (SELECT *, ts + INTERVAL 330 MINUTE AS t FROM events)""")
cte("frac", "SELECT event_id, value, f0 + (m - m0) / CAST(m1 - m0 AS DOUBLE) * (f1 - f0) AS fraction FROM mins JOIN prof ON (m > m0 OR (m = 0 AND m0 = 0)) AND m <= m1")
oracle("d5_volume_fraction", "event_id:i fraction:f", "SELECT * FROM frac")
oracle("d6_projected_volume", "event_id:i projected:f", "SELECT event_id, CASE WHEN fraction >= 0.5 THEN value / fraction ELSE value END AS projected FROM frac")
oracle("d7_volume_profile", "bucket:i median_share:f n_days:i", """SELECT bucket, median(share) AS median_share, count(*) AS n_days FROM (SELECT *, sum(v) OVER (PARTITION BY event_type, day ORDER BY bucket) * 1.0 / sum(v) OVER (PARTITION BY event_type, day) AS share
 FROM (SELECT event_type, CAST(ts AS DATE) AS day, hour(ts) AS bucket, count(*) AS v FROM events GROUP BY 1, 2, 3)) GROUP BY bucket""")

# ── sorts, sets, maintenance ─────────────────────────────────────────────

oracle("k1_watchlist_order", "date:d symbol score:f", "SELECT * FROM cand ORDER BY score DESC, symbol, date")
oracle("k2_universe_order", "symbol company_name industry", "SELECT * FROM uni ORDER BY symbol")
oracle("u1_union_aligned", "symbol date:d close:f note", "SELECT symbol, date, close, NULL::VARCHAR AS note FROM bars UNION ALL SELECT symbol, date, NULL, 'event' FROM evcal")
oracle("u2_difference_intersection", "date:d side", """SELECT date, 'only_ship' AS side FROM (SELECT CAST(l_shipdate AS DATE) AS date FROM lineitem EXCEPT SELECT CAST(o_orderdate AS DATE) FROM orders) UNION ALL
 SELECT date, 'both' FROM (SELECT CAST(l_shipdate AS DATE) AS date FROM lineitem INTERSECT SELECT CAST(o_orderdate AS DATE) FROM orders)""")
oracle("u3_union_distinct", "date:d", "SELECT date FROM hols UNION SELECT date FROM evcal")
oracle("t1_rebase_prices", "symbol date:d open:f high:f low:f close:f volume:i", """SELECT c.symbol, c.date, c.open * coalesce(price_factor, 1) AS open, c.high * coalesce(price_factor, 1) AS high, c.low * coalesce(price_factor, 1) AS low, c.close * coalesce(price_factor, 1) AS close,
 CASE WHEN abs(volume_factor - 1) > 0.005 THEN round_even(c.volume * volume_factor, 0) ELSE c.volume END AS volume FROM cached c LEFT JOIN factor f USING (symbol) WHERE NOT EXISTS (SELECT 1 FROM feed x WHERE x.symbol = c.symbol AND x.date = c.date)
 UNION ALL SELECT symbol, date, open, high, low, close, volume FROM feed""")
oracle("t2_rebase_trades", "symbol entry_date:d state entry_price:f stop_loss:f target_2:f shares:i", """SELECT symbol, entry_date, state, entry_price * k AS entry_price, stop_loss * k AS stop_loss, target_2 * k AS target_2, CASE WHEN k = 1 THEN shares ELSE round_even(shares / k, 0) END AS shares
 FROM (SELECT l.*, CASE WHEN NOT shut THEN coalesce(price_factor, 1) ELSE 1 END AS k FROM live l LEFT JOIN factor f USING (symbol))""")
oracle("t3_repair_scan", "symbol date:d move:f open_trades:i", "SELECT b.*, (SELECT count(*) FROM live l WHERE l.symbol = b.symbol AND NOT shut) AS open_trades FROM bad35 b")
oracle("t4_backfill_progress", "symbol entry_date:d days_in_trade max_favorable:f", """SELECT symbol, entry_date, 'D' || (count(*) - 1) AS days_in_trade, greatest(0, max((bh - entry_price) / abs(entry_price - stop_loss)) FILTER (WHERE bdate > entry_date)) AS max_favorable FROM tbars GROUP BY symbol, entry_date""")
oracle("t5_flag_failed", "symbol breakout_date:d failure_date", """SELECT w.symbol, breakout_date, CASE WHEN date_diff('day', breakout_date, b.date) BETWEEN 0 AND 3 AND b.close < breakout_level THEN CAST(b.date AS VARCHAR) END AS failure_date
 FROM watch w LEFT JOIN bars b ON b.symbol = w.symbol AND b.bar_no = w.bn + 1""")
oracle("t6_feature_snapshot", "trade_id symbol alert_date:d alert_type pattern score:f pattern_confidence:f stage rs_percentile:f rs_points:f tightness:f volume_ratio:f volume_ratio_morning:f sector sector_trend distance_pct:f extension_pct:f close_in_range:f atr_pct:f adv_cr:f earnings_blackout:b vix:f market_mood regime regime_score:i breadth_pct:f nifty_trend risk_multiplier:f breakout_level:f entry_price:f base_height:f", "SELECT * FROM feat")

# the daily runs: outcomes by first bars at which something ends, the days as one recursion over all events
cte("stress", """SELECT date, least(CASE WHEN vix >= 30 THEN 0.25 WHEN vix >= 25 THEN 0.5 WHEN vix >= 20 THEN 0.75 ELSE 1 END, CASE WHEN breadth_pct < 30 THEN 0.3 WHEN breadth_pct < 40 THEN 0.6 WHEN breadth_pct < 50 THEN 0.8 ELSE 1 END,
CASE regime WHEN 'risk_off' THEN 0.5 WHEN 'neutral' THEN 0.8 ELSE 1 END) AS scale FROM reg""")
cte("dayrow0", f"""SELECT symbol, date, bar_no, open, high, low, close, atr_14, nbad = 0 AS fine, CASE WHEN bar_no > 20 THEN max(high) {over(-20, -1)} END AS level, max(high) {over(-20, -1)} - min(low) {over(-20, -1)} AS base_height,
 coalesce(cir * 40 + 38, 38) AS score, CASE WHEN bar_no > 20 THEN volume / avg(volume) {over(-20, -1)} END AS vr FROM atrs JOIN (SELECT symbol, bar_no, nbad FROM cont) USING (symbol, bar_no)""")
cte("dayrow", """SELECT d.*, coalesce(u.sector, 'unknown') AS sector, coalesce(s.scale, 1) AS scale, CASE WHEN isodow(d.date) = 5 AND NOT k.trading THEN 3.5 WHEN isodow(d.date) = 5 THEN 2.5 ELSE 1.5 END AS mu
 FROM dayrow0 d LEFT JOIN uni u USING (symbol) LEFT JOIN stress s ON s.date = d.date LEFT JOIN cal k ON k.date = d.date + 3""")
cte("crossed", "SELECT *, 0 AS prio, date AS since, 'BREAKOUT' AS alert_type, 'channel' AS pattern FROM dayrow WHERE fine AND close > level AND level > 0 AND vr >= 1.5 AND score >= 60 AND atr_14 IS NOT NULL")
cte("after_", """SELECT c.symbol, c.since, c.level, c.score, d.date, d.bar_no, d.open, d.high, d.low, d.close, d.atr_14, d.fine, d.sector, d.scale, d.mu,
 min(CASE WHEN d.close < c.level AND d.date - c.since BETWEEN 0 AND 3 THEN d.date END) OVER (PARTITION BY c.symbol, c.since) AS failed_on FROM crossed c JOIN dayrow d ON d.symbol = c.symbol AND d.date - c.since BETWEEN 0 AND 10""")
cte("entries", """SELECT symbol, date, bar_no, close, atr_14, level, base_height, score, sector, scale, mu, prio, since, alert_type, pattern FROM crossed UNION ALL
 SELECT symbol, date, bar_no, close, atr_14, level, greatest(0.0, close - level), score, sector, scale, mu, 1, since, 'PULLBACK_ENTRY', 'pullback' FROM after_ WHERE fine AND bar_no > 20 AND atr_14 IS NOT NULL AND (failed_on IS NULL OR date < failed_on)
 AND level <= low AND low <= level * 1.01 AND close > level AND (least(open, close) - low > abs(close - open) OR close > open) AND (CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0 END >= 0.5 OR close - level >= level * 0.01)""")
cte("placed0", "SELECT *, level - mu * atr_14 AS sl, close + 2.0 * abs(close - (level - mu * atr_14)) AS t1, close + base_height AS t2 FROM entries")
cte("placed1", """SELECT p.symbol, p.date, p.since, p.prio, min(b.bar_no) FILTER (WHERE b.low <= p.sl OR b.high >= p.t2 OR (b.date - p.date >= 30 AND b.high < p.t1)) AS e1, min(b.bar_no) FILTER (WHERE b.high >= p.t1) AS tb
 FROM placed0 p JOIN bars b ON b.symbol = p.symbol AND b.bar_no BETWEEN p.bar_no + 1 AND p.bar_no + 40 GROUP BY ALL""")
cte("placed2", """SELECT p.symbol, p.date, p.since, p.prio, any_value(q.e1) AS e1, any_value(q.tb) AS tb, min(b.bar_no) FILTER (WHERE b.bar_no > q.tb AND (b.low <= p.close OR b.high >= p.t2 OR b.date - p.date >= 30)) AS e2
 FROM placed0 p JOIN placed1 q USING (symbol, date, since, prio) JOIN bars b ON b.symbol = p.symbol AND b.bar_no BETWEEN p.bar_no + 1 AND p.bar_no + 40 GROUP BY ALL""")
cte("placed3", """SELECT p.*, coalesce(tb < e1 OR (e1 IS NULL AND tb IS NOT NULL), false) AS half, CASE WHEN coalesce(tb < e1 OR (e1 IS NULL AND tb IS NOT NULL), false) THEN e2 ELSE e1 END AS fin_no,
 CASE WHEN coalesce(tb < e1 OR (e1 IS NULL AND tb IS NOT NULL), false) THEN close ELSE sl END AS live FROM placed0 p LEFT JOIN placed2 USING (symbol, date, since, prio)""")
cte("placed", """SELECT p.*, b.date AS exit_date, CASE WHEN b.date IS NULL THEN CASE WHEN half THEN 'TARGET_1_HIT' ELSE 'ENTERED' END WHEN b.low <= live THEN 'STOPPED_OUT' WHEN b.high >= t2 THEN 'TARGET_HIT' ELSE 'TIME_EXIT' END AS state,
 CASE WHEN b.low <= live THEN least(live, b.open) WHEN b.high >= t2 THEN t2 ELSE b.close END AS exit_price, least(CAST(floor(500000.0 * (1.0 * p.scale / 100) / abs(p.close - sl)) AS BIGINT), CAST(floor(62500.0 / p.close) AS BIGINT)) AS shares,
 row_number() OVER (ORDER BY p.date, prio, CASE prio WHEN 0 THEN -score ELSE 0 END, p.symbol, since) AS rn FROM placed3 p LEFT JOIN bars b ON b.symbol = p.symbol AND b.bar_no = fin_no""")
cte("dayfold", """SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(sector VARCHAR, fin DATE)[]) AS book, CAST([] AS STRUCT(symbol VARCHAR, since DATE)[]) AS listed, CAST([] AS STRUCT(symbol VARCHAR, level DOUBLE)[]) AS fired, false AS taken, CAST(0 AS BIGINT) AS n_open, CAST(0 AS BIGINT) AS n_sector
 UNION ALL SELECT rn, CASE WHEN ok THEN list_append(kept, {'sector': sector, 'fin': exit_date}) ELSE kept END, CASE WHEN ok AND prio = 0 THEN list_append(others, {'symbol': symbol, 'since': since}) WHEN ok THEN others ELSE listed END,
 CASE WHEN ok AND prio = 1 THEN list_append(fired, {'symbol': symbol, 'level': level}) ELSE fired END, ok, len(kept), same FROM (SELECT *, len(kept) < 8 AND same < 3 AND (prio = 0 OR (waits AND NOT again)) AS ok FROM (
 SELECT *, len(list_filter(kept, lambda x: x.sector = sector)) AS same FROM (SELECT c.*, f.listed, f.fired, list_filter(f.book, lambda x: x.fin IS NULL OR x.fin >= c.date) AS kept,
 list_filter(f.listed, lambda x: x.symbol <> c.symbol AND x.since >= c.date - 10) AS others, len(list_filter(f.listed, lambda x: x.symbol = c.symbol AND x.since = c.since)) > 0 AS waits,
 len(list_filter(f.fired, lambda x: x.symbol = c.symbol AND abs(x.level - c.level) < 0.01)) > 0 AS again
 FROM dayfold f JOIN (SELECT rn, CAST(date AS DATE) AS date, symbol, sector, CAST(since AS DATE) AS since, level, CAST(exit_date AS DATE) AS exit_date, prio FROM placed) c ON c.rn = f.rn + 1)))""")
oracle("daily_runs", "date:d symbol alert_type pattern score:f sector breakout_level:f since:d entry_price:f stop_loss:f target_1:f target_2:f shares:i state exit_date:d exit_price:f pnl_inr:f pnl_r:f n_open:i n_sector:i",
 f"""SELECT c.*, level AS breakout_level, close AS entry_price, sl AS stop_loss, t1 AS target_1, t2 AS target_2, (exit_price - close) * shares - {trip('close', 'exit_price', 'shares')} AS pnl_inr,
 ((exit_price - close) - {trip('close', 'exit_price', '1.0')}) / greatest(1e-9, abs(close - sl)) AS pnl_r, f.n_open, f.n_sector FROM placed c JOIN dayfold f USING (rn) WHERE f.taken""")

# ── state and streams ────────────────────────────────────────────────────

cte("one", """SELECT t.*, b.date AS bd, b.open AS bo, b.high AS bh2, b.low AS bl2, b.close AS bc2, t.entry_no % 3 = 0 AS t1done, CASE WHEN t.entry_no % 3 = 0 THEN greatest(t.entry_price, t.stop_loss) ELSE t.stop_loss END AS st,
 date_diff('day', t.entry_date, b.date) AS held FROM trades t LEFT JOIN bars b ON b.symbol = t.symbol AND b.bar_no = t.entry_no + 2""")
cte("one1", """SELECT *, CASE WHEN bd IS NULL THEN CASE WHEN t1done THEN 'TARGET_1_HIT' ELSE 'ENTERED' END WHEN bl2 <= st THEN 'STOPPED_OUT' WHEN bh2 >= target_2 THEN 'TARGET_HIT' WHEN NOT t1done AND bh2 >= target_1 THEN 'TARGET_1_HIT' WHEN held >= 30 THEN 'TIME_EXIT'
 WHEN t1done THEN 'TARGET_1_HIT' ELSE 'ENTERED' END AS new_state FROM one""")
cte("one2", "SELECT *, CASE new_state WHEN 'STOPPED_OUT' THEN least(st, bo) WHEN 'TARGET_HIT' THEN target_2 WHEN 'TIME_EXIT' THEN bc2 END AS xp FROM one1")
oracle("x1_settle", "symbol entry_date:d new_state exit_price:f days_held:f pnl_inr:f pnl_r:f", f"""SELECT symbol, entry_date, new_state, xp AS exit_price, CASE WHEN xp IS NOT NULL THEN held END AS days_held, CASE WHEN xp IS NOT NULL THEN (xp - entry_price) * shares - {trip('entry_price', 'xp', 'shares')} END AS pnl_inr,
 CASE WHEN xp IS NOT NULL THEN (xp - entry_price - {trip('entry_price', 'xp', '1.0')}) / greatest(1e-9, abs(entry_price - stop_loss)) END AS pnl_r FROM one2""")
oracle("x2_label_outcomes", "symbol entry_date:d exit_date:d state exit_price:f bars_held:i shares:i pnl_r:f", "SELECT * FROM lab")
oracle("x3_replay", "symbol entry_date:d exit_date:d state exit_price:f", "SELECT * FROM trades")
# the same labels and choice over the scanner's own signal
cte("dsig", f"""SELECT * FROM (SELECT s.*, p.pattern, p.breakout_level AS level, p.base_height, p.breakout_level - 1.5 * s.atr_14 AS stop_loss, CASE WHEN s.stage = 'STAGE_2' THEN greatest(0, p.confidence * 0.35 + 15 + {vol_pts('coalesce(s.volume_ratio_20, 1)')}
 + {CLOSE_PTS} + 3 - {ext_pen('(CASE WHEN p.breakout_level > 0 THEN (s.close - p.breakout_level) / p.breakout_level * 100 END)')}) ELSE 0 END AS score
 FROM stg s JOIN (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY confidence DESC, ix) AS r FROM plain) p ON p.symbol = s.symbol AND p.date = s.date AND p.r = 1)
 WHERE bar_no > 200 AND bar_no < n_bars AND level > 0 AND (level - close) / level <= 0.02 AND score >= 60 AND atr_14 IS NOT NULL""")
for name in ("lab0", "lab1", "lab2", "lab3", "lab4", "lab5", "lab", "nxt", "pick", "trades"):
    cte(f"d{name}", re.sub(r"\b(sig|lab[0-5]?|nxt|pick|trades)\b", r"d\1", CTES[name]))
oracle("x3_replay_default_signal", "symbol entry_date:d exit_date:d pattern score:f state exit_price:f pnl_r:f", "SELECT * FROM dtrades")
cte("tk0", "SELECT t.*, b.bar_no AS bn, b.date AS bd, b.open AS bo, b.high AS bh2, b.low AS bl2, b.close AS bc2, date_diff('day', t.entry_date, b.date) AS held FROM trades t JOIN bars b ON b.symbol = t.symbol AND b.date > t.entry_date")
cte("tk1", "SELECT id, min(bn) FILTER (WHERE bl2 <= stop_loss) AS j_stop, min(bn) FILTER (WHERE bh2 >= target_2) AS j_t2, min(bn) FILTER (WHERE bh2 >= target_1) AS j_t1 FROM tk0 GROUP BY id")
cte("tk2", "SELECT *, CASE WHEN j_t1 IS NOT NULL AND (j_stop IS NULL OR j_t1 < j_stop) AND (j_t2 IS NULL OR j_t1 < j_t2) THEN j_t1 END AS hit FROM tk1")
cte("tk3", "SELECT k.id, h.hit, min(k.bn) FILTER (WHERE CASE WHEN h.hit IS NOT NULL AND k.bn > h.hit THEN k.bl2 <= k.entry_price ELSE k.bl2 <= k.stop_loss END) AS js, min(k.bn) FILTER (WHERE k.bh2 >= k.target_2) AS j2, min(k.bn) FILTER (WHERE k.held >= 30 AND k.bn IS DISTINCT FROM h.hit) AS jt FROM tk0 k JOIN tk2 h USING (id) GROUP BY k.id, h.hit")
cte("tk4", "SELECT *, least(coalesce(js, 1000000000), coalesce(j2, 1000000000), coalesce(jt, 1000000000)) AS jx FROM tk3")
oracle("x4_stream_tracker", "symbol entry_date:d state date:d price:f", """SELECT k.symbol, k.entry_date, k.bd AS date, CASE WHEN k.bn = x.jx THEN CASE WHEN x.jx = x.js THEN 'STOPPED_OUT' WHEN x.jx = x.j2 THEN 'TARGET_HIT' ELSE 'TIME_EXIT' END ELSE 'TARGET_1_HIT' END AS state,
 CASE WHEN k.bn = x.jx THEN CASE WHEN x.jx = x.js THEN least(CASE WHEN x.hit < x.jx THEN k.entry_price ELSE k.stop_loss END, k.bo) WHEN x.jx = x.j2 THEN k.target_2 ELSE k.bc2 END ELSE k.target_1 END AS price
 FROM tk0 k JOIN tk4 x USING (id) WHERE k.bn = x.jx OR (k.bn = x.hit AND x.hit < x.jx)""")
oracle("x5_stream_bars", "symbol ts:t open:f high:f low:f close:f volume:i", """SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2""")
oracle("x6_stream_upsert", "symbol date:d close:f volume:i", "SELECT symbol, date, CASE WHEN bar_no > n_bars - 10 THEN close + 1 ELSE close END AS close, volume FROM bars")
oracle("x6_stream_counts", "read:i late:i repeated:i kept:i", """SELECT count(*) + count(*) FILTER (WHERE volume % 3 = 0) AS read, 0 AS late, count(*) FILTER (WHERE volume % 3 = 0) AS repeated, count(*) AS kept
 FROM bars WHERE bar_no > n_bars - 10""")
oracle("x7_stream_confirm", "symbol date:d close:f breakout_level:f", "SELECT l.symbol, l.date, l.close, w.breakout_level FROM lev l JOIN watch w USING (symbol) WHERE l.date >= breakout_date AND l.close > w.breakout_level AND l.vr >= 1.5")
oracle("x8_expiring_watchlist", "symbol breakout_date:d breakout_level:f original_score:f", "SELECT * FROM watch WHERE breakout_date >= DATE '2000-03-31' - 400")
oracle("x8_stream_watchlist", "symbol date:d change breakout_date:d breakout_level:f original_score:f", """SELECT k.symbol, c.date, c.change, k.date AS breakout_date, k.level AS breakout_level, k.score AS original_score FROM (
 SELECT *, lead(date) OVER (PARTITION BY symbol ORDER BY date) AS nd, lead(removes) OVER (PARTITION BY symbol ORDER BY date) AS nr, max(date) OVER () AS fin FROM (
 SELECT symbol, date, false AS removes, level, close / 20.0 AS score FROM lev WHERE close > level AND vr >= 1.2 UNION ALL SELECT symbol, date, true, NULL, NULL FROM lev WHERE close < 0.9 * level)) k,
 LATERAL (SELECT k.date AS date, 'added' AS change UNION ALL SELECT k.nd, 'removed' WHERE k.nr AND k.nd <= k.date + 20 UNION ALL SELECT k.date + 21, 'expired' WHERE coalesce(k.nd > k.date + 20, true) AND k.date + 21 <= k.fin) c
 WHERE NOT k.removes""")

ORACLES: dict[str, str] = {name: statement(name) for name in BODIES}
