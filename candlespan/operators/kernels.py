"""Grouped-map kernels: the few per-series computations that window frames cannot express.

`run_kernels` sends each bounded segment of the panel through Arrow once and lets every kernel add its columns, so
smoothing and the three search-type patterns share one exchange. Windowed columns should be added before it (the
exchange is the same) and only row-level expressions after it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from candlespan.operators.panel import BACK, SEG_ROWS, panel


@dataclass(frozen=True)
class Kernel:
    """`fn(segment rows in bar order) -> {column: values}`; `outputs` lists (column, Spark type). The rows are a frame, or `Columns`."""

    outputs: tuple
    fn: Callable[[pd.DataFrame | Columns], dict]


class Columns:
    """A segment's columns by name, as Series made when they are asked for: frames of all columns, made anew for every kernel, cost more than
    some searches."""

    def __init__(self, values: dict[str, np.ndarray]):
        self.values, self.made = values, {}

    def __getitem__(self, name: str) -> pd.Series:
        if name not in self.made:
            self.made[name] = pd.Series(self.values[name], copy=False)
        return self.made[name]

    def __setitem__(self, name: str, column: pd.Series) -> None:
        self.made[name] = column

    def __len__(self) -> int:
        return len(next(iter(self.values.values())))

    def copy(self, deep: bool = False) -> Columns:
        out = Columns(self.values)
        out.made.update(self.made)
        return out


def only(kernel: Kernel, names) -> Kernel:
    """A kernel that hands back some of its columns."""
    return Kernel(tuple(o for o in kernel.outputs if o[0] in names), lambda pdf: {n: v for n, v in kernel.fn(pdf).items() if n in names})


def run_kernels(panel: DataFrame, kernels: list[Kernel], keep: Callable[[pd.DataFrame], np.ndarray] | None = None) -> DataFrame:
    """Adds all kernels' columns with one grouped map over `(symbol, seg)`; with `keep` only the rows it marks are handed back."""
    if not kernels:
        return panel
    added = [T.StructField(name, kind) for k in kernels for name, kind in k.outputs]
    # dates travel as day numbers: Arrow would otherwise turn every one into a Python object
    dates = [f.name for f in panel.schema.fields if isinstance(f.dataType, T.DateType)]
    plain = panel.withColumns({c: F.unix_date(c) for c in dates})
    schema = T.StructType(plain.schema.fields + added)
    plain_names, at_bar = plain.columns, plain.columns.index("bar_no")
    texts = {f.name for f in plain.schema.fields if isinstance(f.dataType, T.StringType)}

    kinds = {f.name: to_arrow_type(f.dataType) for f in added}
    target = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def apply(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        numbers = rows.column(at_bar).to_numpy()
        if not np.all(numbers[1:] >= numbers[:-1]):
            rows = rows.take(pa.array(np.argsort(numbers, kind="stable")))
        columns = {c: rows.column(i) for i, c in enumerate(plain_names)}
        seen = {c: columns[c].to_numpy() for c in plain_names if c not in texts}
        for c, values in seen.items():
            if values.dtype.kind == "f" and pa.types.is_floating(columns[c].type):
                columns[c] = pa.array(values, from_pandas=True)  # what is not a number leaves as NULL
        frame = Columns(seen)
        for k in kernels:
            made = k.fn(frame)
            for name, values in made.items():
                seen[name] = values.to_numpy() if isinstance(values, pd.Series) else values
                columns[name] = pa.array(seen[name], kinds[name], from_pandas=True)
        out = pa.Table.from_arrays([columns[c] for c in target.names], names=target.names)
        return out if keep is None else out.filter(pa.array(keep(frame)))

    out = plain.groupBy("symbol", "seg").applyInArrow(apply, schema)
    return out.withColumns({c: F.date_from_unix_date(c) for c in dates})


# ── exponential smoothing ────────────────────────────────────────────────


@dataclass(frozen=True)
class Smooth:
    """One recursive mean: y[t] = (1-alpha)*y[t-1] + alpha*x[t], started at the first value.

    `source` is a column name or a function of the segment's frame, which may use earlier outputs. Nulls keep the
    previous mean and fade it by the gap; the result stays NULL until `min_periods` values were seen.
    """

    out: str
    source: str | Callable[[pd.DataFrame], pd.Series]
    alpha: float
    min_periods: int = 1


def halo_rows(alpha: float) -> int:
    """Rows after which a recursive mean has forgotten its start, to double precision."""
    return 1 if alpha >= 1 else math.ceil(math.log(1e-16) / math.log1p(-alpha))


def smoothing_panel(bars: DataFrame, specs: list[Smooth]) -> DataFrame:
    """A panel whose segments carry as many rows before their own as the slowest of the means needs."""
    back = max([BACK, *[halo_rows(s.alpha) for s in specs]])
    return panel(bars, seg_rows=max(SEG_ROWS, back), back=back)


def smoothing(specs: list[Smooth]) -> Kernel:
    """Recursive means of any period. A segment that starts with the series is exact; a later one restarts the recursion at its halo,
    which must be long enough for the start to fade below double precision: `smoothing_panel` cuts it so."""

    def fn(pdf: pd.DataFrame) -> dict:
        # a symbol's first segment starts with the series, even if its first numbers are those of bars without a date
        if pdf["bar_no"].iloc[0] > 1 and pdf["seg"].iloc[0] > 0:
            halo = int(np.argmax(pdf["own"].to_numpy(bool)))
            for s in specs:
                if halo < halo_rows(s.alpha):
                    raise ValueError(f"{s.out}: a halo of {halo} rows is too short for alpha {s.alpha}; use smoothing_panel")
        work = pdf.copy(deep=False)
        out = {}
        for s in specs:
            x = s.source(work) if callable(s.source) else work[s.source]
            out[s.out] = x.ewm(alpha=s.alpha, adjust=False, min_periods=s.min_periods).mean()
            work[s.out] = out[s.out]
        return out

    return Kernel(tuple((s.out, T.DoubleType()) for s in specs), fn)


def reseeded(y: str, x: str, alpha: float, seed_bars: int) -> Column:
    """A smoothed column as if its recursion had started `seed_bars` bars ago instead of at the first bar.

    The two recursions differ by the start difference, faded once per bar, so no second pass is needed. `y` must be
    smoothed with `min_periods` 1, so that the start values are known.
    """
    from candlespan.operators.panel import series

    gap = F.lag(F.col(y) - F.col(x), seed_bars - 1).over(series())
    return F.col(y) - F.coalesce(gap, F.lit(0.0)) * (1.0 - alpha) ** (seed_bars - 1)


# ── trailing windows ─────────────────────────────────────────────────────
# A sliding window frame of Spark's reads all its rows again for every bar. Here whole shifted series are added in the order in
# which the frame would add its rows, so means are the same to the last bit.


@dataclass(frozen=True)
class Rolling:
    """Mean, max or min of the last `n` known values of a column; `full` leaves NULL before there are `n` bars."""

    out: str
    source: str
    n: int
    how: str = "mean"
    full: bool = True


def _trailing_mean(values: np.ndarray, n: int, skip: int = 0) -> np.ndarray:
    """Mean of the known values among the `n` before the newest `skip`, the current one counted; NaN where there is none."""
    known = ~np.isnan(values)
    x, total, size = np.where(known, values, 0.0), np.zeros(len(values)), len(values)
    for k in range(min(n + skip, size) - 1, skip - 1, -1):
        np.add(total[k:], x[: size - k], out=total[k:])
    seen = np.concatenate([[0], np.cumsum(known)])
    at = np.arange(size) + 1
    count = seen[np.maximum(at - skip, 0)] - seen[np.maximum(at - skip - n, 0)]
    return np.where(count > 0, total / np.maximum(count, 1), np.nan)


def _trailing_least(values: np.ndarray, n: int) -> np.ndarray:
    """Least known value of the last `n`, NaN where there is none, from least values of stretches of 1, 2, 4, ... rows."""
    least, width = np.where(np.isnan(values), np.inf, values), 1
    while width < min(n, len(values)):
        step = min(width, n - width)
        wider = least.copy()
        wider[step:] = np.minimum(least[step:], least[: len(least) - step])
        least, width = wider, width + step
    return np.where(np.isinf(least), np.nan, least)


def rolling(specs: list[Rolling]) -> Kernel:
    """Trailing means and extremes, which window frames give as well but with `n` steps a bar."""
    if any(r.n > BACK for r in specs):
        raise ValueError(f"a trailing window exceeds the {BACK}-row halo")

    def fn(pdf: pd.DataFrame) -> dict:
        out, number = {}, pdf["bar_no"].to_numpy(np.int64)
        for r in specs:
            x = pdf[r.source].to_numpy(float)
            if r.how == "mean":
                y = _trailing_mean(x, r.n)
            else:
                y = _trailing_least(x, r.n) if r.how == "min" else -_trailing_least(-x, r.n)
            out[r.out] = np.where(number >= r.n, y, np.nan) if r.full else y
        return out

    return Kernel(tuple((r.out, T.DoubleType()) for r in specs), fn)


def lagged(*specs: tuple[str, str, int]) -> Kernel:
    """(out, source, n): a column's value `n` bars before. For outputs of earlier kernels, as a window behind the grouped map costs an exchange."""

    def fn(pdf: pd.DataFrame) -> dict:
        out = {}
        for name, source, n in specs:
            values = pdf[source].to_numpy(float)
            out[name] = np.full(len(values), np.nan)
            out[name][n:] = values[: len(values) - n] if n < len(values) else values[:0]
        return out

    return Kernel(tuple((name, T.DoubleType()) for name, _, _ in specs), fn)


# ── pivot dominance ──────────────────────────────────────────────────────


def _run_before(values: np.ndarray) -> np.ndarray:
    """For each position, how many directly preceding values are strictly smaller.

    Maxima of all stretches of 1, 2, 4, ... values, then one descent over the widths for all positions at once.
    """
    n = len(values)
    tops, width = [values], 1
    while 2 * width <= n:
        tops.append(np.maximum(tops[-1][: n - 2 * width + 1], tops[-1][width:]))
        width *= 2
    at = np.arange(n)
    for k in range(len(tops) - 1, -1, -1):
        width = 1 << k
        room = np.flatnonzero(at >= width)
        at[room[tops[k][at[room] - width] < values[room]]] -= width
    return np.arange(n) - at


def dominance_kernel() -> Kernel:
    """Runs of strict dominance on both sides of each bar, for highs and (negated) lows."""

    def fn(pdf: pd.DataFrame) -> dict:
        out = {}
        for kind, v in (("h", pdf["high"].to_numpy(float)), ("l", -pdf["low"].to_numpy(float))):
            out[f"{kind}_left"] = _run_before(v)
            out[f"{kind}_right"] = _run_before(v[::-1])[::-1]
        return out

    return Kernel(tuple((f"{k}_{s}", T.LongType()) for k in "hl" for s in ("left", "right")), fn)


# ── pattern searches ─────────────────────────────────────────────────────
# Kernels hand back flat number columns (NULL where nothing was found); `patterns` turns them into structs.

FIELDS = ("confidence", "level", "start", "height")


def _columns(prefix: str, names, size: int) -> dict:
    return {f"{prefix}_{n}": np.full(size, np.nan) for n in names}


def _doubles(prefix: str, names) -> tuple:
    return tuple((f"{prefix}_{n}", T.DoubleType()) for n in names)


def _powers(longest: int) -> int:
    return max(1, longest).bit_length()


def _extremes(values: np.ndarray, longest: int) -> Callable:
    """The place of the first highest value among `a..b-1`, for arrays of non-empty stretches of up to `longest` values."""
    places = [np.arange(len(values))]
    for k in range(1, _powers(min(longest, len(values)))):
        i, j = places[-1][: len(values) - (1 << k) + 1], places[-1][1 << (k - 1) :]
        places.append(np.where(values[i] >= values[j], i, j))

    def look(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), dtype=np.int64)
        powers = np.frexp(b - a)[1] - 1
        for k in np.unique(powers):
            at = np.flatnonzero(powers == k)
            i, j = places[k][a[at]], places[k][b[at] - (1 << int(k))]
            out[at] = np.where(values[i] >= values[j], i, j)
        return out

    return look


def _minima(values: np.ndarray, longest: int) -> Callable:
    """The lowest value among `a..b-1`, NaN where there is one among them, for arrays of stretches as in `_extremes`."""
    least = [values]
    for k in range(1, _powers(min(longest, len(values)))):
        least.append(np.minimum(least[-1][: len(values) - (1 << k) + 1], least[-1][1 << (k - 1) :]))

    def look(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a))
        powers = np.frexp(b - a)[1] - 1
        for k in np.unique(powers):
            at = np.flatnonzero(powers == k)
            out[at] = np.minimum(least[k][a[at]], least[k][b[at] - (1 << int(k))])
        return out

    return look


def _behind(values: np.ndarray, n: int, fill: float) -> np.ndarray:
    """For each bar its last `n` values, the newest first, `fill` before the first one."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, fill), values]), n)[:, ::-1]


def _first_of_each(rows: np.ndarray) -> np.ndarray:
    """The places of the first of every run of equal numbers."""
    return np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)


BOX_NOTES = ("floor", "touches", "window_len", "relative_width")


def box_kernel(max_len: int = 80, min_len: int = 20, touch: float = 0.01, max_height: float = 0.15,
               min_touches: int = 3) -> Kernel:
    """Longest window ending at each bar that opens on its ceiling, is shallow and is retested late."""
    names = FIELDS + BOX_NOTES

    def fn(pdf: pd.DataFrame) -> dict:
        high, low = pdf["high"].to_numpy(float), pdf["low"].to_numpy(float)
        first, n = int(pdf["bar_no"].iloc[0]), len(high)
        out = _columns("box", names, n)
        longest = min(max_len, n)
        if longest < min_len:
            return out
        # a row for each bar, a column for each length of window
        past = _behind(high, longest, -np.inf)
        tops, floors = np.maximum.accumulate(past, axis=1), np.minimum.accumulate(_behind(low, longest, np.inf), axis=1)
        lengths = np.arange(min_len, longest + 1)
        top, floor = tops[:, min_len - 1 :], floors[:, min_len - 1 :]
        line = top * (1 - touch)
        with np.errstate(divide="ignore", invalid="ignore"):
            width = (top - floor) / top
            ok = (floor > 0) & (top > 0) & (past[:, min_len - 1 :] >= line) & (width <= max_height)
        # a late touch: the highest of the later half reaches the line
        ok &= tops[:, lengths - np.ceil(0.5 * (lengths - 1)).astype(int) - 1] >= line
        ok &= lengths <= np.arange(1, n + 1)[:, None]
        # the longest that fits: bars whose longest window lacks touches go on with the next one
        t = np.flatnonzero(ok.any(axis=1))
        k = len(lengths) - 1 - ok[t, ::-1].argmax(axis=1)
        while len(t):
            touches = np.count_nonzero((past[t] >= line[t, k][:, None]) & (np.arange(longest) < lengths[k][:, None]), axis=1)
            good = touches >= min_touches
            at, j, touches = t[good], k[good], touches[good]
            w, length = width[at, j], lengths[j]
            bonus = np.where(w < 0.08, 10.0, np.where(w < 0.12, 5.0, 0.0))
            conf = np.minimum(100.0, 60.0 + np.minimum(20.0, (touches - min_touches) * 5.0) + bonus)
            for name, v in zip(names, (conf, top[at, j], first + at - length + 1, top[at, j] - floor[at, j], floor[at, j], touches, length, w)):
                out[f"box_{name}"][at] = v
            t, k = t[~good], k[~good]
            left = ok[t] & (np.arange(len(lengths)) < k[:, None])
            more = left.any(axis=1)
            t, k = t[more], len(lengths) - 1 - left[more, ::-1].argmax(axis=1)
        return out

    return Kernel(_doubles("box", names), fn)


VCP_NOTES = ("volume_decreasing", "n_contractions")


def contraction_kernel(lookback: int = 250, n: int = 3, min_run: int = 3, ratio: float = 0.6) -> Kernel:
    """Trailing run of pullbacks, each at most `ratio` of the one before. Needs `piv_high`, `piv_low` columns.

    At each bar only pivots confirmed by then and inside the lookback count. The pivots are walked from the newest
    back, merging neighbours of one kind into their extreme, until a pullback breaks the run.
    """
    names = FIELDS + VCP_NOTES

    def fn(pdf: pd.DataFrame) -> dict:
        high = pdf["high"].to_numpy(float)
        vol = np.concatenate([[0], np.cumsum(pdf["volume"].to_numpy(np.int64))])
        ph, pl = pdf["piv_high"].to_numpy(float), pdf["piv_low"].to_numpy(float)
        first, size = int(pdf["bar_no"].iloc[0]), len(high)
        hi, lo = np.nonzero(~np.isnan(ph))[0], np.nonzero(~np.isnan(pl))[0]
        events = sorted([(int(i), 0, float(ph[i])) for i in hi] + [(int(i), 1, float(pl[i])) for i in lo])
        bars = np.array([e[0] for e in events], dtype=np.int64)
        ends = np.searchsorted(bars, np.arange(size) - n, side="right")
        starts = np.searchsorted(bars, np.maximum(np.arange(size) - lookback + 1, 0) + n, side="left")
        out = _columns("vcp", names, size)
        moves: list = [None] * size

        def walk(stop: int, begin: int):
            """Run of (depth, high bar, low bar, low), newest first, and the oldest pivot the result depends on."""
            run: list = []
            low_leg = None
            j = stop - 1
            while j >= begin:
                bar, kind, price = events[j]
                while j - 1 >= begin and events[j - 1][1] == kind:
                    j -= 1
                    if (events[j][2] >= price) if kind == 0 else (events[j][2] <= price):
                        bar, price = events[j][0], events[j][2]
                if kind == 1:
                    low_leg = (bar, price)
                elif low_leg is not None and price > 0 and price > low_leg[1]:
                    depth = (price - low_leg[1]) / price
                    if run and not run[-1][0] <= depth * ratio:
                        return run, j
                    run.append((depth, bar, low_leg[0], low_leg[1]))
                j -= 1
            return run, begin

        # the run changes where a pivot is confirmed, or where the oldest one it rests on leaves the lookback; between, only the level moves
        t = 2 * n + 1
        while t < size:
            run, oldest = walk(int(ends[t]), int(starts[t]))
            until = min(int(np.searchsorted(ends, ends[t], side="right")), max(t + 1, int(np.searchsorted(starts, oldest, side="right"))))
            if len(run) >= min_run:
                legs = run[::-1]
                means = [(vol[c[2] + 1] - vol[c[1]]) / (c[2] - c[1] + 1) for c in legs]
                falling = all(b <= a for a, b in zip(means, means[1:]))
                level = np.maximum.accumulate(high[legs[-1][2] : until])[t - legs[-1][2] :]
                conf = min(100.0, 60.0 + (15.0 if falling else 0.0) + min(15.0, (len(legs) - min_run) * 7.5))
                for name, v in zip(names, (conf, level, first + legs[0][1], level - legs[-1][3], falling, len(legs))):
                    out[f"vcp_{name}"][t:until] = v
                moves[t:until] = [[round(c[0], 3) for c in legs]] * (until - t)
            t = until
        return {**out, "vcp_moves": moves}

    return Kernel((*_doubles("vcp", names), ("vcp_moves", T.ArrayType(T.DoubleType()))), fn)


CUP_NOTES = ("left_lip", "bottom", "cup_depth", "handle_depth", "cup_duration", "handle_len")


def cup_kernel(lookback: int = 180, min_total: int = 40, min_bars: int = 20, max_bars: int = 130,
               depth=(0.12, 0.35), lip: float = 0.05, handle=(5, 25), handle_depth=(0.04, 0.20)) -> Kernel:
    """Rounded base plus shallow handle ending at each bar; the shortest handle that fits is taken."""
    names = FIELDS + CUP_NOTES

    def fn(pdf: pd.DataFrame) -> dict:
        high, low = pdf["high"].to_numpy(float), pdf["low"].to_numpy(float)
        first, size = int(pdf["bar_no"].iloc[0]), len(high)
        out = _columns("cup", names, size)
        if size < min_total:
            return out
        highest, lowest = _extremes(np.where(np.isnan(high), np.inf, high), lookback), _minima(low, lookback)
        length = np.minimum(np.arange(size) + 1, lookback)
        most = min(handle[1], size)
        if most < handle[0]:
            return out
        tops = np.maximum.accumulate(_behind(high, most, -np.inf), axis=1)[:, handle[0] - 1 :]
        floors = np.minimum.accumulate(_behind(low, most, np.inf), axis=1)[:, handle[0] - 1 :]
        handles = np.arange(handle[0], most + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            depths = (tops - floors) / tops
        fits = (tops > 0) & (depths >= handle_depth[0]) & (depths <= handle_depth[1]) & (length[:, None] - handles >= min_bars)
        fits[: min_total - 1] = False
        # all handles of all bars side by side, a bar's shortest first
        t, k = np.nonzero(fits)
        h, top, floor, hd = handles[k], tops[t, k], floors[t, k], depths[t, k]
        mid = t - length[t] + 1 + (length[t] - h) // 2
        left, right = highest(t - length[t] + 1, mid), highest(mid, t - h + 1)
        ll, rl = high[left], high[right]
        dur = right - left
        with np.errstate(divide="ignore", invalid="ignore"):
            ok = (dur >= min_bars) & (dur <= max_bars) & (ll > 0) & (np.abs(rl - ll) / ll <= lip)
        ok &= top <= rl * 1.01
        t, h, floor, hd, left, right, ll, rl, dur = (v[ok] for v in (t, h, floor, hd, left, right, ll, rl, dur))
        bottom = lowest(left, right + 1)
        d = (ll - bottom) / ll
        ok = np.flatnonzero((bottom > 0) & (depth[0] <= d) & (d <= depth[1]) & (floor >= (rl + bottom) / 2.0))
        ok = ok[_first_of_each(t[ok])]
        t, h, hd, left, ll, rl, dur, bottom, d = (v[ok] for v in (t, h, hd, left, ll, rl, dur, bottom, d))
        conf = 60.0 + 10.0 * (1.0 - np.abs(rl - ll) / ll / lip) + np.where(hd < 0.10, 10.0, 0.0)
        found = (np.minimum(100.0, np.maximum(60.0, conf)), rl, first + left, rl - bottom, ll, bottom, d, hd, dur, h)
        for name, v in zip(names, found):
            out[f"cup_{name}"][t] = v
        return out

    return Kernel(_doubles("cup", names), fn)


YEAR_NOTES = ("touches_in_6mo", "distance_pct_from_high", "base_low")


def year_high_kernel(year: int = 252, half: int = 126, near: float = 0.02, touch: float = 0.015) -> Kernel:
    """Close within `near` of the highest high of a year; the bars of half a year are looked at only where it is."""
    names = FIELDS + YEAR_NOTES

    def fn(pdf: pd.DataFrame) -> dict:
        high, low, close = (pdf[c].to_numpy(float) for c in ("high", "low", "close"))
        number, size = pdf["bar_no"].to_numpy(np.int64), len(high)
        out = _columns("year", names, size)
        t, known = np.arange(size), np.where(np.isnan(high), -np.inf, high)
        top = known[_extremes(known, year)(np.maximum(t - year + 1, 0), t + 1)]
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = (top - close) / top
        t = np.flatnonzero((number >= year) & np.isfinite(top) & (gap <= near))
        if not len(t):
            return out

        def past(values: np.ndarray, fill: float) -> np.ndarray:
            padded = np.concatenate([np.full(half - 1, fill), values])
            return np.lib.stride_tricks.sliding_window_view(padded, half)[t]

        length = np.minimum(t + 1, half)
        hits = past(known, -np.inf) >= (top[t] * (1 - touch))[:, None]
        touches = np.count_nonzero(hits, axis=1)
        at = np.where(touches > 0, hits.argmax(axis=1), half - length)
        lows = np.where(np.arange(half) >= at[:, None], past(np.where(np.isnan(low), np.inf, low), np.inf), np.inf).min(axis=1)
        lows = np.where(np.isinf(lows), np.nan, lows)
        conf = np.minimum(100.0, 50.0 + np.maximum(touches - 1, 0) * 5.0)
        found = (conf, top[t], number[t] - half + at + 1, top[t] - lows, touches, gap[t], lows)
        for name, v in zip(names, found):
            out[f"year_{name}"][t] = v
        return out

    return Kernel(_doubles("year", names), fn)


FLAG_NOTES = ("pole_move", "pole_len", "flag_len", "flag_range", "flag_drift")


def flag_kernel(window: int = 60, flags=(5, 15), poles=(5, 19), rise: float = 0.15, height: float = 0.12, drift: float = 0.10,
                least: int = 15) -> Kernel:
    """A rise on above-average volume, then a shallow drift down, ending at each bar; the first lengths that fit win."""
    names = FIELDS + FLAG_NOTES

    def fn(pdf: pd.DataFrame) -> dict:
        high, low, close = (pdf[c].to_numpy(float) for c in ("high", "low", "close"))
        number, size = pdf["bar_no"].to_numpy(np.int64), len(high)
        out = _columns("flag", names, size)
        unknown = pdf["volume"].isna().to_numpy()
        volume = np.concatenate([[0], np.cumsum(pdf["volume"].fillna(0).to_numpy(np.int64))])
        gaps = np.concatenate([[0], np.cumsum(unknown)])
        n = np.minimum(np.arange(size) + 1, window)
        most = min(flags[1], size)
        if most < flags[0]:
            return out
        tops = np.maximum.accumulate(_behind(np.where(np.isnan(high), -np.inf, high), most, -np.inf), axis=1)[:, flags[0] - 1 :]
        floors = np.minimum.accumulate(_behind(np.where(np.isnan(low), np.inf, low), most, np.inf), axis=1)[:, flags[0] - 1 :]
        pl, lengths = np.arange(poles[0], poles[1] + 1), np.arange(flags[0], most + 1)

        def mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Mean volume of the bars `a..b-1`, NaN where one is unknown or there are none."""
            return np.where((b > a) & (gaps[b] == gaps[a]), (volume[b] - volume[a]) / np.maximum(b - a, 1), np.nan)

        began = _behind(close, most, np.nan)[:, flags[0] - 1 :]
        with np.errstate(divide="ignore", invalid="ignore"):
            wides = (tops - np.where(np.isinf(floors), np.nan, floors)) / tops
            slides = (close[:, None] - began) / began
            ok = (tops > 0) & (wides <= height) & (slides <= 0) & (slides >= -drift)
        ok &= (number >= least)[:, None] & (n[:, None] - lengths >= poles[0])
        # all flags of all bars side by side, a bar's shortest first; volumes only where some pole rises enough
        t, k = np.nonzero(ok)
        fl = lengths[k]
        room = (n[t] - fl)[:, None] >= pl
        a = np.where(room, t[:, None] - fl[:, None] - pl + 1, 0)
        end, starts = close[t - fl][:, None], close[a]
        with np.errstate(divide="ignore", invalid="ignore"):
            move = np.where(room & (starts > 0), (end - starts) / starts, np.nan)
            rises = move >= rise
        high_enough = np.flatnonzero(rises.any(axis=1))
        t, k, fl, a, starts, move, rises = (v[high_enough] for v in (t, k, fl, a, starts, move, rises))
        mine = mean(a, np.broadcast_to((t - fl + 1)[:, None], a.shape))
        start = np.broadcast_to((t - n[t] + 1)[:, None], a.shape)
        prior = np.where(a > start, mean(start, np.maximum(a, start)), mine)
        with np.errstate(invalid="ignore"):
            fits = rises & (mine > prior)
        at = np.flatnonzero(fits.any(axis=1))
        at = at[_first_of_each(t[at])]
        t, k, fl, p = t[at], k[at], fl[at], fits[at].argmax(axis=1)
        move, begin, wide, slide = move[at, p], starts[at, p], wides[t, k], slides[t, k]
        conf = 60.0 + np.minimum(20.0, (move - rise) / rise * 20.0) + np.where(wide < height / 2, 10.0, 0.0)
        found = (np.minimum(100.0, conf), tops[t, k], number[t] - fl - pl[p] + 1, close[t - fl] - begin, move, pl[p], fl, wide, slide)
        for name, v in zip(names, found):
            out[f"flag_{name}"][t] = v
        return out

    return Kernel(_doubles("flag", names), fn)


NR7_NOTES = ("today_tr", "near_pivot_high", "volume_contraction")


def nr7_kernel(narrow: int = 7, near: float = 0.02, highs: int = 3, reach=(3, 26), quiet: int = 20) -> Kernel:
    """Smallest true range of `narrow` bars. Needs `tr`, `piv_high`; the newest `highs` swing highs of the rows in `reach` count."""
    names = FIELDS + NR7_NOTES

    def fn(pdf: pd.DataFrame) -> dict:
        high, low, tr, volume, ph = (pdf[c].to_numpy(float) for c in ("high", "low", "tr", "volume", "piv_high"))
        number, size = pdf["bar_no"].to_numpy(np.int64), len(high)
        out = _columns("nr7", names, size)
        t = np.flatnonzero((number >= narrow) & (tr == _trailing_least(tr, narrow)))
        if not len(t):
            return out
        at = np.flatnonzero(~np.isnan(ph))
        end = np.searchsorted(at, t - reach[0], side="right")
        close_by = np.zeros(len(t), dtype=bool)
        for k in range(1, highs + 1):
            has = end >= k
            place = at[np.maximum(end[has] - k, 0)]
            with np.errstate(divide="ignore", invalid="ignore"):
                close_by[has] |= (place >= t[has] - reach[1]) & (np.abs(ph[place] - high[t[has]]) / ph[place] <= near)
        calm = (number[t] >= quiet) & (volume[t] < _trailing_mean(volume, quiet - 1, 1)[t])
        found = (50.0 + close_by * 30.0 + calm * 20.0, high[t], number[t] - narrow + 1, high[t] - low[t], tr[t], close_by, calm)
        for name, v in zip(names, found):
            out[f"nr7_{name}"][t] = v
        return out

    return Kernel(_doubles("nr7", names), fn)


SQUEEZE_NOTES = ("bb_width", "median_width_6mo", "squeeze_ratio", "close_vs_mid")


def _trailing_deviation(values: np.ndarray, n: int) -> np.ndarray:
    """Population deviation of the known values of the last `n`, by the running update that Spark's aggregate makes."""
    size = len(values)
    count, mean, squares = np.zeros(size), np.zeros(size), np.zeros(size)
    for k in range(min(n, size) - 1, -1, -1):
        x = values[: size - k]
        known = ~np.isnan(x)
        count[k:] += known
        delta = np.where(known, x - mean[k:], 0.0)
        part = delta / np.maximum(count[k:], 1.0)
        mean[k:] += part
        squares[k:] += delta * (delta - part)
    return np.where(count > 0, np.sqrt(squares / np.maximum(count, 1.0)), np.nan)


def squeeze_kernel(n: int = 20, k: float = 2.0, window: int = 126, least: int = 60, slack: float = 1.001) -> Kernel:
    """Band width at its least of `window` bars; the median is taken only where it is, with the close in the upper half."""
    names = FIELDS + SQUEEZE_NOTES

    def fn(pdf: pd.DataFrame) -> dict:
        close, number = pdf["close"].to_numpy(float), pdf["bar_no"].to_numpy(np.int64)
        out = _columns("squeeze", names, len(close))
        mid = np.where(number >= n, _trailing_mean(close, n), np.nan)
        dev = np.where(number >= n, _trailing_deviation(close, n), np.nan)
        upper, lower = mid + k * dev, mid - k * dev
        with np.errstate(divide="ignore", invalid="ignore"):
            width = (upper - lower) / mid
        t = np.flatnonzero((number >= least) & (width <= _trailing_least(width, window) * slack) & (close >= mid))
        if not len(t):
            return out
        padded = np.concatenate([np.full(window - 1, np.nan), width])
        past = np.sort(np.lib.stride_tricks.sliding_window_view(padded, window)[t], axis=1)  # unknown widths go last
        known = np.count_nonzero(~np.isnan(past), axis=1)
        row, half = np.arange(len(t)), known // 2
        median = np.where(known % 2 == 1, past[row, half % window], (past[row, half - 1] + past[row, half % window]) / 2.0)
        ratio = np.where(median > 0, width[t] / np.where(median > 0, median, 1.0), 1.0)
        conf = np.minimum(100.0, 60.0 + np.where(ratio < 0.6, 20.0, np.where(ratio < 0.8, 10.0, 0.0)))
        found = (conf, upper[t], number[t] - known + 1, upper[t] - lower[t], width[t], median, ratio, close[t] / mid[t])
        for name, v in zip(names, found):
            out[f"squeeze_{name}"][t] = v
        return out

    return Kernel(_doubles("squeeze", names), fn)


TRIANGLE_NOTES = ("support_slope", "support_r2", "n_resistance_touches", "n_high_pivots", "n_low_pivots")


def triangle_kernel(reach=(3, 76), lookback: int = 80, least: int = 20, highs: int = 4, lows: int = 3, touches: int = 3,
                    near: float = 0.02, fit: float = 0.7) -> Kernel:
    """Swing highs near their top over a rising line of swing lows. Needs `piv_high`, `piv_low`.

    Bars walk through the swing lows of the rows in `reach` side by side, the oldest first, with the running updates of the regression.
    """
    names = FIELDS + TRIANGLE_NOTES

    def fn(pdf: pd.DataFrame) -> dict:
        ph, pl = pdf["piv_high"].to_numpy(float), pdf["piv_low"].to_numpy(float)
        number, size = pdf["bar_no"].to_numpy(np.int64), len(ph)
        out = _columns("triangle", names, size)
        hp, lp, t = np.flatnonzero(~np.isnan(ph)), np.flatnonzero(~np.isnan(pl)), np.arange(size)

        def among(places: np.ndarray) -> tuple:
            first = np.searchsorted(places, t - reach[1], side="left")
            return first, np.maximum(np.searchsorted(places, t - reach[0], side="right") - first, 0)

        (h0, nh), (l0, nl) = among(hp), among(lp)
        t = np.flatnonzero((number >= least) & (nh >= highs) & (nl >= lows))
        if not len(t):
            return out
        h0, nh, l0, nl = h0[t], nh[t], l0[t], nl[t]
        top, hits = np.full(len(t), -np.inf), np.zeros(len(t), dtype=np.int64)
        for j in range(nh.max()):
            at = nh > j
            top[at] = np.maximum(top[at], ph[hp[h0[at] + j]])
        for j in range(nh.max()):
            at = nh > j
            with np.errstate(divide="ignore", invalid="ignore"):
                hits[at] += (top[at] - ph[hp[h0[at] + j]]) / top[at] <= near
        at = np.flatnonzero((top > 0) & (hits >= touches))
        t, h0, nh, l0, nl, top, hits = (v[at] for v in (t, h0, nh, l0, nl, top, hits))
        if not len(t):
            return out
        xm, ym, xx, xv, yy, xy, yx, xs, ys = (np.zeros(len(t)) for _ in range(9))
        lowest = np.full(len(t), np.inf)
        for j in range(nl.max()):
            at = np.flatnonzero(nl > j)
            place = lp[l0[at] + j]
            x, y = number[place].astype(float), pl[place]
            dx, dy = x - xm[at], y - ym[at]
            xm[at] += dx / (j + 1.0)
            ym[at] += dy / (j + 1.0)
            xy[at] += dx * (y - ym[at])
            yx[at] += dy * (x - xm[at])
            xx[at] += dx * (dx - dx / (j + 1.0))
            xv[at] += dx * (x - xm[at])
            yy[at] += dy * (y - ym[at])
            xs[at] += x
            ys[at] += y
            lowest[at] = np.minimum(lowest[at], y)
        with np.errstate(divide="ignore", invalid="ignore"):
            slope, r = xy / xx, yx / np.sqrt(yy * xv)
        r2 = r * r
        support = ys / nl + slope * (number[t] - xs / nl)
        conf = np.minimum(100.0, 60.0 + np.minimum(20.0, (r2 - fit) / (1.0 - fit) * 20.0) + np.minimum(10.0, (hits - touches) * 3.0))
        height = np.where(top > support, top - support, top - lowest)
        found = (conf, top, number[t] - np.minimum(lookback, number[t]) + 1, height, slope, r2, hits, nh, nl)
        ok = np.flatnonzero((slope > 0) & (r2 >= fit))
        for name, v in zip(names, found):
            out[f"triangle_{name}"][t[ok]] = v[ok]
        return out

    return Kernel(_doubles("triangle", names), fn)
