"""Bars and trailing windows: plans that stay cheap, results as the plain frames give them."""

from __future__ import annotations

import datetime as dt

import pytest

from candlespan.plans import queries as Q
from candlespan.session import stored
from candlespan.sources.walk import walk_bars


def lines(spark, rows):
    return spark.createDataFrame(
        [(k, 1, 1, s, q, dt.datetime(1998, m, d)) for k, s, q, m, d in rows],
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_shipdate timestamp",
    )


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("gap_open", [False, True])
def test_bars_need_no_sorted_aggregate(spark, gap_open):
    text = plan(walk_bars(lines(spark, [(1, 7, 20.0, 1, 5)]), gap_open))
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text


def test_bars_of_lines_with_unknown_steps(spark):
    rows = [(3, 7, 30.0, 1, 5), (1, 7, 20.0, 1, 5), (2, 7, None, 1, 6), (4, 7, 40.0, 1, 7), (5, None, 1.0, 1, 7)]
    got = [tuple(r) for r in walk_bars(lines(spark, rows)).orderBy("date").select("symbol", "open", "high", "low", "close", "bar_no", "n_bars").collect()]
    assert got == [("7", 1500.0, 1500.0, 1494.5, 1499.0, 1, 3), ("7", None, None, None, 1499.0, 2, 3), ("7", 1499.0, 1513.5, 1499.0, 1513.5, 3, 3)]


@pytest.mark.parametrize("name", ["t2_rebase_trades", "t3_repair_scan", "t5_flag_failed", "x1_settle", "a12_mean_correlation", "m12_correlated_size"])
def test_order_lines_are_summed_once(spark, monkeypatch, name):
    made = []
    monkeypatch.setattr(Q.B, "walk_bars", lambda lineitem, gap_open=False: made.append(1) or walk_bars(lineitem, gap_open))
    monkeypatch.setattr(Q, "stored", lambda df, kind: made.append(kind) or stored(df, kind))
    rows = Q.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert made.count(1) == 1 and made.count("bars") == 1 and rows.columns
