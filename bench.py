"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from candlespan.config import Settings, Thresholds  # noqa: E402
from candlespan.operators import crosssection as X  # noqa: E402
from candlespan.operators import indicators as I  # noqa: E402
from candlespan.operators.panel import own_rows, panel  # noqa: E402
from candlespan.operators.ranking import percentile_ranks  # noqa: E402
from candlespan.operators.stage import with_stage  # noqa: E402
from candlespan.plans import scan  # noqa: E402
from candlespan.plans.queries import QUERIES  # noqa: E402
from candlespan.session import build_session, scratch_dir  # noqa: E402
from candlespan.sources.walk import table, universe, walk_bars  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus), "16g")
    spark.sparkContext.setLogLevel("ERROR")
    s = Settings(thresholds=Thresholds(min_adv_cr=0.004))
    dims = universe(*[table(spark, folder, n) for n in ("supplier", "nation", "region")])
    times: dict[str, float] = {}

    def run(name, made):
        start = time.time()
        df = made() if callable(made) else made  # some plans store rows while they are built
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)

    path = scratch_dir(spark, "bars")
    start = time.time()
    walk_bars(table(spark, folder, "lineitem")).write.parquet(path)
    times["build_bars"] = round(time.time() - start, 3)
    bars = spark.read.parquet(path)

    pre = scan.prepass(bars)
    run("cross_section", percentile_ranks(pre.filter("continuous").select("symbol", "date", "ret_63"), ["date"], "ret_63"))
    run("breadth", X.breadth(pre))
    run("sector_trends", X.sector_trends(pre.join(dims.select("symbol", "sector"), "symbol"), "ret_63"))
    run("indicators", own_rows(I.smoothed_indicators(panel(bars))))
    run("stages", own_rows(with_stage(panel(bars))))
    run("panel_all_patterns", own_rows(scan.analysed(bars, s)))
    run("morning_scan", scan.morning_scan(bars, dims, s))
    run("replay", lambda: scan.replay(scan.analysed(bars, s), s=s))
    for name, query in (("correlation", "a12_mean_correlation"), ("excursions", "a18_excursions"), ("full_report", "a8_full_report"), ("trade_stream", "x4_stream_tracker")):
        start = time.time()
        QUERIES[query](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    sf = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(sf.group(1)) if sf else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
