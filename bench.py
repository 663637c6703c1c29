"""Time the headline queries and print one JSON line.

Each query runs into Spark's no-op sink, so results are computed in full but not collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelkite.catalog import registry
from panelkite.session import build_session

HEADLINE = (
    "bars_from_lineitem densify_panel sma_20 linreg_20 ema_12 ewm_std_20 llt_01 cross_signals xs_rank "
    "weekly_factor_sheet weekly_top3_weights ranked_universe_weights event_panel fill_resolution "
    "compose_nav cost_scenarios sma_grid_screen perf_metrics turnover split_adjust_forward "
    "total_return_index gold_view fx_convert_asof session_status dq_all dq_price_jumps dq_bundle_bars "
    "cn_bars dividend_dedupe hk_symbols asof_point_in_time latest_bars upsert_latest "
    "table_fingerprint strategy_equity strategy_metrics"
).split()


def run(spark, name: str, sf_dir: str) -> tuple[float, int]:
    """Seconds, and the stages that ran: one more than its shuffles for each job, written parts included."""
    context = spark.sparkContext
    context.setJobGroup(name, name)
    start = time.perf_counter()
    registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - start
    tracker = context.statusTracker()
    infos = (tracker.getJobInfo(job) for job in tracker.getJobIdsForGroup(name))
    stages = {s for info in infos if info for s in info.stageIds}
    return seconds, sum(1 for s in stages if (i := tracker.getStageInfo(s)) and i.numCompletedTasks)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.sql.files.openCostInBytes": "262144",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    run(spark, "sma_20", sf_dir)  # start the JVM's compiler, not timed
    results = {name: run(spark, name, sf_dir) for name in HEADLINE}
    timings = {name: round(seconds, 3) for name, (seconds, _) in results.items()}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "stages": {name: n for name, (_, n) in results.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
