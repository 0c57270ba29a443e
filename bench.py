"""Time headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from atalaya.bindings import load_all  # noqa: E402
from atalaya.session import build_session  # noqa: E402

HEADLINE = [
    "monthly_series", "territory_summary", "union_sources", "join_population_clip", "national_kpis",
    "feature_panel", "z_alerts", "isolation_score", "baseline_backtest", "metrics_by_volume", "data_drift",
    "funnel_territory", "category_ranking", "chunk_text", "vector_topk", "resolve_entities",
    "score_answers", "stream_group_count", "failure_lockout", "forecast_recursive",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus), **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    # One untimed query starts the JVM's code paths, as on a running cluster.
    registry["category_year"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
