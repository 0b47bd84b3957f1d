"""Headline queries, wall-clock seconds: one JSON line on stdout."""
from __future__ import annotations

import json
import os
import time

from panelspark.catalog import QUERIES
from panelspark.session import local_session

HEADLINE = [
    "align_bars", "log_momentum", "rsi", "adx", "supertrend", "realized_vol", "breadth_above_ma", "asof_join",
    "fundamental_ratios", "insider_features", "cs_rank", "winsorize", "rank_ic_by_date", "signal_decay", "gram_blocks",
    "walk_forward_predict", "equal_weight", "portfolio_returns", "return_metrics", "block_bootstrap", "decide", "standings",
    "build_panel",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), 8)
    spark.read.parquet(f"{folder}/lineitem.parquet").count()  # start the workers
    seconds = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - t0, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).replace("sf", ""),
    }))


if __name__ == "__main__":
    main()
