"""Times the headline queries over one scale factor; prints one JSON line.

Every query is run once to warm up, then timed; the median counts. Results are computed in full and
thrown away by the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from lectern.plans.catalog import QUERIES
from lectern.session import build_session

HEADLINE = (
    "chat_render",
    "token_count",
    "seeded_shuffle",
    "sample_cap",
    "batch_numbering",
    "prep_funnel",
    "build_vocab",
    "length_truncate",
    "multi_source",
    "extract_boxed",
    "score_join",
    "group_advantage",
    "reward_report",
    "soft_label_loss",
    "generate_responses",
    "training_shards",
    "logit_training",
    "logit_training_all",
    "reward_scoring",
)
# Input rows behind the rates, by query.
INPUT = {
    "chat_render": "conversations",
    "token_count": "documents",
    "seeded_shuffle": "documents",
    "batch_numbering": "conversations",
    "prep_funnel": "documents",
    "soft_label_loss": "embeddings",
}
RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(RUNS)), 4)
    rates = {
        name: round(spark.read.parquet(f"{sf_dir}/{table}.parquet").count() / seconds[name])
        for name, table in INPUT.items()
        if name in seconds
    }
    result = {
        "metric": "sum of median query times",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "rows_per_sec": rates,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
