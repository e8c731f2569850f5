"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from commentlab.queries import REGISTRY  # noqa: E402
from commentlab.session import local_session  # noqa: E402

HEADLINE = [
    "metrics_report", "language_metrics", "roc_auc", "bias_auc", "run_compare",
    "threshold_sweep_f1", "apply_thresholds", "evaluate_val", "predict_test",
    "error_sample", "error_categories", "stratified_sample", "split_80_10_10", "surrogate_id",
    "clean_text", "strip_accents", "tokenize", "ngrams", "pack_sequences",
    "term_stats", "vocabulary", "tfidf", "score_external", "run_external",
    "load_splits", "write_predictions", "run_all_languages",
]


def scale_of(sf_dir: str) -> float | str:
    name = Path(sf_dir).name
    try:
        return float(name.removeprefix("sf"))
    except ValueError:
        return name


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cpus, shuffle_partitions=cpus)
    # Start the JVM code paths and the Python workers before the clock.
    REGISTRY["metrics_report"].run(spark, sf_dir).collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": scale_of(sf_dir),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
