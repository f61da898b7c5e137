"""Time the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import QUERIES  # noqa: E402
from corpuskiln.scratch import use_local_scratch  # noqa: E402
from corpuskiln.session import local_session  # noqa: E402

RUNS = 2

HEADLINE = (
    "collect_sources",
    "file_features",
    "heuristic_filter",
    "exact_dedup",
    "minhash_signature",
    "lsh_candidates",
    "duplicate_clusters",
    "near_dedup",
    "near_dedup_greedy",
    "train_valid_split",
    "seeded_shuffle",
    "pack_sequences",
    "extract_functions",
    "truncate_at_stop",
    "line_clones",
    "memorization_report",
    "ngram_train",
    "ngram_perplexity",
    "ngram_federated",
    "weighted_vector_mean",
    "stream_exact_dedup",
)


def timed(spark, name: str, sf_dir: str) -> float:
    """Seconds for the whole result; nothing is collected."""
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    use_local_scratch(spark)
    # the first run of each query compiles its code and starts Python workers
    seconds = {name: round(min(timed(spark, name, sf_dir) for _ in range(RUNS)), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
