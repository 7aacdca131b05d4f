"""Time headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from locuswise import catalog
from locuswise.session import local_session

HEADLINE = [
    "rle_encode",
    "theta_estimate",
    "mask_by_intervals",
    "mask_by_codes",
    "subtract_intervals",
    "pair_haplotypes",
    "bin_rate",
    "bin_diversity",
    "bin_rate_in_time",
    "average_landscape",
    "compare_maps",
    "time_transitions",
    "interval_lookup",
    "best_model",
    "convergence_step",
    "mean_rate",
    "rate_per_time",
    "forward_loglik",
    "likelihood_sweep",
    "filter_carry",
    "posterior_decode",
    "joint_decode",
    "baum_welch_trans",
    "stream_bins",
    "decode_dataset",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    # starts the JVM's compilers and the Python workers, so that the first query isn't charged for them
    catalog.flagship(spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in chosen:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
