"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) is the folder of tables, BENCH_CPUS (default 8) the cores.
"""

from __future__ import annotations

import json
import os
import time

from semaspan.session import local_session
from semaspan.workload.queries import QUERIES

HEADLINE = [
    "token_freq", "freq_rank", "xml_tokens", "sentence_assemble", "cooccurrence", "ppmi", "pair_scores", "spearman",
    "sentence_projection", "in_vocabulary", "anon_numerals_corpus", "obj_construction_match", "clean_groups",
    "length_summary", "column_summary", "iqr_outliers", "brunner_munzel", "bm_permutation", "p_bh", "cosine_pairs",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline query time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
