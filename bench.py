"""Time registered queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_QUERIES (comma-separated, or
'all') the queries, BENCH_REPEATS the runs whose median counts. One query warms the session.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from seqtables.catalog import QUERIES
from seqtables.session import local_session

HEADLINE = (
    "truncation_summary clean_corpus assign_classes truncate_frame extend_orf translate_codons gene_nt "
    "kmer_profile suffix_composition interval_match label_genes match_with_ref results_star_join "
    "threshold_sweep mann_whitney_u mwu_by_dim ecdf histogram kde prediction_crosstab accuracy_sweep "
    "group_split cluster_ids kmer_search hsp_search jaccard_pairs dereplicate_exact dereplicate_near best_hit best_hsp "
    "residue_batches parse_prodigal_header annotation_scan fasta_roundtrip standardize predict_linear"
).split()


def run(spark, folder: str, name: str) -> float:
    begin = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if asked == "all" else asked.split(",") if asked else HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="seqtables-bench")
    seconds = {}
    run(spark, folder, "histogram")
    for name in names:
        seconds[name] = round(statistics.median(run(spark, folder, name) for _ in range(repeats)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    line = {"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec"}
    print(json.dumps({**line, "queries": seconds, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))


if __name__ == "__main__":
    main()
