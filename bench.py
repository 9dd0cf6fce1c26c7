"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spanloom.plans import PLANS  # noqa: E402
from spanloom.session import build_session  # noqa: E402

HEADLINE = [
    "c01_clean_post",
    "s03_lines_with_offsets",
    "c15_whitespace_tokens",
    "c17_regex_sentences",
    "a02_label_counts",
    "j05_annotations_to_lines",
    "j07_overlaps",
    "j08_resolve_references",
    "j10_partially_marked",
    "j11_similar_cosine",
    "j13_superstrings",
    "j19_search_entities",
    "j22_search_events",
    "j23_search_text",
    "j24_concordance",
    "v12_check_structure",
    "u15_match_spans",
    "w08_renumber",
    "k01_upsert",
    "k04_standoff_lines",
    "w05_annotation_spans",
    "w07_latest",
    "o06_split_stratified",
    "s07_ordered_batches",
    "u12_multiset_diff",
    "a06_multilabel_metrics",
    "m01_tfidf",
    "g02_subtree",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up costs of the session are not part of any query.
    spark.read.parquet(f"{folder}/region.parquet").groupBy("r_name").count().collect()
    times = {}
    for name in names:
        begun = time.time()
        PLANS[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begun, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
