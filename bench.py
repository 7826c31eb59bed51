"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of local threads, BENCH_RUNS how often each query runs
(the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from docsieve.functions.text import words
from docsieve.operators.aggregate import aggregate
from docsieve.plans import all_queries
from docsieve.plans.corpora import documents
from docsieve.session import local_session

HEADLINE = [
    "scan_project",
    "match_word",
    "match_phrase",
    "match_labels",
    "match_labels_many",
    "match_wildcard",
    "match_fuzzy",
    "match_near",
    "filter_range",
    "filter_combine",
    "filter_ids",
    "snippet_head",
    "snippet_matches",
    "highlight",
    "page",
    "page_far",
    "sort_multi",
    "agg_terms",
    "agg_multi_axis",
    "agg_date_bucket",
    "agg_datepart",
    "agg_number_bucket",
    "agg_by_query",
    "agg_by_query_axis",
    "agg_by_query_many",
    "agg_metrics",
    "agg_metrics_more",
    "agg_top_hits",
    "field_stats",
    "field_values",
    "pivot_wide",
    "top_columns",
    "zero_fill_dates",
    "drill_down",
    "write_index",
    "write_upsert",
    "tag_where",
    "copy_where",
    "infer_types",
    "validate_columns",
    "find_duplicates",
    "quota_running",
    "reconcile_objects",
    "effective_role",
    "source_export",
    "ingest_batches",
]

# How counting by query grows with the number of labels.
LABELS = (1, 10, 100)


def label_query(spark, sf_dir: str, count: int):
    """Counts by the most frequent words of the documents, one label each."""
    found = documents(spark, sf_dir)
    word = found.select(F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    top = word.groupBy("word").count().orderBy(F.desc("count"), "word").limit(count).collect()
    queries = {row["word"]: f"text:{row['word']}" for row in top}
    return aggregate(found, ["_query", "lang"], queries=queries)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}

    def timed(name: str, build) -> None:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)

    for name in HEADLINE:
        timed(name, lambda: queries[name](spark, sf_dir))
    for count in LABELS:
        query = label_query(spark, sf_dir, count)
        # A new frame each time, as a frame that has run once keeps its shuffle files.
        timed(f"labels_{count}", lambda: query.select("*"))
    line = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "runs": runs,
        "cpus": cpus,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
