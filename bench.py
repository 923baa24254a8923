"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. Each query is run once and computes its full result.
"""

from __future__ import annotations

import json
import os
import time

from gonggo.plans.catalog import QUERIES
from gonggo.session import build_session

HEADLINE = (
    "related_techs", "cooccurrence", "region_top_techs", "tech_extraction", "posting_techs",
    "urgency_scores", "label_distribution", "reference_stats", "deadlines", "recommendation_pool",
    "tech_idf", "recommend_length_norm", "compare_schemes", "text_fallback", "source_stop_words",
    "copy_stats", "group_split", "tfidf_vocabulary", "fallback_grid", "page_texts",
    "logistic_model",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("gonggo-bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, "20g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
