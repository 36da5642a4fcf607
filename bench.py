"""Time the headline queries and print one JSON line. BENCH_SF_DIR and BENCH_CPUS name the data and the cores.

What an import leaves behind (the graph, the index for matching, the dump and the pages) is made first, and timed apart
as ``prepare``.
"""

from __future__ import annotations

import json
import os
import time

from wavegraph.session import build_session
from wavegraph.standin import corpus, tables
from wavegraph.standin.all_queries import QUERIES

HEADLINE = [
    "predicted_score",
    "aggregate_recommendations",
    "aggregate_recommendations_deep",
    "find_similar_releases",
    "label_propagation_scores",
    "traverse_and_weight",
    "preference_recommendations",
    "label_rating_distribution",
    "anti_join_unlistened",
    "playlist_mart",
    "playlist_neighbors",
    "normalize_catalog",
    "scan_catalog_xml",
    "import_catalog",
    "page_metadata_corpus",
    "correlate_pages",
    "stream_listens_per_day",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the engine
    start = time.time()
    graph = lambda spark, sf: tables.graph(spark, sf).write_all()
    for made in (graph, corpus.documents, corpus.dump, corpus.match_index, corpus.release_pages):
        made(spark, sf_dir)
    prepare = round(time.time() - start, 3)
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "prepare": prepare,
    }))


if __name__ == "__main__":
    main()
