"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of cores. The derived
tables are built first and timed as ``derive_tables``; each query is then
computed in full (written to the noop sink).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from splicelake.plans.catalog import QUERIES
from splicelake.plans.derived import Tables

HEADLINE = [
    "exons_to_cds",
    "splice_in_domains",
    "collapse_events",
    "domain_fallback",
    "domains_text",
    "exon_usage",
    "overlap_islands",
    "close_groups",
    "group_name",
    "or_join",
    "fill_missing_ids",
    "reconcile_sources",
    "dedupe_transcripts",
    "id_mapping_last_wins",
    "domain_components",
    "type_attributes",
    "search",
    "gene_document",
    "orthologs",
    "exon_similarity",
    "transcript_similarity",
    "gene_similarity",
    "species_domain_stats",
    "species_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("splicelake-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}
    start = time.perf_counter()
    tables = Tables(spark, sf_dir)
    tables.prepare()
    timings["derive_tables"] = round(time.perf_counter() - start, 3)
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
