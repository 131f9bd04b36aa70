"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from logloom.plans.registry import QUERIES
from logloom.session import spark_session

HEADLINE = (
    "event_step_features", "session_features", "session_scores", "score_quantile_cut", "transitions",
    "pattern_counts", "event_multi_session", "event_frequency_encoding", "line_numbering", "record_assembly",
    "record_features", "template_frequency", "anomaly_families", "signature_intervals", "message_templates",
    "key_value_lines", "audit_case_table", "transcripts", "saml_fields", "request_response_match",
    "sequence_matches", "match_kpis", "country_of_ip", "hourly_filled", "weekday_hour_matrix",
    "summary_statistics", "tukey_outliers", "transaction_vectors", "isolation_forest_embeddings",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = spark_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="logloom-bench-"),
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.driver.host": "127.0.0.1",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
