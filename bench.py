"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyforge.plans.queries import QUERIES  # noqa: E402
from tallyforge.session import local  # noqa: E402

HEADLINE = [
    "coarse_eval_metrics", "joint_eval_metrics", "confusion_matrix_normalized", "bias_by_group", "dedupe_keep_last",
    "majority_mean", "majority_multilabel", "soft_label_distribution", "label_frequency_share", "pairwise_agreement_kappa",
    "reannotation_queue", "work_queue_remaining", "hypothesis_chi2", "category_wilson_ci", "stratified_split", "best_seed",
    "batch_assignment", "left_join_metadata", "train_messages_joint", "assemble_conversations",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run(HEADLINE[0])
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - began, 4)
    total = round(sum(seconds.values()), 4)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
