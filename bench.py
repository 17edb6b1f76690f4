"""Time the headline queries and print one JSON line.

Every query runs to the end through the ``noop`` sink, so no column is pruned away.  The model
that the encoding queries share (64 merges) is trained once, timed as ``t4_train_bpe``; the
registered training query learns 256 merges and is timed as ``t4_train_bpe_256``.
"""

import json
import os
import sys
import time

from glyphmill.plans import queries as q
from glyphmill.session import build_session

OTHER = {
    "t4_train_bpe": lambda spark, sf_dir: q.corpus_model(spark, sf_dir).merges,
    "t4_train_bpe_256": q.t4_train_bpe,
}
HEADLINE = [
    "p5_piece_counts",
    "t4_train_bpe",
    "e1_encode",
    "e3_decode",
    "e6_training_rows",
    "a1_sample_per_file",
    "a4_length_stats_global",
    "a6_compression_rate",
    "l5_epoch_batches",
    "c1_render_chat",
    "c6_encode_chat",
    "n1_normalize_nfc",
    "r2_expert_load",
    "t4_train_bpe_256",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Two small queries load the JVM's classes and start the Python workers before the clock runs.
    q.s7_require_text(spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(64).mapInArrow(lambda rows: rows, "id long").count()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        OTHER.get(name, q.QUERIES.get(name))(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
