"""Times the headline queries and prints one JSON line. BENCH_SF_DIR: tables; BENCH_CPUS: threads."""

from __future__ import annotations

import importlib.util
import json
import os
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = f"{HERE}:{os.environ.get('PYTHONPATH', '')}"

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = ("chunk_lines_50", "token_estimate", "fts_or", "fts_phrase", "vec_topk", "hybrid_search", "context_result", "classify_tasks", "budget_cap", "call_sites", "import_edges", "related_files_k3", "cdc_apply", "upsert_replace")


def stored(spark, run) -> None:
    """Adds the full-text side as an engine has it: an index written once, and searches and contexts over it."""
    import tempfile

    from pyspark.sql import functions as F

    from lodestone.operators import fts
    from lodestone.plans import queries as q

    folder = "file://" + tempfile.mkdtemp(prefix="bench-index-")
    began = time.perf_counter()
    fts.save_index(fts.build_index(q._symbols(spark, SF_DIR), False), folder)
    print("index written in", round(time.perf_counter() - began, 3), file=sys.stderr, flush=True)
    index = fts.load_index(spark, folder)
    run["fts_or_stored"] = lambda s, d: fts.search(index, {0: q.FTS_QUERIES["fts_or"]}, s)
    run["fts_phrase_stored"] = lambda s, d: fts.search(index, {0: q.FTS_QUERIES["fts_phrase"]}, s)
    run["context_result_stored"] = lambda s, d: q.contexts(s, d, fts.search(index, q.TASK_TEXTS, s).withColumn("rank", F.round("rank", q.DIGITS))).drop("files")


def main() -> None:
    from pyspark.sql import SparkSession

    from lodestone.plans.queries import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = {name: QUERIES[name] for name in HEADLINE}
    # Whole-table operators are timed once: they run for seconds to minutes.
    once = set()
    if importlib.util.find_spec("lodestone.llm"):
        ops = importlib.import_module("lodestone.llm.catalogue").QUERIES
        once, run = set(ops), run | ops
    seconds = {}
    stored(spark, run)
    for name, query in run.items():
        times = []
        for k in range(1 if name in once else RUNS + 1):
            began = time.perf_counter()
            query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
            if name not in once and k == 0:
                times.clear()  # the first run compiles
        seconds[name] = round(statistics.median(times), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
