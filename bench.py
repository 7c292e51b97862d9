"""Headline queries, timed. Prints one JSON line.

The given tables are stored once more in as many files as there are cores, as a cluster holds them; that is not timed. The
corpus is indexed once, as a user would, and that is timed; searches, reports, audits and triage then run on the stored
files table, comparing and merging on stored snapshots. The other queries run from the tables. Each query runs once to warm up code
generation and then twice; the faster run counts. Results go to a sink that discards them.
"""

from __future__ import annotations

import json
import os
import sys
import time

import pyspark

from shelfmark.operators import audit, discover, links, rollup, search, snapshot, triage
from shelfmark.operators.gram_index import GramIndex
from shelfmark.operators.many_queries import search_table
from shelfmark.plans import catalog, frames
from shelfmark.plans.corpus_queries import MANY, asked
from shelfmark.session import build_session, shared_dir
from shelfmark.sources.snapshots import SnapshotTable

POLICY = frames.POLICY
TABLES = "customer orders lineitem part events documents pages labels conversations nation".split()
ON_INDEX = {
    "search_files": lambda f: search.search_files(f, "the was", POLICY),
    "search_total": lambda f: search.search_total(f, "the was", POLICY),
    "search_many": lambda f: search.search_many(f, MANY, POLICY),
    "search_keyword": lambda f: search.search_keyword(f, "the", POLICY),
    "coverage_report": lambda f: rollup.coverage_report(f, POLICY),
    "kind_distribution": rollup.kind_distribution,
    "list_directory": lambda f: rollup.list_directory(f, "/vault", 3),
    "monthly_activity": lambda f: rollup.monthly_activity(f, POLICY),
    "duplicate_groups": audit.duplicate_groups,
    "duplicate_members": lambda f: audit.duplicate_members(f, POLICY),
    "audit": lambda f: audit.audit(f, POLICY),
    "triage": lambda f: triage.triage(f, POLICY),
    "discover_entry_docs": lambda f: discover.discover_entry_docs(f, POLICY),
}
INDEXED = {
    "search_files_indexed": lambda i: i.search_files("erthin ouea", POLICY),
    "search_total_indexed": lambda i: i.search_total("erthin ouea", POLICY),
    "search_keyword_indexed": lambda i: i.search_keyword("the erthin", POLICY),
}
ON_SNAPSHOTS = {
    "merge_snapshot": lambda prev, cur: snapshot.merge_snapshot(prev, cur, 2000, POLICY.root_paths),
    "diff_snapshots": lambda prev, cur: snapshot.diff_snapshots(prev, cur, "path", ("size", "mtime_ms", "kind", "name", "denied")),
}
FROM_TABLES = (
    "current_claims", "claims_summary", "find_project", "signal_lift",
    "segment", "build_payloads", "apply_results", "stream_current_claims",
)


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def discard(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()

    given, sf_dir = sf_dir, shared_dir(spark, "tables")
    for name in TABLES:
        spark.read.parquet(f"{given}/{name}.parquet").repartition(int(cpus)).write.parquet(f"{sf_dir}/{name}.parquet")
    index = shared_dir(spark, "index")
    sides = [shared_dir(spark, side) for side in ("prev", "cur")]
    for side, rows in zip(sides, frames.snapshots(spark, sf_dir)):
        rows.write.parquet(side)
    jobs = {"index_build": lambda: frames.files(spark, sf_dir).write.mode("overwrite").parquet(index)}
    for name, report in ON_INDEX.items():
        jobs[name] = lambda report=report: discard(report(spark.read.parquet(index)))
    built = []
    jobs["gram_index_build"] = lambda: built.append(GramIndex.build(spark.read.parquet(index), shared_dir(spark, "gram")))
    for name, report in INDEXED.items():
        jobs[name] = lambda report=report: discard(report(built[-1]))
    jobs["search_table"] = lambda: discard(search_table(spark.read.parquet(index), asked(spark, sf_dir), POLICY, 5))
    table = SnapshotTable(spark, "bench_snapshot", shared_dir(spark, "snapshots"), buckets=int(cpus), slices=8)
    jobs["snapshot_write"] = lambda: table.write(spark.read.parquet(sides[0]), 0)
    jobs["snapshot_merge_and_store"] = lambda: table.merge(spark.read.parquet(sides[1]), 0, 2000, POLICY.root_paths)
    jobs["snapshot_diff"] = lambda: discard(table.diff(0, 1, ("size", "mtime_ms", "kind", "name", "denied")))
    pages = shared_dir(spark, "pages")
    frames.page_files(spark, sf_dir).write.parquet(pages)
    jobs["broken_links"] = lambda: discard(links.broken_links(spark.read.parquet(pages), POLICY))
    for name, work in ON_SNAPSHOTS.items():
        jobs[name] = lambda work=work: discard(work(*(spark.read.parquet(side) for side in sides)))
    for name in FROM_TABLES:
        jobs[name] = lambda name=name: discard(catalog.QUERIES[name](spark, sf_dir))

    wanted = sys.argv[1:] or list(jobs)
    if any("indexed" in name for name in wanted):
        wanted.append("gram_index_build")
    if any(name.startswith("snapshot_") for name in wanted):
        wanted += ["snapshot_write", "snapshot_merge_and_store"]
    seconds = {}
    failed = {}
    for name, job in jobs.items():
        if name == "index_build" or name in wanted:
            try:
                job()
                seconds[name] = min(timed(job), timed(job))
            except Exception as error:  # the figures of the others are still wanted
                failed[name] = str(error).splitlines()[0][:200]
            print(name, seconds.get(name, "failed"), file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(given.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "spark": pyspark.__version__,
        **({"failed": failed} if failed else {})}))
    spark.stop()


if __name__ == "__main__":
    main()
