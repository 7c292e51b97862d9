"""Plans have the shape that holds at scale: pruned scans, pushed filters, map-side combination, no cross joins."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from shelfmark.operators import audit, claims, export, links, ranking, rollup, search, triage

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def stored(make_files, spark, scratch):
    make_files({f"d/{i}.md": f"text {i}" for i in range(5)}).write.parquet(scratch + "/files")
    return spark.read.parquet(scratch + "/files")


def read_columns(df) -> set[str]:
    return {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<([^>]*)", plan(df)) for c in s.split(",")}


@pytest.mark.parametrize("report", [
    rollup.root_stats, rollup.kind_distribution, lambda f: rollup.list_directory(f, "/w", 2), lambda f: audit.same_name_groups(f)])
def test_metadata_reports_never_read_bodies(stored, report):
    assert not read_columns(report(stored)) & {"body", "headings", "title"}


def test_triage_and_coverage_never_read_bodies(stored, policy):
    for df in (triage.triage(stored, policy), rollup.coverage_report(stored, policy), audit.stale(stored, policy)["by_dir"]):
        assert "body" not in read_columns(df)


def test_filters_reach_the_scan(stored, policy, spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(search.filter_files(stored, policy, kind="doc", since="30d", min_size=1).select("path"))
    pushed = re.search(r"PushedFilters: \[(.*?)\], Read", text).group(1)
    for column in ("mtime_ms", "size", "gone", "denied"):
        assert column in pushed


def test_top_rows_are_limited_before_the_shuffle(stored):
    text = plan(ranking.top_k(stored.select("root", "size", "path"), ["root"], [F.desc("size"), F.asc("path")], 3))
    assert text.count("WindowGroupLimit") == 2 and text.rindex("Partial") > text.index("Exchange hashpartitioning")


def test_newest_per_key_is_combined_before_the_shuffle(spark):
    df = spark.range(10).select("id", F.lit("t").alias("target"), F.lit("v").alias("verdict"), F.col("id").alias("ts"))
    text = plan(claims.current_claims(df))
    assert "partial_max_by" in text.split("Exchange")[1] and "Window" not in text


def test_export_does_not_shuffle(stored, policy):
    docs = stored.select("root", "rel", "name", "body", *[F.lit(None).cast("string").alias(c) for c in (
        "role", "author", "original_date", "source_type", "parent_source_key", "source_title")])
    assert "Exchange" not in plan(export.build_payloads(export.attribute(docs), policy, "agent:x"))


def test_duplicates_and_links_never_read_bodies(stored, policy):
    for df in (audit.duplicate_groups(stored), audit.duplicate_members(stored, policy), links.broken_links(stored, policy)):
        assert not read_columns(df) & {"body", "headings"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_registered_plans_move_what_they_must(spark):
    run = lambda name: plan(driver.queries()[name](spark, SF))
    for name in ("segment", "build_payloads", "triage", "extract_documents", "extract_rules"):
        # Texts are worked on where they are read.
        assert "RoundRobin" not in run(name) and "REPARTITION" not in run(name), name
    assert "Exchange" not in run("build_payloads")
    assert run("signal_lift").count("labels.parquet") == 1 and "collect_list" not in run("find_project")


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_no_registered_query_multiplies_its_inputs(spark):
    for name, run in driver.queries().items():
        if not name.startswith("stream_"):
            text = plan(run(spark, SF))
            assert "CartesianProduct" not in text and "NestedLoop" not in text, name
