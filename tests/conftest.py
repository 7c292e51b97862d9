import tempfile

import pytest

from shelfmark.policy import Policy, Root
from shelfmark.session import build_session

AS_OF = 1_767_225_600_000  # 2026-01-01
DAY = 86_400_000


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture()
def policy():
    return Policy(as_of_ms=AS_OF, roots=(Root("/w", "work"), Root("/x", "extra")), home="/home/me")


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@pytest.fixture()
def make_files(spark, policy):
    """Rows of the files table out of {rel: text} or {rel: {field: value}}."""
    from pyspark.sql import functions as F

    from shelfmark.operators.extract import extract_text
    from shelfmark.sources.corpus import describe

    def build(items: dict, root: str = "/w", pol: Policy = policy):
        rows = []
        for rel, spec in items.items():
            spec = {"text": spec} if isinstance(spec, str) else spec
            text = spec.get("text", "")
            rows.append((spec.get("root", root), rel, text, spec.get("size", len(text.encode())),
                         spec.get("mtime_ms", AS_OF - DAY), spec.get("gone", False), spec.get("scan_id", 1)))
        raw = spark.createDataFrame(
            rows, "root string, rel string, text string, size long, mtime_ms long, gone boolean, scan_id long")
        named = describe(raw.withColumn("path", F.concat_ws("/", "root", "rel")), pol)
        readable = F.col("is_text") & ~F.col("denied")
        named = named.withColumn("content_hash", F.when(~F.col("denied"), F.sha2("text", 256)))
        text = named.withColumn("text", F.when(readable, F.col("text")).otherwise(F.lit("")))
        return extract_text(text, pol).drop("text").withColumn("is_binary", F.lit(False))

    return build
