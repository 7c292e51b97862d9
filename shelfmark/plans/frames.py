"""Driver tables as corpus frames.

The recipe is a handful of SQL expressions both engines understand, so a query and its SQL twin start from the same
rows. Attributes a file system would give (folder, extension, time of change) are derived from the document id; no
row is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.extract import extract_text, local_links
from shelfmark.policy import Policy, Root
from shelfmark.sources.corpus import kind_and_flags, name_and_ext

AS_OF_MS = 1_767_225_600_000  # 2026-01-01
SOURCES = tuple(f"src{i}" for i in range(20))
POLICY = Policy(
    as_of_ms=AS_OF_MS,
    roots=tuple(Root(f"/vault/{s}", s) for s in SOURCES),
    primary_root="/vault/src0",
    inbox_dir="inbox",
    project_card_dir="cards",
    dir_notes={"releases": "built packages"},
)

ROOT = "concat('/vault/', source)"
STEM = """CASE doc_id % 12
  WHEN 0 THEN concat('readme-', doc_id) WHEN 1 THEN concat('report-', doc_id, '-final')
  WHEN 2 THEN concat('img_', doc_id) WHEN 3 THEN concat('00-', doc_id)
  WHEN 4 THEN concat('rules-', doc_id) WHEN 5 THEN concat('projects-', doc_id)
  WHEN 6 THEN concat('secret-', doc_id) WHEN 7 THEN concat('wechat-', doc_id)
  WHEN 8 THEN 'summary' WHEN 9 THEN concat('doc-', doc_id, ' (1)')
  WHEN 10 THEN concat(repeat('long-', 12), doc_id) ELSE concat('ledger_', doc_id) END"""
EXT = """CASE doc_id % 11
  WHEN 4 THEN '.txt' WHEN 5 THEN '.json' WHEN 6 THEN '.py' WHEN 7 THEN '.html'
  WHEN 8 THEN '.csv' WHEN 9 THEN '.png' WHEN 10 THEN '.log' ELSE '.md' END"""
FOLDER = """CASE doc_id % 7
  WHEN 0 THEN concat(lang, '/notes/') WHEN 1 THEN concat(lang, '/archive/') WHEN 2 THEN 'node_modules/'
  WHEN 3 THEN 'releases/' WHEN 4 THEN concat(lang, '/docs/deep/') WHEN 5 THEN 'inbox/' ELSE '' END"""
# A name without the id stands in a folder of its own.
OWN_FOLDER = "CASE WHEN doc_id % 12 = 8 THEN concat('n', doc_id, '/') ELSE '' END"
REL = f"concat({FOLDER}, {OWN_FOLDER}, {STEM}, {EXT})"
MTIME = "1704067200000 + ((doc_id * 7919) % 730) * 86400000"
GONE = "doc_id % 97 = 0"
SCAN_ID = "1000 + doc_id % 5"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_row(before: DataFrame, after: DataFrame, *derived: str) -> DataFrame:
    """Keep derived attributes as if they were columns of a stored table.

    A filter on an attribute is otherwise pushed below its definition, and definitions that build on each other
    multiply. The one-row generator computes each attribute once per document.
    """
    return after.select(*before.columns, F.inline(F.array(F.struct(*derived))))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a described listing with their text; the size counts UTF-8 bytes."""
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "lang", "source", "CAST(octet_length(text) AS BIGINT) AS size", "n_chars", "text", f"{ROOT} AS root", f"{REL} AS rel",
        f"concat({ROOT}, '/', {REL}) AS path", f"{MTIME} AS mtime_ms", f"{GONE} AS gone", f"{SCAN_ID} AS scan_id")
    given = ("doc_id", "lang", "source", "size", "n_chars", "text")
    docs = docs.select(*given, F.inline(F.array(F.struct(*[c for c in docs.columns if c not in given]))))
    named = in_row(docs, name_and_ext(docs), "name", "ext")
    return in_row(named, kind_and_flags(named, POLICY), "kind", "is_text", "is_symlink", "denied")


def readable() -> Column:
    return F.col("is_text") & ~F.col("denied")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files table without what is read from content, but for the hash of its bytes.

    The stored character count serves reports about metadata; it equals the length of the body.
    """
    return listing(spark, sf_dir).withColumns({
        "body_chars": F.when(readable(), F.col("n_chars")).otherwise(F.lit(0)), "is_binary": F.lit(False),
        "truncated": F.lit(False), "content_hash": F.when(~F.col("denied"), F.sha2("text", 256)),
    }).drop("text", "n_chars")


def with_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and body, for operators that need neither title nor headings."""
    return listing(spark, sf_dir).withColumns({
        "body": F.when(readable(), F.col("text")).otherwise(F.lit("")),
        "body_chars": F.when(readable(), F.col("n_chars")).otherwise(F.lit(0)), "is_binary": F.lit(False),
        "truncated": F.lit(False), "content_hash": F.when(~F.col("denied"), F.sha2("text", 256)),
    }).drop("text", "n_chars")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole files table: title, headings and body extracted where policy lets us read."""
    rows = with_body(spark, sf_dir)
    text = extract_text(rows.withColumnRenamed("body", "text").drop("body_chars", "truncated"), POLICY).drop("text")
    known = [c for c in rows.columns if c not in ("body_chars", "truncated", "body")]
    return text.select(*known, F.inline(F.array(F.struct(
        "title", "headings", "links", "body", "truncated", "body_chars"))))


CLAIM_SQL = {
    "id": "event_id",
    "kind": "CASE WHEN event_id % 5 = 0 THEN 'material' ELSE 'judgment' END",
    "target_type": "'file'",
    "target": "concat('user-', user_id)",
    "verdict": """CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_type = 'view' THEN '待看'
        WHEN event_type = 'purchase' THEN '保留' WHEN event_type = 'click' THEN '可归档'
        WHEN event_type = 'signup' THEN '可清理' ELSE '撤回' END""",
    "note": "props",
    "source_ref": "concat('vault://file/user-', user_id)",
    "holder": "CASE WHEN event_id % 5 = 0 THEN 'policy:corpus-agent' ELSE 'someone' END",
    "signed_by": "CASE WHEN event_id % 5 = 0 THEN 'policy:corpus-agent' ELSE 'someone' END",
    "actor_type": "CASE WHEN event_id % 5 = 0 THEN 'machine' ELSE 'human' END",
    "authority": "CASE WHEN event_id % 5 = 0 THEN 'L0' ELSE 'L1' END",
}


def claims_from(events: DataFrame) -> DataFrame:
    """Judgment events out of the driver's event table, batch or stream."""
    return events.selectExpr(
        *[f"{sql} AS {name}" for name, sql in CLAIM_SQL.items()],
        "unix_seconds(CAST(ts AS TIMESTAMP)) AS ts", "value")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims_from(table(spark, sf_dir, "events")).drop("value")


SCAN_RUN_SQL = {
    "run_id": "o_orderkey", "root": "concat('/vault/src', o_custkey % 20)",
    "files_seen": "CAST(floor(o_totalprice) AS BIGINT)", "dirs_seen": "o_custkey",
    "skipped_dirs": "o_custkey % 7", "errors": "o_custkey % 3",
}


def scan_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the log of past scans."""
    return table(spark, sf_dir, "orders").selectExpr(*[f"{sql} AS {name}" for name, sql in SCAN_RUN_SQL.items()])


PROJECT_SQL = {
    "id": "concat('P', p_partkey)", "name": "p_name", "group": "p_brand", "kind": "p_type",
    "note": "concat('size ', p_size)",
}


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a ledger of projects."""
    return table(spark, sf_dir, "part").selectExpr(
        *[f"{sql} AS `{name}`" for name, sql in PROJECT_SQL.items()],
        "array(concat(replace(p_name, ' ', '-'), '.example.com')) AS domains",
        "array(concat('repo/', p_brand)) AS repositories", "CAST(array() AS ARRAY<STRING>) AS routes")


# Anchors of a page become relative links to files named after their target.
PAGE_REL = "concat('pages/', page_id, '.md')"
PAGE_ANCHOR = '<a href="/([^"]*)">[^<]*</a>'


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown documents, beside one file for the first link of each page; other targets are missing."""
    pages = table(spark, sf_dir, "pages")
    body = F.regexp_replace("html", PAGE_ANCHOR, "[$1](../words/$1)")
    docs = pages.select(F.expr(PAGE_REL).alias("rel"), F.array_distinct(local_links(body)).alias("links"), F.length("html").alias("body_chars"))
    words = pages.select(F.regexp_extract("html", PAGE_ANCHOR, 1).alias("_w")).where("_w <> ''").distinct().select(
        F.concat(F.lit("words/"), "_w", F.lit(".md")).alias("rel"), F.array().cast("array<string>").alias("links"), F.lit(0).alias("body_chars"))
    return docs.unionByName(words).withColumns({
        "root": F.lit("/vault/src0"), "path": F.concat(F.lit("/vault/src0/"), F.col("rel")), "ext": F.lit(".md"),
        "gone": F.lit(False),
    })


def rule_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rules: every line a numbered item under a heading about rules, then one that is not."""
    items = F.concat(F.lit("# All\n\n## Naming rules\n\n1. "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n1. ")),
                     F.lit("\n\n## Other\n\n1. not a rule\n"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), items.alias("body"))


def export_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to export: every line a paragraph, attribution by language and label."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"{ROOT} AS root", f"{REL} AS rel", f"concat({STEM}, {EXT}) AS name",
        "replace(text, '\\n', '\\n\\n') AS body",
        "CASE lang WHEN 'en' THEN 'user' WHEN 'de' THEN 'assistant' WHEN 'fr' THEN 'external' END AS role",
        "CASE WHEN lang = 'es' THEN NULL ELSE source END AS author",
        "CASE WHEN lang = 'en' THEN '2024-02-29' END AS original_date",
        "CAST(NULL AS STRING) AS source_type", "CAST(NULL AS STRING) AS parent_source_key",
        "CAST(NULL AS STRING) AS source_title")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(previous, current) listings. Labels decide what changed: documents labelled toxic are no longer there,
    those of poor quality were not there before, and every document in Spanish has grown by one."""
    rows = listing(spark, sf_dir).select(
        "doc_id", "lang", "root", "path", "rel", "name", "ext", "kind", "size", "mtime_ms", "is_text", "denied", "gone",
        "scan_id", F.sha2("text", 256).alias("content_hash"), F.sha2(F.concat("text", F.lit("+")), 256).alias("_grown"))
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    marked = rows.join(marks, "doc_id", "left")
    prev = marked.where(F.coalesce(F.col("quality") != 0, F.lit(True)))
    grown = F.col("lang") == "es"
    cur = marked.where(F.coalesce(F.col("toxic") != 1, F.lit(True))).withColumns({
        "size": F.when(grown, F.col("size") + 1).otherwise(F.col("size")),
        "content_hash": F.when(grown, F.col("_grown")).otherwise(F.col("content_hash"))})
    drop = ("doc_id", "lang", "quality", "toxic", "_grown")
    return prev.drop(*drop), cur.drop(*drop, "gone", "scan_id")
