"""Registered queries over export, ledger, sources and streams, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfmark.functions import keys
from shelfmark.functions.text import SPACE
from shelfmark.operators import export, ledger
from shelfmark.operators.claims import COLUMNS as CLAIM_COLUMNS
from shelfmark.plans import frames as fr
from shelfmark.plans.base_sql import LISTING, SNAPSHOTS, P, on_claims, over
from shelfmark.plans.registry import ORACLES, add
from shelfmark.session import scratch_dir
from shelfmark.sources import corpus, documents
from shelfmark.sources import sinks
from shelfmark.sources.sinks import VersionedTable
from shelfmark.streaming import jobs, ledger_stream

SCOPE = "agent:corpus-inbox"

# -- attribution and identity ---------------------------------------------------------------------


def manifest_rows(s, d):
    """A manifest entry per conversation turn, many of them wrong in some way."""
    return fr.table(s, d, "conversations").selectExpr(*[f"{sql} AS {c}" for c, sql in MANIFEST_SQL.items()])


MANIFEST_SQL = {
    "path": "CASE turn WHEN 0 THEN concat('talks/', conv_id, '.md') WHEN 1 THEN concat('/abs/', conv_id) WHEN 2 THEN concat('../up/', conv_id) "
            "ELSE concat('dup/', conv_id) END",
    "role": "CASE WHEN conv_id % 3 = 0 THEN NULL WHEN conv_id % 3 = 1 THEN role ELSE 'editor' END",
    "author": "CASE WHEN conv_id % 4 = 0 THEN 'Unknown' WHEN conv_id % 4 = 1 THEN ' Ada ' WHEN conv_id % 4 = 2 THEN '' END",
    "original_date": "CASE WHEN conv_id % 5 = 0 THEN '2024-02-30' WHEN conv_id % 5 = 1 THEN '2024-02-29' WHEN conv_id % 5 = 2 THEN '3/4/24' END",
    "source_type": "CASE WHEN conv_id % 7 = 0 THEN 'imported_summary' WHEN conv_id % 7 = 1 THEN 'conversation' WHEN conv_id % 7 = 2 THEN 'rumour' END",
    "parent_source_key": "CASE WHEN conv_id % 2 = 0 THEN 'parent' END",
}
ATTRIBUTED = """concat_ws('|', CASE WHEN role NOT IN ('user', 'assistant', 'external') THEN 'role' END,
    CASE WHEN author = 'Unknown' THEN 'placeholder-author' END,
    CASE WHEN original_date IS NOT NULL AND try_strptime(original_date, '%Y-%m-%d') IS NULL THEN 'original-date' END,
    CASE WHEN source_type NOT IN ('conversation', 'document', 'imported_summary') THEN 'source-type' END,
    CASE WHEN source_type = 'imported_summary' AND parent_source_key IS NULL THEN 'summary-without-parent' END)"""
ENTRIES = "entries AS (SELECT " + ", ".join(f"{sql} AS {c}" for c, sql in MANIFEST_SQL.items()) + " FROM conversations)"
add("attribute", lambda s, d: export.attribute(manifest_rows(s, d)).select(
        "path", "role", "author", "original_date", "source_type", "rejects"),
    over(ENTRIES, f"SELECT path, coalesce(nullif(role, ''), 'external') AS role, nullif(trim(author), '') AS author, original_date, "
                  f"coalesce(source_type, 'document') AS source_type, {ATTRIBUTED} AS rejects FROM entries"))
add("check_manifest", lambda s, d: documents.check_manifest(manifest_rows(s, d), "/vault/src0").select("path", "root", "role", "rejects"),
    over(ENTRIES, f"""SELECT path, '/vault/src0' AS root, coalesce(nullif(role, ''), 'external') AS role, concat_ws('|', CASE WHEN path LIKE '/%' THEN
      'path-not-relative' END, CASE WHEN list_contains(string_split(path, '/'), '..') THEN 'path-goes-up' END, CASE WHEN count(*) OVER (PARTITION BY path) > 1
      THEN 'path-repeated' END, nullif({ATTRIBUTED}, '')) AS rejects FROM entries"""))

docs = lambda s, d: export.attribute(fr.export_docs(s, d)).drop("rejects")
DOCS = f"""docs AS (SELECT doc_id, {fr.ROOT} AS root, {fr.REL} AS rel, concat({fr.STEM}, {fr.EXT}) AS name,
    replace(text, chr(10), chr(10) || chr(10)) AS body, CASE lang WHEN 'en' THEN 'user' WHEN 'de' THEN 'assistant' ELSE 'external' END AS role,
    CASE WHEN lang = 'es' THEN NULL ELSE source END AS author, CASE WHEN lang = 'en' THEN '2024-02-29' END AS original_date FROM documents),
  ided AS (SELECT *, substr(sha256(root || chr(10) || rel), 1, 16) AS stable_id FROM docs),
  keyed AS (SELECT *, substr(sha256(concat('stableId', chr(31), stable_id, chr(30), 'body', chr(31), body, chr(30), 'role', chr(31), role, chr(30),
    'author', chr(31), coalesce(author, chr(0)), chr(30), 'originalDate', chr(31), coalesce(original_date, chr(0)), chr(30), 'locator', chr(31), chr(0),
    chr(30), 'parserVersion', chr(31), '{P.parser_version}')), 1, 16) AS version_hash FROM ided)"""
KEY = f"'{P.key_prefix}:' || stable_id || ':' || version_hash"
add("with_identity", lambda s, d: export.with_identity(docs(s, d), P).select("rel", "stable_id", "version_hash", "base_source_key", "original_ref"),
    over(DOCS, f"SELECT rel, stable_id, version_hash, {KEY} AS base_source_key, '{P.key_prefix}://' || stable_id || '/' || version_hash AS original_ref FROM keyed"))
add("find_by_identity",
    lambda s, d: export.find_by_identity(fr.metadata(s, d), export.with_identity(docs(s, d), P).where(F.col("author").isNull()))
    .select("path", "stable_id"),
    over(DOCS, "SELECT root || '/' || rel AS path, stable_id FROM keyed WHERE author IS NULL"))

# -- segments and batches -------------------------------------------------------------------------

BLANK = SPACE.replace(r"[\s", r"[ \t\r\f")
SHORT = P.with_(segment_chars=400, batch_messages=5, batch_bytes=2_000)
PARA = f"(?:{BLANK}*\\n)*(?:[^\\n]*[^\\n \\t\\r\\f][^\\n]*(?:\\n|$))+(?:{BLANK}*\\n)*(?:{BLANK}+$)?"


def parts_sql(policy) -> str:
    """Paragraphs by one pattern, oversize ones cut step by step."""
    budget = policy.segment_chars
    keep = budget - budget // 4
    cut = f"length(regexp_extract(substr(rest, {keep + 1}, {budget - keep}), '(?s)^.*[\\n。！？；.!?;]'))"
    size = f"CASE WHEN length(rest) <= {budget} THEN length(rest) WHEN {cut} > 0 THEN {keep} + {cut} ELSE {budget} END"
    return f"""{DOCS},
  split AS (SELECT doc_id, unnest(ps) AS para_text, generate_subscripts(ps, 1) - 1 AS para FROM (SELECT doc_id, CASE WHEN body = '' THEN ['']
    WHEN regexp_matches(body, '[^\\s]') THEN regexp_extract_all(body, '{PARA}') ELSE [body] END AS ps FROM docs)),
  cuts AS (SELECT doc_id, para, CAST(0 AS BIGINT) AS k, substr(rest, 1, {size}) AS text, substr(rest, {size} + 1) AS rest FROM (SELECT doc_id, para, para_text AS rest FROM split)
    UNION ALL SELECT doc_id, para, k + 1, substr(rest, 1, {size}), substr(rest, {size} + 1) FROM cuts WHERE rest <> ''),
  parts AS (SELECT doc_id, para, k, text, count(*) OVER (PARTITION BY doc_id, para) AS n,
    row_number() OVER (PARTITION BY doc_id ORDER BY para, k) - 1 AS ordinal,
    CAST(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY para, k) AS BIGINT) AS end_cp FROM cuts),
  placed AS (SELECT *, end_cp - length(text) AS start_cp, 'p' || lpad(CAST(ordinal AS VARCHAR), 4, '0') AS id,
    'paragraph-' || (para + 1) || CASE WHEN n > 1 THEN '+part-' || (k + 1) || '/' || n ELSE '' END AS locator FROM parts)"""


def packed_sql(policy) -> str:
    """Greedy packing, one message after the other."""
    return f"""{parts_sql(policy)},
  sized AS (SELECT p.*, k.rel, k.role, k.stable_id, k.version_hash, k.name, strlen(CAST(json_object('id', p.id, 'role', k.role, 'text', p.text,
    'source_title', k.name) AS VARCHAR)) AS bytes FROM placed p JOIN keyed k USING (doc_id)),
  walk AS (SELECT doc_id, 0 AS ordinal, 0 AS batch, 1 AS cnt, bytes + 2 AS used FROM sized WHERE ordinal = 0
    UNION ALL SELECT s.doc_id, s.ordinal, CASE WHEN cnt + 1 > {policy.batch_messages} OR used + s.bytes + 1 > {policy.batch_bytes} THEN batch + 1 ELSE batch END,
      CASE WHEN cnt + 1 > {policy.batch_messages} OR used + s.bytes + 1 > {policy.batch_bytes} THEN 1 ELSE cnt + 1 END,
      CASE WHEN cnt + 1 > {policy.batch_messages} OR used + s.bytes + 1 > {policy.batch_bytes} THEN s.bytes + 2 ELSE used + s.bytes + 1 END
    FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.ordinal = w.ordinal + 1),
  batches AS (SELECT s.doc_id, batch, any_value(rel) AS rel, any_value(role) AS role, any_value(stable_id) AS stable_id, any_value(version_hash) AS version_hash,
    count(*) AS messages, sum(bytes) + count(*) + 1 AS json_bytes, min(s.ordinal) AS part_index, arg_min(locator, s.ordinal) AS first,
    arg_max(locator, s.ordinal) AS last, sha256(string_agg(s.text, '' ORDER BY s.ordinal)) AS text_hash FROM walk w JOIN sized s
    ON s.doc_id = w.doc_id AND s.ordinal = w.ordinal GROUP BY s.doc_id, batch)"""


PART_COLS = ("doc_id", "ordinal", "para", "k", "n", "start_cp", "end_cp", "id", "locator")
parts = lambda s, d, p: export.explode_parts(export.segment(docs(s, d), p), "doc_id").select(*PART_COLS, F.sha2("text", 256).alias("text_hash"))
PARTS = f"SELECT {', '.join(PART_COLS)}, sha256(text) AS text_hash FROM placed"
add("segment", lambda s, d: parts(s, d, P), over("RECURSIVE " + parts_sql(P), PARTS))
add("segment_short_budget", lambda s, d: parts(s, d, SHORT), over("RECURSIVE " + parts_sql(SHORT), PARTS))
add("segment_round_trip",
    lambda s, d: export.segment(docs(s, d), SHORT).select(
        "doc_id", (F.array_join(F.transform("parts", lambda p: p["text"]), "") == F.col("body")).alias("same"),
        (F.array_max(F.transform("parts", lambda p: F.length(p["text"]))) <= 400).alias("fits")),
    "SELECT doc_id, true AS same, true AS fits FROM documents")


def batches(s, d, policy):
    return export.build_payloads(docs(s, d), policy, SCOPE)


def batch_view(df):
    return df.select("rel", "source_key", "part_index", "locator", F.size("messages").alias("messages"),
                     F.octet_length(F.to_json("messages")).alias("json_bytes"),
                     F.sha2(F.array_join(F.transform("messages", lambda m: m["text"]), ""), 256).alias("text_hash"))


BATCHES = (f"SELECT rel, {KEY} || '#p' || lpad(CAST(batch + 1 AS VARCHAR), 4, '0') AS source_key, part_index, CASE WHEN first = last THEN first ELSE "
           f"first || '..' || last END AS locator, messages, CAST(json_bytes AS BIGINT) AS json_bytes, text_hash FROM batches")
add("build_payloads", lambda s, d: batch_view(batches(s, d, P)), over("RECURSIVE " + packed_sql(P), BATCHES))
add("pack_short_limits", lambda s, d: batch_view(batches(s, d, SHORT)), over("RECURSIVE " + packed_sql(SHORT), BATCHES))
add("export_plan", lambda s, d: export.export_plan(docs(s, d), P, SCOPE).select("rel", "role", "version_hash", "batches", "messages", "bad_batches"),
    over("RECURSIVE " + packed_sql(P), "SELECT rel, any_value(role) AS role, any_value(version_hash) AS version_hash, count(*) AS batches, "
                                       "CAST(sum(messages) AS BIGINT) AS messages, CAST(0 AS BIGINT) AS bad_batches FROM batches GROUP BY rel"))


def spoiled(s, d):
    """Turns of conversations as one-message payloads that break a rule now and then."""
    t = fr.table(s, d, "conversations")
    msg = F.struct(
        F.when(F.col("turn") == 1, F.lit("")).otherwise(F.concat(F.lit("m"), "turn")).alias("id"),
        F.when(F.col("role") == "assistant", F.lit("robot")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("turn") == 2, F.lit("")).otherwise(F.col("text")).alias("text"))
    return t.select(
        "conv_id", "turn", F.when(F.col("conv_id") % 9 != 0, F.lit(SCOPE)).alias("scope"),
        F.concat(F.lit("k"), "conv_id", F.lit("-"), "turn").alias("source_key"), F.lit("conversation").alias("source_type"),
        F.when(F.col("turn") == 0, F.lit("archive")).otherwise(F.lit("digest")).alias("processing_policy"),
        F.when(F.col("conv_id") % 2 == 0, F.array(msg, msg)).otherwise(F.array(msg)).alias("messages"),
        F.struct(*[(F.repeat(F.lit("x"), 1001) if k == "locator" else F.lit("x")).alias(k) for k in export.META_KEYS]).alias("source_metadata"))


add("validate_payloads", lambda s, d: export.validate_payloads(spoiled(s, d), P.with_(batch_bytes=900)).select("conv_id", "turn", "problems"),
    """SELECT conv_id, turn, concat_ws('|', CASE WHEN conv_id % 9 = 0 THEN 'scope-missing' END, CASE WHEN turn <> 0 THEN 'processing-policy' END,
      CASE WHEN turn = 1 THEN 'message-id' END, CASE WHEN conv_id % 2 = 0 THEN 'message-id-repeated' END, CASE WHEN turn = 2 THEN 'message-empty' END,
      CASE WHEN role NOT IN ('user', 'external') THEN 'message-role' END,
      CASE WHEN (CASE WHEN conv_id % 2 = 0 THEN 2 * n + 3 ELSE n + 2 END) > 900 THEN 'messages-too-long' END, 'metadata:locator') AS problems
    FROM (SELECT *, strlen(CAST(json_object('id', CASE WHEN turn = 1 THEN '' ELSE 'm' || turn END, 'role', CASE WHEN role = 'assistant' THEN 'robot' ELSE role END,
      'text', CASE WHEN turn = 2 THEN '' ELSE text END) AS VARCHAR)) AS n FROM conversations)""")
add("check_read",
    lambda s, d: export.check_read(fr.listing(s, d).select("path", "size"), fr.listing(s, d).where("lang <> 'fr'").select(
        "path", F.when(F.col("lang") == "de", F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(F.col("lang") == "es", F.concat("text", F.lit("\u0000"))).otherwise(F.col("text")).alias("text"))),
    over(LISTING, "SELECT path, lang = 'en' AS ok, CASE lang WHEN 'fr' THEN 'missing' WHEN 'de' THEN 'size-mismatch' WHEN 'es' THEN 'binary' END AS reason FROM meta"))

# -- the ledger -----------------------------------------------------------------------------------

STAGE = "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'submitted' WHEN 'signup' THEN 'receipted' WHEN 'purchase' THEN 'indexed' ELSE 'failed' END"


def ledger_rows(s, d):
    """One ledger row per event: a version per user, stage by event type."""
    e = fr.table(s, d, "events")
    none = "CAST(NULL AS STRING)"
    return e.selectExpr(
        "'default' AS instance", "concat('u', user_id) AS stable_id", "event_type AS version_hash", "concat('k', event_id) AS source_key", "0 AS part_index",
        "1 AS part_total", f"{none} AS locator", "props AS payload_digest", "'s' AS scope", "'document' AS source_type", "'user' AS role",
        "props AS payload_json", f"{STAGE} AS stage", f"{none} AS source_id", f"{none} AS job_id", "user_id % 7 AS attempts", f"{none} AS last_error",
        f"{none} AS last_error_kind")


LEDGER = f"""ledger AS (SELECT 'default' AS instance, concat('u', user_id) AS stable_id, event_type AS version_hash, concat('k', event_id) AS source_key,
  props AS payload_digest, {STAGE} AS stage, user_id % 7 AS attempts, event_id, value FROM events)"""


def sent(s, d):
    """Offered payloads: every event once more, those of high value changed, and as many that are new. A third of
    the new ones are offered twice, a third twice with different digests."""
    e = fr.table(s, d, "events")
    again = e.selectExpr("'default' AS instance", "concat('k', event_id) AS source_key", "CASE WHEN value > 50 THEN 'changed' ELSE props END AS payload_digest")
    fresh = e.selectExpr("'default' AS instance", "concat('new', event_id) AS source_key", "props AS payload_digest")
    twice = e.where("event_id % 3 > 0").selectExpr("'default' AS instance", "concat('new', event_id) AS source_key",
                                                   "CASE WHEN event_id % 3 = 1 THEN props ELSE 'other' END AS payload_digest")
    return again.unionByName(fresh).unionByName(twice)


add("plan_submissions", lambda s, d: ledger.plan_submissions(sent(s, d), ledger_rows(s, d)).select("source_key", "payload_digest", "decision"),
    over(LEDGER, "SELECT source_key, CASE WHEN value > 50 THEN 'changed' ELSE payload_digest END AS payload_digest, CASE WHEN value > 50 THEN 'conflict' "
                 "WHEN stage IN ('receipted', 'indexed') THEN 'skip' ELSE 'retry' END AS decision FROM ledger "
                 "UNION ALL SELECT concat('new', event_id), props, CASE WHEN event_id % 3 = 2 THEN 'conflict' ELSE 'new' END FROM events "
                 "UNION ALL SELECT concat('new', event_id), 'other', 'conflict' FROM events WHERE event_id % 3 = 2"))


def result_events(s, d):
    """Results for ledger rows out of line items: several per order, in line order."""
    li = fr.table(s, d, "lineitem")
    return li.selectExpr(
        "'default' AS instance", "concat('k', l_orderkey) AS source_key", "l_linenumber AS seq",
        "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'failed' WHEN l_returnflag = 'R' THEN 'counted' WHEN l_returnflag = 'A' AND l_linestatus = 'F' "
        "THEN 'submitted' WHEN l_returnflag = 'A' THEN 'receipted' WHEN l_quantity > 45 THEN 'indexed' ELSE 'submitted' END AS event",
        "CASE WHEN l_returnflag = 'N' THEN concat('src', l_linenumber) END AS source_id", "CAST(NULL AS STRING) AS job_id",
        "concat('line ', l_linenumber) AS message", "'tool' AS kind", "l_suppkey", "l_partkey", "l_quantity").where("event IS NOT NULL")


EVENT = """CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'failed' WHEN l_returnflag = 'R' THEN 'counted' WHEN l_returnflag = 'A' AND l_linestatus = 'F'
  THEN 'submitted' WHEN l_returnflag = 'A' THEN 'receipted' WHEN l_quantity > 45 THEN 'indexed' ELSE 'submitted' END"""


def unique_results(s, d):
    """Line numbers repeat within an order, so a running number over all its columns makes the order total."""
    seq = F.struct("seq", "l_partkey", "l_suppkey", "l_quantity", "event")
    return result_events(s, d).withColumn("seq", seq).drop("l_partkey", "l_suppkey", "l_quantity")


add("apply_results", lambda s, d: ledger.apply_results(ledger_rows(s, d), unique_results(s, d)).select(
        "source_key", "stage", "attempts", "source_id", "last_error"),
    over(f"""{LEDGER}, ev AS (SELECT concat('k', l_orderkey) AS source_key, {EVENT} AS event, CASE WHEN l_returnflag = 'N' THEN concat('src', l_linenumber) END AS source_id,
      concat('line ', l_linenumber) AS message, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, {EVENT}) AS seq FROM lineitem),
    folded AS (SELECT source_key, count(*) FILTER (WHERE event IN ('submitted', 'failed', 'counted')) AS n, bool_or(event = 'indexed') AS idx, bool_or(event = 'receipted') AS rec,
      arg_max(event, seq) FILTER (WHERE event IN ('submitted', 'failed')) AS last, arg_max(source_id, seq) FILTER (WHERE source_id IS NOT NULL) AS sid,
      arg_max(CASE WHEN event = 'submitted' THEN '' ELSE message END, seq) FILTER (WHERE event IN ('failed', 'counted', 'submitted')) AS err FROM ev GROUP BY source_key)""",
         """SELECT source_key, CASE WHEN coalesce(idx, false) OR stage = 'indexed' THEN 'indexed' WHEN coalesce(rec, false) OR stage = 'receipted' THEN 'receipted'
      ELSE coalesce(last, stage) END AS stage, attempts + coalesce(n, 0) AS attempts, sid AS source_id, nullif(err, '') AS last_error FROM ledger LEFT JOIN folded USING (source_key)"""))


def streamed_ledger(s, d):
    """The same events as a stream of several micro-batches in no order, each event twice, from the stored ledger on."""
    order = F.row_number().over(Window.partitionBy("instance", "source_key").orderBy("seq"))  # the lines of an order
    events = unique_results(s, d).withColumn("seq", order.cast("long")).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000)))
    feed = scratch_dir(s, "ledger-feed")
    twice = events.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2))))
    twice.repartition(4, F.xxhash64("source_key", "seq", "_copy")).drop("_copy").write.parquet(feed)
    stream = s.readStream.schema(s.read.parquet(feed).schema).option("maxFilesPerTrigger", 2).parquet(feed)
    rows = ledger_rows(s, d)
    states = ledger_stream.ledger_states(stream, rows)
    table = VersionedTable(s, scratch_dir(s, "ledger-states"))
    ledger_stream.start_ledger(states, table, scratch_dir(s, "ledger-checkpoint")).awaitTermination()
    return ledger_stream.current_ledger(rows, table.read_all(states.schema)).select("source_key", "stage", "attempts", "source_id", "last_error")


add("stream_ledger", streamed_ledger, ORACLES["apply_results"])
add("pending_parts", lambda s, d: ledger.pending(ledger_rows(s, d)).select("source_key", "stage"),
    over(LEDGER, "SELECT source_key, stage FROM ledger WHERE stage IN ('pending', 'failed', 'submitted')"))
add("exhausted_parts", lambda s, d: ledger.exhausted(ledger_rows(s, d), 5).select("source_key", "attempts"),
    over(LEDGER, "SELECT source_key, attempts FROM ledger WHERE stage IN ('pending', 'failed') AND attempts >= 5"))
add("compensation", lambda s, d: ledger.compensation(ledger_rows(s, d), 5),
    over(LEDGER, "SELECT instance, source_key, payload_digest AS payload_json FROM ledger WHERE stage IN ('pending', 'failed', 'submitted') AND attempts < 5"))
add("version_complete", lambda s, d: ledger.version_complete(ledger_rows(s, d)),
    over(LEDGER, "SELECT *, total = done AS complete FROM (SELECT instance, stable_id, version_hash, count(*) AS total, count(*) FILTER (WHERE stage IN "
                 "('receipted', 'indexed')) AS done FROM ledger GROUP BY ALL)"))


def removed_docs(s, d):
    return fr.metadata(s, d).where("gone").select("root", "rel")


add("tombstones",
    lambda s, d: ledger.tombstones(removed_docs(s, d), ledger.tombstones(removed_docs(s, d).where("root = '/vault/src1'"), removed_docs(s, d).limit(0).select(
        *[F.lit("").alias(c) for c in ("instance", "stable_id", "source_key")]))),
    over(LISTING, "SELECT 'default' AS instance, substr(sha256(root || chr(10) || rel), 1, 16) AS stable_id, '' AS source_key, 'no longer present' AS reason, 'pending' AS "
                  "state FROM meta WHERE gone AND root <> '/vault/src1'"))
add("export_status",
    lambda s, d: ledger.export_status(ledger_rows(s, d).where("version_hash <> 'signup'"), removed_docs(s, d).select(F.lit("pending").alias("state"))),
    over(f"{LEDGER}, {LISTING}", "SELECT " + ", ".join(f"count(*) FILTER (WHERE stage = '{x}') AS {x}" for x in ("pending", "submitted", "receipted", "indexed", "failed")) +
         ", (SELECT count(*) FROM meta WHERE gone) AS tombstones_pending FROM ledger WHERE version_hash <> 'signup'"))
RESULT_SQL = {
    "id": "event_id", "status": "CASE WHEN user_id % 9 = 0 THEN NULL WHEN user_id % 9 = 1 THEN 403 WHEN user_id % 9 = 2 THEN 429 WHEN user_id % 9 = 3 THEN 503 "
                               "WHEN user_id % 9 = 4 THEN 422 WHEN user_id % 9 = 5 THEN 302 ELSE 200 END",
    "rpc_error": "event_type = 'error'", "tool_error": "event_type = 'click'",
    "message": "CASE WHEN value > 60 THEN 'Scope is forbidden' WHEN value > 40 THEN 'no permission' ELSE 'bad field' END",
}
add("classify_results",
    lambda s, d: ledger.classify_results(fr.table(s, d, "events").selectExpr(*[f"{sql} AS {c}" for c, sql in RESULT_SQL.items()])).select("id", "kind", "action"),
    over("r AS (SELECT " + ", ".join(f"{sql} AS {c}" for c, sql in RESULT_SQL.items()) + " FROM events), k AS (SELECT id, CASE WHEN status IS NULL THEN 'unknown' WHEN status "
         "IN (401, 403) THEN 'auth' WHEN status = 429 OR status >= 500 THEN 'transient' WHEN status >= 400 THEN 'validation' WHEN status <> 200 THEN 'protocol' WHEN rpc_error "
         "THEN CASE WHEN message LIKE 'Scope%' THEN 'auth' ELSE 'validation' END WHEN tool_error THEN CASE WHEN message <> 'bad field' THEN 'auth' ELSE 'tool' END END AS kind FROM r)",
         "SELECT id, kind, CASE WHEN kind IS NULL THEN 'receipt' WHEN kind = 'auth' THEN 'stop' WHEN kind IN ('unknown', 'transient') THEN 'count' ELSE 'fail' END AS action FROM k"))


def answers(s, d):
    """Receipts as services send them: flat, nested, or as JSON inside a string; ids in prose and escaped values too."""
    inner = F.to_json(F.struct(F.concat(F.lit("s"), "conv_id").alias("source_id"), F.concat(F.lit("j"), "turn").alias("jobId")))
    nested = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), inner.alias("text"))).alias("content")))
    prose = F.to_json(F.struct(F.concat(F.lit('see "source_id":"abc" in the guide, page '), "conv_id").alias("message")))
    escaped = F.to_json(F.struct(F.concat(F.lit('a"b\\c\n'), "conv_id").alias("source_id"), F.col("text").alias("note")))
    return fr.table(s, d, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") == 0, inner).when(F.col("turn") == 1, nested).when(F.col("turn") == 2, F.to_json(F.struct(nested.alias("result"))))
        .when(F.col("turn") == 3, prose).when(F.col("turn") == 4, escaped).otherwise(F.lit("{not json")).alias("response"))


add("receipts", lambda s, d: ledger.receipts(answers(s, d)).select("conv_id", "turn", "source_id", "job_id"),
    "SELECT conv_id, turn, CASE WHEN turn < 3 THEN 's' || conv_id WHEN turn = 4 THEN 'a\"b\\c' || chr(10) || conv_id END AS source_id, "
    "CASE WHEN turn < 3 THEN 'j' || turn END AS job_id FROM conversations")
add("short_hashes", lambda s, d: fr.table(s, d, "documents").select("doc_id", keys.short_hash(F.col("text")).alias("hash")),
    "SELECT doc_id, substr(sha1(text), 1, 12) AS hash FROM documents")

# -- sources and streams --------------------------------------------------------------------------

PRUNE_REL = "concat(CASE WHEN lang = 'en' THEN 'tools/My.app/' WHEN lang = 'de' THEN 'x/dist/' ELSE '' END, " + fr.REL + ")"
add("prune_paths",
    lambda s, d: corpus.prune_paths(corpus.describe(fr.table(s, d, "documents").selectExpr(
        f"{fr.ROOT} AS root", f"{PRUNE_REL} AS rel", f"concat({fr.ROOT}, '/', {PRUNE_REL}) AS path", "CAST(octet_length(text) AS BIGINT) AS size", f"{fr.MTIME} AS mtime_ms"), P), P)
    .select("root", "path", "rel", "name", "kind", "size", "mtime_ms"),
    over(LISTING, f"""SELECT root, path, rel, name, kind, size, mtime_ms FROM meta WHERE lang NOT IN ('en', 'de') AND NOT list_has_any(string_split(folder, '/'),
        ['node_modules', 'dist']) UNION ALL SELECT root, root || '/tools/My.app', 'tools/My.app', 'My.app', 'bundle', 0, max(mtime_ms) FROM meta WHERE lang = 'en' GROUP BY root"""))


def events_stream(s, d):
    return fr.claims_from(corpus.stream_table(s, f"{d}/events.parquet", fr.table(s, d, "events").schema)).drop("value")


def run_current(s, d):
    base = scratch_dir(s, "current")
    table = VersionedTable(s, base + "/table")
    events = events_stream(s, d)
    jobs.start_current(events, table, base + "/checkpoint").awaitTermination()
    return jobs.current_from_updates(table.read_all(jobs.stream_current(events).schema))


def run_daily(s, d):
    base = scratch_dir(s, "daily")
    counts = jobs.daily_counts(jobs.with_event_time(events_stream(s, d)))
    jobs.append_to(counts, base + "/out", base + "/checkpoint").awaitTermination()
    return sinks.read_written(s, base + "/out", counts.schema).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "actor_type", "verdict", "events")


def run_once_only(s, d):
    """Every event delivered twice; each comes out once."""
    base = scratch_dir(s, "once")
    twice = jobs.with_event_time(events_stream(s, d)).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    once = jobs.without_repeats(twice)
    jobs.append_to(once, base + "/out", base + "/checkpoint").awaitTermination()
    return sinks.read_written(s, base + "/out", once.schema).select("id", "target", "ts")


add("stream_current_claims", run_current, on_claims(f"SELECT {', '.join(CLAIM_COLUMNS)} FROM current"))
# The watermark passes a day once the newest event is a day past its end.
add("stream_daily_counts", run_daily,
    on_claims("""SELECT strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS day, actor_type, verdict, count(*) AS events FROM claims
      WHERE (ts // 86400 + 1) * 86400 <= (SELECT max(ts) - 86400 FROM claims) GROUP BY ALL"""))
add("stream_without_repeats", run_once_only, on_claims("SELECT id, target, ts FROM claims"))


def run_refresh(s, d):
    """Extracted rows as a stream, each path twice, the newer row last; then the merge with the full listing."""
    base = scratch_dir(s, "refresh")
    prev, cur = fr.snapshots(s, d)
    twice = cur.withColumn("scan_id", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")))).withColumn(
        "content_hash", F.when(F.col("scan_id") == 2, F.col("content_hash")).otherwise("outdated"))
    twice.write.parquet(base + "/feed")
    feed = s.readStream.schema(s.read.parquet(base + "/feed").schema).option("maxFilesPerTrigger", 2).parquet(base + "/feed")
    table = VersionedTable(s, base + "/versions")
    jobs.append_versions(feed, table, base + "/checkpoint").awaitTermination()
    done = jobs.refresh_snapshot(prev, table.read_all(), cur.drop("content_hash"), 2000, P.root_paths)
    return done.select("path", "size", "content_hash", "action", "gone", "scan_id")


add("stream_refresh", run_refresh,
    over(SNAPSHOTS, """SELECT a.path, coalesce(c.size, p.size) AS size, CASE WHEN a.action IN ('added', 'updated') THEN sha256(c.text || CASE WHEN c.lang = 'es' THEN '+' ELSE '' END)
      ELSE sha256(p.text) END AS content_hash, a.action, a.action IN ('removed', 'gone') AS gone, CASE WHEN a.action IN ('gone', 'kept') THEN p.scan_id ELSE 2000 END AS scan_id
      FROM actions a LEFT JOIN prev p ON p.path = a.path LEFT JOIN cur c ON c.path = a.path"""))


# What goes wrong with a document of the export, by its id.
FAULT_SQL = """CASE WHEN doc_id % 13 = 1 THEN 'size-mismatch' WHEN doc_id % 13 = 2 THEN 'missing' WHEN doc_id % 13 = 3 THEN 'binary'
  WHEN doc_id % 13 = 4 THEN 'message-empty' END"""


def faulty(s, d):
    """(documents with what goes wrong, index rows, stored content): the index holds the first hundred characters of a body."""
    whole = docs(s, d).withColumns({
        "path": F.concat("root", F.lit("/"), "rel"), "fault": F.expr(FAULT_SQL), "gone": F.col("rel").contains("/archive/"),
        "denied": F.col("rel").contains("secret"), "size": F.octet_length("body").cast("bigint")})
    text = F.when(F.col("fault") == "binary", F.concat("body", F.lit("\u0000"))).when(F.col("fault") == "message-empty", F.lit("")).otherwise(F.col("body"))
    size = F.octet_length(text).cast("bigint")
    listed = F.when(F.col("fault") == "size-mismatch", F.col("size") + 1).otherwise(size)
    rows = whole.withColumns({"size": listed, "body": F.substring("body", 1, 100)})
    return rows, whole.where("fault IS NULL OR fault <> 'missing'").select("path", size.alias("size"), text.alias("text"))


def dry_run(s, d):
    rows, stored = faulty(s, d)
    return export.dry_run_errors(export.read_whole(rows.where("NOT gone").drop("body"), stored), P, SCOPE)


add("dry_run_errors", dry_run,
    over(DOCS, f"""SELECT rel, CASE WHEN NOT contains(rel, 'secret') AND fault = 'message-empty' THEN 'payload' ELSE 'read' END AS kind, CASE WHEN contains(rel, 'secret') THEN 'denied'
      ELSE fault END AS reason FROM (SELECT *, {FAULT_SQL} AS fault FROM docs) WHERE NOT contains(rel, '/archive/') AND (contains(rel, 'secret') OR fault IS NOT NULL)"""))


def run_export(s, d):
    """The change feed of all documents, exported micro-batch by micro-batch: the ledger it leaves, removals, and errors.

    The index holds the first hundred characters of a body only, the store has whole texts. Every document comes twice,
    the second time in a later scan. Some documents cannot be read, some have no text.
    """
    base = scratch_dir(s, "export")
    feed_dir = base + "/feed"
    rows, store = faulty(s, d)
    rows.select("path", "root", "rel", "name", "gone", "denied", "body", "size",
                F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))).alias("scan_id")).write.parquet(feed_dir)
    entries = docs(s, d).select("root", F.col("rel").alias("path"), "role", "author", "original_date", "source_type", "parent_source_key", "source_title")
    feed = s.readStream.schema(s.read.parquet(feed_dir).schema).option("maxFilesPerTrigger", 3).parquet(feed_dir)
    book, stones, faults = (VersionedTable(s, f"{base}/{name}") for name in ("ledger", "tombstones", "errors"))
    jobs.start_export(feed, base + "/checkpoint", manifest=entries, content=store, ledger=book, removals=stones, errors=faults, policy=P,
                      scope=SCOPE).awaitTermination()
    none = F.lit(None).cast("string")
    removed = stones.read_all().select(F.lit("removed").alias("stage"), "stable_id", "source_key", none.alias("payload_digest"))
    failed = jobs.open_errors(faults, book).select(F.concat("kind", F.lit(":"), "reason").alias("stage"), "stable_id", F.lit("").alias("source_key"),
                                                   none.alias("payload_digest"))
    return book.read_all().select("stage", "stable_id", "source_key", "payload_digest").unionByName(removed).unionByName(failed)


EXPORTED = f"""NOT contains(rel, '/archive/') AND NOT contains(rel, 'secret') AND ({FAULT_SQL}) IS NULL"""


def payload_sql() -> str:
    """The JSON of a batch; keys without a value are left out."""
    lead = ("'{\"original_ref\":\"" + P.key_prefix + "://' || stable_id || '/' || version_hash || '\",\"parser_version\":\"" + P.parser_version +
            "\",\"locator\":\"' || CASE WHEN first = last THEN first ELSE first || '..' || last END || '\"'")
    more = "CASE WHEN author IS NULL THEN '' ELSE ',\"author\":\"' || author || '\"' END || CASE WHEN original_date IS NULL THEN '' ELSE ',\"original_date\":\"' || original_date || '\"' END"
    return ("'{\"scope\":\"" + SCOPE + "\",\"source_key\":\"' || source_key || '\",\"source_type\":\"document\",\"processing_policy\":\"archive\",\"source_metadata\":' || "
            + lead + " || " + more + " || '},\"messages\":[' || texts || ']}'")


KEYED = f"""{packed_sql(P)}, json AS (SELECT w.doc_id, w.batch, string_agg(CAST(json_object('id', s.id, 'role', s.role, 'text', s.text, 'source_title', s.name) AS VARCHAR), ','
    ORDER BY s.ordinal) AS texts FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.ordinal = w.ordinal GROUP BY w.doc_id, w.batch),
  full_batches AS (SELECT b.*, k.author, k.original_date, texts, {KEY.replace('stable_id', 'b.stable_id').replace('version_hash', 'b.version_hash')} || '#p' ||
    lpad(CAST(b.batch + 1 AS VARCHAR), 4, '0') AS source_key FROM batches b JOIN json j ON j.doc_id = b.doc_id AND j.batch = b.batch JOIN keyed k ON k.doc_id = b.doc_id),
  digested AS (SELECT doc_id, rel, stable_id, source_key, {payload_sql()} AS payload FROM full_batches)"""
add("payload_digests", lambda s, d: batches(s, d, P).select("source_key", "payload_digest", F.octet_length("payload_json").alias("payload_bytes")),
    over("RECURSIVE " + KEYED, "SELECT source_key, sha256(payload) AS payload_digest, strlen(payload) AS payload_bytes FROM digested"))


def sent_lines(s, d):
    """Batches written as lines of text and read back."""
    path = scratch_dir(s, "batches") + "/lines"
    sinks.write_batches(batches(s, d, P), path)
    return s.read.text(path).select(F.sha2("value", 256).alias("payload_digest"), F.octet_length("value").alias("payload_bytes"))


add("batch_sink", sent_lines, over("RECURSIVE " + KEYED, "SELECT sha256(payload) AS payload_digest, strlen(payload) AS payload_bytes FROM digested"))
add("stream_export", run_export,
    over("RECURSIVE " + KEYED,
         f"SELECT 'pending' AS stage, stable_id, source_key, sha256(payload) AS payload_digest FROM digested WHERE {EXPORTED} "
         f"UNION ALL SELECT 'removed', stable_id, '', NULL FROM ided WHERE contains(rel, '/archive/') "
         f"UNION ALL SELECT CASE WHEN contains(rel, 'secret') THEN 'read:denied' WHEN fault = 'message-empty' THEN 'payload:message-empty' ELSE 'read:' || fault END, "
         f"stable_id, '', NULL FROM (SELECT *, {FAULT_SQL} AS fault FROM ided) WHERE NOT contains(rel, '/archive/') AND (contains(rel, 'secret') OR fault IS NOT NULL)"))


# The cursor stops in front of the first scan with a document that could not be sent.
def held(s, d):
    rows, _ = faulty(s, d)
    feed = rows.withColumn("scan_id", F.col("doc_id") + 10)
    failed = feed.where("fault = 'missing'").select(keys.stable_id(F.col("root"), F.col("rel")).alias("stable_id"))
    return jobs.held_cursor(feed, failed)


add("held_cursor", held, f"SELECT least(max(doc_id) + 10, min(doc_id) FILTER (({FAULT_SQL}) = 'missing') + 9) AS cursor FROM documents")
