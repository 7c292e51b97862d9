"""Registered queries over the judgment log, projects and snapshots, each with its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfmark.operators import claims, projects, rollup, settings, snapshot, summaries
from shelfmark.plans import frames as fr
from shelfmark.plans.base_sql import CLAIMS, LISTING, SCAN_RUNS, SNAPSHOTS, P, on_claims, over
from shelfmark.plans.registry import ORACLES, add
from shelfmark.session import scratch_dir, store
from shelfmark.sources.sinks import append_claims, append_scan_runs
from shelfmark.sources.snapshots import SnapshotTable, relist, start_refresh
from shelfmark.policy import RETRACT, VERDICTS

COLS = ", ".join(claims.COLUMNS)
log = fr.claims

# -- judgments ------------------------------------------------------------------------------------

# Events with something wrong now and then, by their value.
FLAWS = {
    "holder": "CASE WHEN value < 1 THEN ' ' ELSE holder END",
    "kind": "CASE WHEN value BETWEEN 1 AND 2 THEN 'rumour' ELSE kind END",
    "authority": "CASE WHEN value BETWEEN 2 AND 4 THEN 'L1' WHEN value BETWEEN 4 AND 5 THEN 'L9' ELSE authority END",
    "verdict": "CASE WHEN value BETWEEN 5 AND 7 THEN '保留' WHEN value BETWEEN 7 AND 8 THEN 'maybe' ELSE verdict END",
}
KEPT = ", ".join(f"{FLAWS.get(c, c)} AS {c}" for c in claims.COLUMNS)
REJECTED = """CASE WHEN trim(holder) = '' THEN 'missing:holder'
  WHEN kind NOT IN ('event', 'material', 'fact', 'judgment', 'consequence') THEN 'unknown:kind'
  WHEN authority NOT IN ('L0', 'L1', 'L2') THEN 'unknown:authority'
  WHEN actor_type = 'machine' AND authority <> 'L0' THEN 'machine-above-L0'
  WHEN coalesce(verdict, '') <> '' AND actor_type <> 'human' THEN 'verdict-needs-human'
  WHEN coalesce(verdict, '') <> '' AND verdict NOT IN ('保留', '待看', '可归档', '可清理', '撤回') THEN 'unknown:verdict' END"""


def flawed(s, d):
    return fr.claims_from(fr.table(s, d, "events")).selectExpr(*[f"{FLAWS.get(c, c)} AS {c}" for c in claims.COLUMNS])


add("check_claims", lambda s, d: claims.check_claims(flawed(s, d)).select("id", "reject_reason"),
    on_claims(f"SELECT id, {REJECTED} AS reject_reason FROM (SELECT {KEPT} FROM claims)"))
add("append_claims_valid", lambda s, d: claims.validate_claims(flawed(s, d))[0],
    on_claims(f"SELECT {COLS} FROM (SELECT {KEPT} FROM claims) WHERE {REJECTED} IS NULL"))


def appended(s, d):
    """The events in two batches, appended to a log after validation; what the log then holds."""
    path = scratch_dir(s, "claims")
    for half in (0, 1):
        append_claims(flawed(s, d).where(F.col("ts") % 2 == half), path)
    return s.read.parquet(path).select(*claims.COLUMNS)


def refused(s, d):
    return append_claims(flawed(s, d), scratch_dir(s, "claims")).select("id", "reject_reason")


add("append_claims", appended, ORACLES["append_claims_valid"])
add("append_claims_refused", refused, on_claims(f"SELECT * FROM (SELECT id, {REJECTED} AS reject_reason FROM (SELECT {KEPT} FROM claims)) WHERE reject_reason IS NOT NULL"))
add("current_claims", lambda s, d: claims.current_claims(log(s, d)), on_claims(f"SELECT {COLS} FROM current"))
add("current_claims_by_verdict", lambda s, d: claims.current_claims(log(s, d)).where(F.col("verdict") == VERDICTS[0]),
    on_claims(f"SELECT {COLS} FROM current WHERE verdict = '{VERDICTS[0]}'"))
add("current_claims_human_only", lambda s, d: claims.current_claims(log(s, d), human_only=True),
    over(f"{CLAIMS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ts DESC, id DESC) AS rn FROM claims "
         f"WHERE actor_type = 'human')", f"SELECT {COLS} FROM ranked WHERE rn = 1 AND verdict IS DISTINCT FROM '{RETRACT}'"))
SINCE = 1_705_276_800_000
add("list_claims", lambda s, d: claims.list_claims(log(s, d), actor_type="human", verdict=VERDICTS[1], since_ms=SINCE, limit=500),
    on_claims(f"SELECT {COLS} FROM claims WHERE actor_type = 'human' AND verdict = '{VERDICTS[1]}' AND ts >= {SINCE // 1000} "
              f"ORDER BY ts DESC, id DESC LIMIT 500"))
add("list_claims_total", lambda s, d: claims.list_claims_total(log(s, d), actor_type="human", verdict=VERDICTS[1], since_ms=SINCE),
    on_claims(f"SELECT count(*) AS total, least(count(*), 500) AS shown FROM claims WHERE actor_type = 'human' AND "
              f"verdict = '{VERDICTS[1]}' AND ts >= {SINCE // 1000}"))
add("claim_history", lambda s, d: claims.history(log(s, d), "user-8"), on_claims(f"SELECT {COLS} FROM claims WHERE target = 'user-8'"))
add("claims_summary", lambda s, d: claims.claims_summary(log(s, d)),
    on_claims("SELECT (SELECT count(*) FROM claims) AS events, count(*) AS current_targets, " + ", ".join(
        f"count(*) FILTER (WHERE verdict = '{v}') AS verdict_{i}" for i, v in enumerate(VERDICTS)) +
        ", count(*) FILTER (WHERE verdict IS NULL) AS unjudged, (SELECT count(*) FROM claims WHERE actor_type = 'machine') AS machine_notes, "
        "(SELECT count(*) FROM claims WHERE actor_type <> 'machine') AS human_claims, (SELECT count(DISTINCT target) FROM claims WHERE "
        f"verdict = '{RETRACT}') AS retracted_targets FROM current"))
NOTES = (f"SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ts DESC, id DESC) AS rn FROM claims WHERE "
         f"actor_type = 'machine' AND authority = 'L0') WHERE rn = 1")
add("newest_machine_notes", lambda s, d: claims.newest_machine_notes(log(s, d)), on_claims(NOTES))
add("pending_notes", lambda s, d: claims.pending_notes(log(s, d)),
    on_claims(f"SELECT n.* FROM ({NOTES}) n LEFT JOIN current c USING (target) WHERE c.target IS NULL OR c.actor_type = 'machine'"))


def users(s, d):
    return fr.table(s, d, "customer").select(F.concat(F.lit("user-"), "c_custkey").alias("top_dir"))


add("judged_progress", lambda s, d: claims.judged_progress(users(s, d), claims.current_claims(log(s, d))),
    on_claims("""SELECT *, targets - judged AS remaining, round(judged / targets, 6) AS fraction FROM (SELECT count(*) AS targets,
      count(*) FILTER (WHERE target IN (SELECT target FROM current WHERE verdict IS NOT NULL)) AS judged
      FROM (SELECT DISTINCT concat('user-', c_custkey) AS target FROM customer))"""))


def after_new_events(s, d):
    """Every user with a purchase is kept, every one with an error is noted, then the state is read again."""
    events = fr.table(s, d, "events")
    seen = events.groupBy("user_id").agg(F.max("event_id").alias("last"), F.max(F.col("event_type") == "error").alias("bad"))
    base = F.lit(1_000_000_000)
    rows = lambda df, shift: df.select(
        F.concat(F.lit("user-"), "user_id").alias("target"), F.lit("file").alias("target_type"),
        (base + F.col("user_id") * 2 + shift).alias("id"))
    kept = claims.judge(rows(seen.where(~F.col("bad") | (F.col("last") > 0)), 0), VERDICTS[0], "someone", P)
    noted = claims.annotate(rows(seen.where("bad"), 1), "had an error", P)
    return claims.current_claims(log(s, d).unionByName(kept).unionByName(noted)).select(
        "target", "verdict", "signed_by", "authority", "source_ref")


add("judge_and_annotate", after_new_events,
    """SELECT concat('user-', user_id) AS target, CASE WHEN bad THEN NULL ELSE '保留' END AS verdict,
      CASE WHEN bad THEN 'policy:corpus-agent' ELSE 'someone' END AS signed_by, CASE WHEN bad THEN 'L0' ELSE 'L1' END AS authority,
      concat('vault://file/user-', user_id) AS source_ref FROM (SELECT user_id, bool_or(event_type = 'error') AS bad FROM events GROUP BY user_id)""")


def after_retraction(s, d):
    """Whoever is kept now is taken back; nothing older may come to light for them."""
    kept = claims.current_claims(log(s, d)).where(F.col("verdict") == VERDICTS[0])
    taken = claims.retract(kept.select("target", "target_type", (F.col("id") + 1_000_000_000).alias("id")), "someone", P)
    return claims.current_claims(log(s, d).unionByName(taken)).select("target", "id")


add("retract_kept", after_retraction,
    on_claims(f"SELECT target, id FROM current WHERE verdict IS DISTINCT FROM '{VERDICTS[0]}'"))

# -- projects -------------------------------------------------------------------------------------

ASKED = {"ring": "ring", "exact": "red widget", "brand": "Brand#17", "id": "P12", "wide": "the blue bolt of old"}


def project_score(q: str) -> str:
    return f"""CASE WHEN lower(id) = '{q}' THEN 100 WHEN contains(lower(id), '{q}') THEN 40 ELSE 0 END
      + CASE WHEN lower(name) = '{q}' THEN 90 WHEN contains(lower(name), '{q}') THEN 45 WHEN length(name) >= 2 AND contains('{q}', lower(name)) THEN 30
        ELSE 0 END + CASE WHEN contains(lower(domain), '{q}') OR contains('{q}', lower(domain)) THEN 35 ELSE 0 END
      + CASE WHEN contains(lower(repo), '{q}') THEN 30 ELSE 0 END + CASE WHEN contains(lower(grp), '{q}') THEN 12 ELSE 0 END
      + CASE WHEN contains(lower(note), '{q}') THEN 8 ELSE 0 END"""


PROJECTS = """projects AS (SELECT concat('P', p_partkey) AS id, p_name AS name, p_brand AS grp, concat('size ', p_size) AS note,
  concat(replace(p_name, ' ', '-'), '.example.com') AS domain, concat('repo/', p_brand) AS repo FROM part)"""
add("match_ledger", lambda s, d: projects.match_ledger(fr.projects(s, d), ASKED).select("query", "id", "name", "score"),
    over(PROJECTS, "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{k}' AS query, id, name, CAST({project_score(q.lower())} AS BIGINT) AS score FROM projects" for k, q in ASKED.items()) +
        ") WHERE score > 0"))
WHY = lambda q: f"""concat_ws('|', CASE WHEN lower(id) = '{q}' THEN 'id' WHEN contains(lower(id), '{q}') THEN 'id part' END,
  CASE WHEN lower(name) = '{q}' THEN 'name' WHEN contains(lower(name), '{q}') THEN 'name part' WHEN length(name) >= 2 AND contains('{q}', lower(name)) THEN 'in query' END,
  CASE WHEN contains(lower(domain), '{q}') OR contains('{q}', lower(domain)) THEN 'domain' END, CASE WHEN contains(lower(repo), '{q}') THEN 'repository' END,
  CASE WHEN contains(lower(grp), '{q}') THEN 'group' END, CASE WHEN contains(lower(note), '{q}') THEN 'note' END)"""
add("ledger_grounds", lambda s, d: projects.match_ledger(fr.projects(s, d), ASKED).select("query", "id", "why"),
    over(PROJECTS, "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS query, id, {WHY(q.lower())} AS why FROM projects" for k, q in ASKED.items()) + ") WHERE why <> ''"))
add("projects_by_group", lambda s, d: projects.projects_by_group(fr.projects(s, d), P),
    over(PROJECTS, 'SELECT grp AS "group", count(*) OVER (PARTITION BY grp) AS projects, id, name FROM projects'))
# A ledger of the corpus itself: its languages. Folders of the corpus answer besides.
FOLDERS = {"releases": "releases", "french": "fr", "notes": "notes", "english": "en"}


def languages(s, d):
    none = F.array().cast("array<string>")
    return fr.table(s, d, "documents").select(F.col("lang").alias("id")).distinct().select(
        F.col("id"), F.concat(F.lit("language "), "id").alias("name"), F.lit("languages").alias("group"),
        F.lit(None).cast("string").alias("kind"), none.alias("domains"), none.alias("repositories"),
        F.lit("").alias("note"), none.alias("routes"))


FIND = f"""{LISTING}, langs AS (SELECT DISTINCT lang AS id, 'language ' || lang AS name, 'languages' AS grp FROM documents),
  hits AS ({' UNION ALL '.join(f"SELECT '{k}' AS query, id, name, CASE WHEN id = '{q}' THEN 100 WHEN contains(id, '{q}') THEN 40 ELSE 0 END + "
                               f"CASE WHEN contains(name, '{q}') THEN 45 ELSE 0 END + CASE WHEN contains(grp, '{q}') THEN 12 ELSE 0 END AS score FROM langs"
                               for k, q in FOLDERS.items())}),
  found AS (SELECT * FROM hits WHERE score > 0),
  chain AS (SELECT DISTINCT array_to_string(parts[1:n], '/') AS folder, parts[n] AS segment FROM (SELECT parts, unnest(generate_series(1, len(parts) - 1)) AS n
    FROM (SELECT string_split(rel, '/') AS parts FROM meta WHERE NOT gone AND root = '/vault/src0'))),
  asked AS ({' UNION ALL '.join(f"SELECT '{k}' AS query, * FROM chain WHERE contains(lower(segment), '{q}')" for k, q in FOLDERS.items())}),
  owned AS (SELECT a.*, (SELECT arg_min(f.id, lpad(CAST(1000 - f.score AS VARCHAR), 5, '0') || f.id) FROM found f WHERE f.query = a.query AND
    (contains(a.folder, f.id) OR contains(a.segment, f.name))) AS owner FROM asked a),
  answers AS (SELECT f.query, f.id, f.name, f.score + 15 * coalesce(n, 0) AS score, folder, 'ledger' AS source FROM found f LEFT JOIN
      (SELECT query, owner, count(*) AS n, min(folder) AS folder FROM owned WHERE owner IS NOT NULL GROUP BY ALL) o ON o.query = f.query AND o.owner = f.id
    UNION ALL SELECT query, '', regexp_replace(segment, '^[A-Za-z]+\\d+[-_]', ''), 20, folder, 'folder' FROM owned WHERE owner IS NULL)"""
add("find_project", lambda s, d: projects.find_project(languages(s, d), fr.metadata(s, d), FOLDERS, P),
    over(FIND, "SELECT query, id, name, score, folder, source, rank, CAST(NULL AS VARCHAR) AS card_path FROM (SELECT *, row_number() OVER (PARTITION BY "
               "query ORDER BY score DESC, source DESC, id, name, folder) AS rank FROM answers) WHERE rank <= 8"))



def with_cards(s, d):
    """The corpus with a card for the languages English and French."""
    cards = languages(s, d).where("id IN ('en', 'fr')").select(
        F.lit("/vault/src0").alias("root"), F.concat(F.lit("/vault/src0/cards/"), "id", F.lit(".md")).alias("path"),
        F.concat(F.lit("cards/"), "id", F.lit(".md")).alias("rel"), F.lit(False).alias("gone"))
    return fr.metadata(s, d).select(*cards.columns).unionByName(cards)


add("project_cards", lambda s, d: projects.with_cards(languages(s, d).select("id", "name"), with_cards(s, d), P),
    "SELECT DISTINCT lang AS id, 'language ' || lang AS name, CASE WHEN lang IN ('en', 'fr') THEN '/vault/src0/cards/' || lang || '.md' END AS card_path FROM documents")

# -- snapshots ------------------------------------------------------------------------------------


def both(s, d):
    return fr.snapshots(s, d)


add("classify_snapshot", lambda s, d: snapshot.classify_snapshot(*both(s, d), listed=P.root_paths), over(SNAPSHOTS, "SELECT path, root, action FROM actions"))
MERGED = """SELECT coalesce(c.root, p.root) AS root, a.path, coalesce(c.rel, p.rel) AS rel, coalesce(c.size, p.size) AS size,
  coalesce(c.mtime_ms, p.mtime_ms) AS mtime_ms, a.action, a.action IN ('removed', 'gone') AS gone,
  CASE WHEN a.action IN ('gone', 'kept') THEN p.scan_id ELSE 2000 END AS scan_id
  FROM actions a LEFT JOIN prev p ON p.path = a.path LEFT JOIN cur c ON c.path = a.path"""
merged = lambda s, d: snapshot.merge_snapshot(*both(s, d), 2000, listed=P.root_paths)
add("merge_snapshot", lambda s, d: merged(s, d).select("root", "path", "rel", "size", "mtime_ms", "action", "gone", "scan_id"), over(SNAPSHOTS, MERGED))
N = lambda *a: "count(*) FILTER (WHERE action IN (" + ", ".join(f"'{x}'" for x in a) + "))"
add("scan_run_stats", lambda s, d: snapshot.scan_run_stats(snapshot.classify_snapshot(*both(s, d), listed=P.root_paths)),
    over(SNAPSHOTS, f"SELECT root, {N('reused', 'updated', 'added')} AS files_seen, {N('added')} AS files_added, {N('updated')} AS files_updated, "
                    f"{N('reused')} AS files_reused, {N('removed')} AS files_removed FROM actions GROUP BY root"))
add("scan_run_record",
    lambda s, d: snapshot.scan_run_record(snapshot.classify_snapshot(*both(s, d), listed=P.root_paths), rollup.latest_scan_runs(fr.scan_runs(s, d)), 7, 1_000, 4_500),
    over(f"{SNAPSHOTS}, {SCAN_RUNS}", f"""SELECT 7 AS run_id, root, 1000 AS started_ms, 4500 AS finished_ms, files_seen, files_added, files_updated, files_removed, coalesce(dirs_seen, 0) AS dirs_seen,
      coalesce(skipped_dirs, 0) AS skipped_dirs, coalesce(errors, 0) AS errors, 3500 AS elapsed_ms, coalesce(errors, 0) = 0 AS ok, CASE WHEN errors > 0 THEN errors || ' entries could not be read' END AS detail
      FROM (SELECT root, {N('reused', 'updated', 'added')} AS files_seen, {N('added')} AS files_added, {N('updated')} AS files_updated, {N('removed')} AS files_removed FROM actions GROUP BY root)
      LEFT JOIN (SELECT root, dirs_seen, skipped_dirs, errors FROM scan_runs QUALIFY row_number() OVER (PARTITION BY root ORDER BY run_id DESC) = 1) USING (root)"""))
add("merge_unchanged", lambda s, d: snapshot.scan_run_stats(snapshot.classify_snapshot(both(s, d)[0], both(s, d)[0].drop("gone", "scan_id"), P.root_paths)),
    over(SNAPSHOTS, "SELECT root, count(*) AS files_seen, CAST(0 AS BIGINT) AS files_added, CAST(0 AS BIGINT) AS files_updated, count(*) AS "
                    "files_reused, CAST(0 AS BIGINT) AS files_removed FROM prev GROUP BY root"))
add("vanished", lambda s, d: snapshot.vanished(*both(s, d), P.root_paths),
    over(SNAPSHOTS, "SELECT root, path, rel FROM prev WHERE NOT gone AND root IN (SELECT root FROM cur) AND path NOT IN (SELECT path FROM cur)"))
add("unlisted_roots", lambda s, d: snapshot.unlisted_roots(both(s, d)[0], [r for r in P.root_paths if r != "/vault/src3"]),
    over(SNAPSHOTS, "SELECT root, count(*) AS files FROM prev WHERE NOT gone AND root = '/vault/src3' GROUP BY root"))
FIELDS = ("size", "mtime_ms", "kind", "name", "ext", "is_text", "denied")
add("diff_snapshots", lambda s, d: snapshot.diff_snapshots(*both(s, d), "path", FIELDS),
    over(SNAPSHOTS, " UNION ALL ".join(
        f"SELECT p.path, '{f}' AS field, CAST(p.{f} AS VARCHAR) AS in_a, CAST(c.{f} AS VARCHAR) AS in_b FROM prev p JOIN cur c ON p.path = c.path "
        f"WHERE p.{f} IS DISTINCT FROM c.{f}" for f in FIELDS) +
        " UNION ALL SELECT path, 'only-in-a', NULL, NULL FROM prev WHERE path NOT IN (SELECT path FROM cur)"
        " UNION ALL SELECT path, 'only-in-b', NULL, NULL FROM cur WHERE path NOT IN (SELECT path FROM prev)"))




# -- stored snapshots: the same results from bucketed versions and their digests


def stored(s, d):
    """The two listings as versions 0 and 1 of a stored snapshot."""
    prev, cur = both(s, d)
    table = SnapshotTable(s, f"snapshot_{uuid.uuid4().hex}", scratch_dir(s, "snapshots"), buckets=8, slices=16)
    table.write(prev, 0)
    return table, cur


def two_stored(s, d):
    table, cur = stored(s, d)
    table.write(cur.withColumns({"gone": F.lit(False), "scan_id": F.lit(2000).cast("bigint")}), 1)
    return table


def merged_stored(s, d):
    table, cur = stored(s, d)
    return table, table.merge(cur, 0, 2000, P.root_paths)


add("merge_snapshot_stored", lambda s, d: merged_stored(s, d)[0].read(1).select("root", "path", "rel", "size", "mtime_ms", "gone", "scan_id"),
    over(SNAPSHOTS, f"SELECT * EXCLUDE (action) FROM ({MERGED})"))
def logged_run(s, d):
    """The scan as the merge counted it, appended to the log of scans; what the log then holds."""
    log_dir = scratch_dir(s, "scan-runs")
    append_scan_runs(snapshot.observed_run(s, merged_stored(s, d)[1], P.root_paths), log_dir)
    return s.read.parquet(log_dir)


add("scan_run_observed", logged_run, ORACLES["scan_run_stats"])
add("diff_snapshots_stored", lambda s, d: two_stored(s, d).diff(0, 1, FIELDS), ORACLES["diff_snapshots"])
SIDE = "SELECT root, top_dir, count(*) AS files, list(rel || '|' || size || '|' || mtime_ms || '|' || gone || '|' || h ORDER BY rel) AS held FROM ({}) GROUP BY root, top_dir"
add("changed_folders", lambda s, d: two_stored(s, d).changed_folders(0, 1),
    over(SNAPSHOTS + f""", a AS ({SIDE.format("SELECT *, sha256(text) AS h FROM prev")}),
      b AS ({SIDE.format("SELECT * EXCLUDE (gone), false AS gone, sha256(text || CASE WHEN lang = 'es' THEN '+' ELSE '' END) AS h FROM cur")})""",
         """SELECT coalesce(a.root, b.root) AS root, coalesce(a.top_dir, b.top_dir) AS top_dir, coalesce(a.files, 0) AS files_a, coalesce(b.files, 0) AS files_b
      FROM a FULL OUTER JOIN b ON a.root = b.root AND a.top_dir = b.top_dir WHERE a.held IS DISTINCT FROM b.held"""))


def kept_up(s, d):
    """The summary of the first version, kept up over the changes to the second."""
    table = two_stored(s, d)
    keys = summaries.keys_of()
    old = store(summaries.summarise(table.read(0), keys), "summary")
    return summaries.keep_up(old, table.changes(0, 1, ("root", "rel", "kind", "size", "mtime_ms", "gone")), table.read(1), keys)


NOW = "SELECT {} AS top_dir, root, kind, size, mtime_ms FROM cur".format("CASE WHEN contains(rel, '/') THEN string_split(rel, '/')[1] ELSE '' END")
KEPT_SUMS = "count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes"
add("kept_root_stats", lambda s, d: summaries.root_stats(kept_up(s, d)),
    over(SNAPSHOTS, f"SELECT root, {KEPT_SUMS}, max(mtime_ms) AS latest_ms FROM cur GROUP BY root"))
add("kept_top_dirs", lambda s, d: summaries.top_level_dirs(kept_up(s, d)),
    over(SNAPSHOTS, f"SELECT root, top_dir, {KEPT_SUMS}, max(mtime_ms) AS latest_ms FROM ({NOW}) GROUP BY root, top_dir"))
add("kept_kind_distribution", lambda s, d: summaries.kind_distribution(kept_up(s, d)),
    over(SNAPSHOTS, f"""SELECT CASE grouping(root, top_dir) WHEN 3 THEN 'corpus' WHEN 1 THEN 'root' ELSE 'top_dir' END AS grain, root, top_dir, kind, {KEPT_SUMS}
      FROM ({NOW}) GROUP BY GROUPING SETS ((kind), (root, kind), (root, top_dir, kind))"""))


def refreshed(s, d):
    """Changes as a stream of micro-batches merged into the stored snapshot, then a full listing that notices what vanished."""
    table, cur = stored(s, d)
    feed = scratch_dir(s, "refresh-feed")
    twice = cur.withColumn("scan_id", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")))).withColumn(
        "content_hash", F.when(F.col("scan_id") == 2, F.col("content_hash")).otherwise("outdated"))
    twice.repartition(3).write.parquet(feed)
    changes = s.readStream.schema(s.read.parquet(feed).schema).option("maxFilesPerTrigger", 2).parquet(feed)
    start_refresh(changes, table, scratch_dir(s, "refresh-checkpoint"), P.root_paths).awaitTermination()
    relist(table, cur.drop("content_hash"), 2000, P.root_paths)
    return table.read(table.current()).select("root", "path", "rel", "size", "mtime_ms", "gone")


add("stream_refresh_stored", refreshed, over(SNAPSHOTS, f"SELECT root, path, rel, size, mtime_ms, gone FROM ({MERGED})"))


def manifest(s, d):
    """Labelled documents as an allow-list."""
    rows = fr.listing(s, d).select("doc_id", "root", F.col("rel").alias("path")).join(fr.table(s, d, "labels"), "doc_id")
    return rows.select("root", "path", F.when(F.col("quality") == 1, "user").otherwise("external").alias("role"))


ALLOW = f"{LISTING}, allowed AS (SELECT m.*, CASE WHEN quality = 1 THEN 'user' ELSE 'external' END AS role FROM meta m JOIN labels USING (doc_id))"
FEED = "SELECT path, scan_id, CASE WHEN gone THEN 'removed' ELSE 'live' END AS change, role FROM allowed WHERE scan_id > 1001"
add("apply_allow_list", lambda s, d: snapshot.apply_allow_list(fr.metadata(s, d), manifest(s, d)).select("path", "role"),
    over(ALLOW, "SELECT path, role FROM allowed"))
add("change_feed", lambda s, d: snapshot.change_feed(fr.metadata(s, d), 1001, manifest(s, d)).select("path", "scan_id", "change", "role"),
    over(ALLOW, FEED))
add("next_cursor", lambda s, d: snapshot.next_cursor(snapshot.change_feed(fr.metadata(s, d), 1001), 1001),
    over(LISTING, "SELECT greatest(coalesce(max(scan_id), 1001), 1001) AS cursor FROM meta WHERE scan_id > 1001"))
add("latest_version",
    lambda s, d: snapshot.latest_version(both(s, d)[0].select("path", "size", "scan_id").unionByName(
        both(s, d)[1].select("path", "size", F.lit(5000).cast("bigint").alias("scan_id")))),
    over(SNAPSHOTS, "SELECT path, size, 5000 AS scan_id FROM cur UNION ALL SELECT path, size, scan_id FROM prev WHERE path NOT IN (SELECT path FROM cur)"))


# -- settings: every part has defaults and a patch of its own, nested three deep

BASE_JSON = """concat('{"caps":{"text":', p_size, ',"depth":24},"roots":["', p_brand, '"],"words":{"inbox":"', p_type, '","more":{"a":1,"b":[1,2]}}}')"""
PATCH_JSON = """CASE p_partkey % 4 WHEN 0 THEN concat('{"caps":{"text":', p_partkey, '},"roots":["x","y"]}') WHEN 1 THEN '{"words":{"more":{"b":[],"c":{"d":true}}},"caps":7}'
  WHEN 2 THEN concat('{"roots":{"main":"', p_brand, '"},"words":{"inbox":{"at":"', p_type, '"}}}') ELSE '{"words":{},"new":{}}' END"""


def nested(s, d):
    return fr.table(s, d, "part").selectExpr("p_partkey AS id", f"{BASE_JSON} AS base", f"{PATCH_JSON} AS patch")


def merged_settings(s, d):
    return settings.deep_merge(nested(s, d)).select("id", F.concat(F.lit("$."), F.array_join("path", ".")).alias("key"), "value")


add("deep_merge", merged_settings,
    f"""SELECT p_partkey AS id, replace(t.fullkey, '"', '') AS key, CAST(t.value AS VARCHAR) AS value FROM (SELECT p_partkey, json_merge_patch(CAST({BASE_JSON} AS JSON), CAST({PATCH_JSON} AS JSON)) AS j
      FROM part), json_tree(j) AS t WHERE NOT contains(t.fullkey, '[') AND (t.type <> 'OBJECT' OR CAST(t.value AS VARCHAR) = '{{}}')""")
add("deep_merge_documents", lambda s, d: settings.rebuild(settings.deep_merge(nested(s, d))).select(
        "id", F.get_json_object("document", "$.words.more").alias("more"), F.get_json_object("document", "$.caps").alias("caps"), F.get_json_object("document", "$.new").alias("new")),
    f"""SELECT p_partkey AS id, CAST(json_extract(j, '$.words.more') AS VARCHAR) AS more, CASE WHEN p_partkey % 4 = 1 THEN '7' ELSE '{{"depth":24,"text":' || CAST(json_extract(j, '$.caps.text') AS VARCHAR) || '}}' END AS caps,
      CAST(json_extract(j, '$.new') AS VARCHAR) AS new FROM (SELECT p_partkey, json_merge_patch(CAST({BASE_JSON} AS JSON), CAST({PATCH_JSON} AS JSON)) AS j FROM part)""")
