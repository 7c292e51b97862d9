"""Registered queries over the files table, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import dates, names, text
from shelfmark.operators import audit, discover, extract, gram_index, links, many_queries, ranking, rollup, search, triage
from shelfmark.operators.triage import (
    ASSET_EXTS, BINARY_EXTS, BUILD_DIRS, CHAT_WORDS, CONFIG_EXTS, DENSITY, DEPENDENCY_MARKERS, ENTRY_EXTS, ENTRY_WORDS,
    INSTALLER_EXTS, MAIL_EXTS, MEDIA_EXTS, MODEL_EXTS, PROSE_EXTS, SOURCE_EXTS, STRUCTURED_EXTS, VENDOR_DIRS,
    VENDOR_STEMS,
)
from shelfmark.plans import frames as fr
from shelfmark.plans.base_sql import FILES, LISTING, TITLE, SCAN_RUNS, P, clip, on_files, on_meta, over, squeeze, words
from shelfmark.plans.registry import add
from shelfmark.session import scratch_dir
from shelfmark.sources import documents
from shelfmark.policy import COVERAGE_LADDER, OPAQUE_EXTS, SANE_MTIME_MS, UBIQUITOUS_NAMES

LIVE = "NOT gone"
files, meta, body = fr.files, fr.metadata, fr.with_body

# -- search ---------------------------------------------------------------------------------------

QUERY = "the was"
FIELDS = {"name": 40, "rel": 18, "title": 16, "headings": 10, "body": 5}
LABEL = {"name": "name", "rel": "path", "title": "title", "headings": "heading", "body": "body"}


def has(field: str, term: str) -> str:
    return f"contains(lower({field}), '{term}')"


def match_sql(query: str, fields=tuple(FIELDS)) -> str:
    return " AND ".join("(" + " OR ".join(has(f, t) for f in fields) + ")" for t in query.split())


def score_sql(query: str, fields=tuple(FIELDS)) -> str:
    return " + ".join(f"(CASE WHEN {has(f, t)} THEN {FIELDS[f]} ELSE 0 END)" for t in query.split() for f in fields)


def matched_sql(query: str) -> str:
    one = ["CASE " + " ".join(f"WHEN {has(f, t)} THEN '{LABEL[f]}'" for f in FIELDS) + " END" for t in query.split()]
    first = one[0]
    rest = f", CASE WHEN {one[1]} IS DISTINCT FROM {one[0]} THEN {one[1]} END" if len(one) > 1 else ""
    return f"concat_ws(',', {first}{rest})"


def snippet_sql(query: str) -> str:
    cases = []
    for t in query.split():
        at = f"instr(lower(body), '{t}')"
        start, end = f"greatest({at} - 60, 1)", f"least({at} - 1 + {len(t)} + 90, length(body))"
        cases.append(
            f"WHEN {at} > 0 THEN concat(CASE WHEN {start} > 1 THEN '…' ELSE '' END, "
            f"{squeeze(f'substr(body, {start}, {end} - {start} + 1)')}, "
            f"CASE WHEN {end} < length(body) THEN '…' ELSE '' END)")
    fallback = " ".join(
        f"WHEN {squeeze(c)} <> '' THEN {clip(squeeze(c), 150)}" for c in ("headings", "title"))
    return f"CASE {' '.join(cases)} {fallback} ELSE {clip(squeeze('body'), 150)} END"


HIT = "path, root, rel, name, kind, ext, size, mtime_ms"
SHOWN = "NOT gone AND NOT denied"


def search_sql(query: str, where: str, order: str, limit: int, fields=tuple(FIELDS)) -> str:
    return on_files(
        f"SELECT {HIT}, {squeeze('title')} AS title, CAST({score_sql(query, fields)} AS BIGINT) AS score, "
        f"{matched_sql(query)} AS matched_in, {snippet_sql(query)} AS snippet FROM files "
        f"WHERE {SHOWN} AND {where} AND {match_sql(query, fields)} ORDER BY {order} LIMIT {limit}")


def by_score(query, fields=tuple(FIELDS)):
    return f"{score_sql(query, fields)} DESC, mtime_ms DESC, path"


add("search_files", lambda s, d: search.search_files(files(s, d), QUERY, P),
    search_sql(QUERY, "true", by_score(QUERY), 20))
add("search_files_name_scope", lambda s, d: search.search_files(files(s, d), "report final", P, scope="name",
                                                               sort="recent", limit=50),
    search_sql("report final", "true", "mtime_ms DESC, path", 50, ("name", "rel")))
add("search_files_content_filtered",
    lambda s, d: search.search_files(files(s, d), "de la", P, scope="content", kind="doc,web", ext="md html",
                                     since="400d", min_size=200, path_prefix="fr", limit=200, sort="size"),
    search_sql("de la", f"kind IN ('doc', 'web') AND ext IN ('.md', '.html') AND size >= 200 AND "
                        f"mtime_ms >= {P.cutoff_ms(400)} AND rel LIKE 'fr/%'", "size DESC, path", 200,
               ("title", "headings", "body")))
add("search_files_by_root",
    lambda s, d: search.search_files(files(s, d), "in", P, root=["src1", "/vault/src2"], sort="oldest",
                                     before="2025-06-30", max_size=5000, limit=100),
    search_sql("in", "root IN ('/vault/src1', '/vault/src2') AND size <= 5000 AND mtime_ms <= "
                     "epoch_ms(TIMESTAMP '2025-06-30')", "mtime_ms, path", 100))
add("search_total", lambda s, d: search.search_total(files(s, d), QUERY, P),
    on_files(f"SELECT count(*) AS total, count(*) > 20 AS has_more FROM files WHERE {SHOWN} AND {match_sql(QUERY)}"))
SEVEN = "the of and in to a is"
add("search_seven_terms", lambda s, d: search.search_matches(files(s, d), SEVEN, P).select("path", "score"),
    on_files(f"SELECT path, CAST({score_sql(SEVEN)} AS BIGINT) AS score FROM files WHERE {SHOWN} AND {match_sql(SEVEN)}"))
MANY = {"english": "the was", "german": "der und", "french": "de la", "reports": "report final", "wide": "a"}
add("search_many", lambda s, d: search.search_many(files(s, d), MANY, P, 10),
    on_files("SELECT query, rank, path, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY "
             "score DESC, mtime_ms DESC, path) AS rank FROM (" + " UNION ALL ".join(
                 f"SELECT '{k}' AS query, path, mtime_ms, CAST({score_sql(q)} AS BIGINT) AS score FROM files "
                 f"WHERE {SHOWN} AND {match_sql(q)}" for k, q in MANY.items()) + ")) WHERE rank <= 10"))


# The same searches over a stored index. The common query is answered by a scan, the others by candidates.
def indexed(s, d, **settings):
    return gram_index.GramIndex.build(files(s, d), scratch_dir(s, "gram-index"), rows_per_block=1 << 12, **settings)


RARE, SHORT = "thint ouea", "ß 5"
add("search_files_indexed", lambda s, d: indexed(s, d).search_files(RARE, P, limit=50), search_sql(RARE, "true", by_score(RARE), 50))
add("search_files_indexed_common", lambda s, d: indexed(s, d, broadcast_rows=10).search_files(QUERY, P), search_sql(QUERY, "true", by_score(QUERY), 20))
add("search_files_indexed_short", lambda s, d: indexed(s, d).search_files(SHORT, P, limit=200), search_sql(SHORT, "true", by_score(SHORT), 200))
add("search_total_indexed", lambda s, d: indexed(s, d).search_total(RARE, P),
    on_files(f"SELECT count(*) AS total, count(*) > 20 AS has_more FROM files WHERE {SHOWN} AND {match_sql(RARE)}"))


def asked(s, d):
    """A query for every document: the second and the fifth of its words in lower case of four letters or more."""
    # Up to the word that is asked for and no further; what was read is not tried again.
    word = lambda n: F.nullif(F.regexp_extract("text", f"(?s)^(?>.*?[a-z]{{4,}}+){{{n - 1}}}(?>.*?([a-z]{{4,}}+))", 1), F.lit(""))
    return fr.table(s, d, "documents").select(F.col("doc_id").alias("query"), F.concat_ws(" ", word(2), word(5)).alias("text"))


add("search_table", lambda s, d: many_queries.search_table(files(s, d), asked(s, d), P, 5),
    over(FILES + f""", low AS MATERIALIZED (SELECT path, mtime_ms, lower(name) AS name, lower(rel) AS rel, lower(title) AS title, lower(headings) AS headings, lower(body) AS body
      FROM files WHERE {SHOWN}), asked AS (SELECT doc_id AS query, list_distinct(list_filter([w[2], w[5]], lambda x: x IS NOT NULL)) AS terms
      FROM (SELECT doc_id, regexp_extract_all(text, '[a-z]{{4,}}') AS w FROM documents)), terms AS (SELECT DISTINCT unnest(terms) AS t FROM asked),
    hits AS MATERIALIZED (SELECT t, path, mtime_ms, s FROM (SELECT t, path, mtime_ms, """ + " + ".join(
        f"(CASE WHEN contains({f}, t) THEN {w} ELSE 0 END)" for f, w in FIELDS.items()) + """ AS s FROM terms, low) WHERE s > 0),
    found AS (SELECT query, path, mtime_ms, sum(s) AS score FROM (SELECT query, len(terms) AS n, unnest(terms) AS t FROM asked) q JOIN hits USING (t)
      GROUP BY query, n, path, mtime_ms HAVING count(*) = n)""",
    """SELECT query, rank, path, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, mtime_ms DESC, path) AS rank FROM found)
    WHERE rank <= 5"""))
AGE = f"({P.as_of_ms} - mtime_ms) / 86400000.0"
add("recency_boost",
    lambda s, d: search.recency_boost(search.search_files(files(s, d), QUERY, P, limit=100), P)
    .select("path", "score"),
    on_files(f"SELECT path, score + CASE WHEN {AGE} <= 7 THEN 6 WHEN {AGE} <= 30 THEN 3 WHEN {AGE} <= 90 THEN 1 "
             f"ELSE 0 END AS score FROM (SELECT path, mtime_ms, CAST({score_sql(QUERY)} AS BIGINT) AS score FROM files "
             f"WHERE {SHOWN} AND {match_sql(QUERY)} ORDER BY {by_score(QUERY)} LIMIT 100)"))


def keyword_sql(q: str, where: str) -> str:
    name, bod, rel = (has(f, q) for f in ("name", "body", "rel"))
    at = f"instr(lower(body), '{q}')"
    score = f"(CASE WHEN {name} THEN 100 ELSE 0 END + CASE WHEN {bod} THEN 40 ELSE 0 END + CASE WHEN {rel} THEN 20 ELSE 0 END)"
    return on_meta(
        f"SELECT path, rel, name, kind, size, mtime_ms, CAST({score} AS BIGINT) AS score, CASE WHEN {name} THEN 'name' "
        f"WHEN {bod} THEN 'body' WHEN {rel} THEN 'path' END AS matched_in, "
        f"CAST((length(body) - length(replace(lower(body), '{q}', ''))) // {len(q)} AS BIGINT) AS hit_count, "
        f"CASE WHEN {at} > 0 THEN substr(body, greatest({at} - 70, 1), 200) WHEN body_chars > 0 THEN "
        f"'found in the name or path, not in the body' ELSE 'no body (' || kind || '); found by name or path' END AS snippet "
        f"FROM meta WHERE {LIVE} AND {where} AND ({name} OR {bod} OR {rel})")


add("search_keyword", lambda s, d: search.search_keyword(body(s, d), "the", P), keyword_sql("the", "true"))
add("search_keyword_indexed", lambda s, d: indexed(s, d).search_keyword("tion the", P), keyword_sql("tion the", "true"))
add("search_keyword_filtered",
    lambda s, d: search.search_keyword(body(s, d), "readme", P, kinds=["doc", "web"], top_dir="en", since_days=700),
    keyword_sql("readme", f"kind IN ('doc', 'web') AND rel LIKE 'en/%' AND mtime_ms > {P.cutoff_ms(700)}"))
add("search_simple", lambda s, d: search.search_simple(body(s, d), "wechat"),
    on_meta(f"SELECT path, rel, name, kind, size, mtime_ms, {has('name', 'wechat')} AS name_hit FROM meta WHERE {LIVE} "
            f"AND ({has('name', 'wechat')} OR {has('rel', 'wechat')} OR {has('body', 'wechat')})"))
add("text_assets", lambda s, d: search.text_assets(body(s, d)),
    on_meta(f"SELECT path, rel, name, kind, size, mtime_ms, substr(body, 1, 4000) AS preview, body_chars, "
            f"false AS truncated FROM meta WHERE {LIVE} AND is_text AND body_chars > 0"))
add("all_files", lambda s, d: search.all_files(meta(s, d)),
    on_meta(f"SELECT path, rel, name, ext, kind, size, mtime_ms, body_chars FROM meta WHERE {LIVE}"))
add("recent_files", lambda s, d: search.recent_files(meta(s, d)),
    on_meta(f"SELECT path, rel, name, kind, size, mtime_ms FROM meta WHERE {LIVE} AND mtime_ms > {SANE_MTIME_MS} "
            f"ORDER BY mtime_ms DESC, path LIMIT 12"))
add("files_in", lambda s, d: search.files_in(meta(s, d), "inbox"),
    on_meta(f"SELECT path, rel, name, kind, size, mtime_ms FROM meta WHERE {LIVE} AND rel LIKE 'inbox/%'"))
add("files_in_loose", lambda s, d: search.files_in(meta(s, d), "", by="rel"),
    on_meta(f"SELECT path, rel, name, kind, size, mtime_ms FROM meta WHERE {LIVE} AND NOT contains(rel, '/')"))
LISTED = f"{LIVE} AND mtime_ms >= {P.cutoff_ms(200)} AND rel LIKE 'en/%' AND len(string_split(rel, '/')) - 1 <= 2"
add("list_files", lambda s, d: search.list_files(files(s, d), P, path_prefix="en", since="200d", max_depth=2),
    on_files(f"SELECT path, root, rel, name, ext, kind, size, mtime_ms, {squeeze('title')} AS title FROM files "
             f"WHERE {LISTED} ORDER BY mtime_ms DESC, path LIMIT 50"))
add("list_files_total", lambda s, d: search.list_files_total(meta(s, d), P, path_prefix="en", since="200d", max_depth=2),
    on_meta(f"SELECT count(*) AS total FROM meta WHERE {LISTED}"))
add("count_denied", lambda s, d: search.count_denied(meta(s, d), P, name_like="SECRET"),
    on_meta(f"SELECT count(*) AS denied_files FROM meta WHERE {LIVE} AND denied AND (contains(lower(name), 'secret') "
            f"OR contains(lower(rel), 'secret'))"))
add("filter_files", lambda s, d: search.filter_files(meta(s, d), P, kind="sheet data", include_denied=True,
                                                     since="2024-06-01", max_size=3000).select("path", "kind", "size"),
    on_meta(f"SELECT path, kind, size FROM meta WHERE {LIVE} AND kind IN ('sheet', 'data') AND size <= 3000 AND "
            f"mtime_ms >= epoch_ms(TIMESTAMP '2024-06-01')"))
add("filter_items", lambda s, d: search.filter_items(meta(s, d), "code", "doc", "date", ascending=False),
    on_meta(f"SELECT path, rel, name, ext, size, mtime_ms FROM meta WHERE {LIVE} AND ext IN "
            f"({words(search.ITEM_GROUPS['code'])}) AND (contains(lower(name), 'doc') OR contains(lower(rel), 'doc'))"))
add("body_detail", lambda s, d: search.body_detail(body(s, d)),
    on_meta(f"SELECT path, CASE WHEN denied THEN '' ELSE body END AS body, body_chars, false AS truncated, denied "
            f"FROM meta WHERE {LIVE}"))

# -- content --------------------------------------------------------------------------------------

add("extract_documents", lambda s, d: files(s, d).select("path", "title", F.array_join("headings", "\n").alias("headings"),
                                                          F.sha2("body", 256).alias("body_hash"), "body_chars"),
    on_files("SELECT path, title, headings, sha256(body) AS body_hash, body_chars FROM files"))


def stored_files(s, d):
    """Documents as files with bytes: a byte order mark, carriage returns, front matter or a zero byte, by id."""
    rows = fr.listing(s, d).select("doc_id", "root", "rel", "path", "name", "ext", "kind", "is_text", "is_symlink", "denied", F.expr("""
      CASE doc_id % 5 WHEN 0 THEN concat('\ufeff', text) WHEN 1 THEN replace(text, '\n', '\r\n')
        WHEN 2 THEN concat('---\ntitle: "T ', doc_id, '"\nkind: x\n---\n', text) WHEN 3 THEN concat(text, '\u0000') ELSE text END""").alias("_t"))
    return rows.withColumns({"content": F.encode("_t", "UTF-8"), "size": F.octet_length("_t").cast("bigint")}).drop("_t")


add("extract_files", lambda s, d: extract.extract_documents(stored_files(s, d), P).select(
        "path", "title", "is_binary", "body_chars", F.sha2("body", 256).alias("body_hash"), "content_hash"),
    over(f"""{LISTING}, stored AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN chr(65279) || text WHEN 1 THEN replace(text, chr(10), chr(13) || chr(10))
        WHEN 2 THEN '---' || chr(10) || 'title: "T ' || doc_id || '"' || chr(10) || 'kind: x' || chr(10) || '---' || chr(10) || text WHEN 3 THEN text || chr(0) ELSE text END AS raw,
        doc_id % 5 = 2 AND ext IN ('.md', '.markdown') AND is_text AND NOT denied AS fm FROM listing),
      opened AS (SELECT * EXCLUDE (text), is_text AND NOT denied AND doc_id % 5 = 3 AS is_binary, CASE WHEN NOT is_text OR denied OR doc_id % 5 = 3 THEN ''
        WHEN doc_id % 5 = 2 AND NOT fm THEN raw ELSE text END AS body FROM stored)""",
         f"""SELECT path, CASE WHEN fm THEN 'T ' || doc_id ELSE {TITLE} END AS title, is_binary, length(body) AS body_chars, sha256(body) AS body_hash,
        CASE WHEN NOT denied THEN sha256(raw) END AS content_hash FROM opened"""))
add("extract_links_html",
    lambda s, d: extract.extract_links(fr.table(s, d, "pages").select("page_id", F.col("html").alias("body")), "html"),
    r"""SELECT DISTINCT page_id, link FROM (SELECT page_id, regexp_replace(unnest(regexp_extract_all(html,
        '(?i)<a\s[^>]*?href=["'']([^"''>\s]+)["'']', 1)), '#.*$', '') AS link FROM pages)
        WHERE link <> '' AND NOT regexp_matches(link, '(?i)^[a-z][a-z0-9+.-]*:')""")
PAGES = rf"""docs AS (SELECT page_id, '/vault/src0/pages/' || page_id || '.md' AS path, 'pages/' || page_id || '.md' AS rel,
    regexp_replace(html, '{fr.PAGE_ANCHOR}', '[\1](../words/\1)', 'g') AS body FROM pages),
  found AS (SELECT DISTINCT path, rel, link FROM (SELECT path, rel, regexp_replace(unnest(regexp_extract_all(body,
    '\[[^\]]*\]\(([^)\s]+)(?:\s+"[^"]*")?\)', 1)), '#.*$', '') AS link FROM docs)
    WHERE link <> '' AND NOT regexp_matches(link, '(?i)^[a-z][a-z0-9+.-]*:')),
  resolved AS (SELECT *, CASE WHEN link LIKE '../%' THEN '/vault/src0/' || rtrim(substr(link, 4), '/')
    ELSE '/vault/src0/pages/' || link END AS target FROM found WHERE link NOT LIKE '/%' AND link NOT LIKE '~%'),
  known AS (SELECT '/vault/src0/words/' || regexp_extract(html, '{fr.PAGE_ANCHOR}', 1) || '.md' AS known FROM pages
    UNION SELECT path FROM docs UNION SELECT unnest(['/vault', '/vault/src0', '/vault/src0/pages', '/vault/src0/words'])),
  checked AS (SELECT *, EXISTS (SELECT 1 FROM known k WHERE k.known IN (target, target || '.md', target || '.markdown',
    target || '.html', target || '/index.md', target || '/README.md', target || '/readme.md')) AS ok FROM resolved)"""
add("broken_links", lambda s, d: links.broken_links(fr.page_files(s, d), P),
    over(PAGES, "SELECT path, rel, link, target FROM checked WHERE NOT ok"))
add("link_summary", lambda s, d: links.link_summary(fr.page_files(s, d), P),
    over(PAGES, "SELECT (SELECT count(*) FROM docs) AS checked_files, count(*) AS checked_links, "
                "count(*) FILTER (WHERE NOT ok) AS broken FROM checked"))
add("extract_rules", lambda s, d: extract.extract_rules(fr.rule_docs(s, d)),
    f"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l,
        generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
      SELECT CAST(doc_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS position,
        {squeeze("replace(l, '**', '')")} AS rule FROM lines""")
add("line_window", lambda s, d: extract.line_window(body(s, d), start=2, n=5),
    on_meta(f"""SELECT path, len(ls) AS total_lines, CAST(2 AS BIGINT) AS start_line, len(ls[2:6]) AS returned_lines,
        1 + len(ls[2:6]) < len(ls) AS has_more, array_to_string(list_transform(ls[2:6],
          lambda x, i: lpad(CAST(i + 1 AS VARCHAR), length(CAST(1 + len(ls[2:6]) AS VARCHAR))::INT, ' ') || '| ' || x), chr(10)) AS content
      FROM (SELECT path, string_split(body, chr(10)) AS ls FROM meta WHERE NOT denied)"""))
add("repeating_ngrams", lambda s, d: extract.repeating_ngrams(body(s, d), 2, 20, "[a-z]"),
    on_meta("""SELECT path, ngram, CAST((length(body) - length(replace(body, ngram, ''))) // 2 AS BIGINT) AS hits
      FROM (SELECT path, ngram FROM (SELECT path, substr(body, i, 2) AS ngram FROM (SELECT path, body,
        unnest(generate_series(1, length(body) - 1)) AS i FROM meta WHERE length(body) > 1))
        WHERE regexp_matches(ngram, '^[a-z]{2}$') GROUP BY path, ngram HAVING count(*) >= 20) JOIN meta USING (path)
      WHERE (length(body) - length(replace(body, ngram, ''))) // 2 >= 20"""))


def lines_of(s, d):
    return fr.table(s, d, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("position", "line"))


add("trim_to_bytes", lambda s, d: ranking.trim_to_bytes(lines_of(s, d), 1200, by="doc_id").select("doc_id", "position", "used_bytes"),
    """SELECT * FROM (SELECT doc_id, i - 1 AS position, CAST(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS used_bytes
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
      WHERE used_bytes <= 1000""")
add("path_parts", lambda s, d: extract.path_parts(meta(s, d)),
    on_meta("""SELECT path, top_dir, len(string_split(rel, '/')) - 1 AS depth,
        regexp_replace(name, '^(.+)\\.[^.]*$', '\\1') AS stem, array_to_string(list_transform(
          generate_series(1, len(string_split(rel, '/')) - 1),
          lambda n: array_to_string(string_split(rel, '/')[1:n], '/')), '|') AS folders FROM meta""".replace("\\\\", "\\")))

# -- roll-ups -------------------------------------------------------------------------------------

SUMS = ("count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, coalesce(max(mtime_ms), 0) AS latest_ms")
TWO = "count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes"
add("root_stats", lambda s, d: rollup.root_stats(meta(s, d)),
    on_meta(f"SELECT root, {SUMS} FROM meta WHERE {LIVE} GROUP BY root"))
add("top_level_dirs", lambda s, d: rollup.top_level_dirs(meta(s, d)),
    on_meta(f"SELECT root, top_dir, {SUMS} FROM meta WHERE {LIVE} GROUP BY root, top_dir"))
add("kind_distribution", lambda s, d: rollup.kind_distribution(meta(s, d)),
    on_meta(" UNION ALL ".join(
        f"SELECT '{grain}' AS grain, {root} AS root, {top} AS top_dir, kind, {TWO} FROM meta WHERE {LIVE} GROUP BY {by}"
        for grain, root, top, by in (("corpus", "NULL", "NULL", "kind"), ("root", "root", "NULL", "root, kind"),
                                     ("top_dir", "root", "top_dir", "root, top_dir, kind")))))
LATEST_RUNS = ("SELECT run_id, root, files_seen, dirs_seen, skipped_dirs, errors FROM scan_runs "
               "QUALIFY row_number() OVER (PARTITION BY root ORDER BY run_id DESC) = 1")
add("latest_scan_runs", lambda s, d: rollup.latest_scan_runs(fr.scan_runs(s, d)), over(SCAN_RUNS, LATEST_RUNS))
COVERED = "is_text AND body_chars > 0"
add("overview", lambda s, d: rollup.overview(meta(s, d), fr.scan_runs(s, d)),
    over(f"{LISTING}, {SCAN_RUNS}",
         f"SELECT f.*, files_seen, dirs_seen, skipped_dirs, errors FROM (SELECT root, {TWO}, count(*) FILTER "
         f"(WHERE {COVERED}) AS covered_files, CAST(coalesce(sum(size) FILTER (WHERE {COVERED}), 0) AS BIGINT) AS covered_bytes "
         f"FROM meta WHERE {LIVE} GROUP BY root) f LEFT JOIN ({LATEST_RUNS}) r USING (root)"))
add("overview_totals", lambda s, d: rollup.overview_totals(meta(s, d)),
    on_meta(f"SELECT {TWO}, count(*) FILTER (WHERE {COVERED}) AS text_files FROM meta WHERE {LIVE}"))
BUCKET = f"""CASE WHEN gone OR size = 0 OR denied THEN 'excluded' WHEN body_chars > 0 THEN 'ok'
  WHEN is_text THEN 'fix'
  WHEN lower(ext) IN ({words(OPAQUE_EXTS)}) THEN 'skip' WHEN kind = 'image' THEN 'ocr'
  WHEN kind IN ('audio', 'video') THEN 'asr' WHEN kind = 'archive' THEN 'unpack'
  WHEN kind IN ('doc', 'sheet', 'slide') THEN 'extractor' WHEN kind = 'data' THEN 'nosql' ELSE 'skip' END"""
CLASSED = f"{LISTING}, classed AS (SELECT *, {BUCKET} AS bucket FROM meta WHERE {LIVE})"
LADDER = f"CAST(list_position([{words(COVERAGE_LADDER)}], bucket) - 1 AS BIGINT)"
BUCKETS = (f"SELECT bucket, files, bytes, round(files * 100.0 / sum(files) OVER (), 6) AS pct_files, {LADDER} AS ladder FROM "
           f"(SELECT bucket, {TWO} FROM classed GROUP BY bucket)")
TOP_EXTS = ("SELECT bucket, ext, files, rank FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY files DESC, ext) "
            "AS rank FROM (SELECT bucket, CASE WHEN ext = '' THEN '(none)' ELSE lower(ext) END AS ext, count(*) AS files "
            "FROM classed GROUP BY ALL)) WHERE rank <= 8")
SAMPLES = ("SELECT bucket, rel, path, rank FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY rel, path) AS rank "
           "FROM classed) WHERE rank <= 5")
add("coverage_buckets", lambda s, d: rollup.coverage_buckets(meta(s, d), P), over(CLASSED, BUCKETS))
add("coverage_top_exts", lambda s, d: rollup.coverage_top_exts(meta(s, d), P), over(CLASSED, TOP_EXTS))
add("coverage_samples", lambda s, d: rollup.coverage_samples(meta(s, d), P), over(CLASSED, SAMPLES))
add("coverage_report",
    lambda s, d: rollup.coverage_report(meta(s, d), P).withColumns({
        "top_exts": F.array_join(F.transform("top_exts", lambda x: F.concat(x["ext"], F.lit(":"), x["files"].cast("string"))), "|"),
        "samples": F.array_join("samples", "|")}),
    over(CLASSED, f"SELECT b.*, top_exts, samples FROM ({BUCKETS}) b LEFT JOIN (SELECT bucket, string_agg(ext || ':' || files, "
                  f"'|' ORDER BY rank) AS top_exts FROM ({TOP_EXTS}) GROUP BY bucket) USING (bucket) LEFT JOIN (SELECT bucket, "
                  f"string_agg(rel, '|' ORDER BY rel) AS samples FROM ({SAMPLES}) GROUP BY bucket) USING (bucket)"))
OK = "FILTER (WHERE bucket = 'ok')"
add("coverage_totals", lambda s, d: rollup.coverage_totals(meta(s, d), P),
    over(CLASSED, f"SELECT *, round(searchable_files * 100.0 / files, 6) AS pct_files, round(searchable_bytes * 100.0 / bytes, 6) AS pct_bytes FROM "
                  f"(SELECT {TWO}, count(*) {OK} AS searchable_files, CAST(coalesce(sum(size) {OK}, 0) AS BIGINT) AS "
                  f"searchable_bytes, CAST(0 AS BIGINT) AS truncated_files FROM classed)"))
add("coverage_by_root", lambda s, d: rollup.coverage_by_root(meta(s, d)),
    on_meta(f"SELECT root, {TWO}, count(*) FILTER (WHERE body_chars > 0) AS with_body, round(count(*) FILTER (WHERE body_chars > 0) "
            f"* 100.0 / count(*), 6) AS pct FROM meta WHERE {LIVE} GROUP BY root"))
add("biggest_dark", lambda s, d: rollup.biggest_dark(meta(s, d), P),
    over(CLASSED, "SELECT path, rel, size, kind, bucket FROM classed WHERE bucket <> 'ok' ORDER BY size DESC, path LIMIT 10"))


def directory_sql(folder: str, depth: int) -> str:
    rest = f"substr(path, {len(folder) + 2})"
    levels = " UNION ALL ".join(
        f"SELECT 'dir' AS entry_type, array_to_string(parts[1:{n}], '/') AS entry, {n} AS level, {TWO}, max(mtime_ms) AS latest_ms "
        f"FROM under WHERE len(parts) > {n} GROUP BY entry" for n in range(1, depth + 1))
    return over(f"{LISTING}, under AS (SELECT *, {rest} AS rest, string_split({rest}, '/') AS parts FROM meta WHERE {LIVE} "
                f"AND path LIKE '{folder}/%')",
                f"{levels} UNION ALL SELECT 'file', rest, len(parts), 1, size, mtime_ms FROM under WHERE len(parts) <= {depth}")


add("list_directory", lambda s, d: rollup.list_directory(meta(s, d), "/vault/src0"), directory_sql("/vault/src0", 1))
add("list_directory_deep", lambda s, d: rollup.list_directory(meta(s, d), "/vault", 3), directory_sql("/vault", 3))
add("directory_total", lambda s, d: rollup.directory_total(meta(s, d), "/vault/src1"),
    on_meta(f"SELECT {TWO} FROM meta WHERE {LIVE} AND path LIKE '/vault/src1/%'"))
RECENT = f"{LIVE} AND mtime_ms >= {P.cutoff_ms(90)} AND kind IN ('doc', 'data')"
BY_DIR = f"SELECT top_dir, {TWO} FROM meta WHERE {RECENT} GROUP BY top_dir"
add("recent_changes_by_dir", lambda s, d: rollup.recent_changes_by_dir(meta(s, d), P, "90d", kind="doc data"), on_meta(BY_DIR))
add("recent_changes", lambda s, d: rollup.recent_changes(files(s, d), P, "90d", kind="doc data"),
    on_files(f"SELECT p.*, g.files AS dir_files FROM (SELECT path, root, rel, kind, size, mtime_ms, {squeeze('title')} AS title, "
             f"top_dir FROM files WHERE {RECENT} ORDER BY mtime_ms DESC, path LIMIT 40) p JOIN ({BY_DIR}) g USING (top_dir)"))
MONTHLY = f"""SELECT month, coalesce(files, 0) AS files FROM (SELECT strftime(unnest(generate_series(TIMESTAMP '2025-02-01',
  TIMESTAMP '2026-01-01', INTERVAL 1 MONTH)), '%Y-%m') AS month) LEFT JOIN (SELECT strftime(epoch_ms(mtime_ms), '%Y-%m') AS month,
  count(*) AS files FROM meta WHERE {LIVE} AND mtime_ms > {SANE_MTIME_MS} GROUP BY 1) USING (month)"""
add("monthly_activity", lambda s, d: rollup.monthly_activity(meta(s, d), P), on_meta(MONTHLY))
add("recent3", lambda s, d: rollup.recent3(rollup.monthly_activity(meta(s, d), P)),
    on_meta(f"SELECT CAST(sum(files) AS BIGINT) AS recent3 FROM (SELECT * FROM ({MONTHLY}) ORDER BY month DESC LIMIT 3)"))
add("folder_totals", lambda s, d: rollup.folder_totals(meta(s, d)),
    on_meta(f"SELECT top_dir AS folder, {TWO} FROM meta WHERE {LIVE} AND top_dir <> '' GROUP BY top_dir"))
add("scaled_bytes", lambda s, d: rollup.scaled_bytes(meta(s, d)),
    on_meta(f"SELECT kind, bytes, round(sqrt(bytes) / greatest(max(sqrt(bytes)) OVER (), 1.0), 6) AS scaled FROM (SELECT kind, {TWO} FROM meta "
            f"WHERE {LIVE} GROUP BY kind)"))
add("file_cards", lambda s, d: meta(s, d).select(
        "path", text.human_bytes(F.col("size")).alias("size_text"), dates.day_text(F.col("mtime_ms")).alias("day"),
        dates.minute_text(F.col("mtime_ms")).alias("minute"), dates.days_ago(F.col("mtime_ms"), P).alias("days"),
        dates.age_text(F.col("mtime_ms"), P).alias("age")),
    on_meta(f"""SELECT path, CASE WHEN size < 1024 THEN size || 'B' WHEN size >= 102400 THEN printf('%.0f', round(size / 1024.0, 0)) || 'KB'
        WHEN size >= 10240 THEN printf('%.1f', round(size / 1024.0, 1)) || 'KB' ELSE printf('%.2f', round(size / 1024.0, 2)) || 'KB' END AS size_text,
        strftime(epoch_ms(mtime_ms), '%Y-%m-%d') AS day, strftime(epoch_ms(mtime_ms), '%Y-%m-%d %H:%M') AS minute, days,
        CASE WHEN days = 0 THEN 'today' WHEN days < 30 THEN days || ' days' WHEN days < 365 THEN (days // 30) || ' months'
        ELSE (days // 365) || ' years' END AS age
      FROM (SELECT *, ({P.as_of_ms} - mtime_ms) // 86400000 AS days FROM meta)"""))

# -- audits ---------------------------------------------------------------------------------------

COMPARABLE = f"{LIVE} AND NOT denied AND size > 0"
GROUPS = f"""SELECT size, sha256(text) AS hash, count(*) AS n, size * (count(*) - 1) AS wasted_bytes,
  arg_max(path, lpad(CAST(mtime_ms AS VARCHAR), 15, '0') || path) AS keep_path,
  arg_max(rel, lpad(CAST(mtime_ms AS VARCHAR), 15, '0') || path) AS keep_rel
  FROM meta WHERE {COMPARABLE} GROUP BY size, sha256(text) HAVING count(*) > 1"""
add("size_groups", lambda s, d: audit.size_groups(meta(s, d)),
    on_meta(f"SELECT size, count(*) AS n FROM meta WHERE {COMPARABLE} GROUP BY size HAVING count(*) > 1"))
add("duplicate_groups", lambda s, d: audit.duplicate_groups(meta(s, d)), on_meta(GROUPS))
add("duplicate_members", lambda s, d: audit.duplicate_members(meta(s, d), P).select("size", "hash", "path", "is_keeper"),
    on_meta(f"SELECT m.size, g.hash, path, path = keep_path AS is_keeper FROM meta m JOIN ({GROUPS}) g ON m.size = g.size AND "
            f"sha256(m.text) = g.hash WHERE {COMPARABLE.replace('size', 'm.size')}"))
add("duplicate_summary", lambda s, d: audit.duplicate_summary(meta(s, d)),
    on_meta(f"SELECT count(*) AS exact_groups, CAST(coalesce(sum(wasted_bytes), 0) AS BIGINT) AS reclaimable_bytes, "
            f"CAST(0 AS BIGINT) AS not_compared, CAST(0 AS BIGINT) AS not_compared_bytes FROM ({GROUPS})"))


def some_unread(s, d):
    """The corpus as if files in French could not be read: they have a size, but no hash."""
    return meta(s, d).withColumn("content_hash", F.when(F.col("lang") != "fr", F.col("content_hash")))


add("duplicate_summary_unread", lambda s, d: audit.duplicate_summary(some_unread(s, d)),
    on_meta(f"SELECT count(*) AS exact_groups, CAST(coalesce(sum(wasted_bytes), 0) AS BIGINT) AS reclaimable_bytes, any_value(k) AS not_compared, "
            f"any_value(b) AS not_compared_bytes FROM ({GROUPS.replace('WHERE', "WHERE lang <> 'fr' AND", 1)}) RIGHT JOIN (SELECT count(*) AS k, "
            f"CAST(coalesce(sum(size), 0) AS BIGINT) AS b FROM meta WHERE {COMPARABLE} AND lang = 'fr') ON true"))
SAME = (f"SELECT lower(name) AS name_key, count(*) AS n, CAST(sum(size) AS BIGINT) AS total_bytes FROM meta WHERE {LIVE} AND "
        f"size >= 1024 AND lower(name) NOT IN ({words(UBIQUITOUS_NAMES)}) GROUP BY 1 HAVING count(*) > 1")
add("same_name_groups", lambda s, d: audit.same_name_groups(meta(s, d)), on_meta(SAME))
add("same_name", lambda s, d: audit.same_name(meta(s, d), P, 5),
    on_meta(f"SELECT name_key, path, rel, size, mtime_ms, n, total_bytes FROM meta JOIN (SELECT * FROM ({SAME}) ORDER BY "
            f"total_bytes DESC, name_key LIMIT 5) ON lower(name) = name_key WHERE {LIVE} AND size >= 1024"))
STALE = f"{LIVE} AND mtime_ms > 0 AND mtime_ms < {P.cutoff_ms(P.stale_days)}"
add("stale_total", lambda s, d: audit.stale(meta(s, d), P)["total"], on_meta(f"SELECT {TWO} FROM meta WHERE {STALE}"))
add("stale_by_dir", lambda s, d: audit.stale(meta(s, d), P)["by_dir"],
    on_meta(f"SELECT top_dir, {SUMS} FROM meta WHERE {STALE} GROUP BY top_dir"))
BIG_STALE = (f"SELECT path, rel, name, size, mtime_ms, ({P.as_of_ms} - mtime_ms) // 86400000 AS days FROM meta WHERE {STALE} {{more}} "
             f"ORDER BY size DESC, path LIMIT {{k}}")
add("stale_biggest", lambda s, d: audit.stale(meta(s, d), P)["biggest"], on_meta(BIG_STALE.format(more="", k=30)))
STEM = r"regexp_replace(name, '^(.+)\.[^.]*$', '\1')"
ANYWHERE, AT_END = names.version_words_regex(P)
REASON = (f"CASE WHEN regexp_matches({STEM}, '{names.COPY_SUFFIX}') THEN 'copy-suffix' WHEN regexp_matches({STEM}, '{ANYWHERE}') OR "
          f"regexp_matches({STEM}, '{AT_END}') THEN 'version-word' END")
NAMEABLE = f"{LIVE} AND NOT contains('/' || rel || '/', '/node_modules/')"
VERSIONS = f"SELECT path, rel, name, size, mtime_ms, {REASON} AS reason FROM meta WHERE {NAMEABLE} AND {REASON} IS NOT NULL"
LONG = (f"SELECT path, rel, name, length(name) AS name_chars FROM meta WHERE {NAMEABLE} AND length(name) > 60 AND NOT "
        f"regexp_matches({STEM}, '{names.HEX_NAME}')")
add("version_names", lambda s, d: audit.version_names(meta(s, d), P), on_meta(VERSIONS))
add("long_names", lambda s, d: audit.long_names(meta(s, d)), on_meta(LONG))
INBOX = (f"SELECT path, rel, name, size, mtime_ms, ({P.as_of_ms} - mtime_ms) // 86400000 AS days, ({P.as_of_ms} - mtime_ms) // "
         f"86400000 > 30 AS overdue FROM meta WHERE {LIVE} AND path LIKE '/vault/src0/inbox/%'")
add("inbox", lambda s, d: audit.inbox(meta(s, d), P), on_meta(INBOX))
add("inbox_summary", lambda s, d: audit.inbox_summary(meta(s, d), P),
    on_meta(f"SELECT true AS configured, count(*) AS files, count(*) FILTER (WHERE overdue) AS overdue_files, "
            f"CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM ({INBOX})"))
NAV = r"(?i)^(README[^/]*|INDEX[^/]*|index\.[^/]*|00-[^/]*|AGENTS\.md|CLAUDE\.md)$"
CLUTTER = (f"SELECT path, rel, name, size, mtime_ms FROM meta WHERE {LIVE} AND root = '/vault/src0' AND NOT contains(rel, '/') AND NOT "
           f"regexp_matches(name, '{NAV}')")
ROOT_DIRS = f"SELECT DISTINCT top_dir FROM meta WHERE {LIVE} AND root = '/vault/src0' AND top_dir <> ''"
add("root_clutter", lambda s, d: audit.root_clutter(meta(s, d), P), on_meta(CLUTTER))
add("root_dirs", lambda s, d: audit.root_dirs(meta(s, d), P), on_meta(ROOT_DIRS))


def metric(check: str, name: str, value: str) -> str:
    return f"SELECT '{check}' AS \"check\", '{name}' AS metric, CAST(({value}) AS BIGINT) AS value"


AUDIT = " UNION ALL ".join([
    metric("stale", "files", f"SELECT count(*) FROM meta WHERE {STALE}"),
    metric("stale", "bytes", f"SELECT coalesce(sum(size), 0) FROM meta WHERE {STALE}"),
    metric("naming", "matched", f"SELECT count(*) FROM ({VERSIONS})"),
    metric("naming", "long_names", f"SELECT count(*) FROM ({LONG})"),
    metric("root_clutter", "files", f"SELECT count(*) FROM ({CLUTTER})"),
    metric("root_clutter", "dirs", f"SELECT count(*) FROM ({ROOT_DIRS})"),
    metric("inbox", "configured", "1"), metric("inbox", "files", f"SELECT count(*) FROM ({INBOX})"),
    metric("inbox", "overdue_files", f"SELECT count(*) FROM ({INBOX}) WHERE overdue"),
    metric("inbox", "bytes", f"SELECT coalesce(sum(size), 0) FROM ({INBOX})"),
    metric("duplicates", "exact_groups", f"SELECT count(*) FROM ({GROUPS})"),
    metric("duplicates", "reclaimable_bytes", f"SELECT coalesce(sum(wasted_bytes), 0) FROM ({GROUPS})"),
    metric("duplicates", "not_compared", "0"), metric("duplicates", "not_compared_bytes", "0"),
    metric("duplicates", "same_name_groups", f"SELECT count(*) FROM ({SAME})"),
    metric("links", "checked_files", f"SELECT count(*) FROM meta WHERE {LIVE} AND ext IN ('.md', '.markdown') AND body_chars > 0"),
    # No text of the given tables holds a Markdown link; the queries on links make some.
    metric("links", "checked_links", f"SELECT count(*) FROM meta WHERE {LIVE} AND regexp_matches(body, '\\[[^\\]]*\\]\\([^)\\s]+')"),
    metric("links", "broken", "0"),
])
add("audit", lambda s, d: audit.audit(body(s, d), P), on_meta(AUDIT))
HERE = "root = '/vault/src0'"
HERE_GROUPS = GROUPS.replace("WHERE", f"WHERE {HERE} AND", 1)
PROPOSALS = f"""
  SELECT 'root-clutter' AS category, 'move' AS action, rel AS from_rel, 'inbox/2026-01/' || name AS to_path, 'low' AS risk
    FROM ({CLUTTER})
  UNION ALL SELECT 'inbox-backlog', 'triage', rel, NULL, 'manual' FROM ({INBOX}) WHERE overdue
  UNION ALL SELECT 'duplicates', 'archive', m.rel, '归档/2026/重复副本/' || name, 'medium' FROM meta m JOIN ({HERE_GROUPS})
    g ON m.size = g.size AND sha256(m.text) = g.hash WHERE {HERE} AND {COMPARABLE.replace('size', 'm.size')}
    AND path <> keep_path
  UNION ALL SELECT 'version-names', 'review', rel, NULL, 'manual' FROM ({VERSIONS.replace('WHERE', f'WHERE {HERE} AND', 1)})
  UNION ALL SELECT 'stale-large', 'review', rel, '归档/2026/（待定）/', 'manual' FROM meta WHERE {STALE} AND {HERE}"""
add("propose_organize", lambda s, d: audit.propose_organize(meta(s, d), P), on_meta(PROPOSALS))
add("proposal_summary", lambda s, d: audit.proposal_summary(audit.propose_organize(meta(s, d), P)),
    on_meta(f"SELECT category, count(*) AS proposals, string_agg(DISTINCT risk, '|' ORDER BY risk) AS risks FROM ({PROPOSALS}) GROUP BY category"))

# -- triage ---------------------------------------------------------------------------------------

SEGMENTS = "string_split(lower(rel), '/')"
TOKENS = " OR ".join(
    f"contains(lower(name), '{w}')" if len(w) >= 5 else rf"regexp_matches(lower(name), '(^|[^\p{{L}}\p{{N}}]){w}([^\p{{L}}\p{{N}}]|$)')"
    for w in CHAT_WORDS)
VENDOR = f"(list_has_any({SEGMENTS}, [{words(VENDOR_DIRS)}]) OR lower({STEM}) IN ({words(VENDOR_STEMS)}))"
BUILT = f"(list_has_any({SEGMENTS}, [{words(BUILD_DIRS)}]) OR lower(rel) LIKE '%.app' OR contains(lower(rel), '.app/'))"
DEP = "(" + " OR ".join(f"contains('/' || lower(rel), '{m}')" for m in DEPENDENCY_MARKERS) + ")"
OLD = "(rel LIKE '归档/%' OR contains(rel, '/归档/') OR contains(lower(rel), '/archive/') OR contains(rel, '备份-'))"
ENTRY = (f"(lower(ext) IN ({words(ENTRY_EXTS)}) AND NOT {DEP} AND NOT {OLD} AND (" +
         " OR ".join(f"contains(lower(name), '{w}')" for w in ENTRY_WORDS) + "))")
TYPE = f"""CASE WHEN lower(name) IN ('.ds_store', 'thumbs.db', 'desktop.ini') THEN 'junk' WHEN {VENDOR} THEN 'vendor'
  WHEN ext IN ({words(CONFIG_EXTS)}) THEN 'config' WHEN ext IN ({words(INSTALLER_EXTS)}) THEN 'installer'
  WHEN ext IN ({words(MODEL_EXTS)}) THEN 'model' WHEN ext IN ({words(BINARY_EXTS)}) THEN 'binary'
  WHEN ext IN ({words(PROSE_EXTS)}) THEN 'prose' WHEN ext IN ({words(STRUCTURED_EXTS)}) THEN 'structured'
  WHEN ext IN ({words(SOURCE_EXTS)}) THEN 'code' WHEN ext IN ({words(MEDIA_EXTS)}) THEN 'media'
  WHEN ext IN ({words(ASSET_EXTS)}) THEN 'asset' WHEN {TOKENS} OR ext IN ({words(MAIL_EXTS)}) THEN 'comms'
  WHEN kind IN ('video', 'audio', 'image') THEN 'media' WHEN kind = 'code' THEN 'code' WHEN kind IN ('doc', 'web') THEN 'prose'
  ELSE 'unknown' END"""
MACHINE = rf"""CASE WHEN regexp_matches({STEM}, '^\p{{N}}{{6,}}$') THEN true WHEN {STEM} LIKE 'eyJ%' AND length({STEM}) > 24 THEN true
  WHEN regexp_matches({STEM}, '^[0-9A-Fa-f]{{16,}}$') THEN true WHEN regexp_matches(upper({STEM}), '{names.CAMERA_PREFIX}') THEN true
  WHEN regexp_matches({STEM}, '{text.CJK}') THEN false WHEN length(regexp_replace({STEM}, '[^\p{{L}}]', '', 'g')) >= 3 THEN false ELSE true END"""
DOWNLOADED = (f"CASE WHEN lower(rel) LIKE 'downloads/%' OR contains(lower(rel), '/downloads/') THEN ({TYPE}) IN ('installer', 'model', 'binary') "
              f"ELSE ({TYPE}) IN ('installer', 'model') AND regexp_matches(name, '\\p{{N}}') END")
add("path_flags", lambda s, d: triage.path_flags(meta(s, d)),
    on_meta(f"SELECT path, {TYPE} AS content_type, {MACHINE} AS machine_named, lower(name) IN ('.ds_store', 'thumbs.db', 'desktop.ini') AS "
            f"system_junk, {VENDOR} AS vendor_asset, {BUILT} AS build_artifact, {DEP} AS in_dependency, {OLD} AS archived, {ENTRY} AS "
            f"entry_doc, {DOWNLOADED} AS downloaded FROM meta"))
add("type_groups", lambda s, d: rollup.type_groups(meta(s, d)),
    on_meta(f"SELECT content_type, files, bytes, round(files / sum(files) OVER (), 6) AS fraction FROM (SELECT {TYPE} AS content_type, {TWO} FROM meta "
            f"WHERE {LIVE} GROUP BY 1)"))
CHARS = "'chars:' || body_chars"
TRIAGED = f"""{LISTING}, facts AS (SELECT *, {TYPE} AS content_type, {BUILT} AS built, {DEP} AS dep, {OLD} AS old, {ENTRY} AS entry,
    CASE WHEN first <> path THEN first END AS copy_of FROM (SELECT *, min(path) OVER (PARTITION BY name, size) AS first FROM meta WHERE {LIVE})),
  grounds AS (SELECT *, [CASE WHEN content_type IN ('installer', 'model', 'binary', 'junk', 'config', 'vendor') OR (content_type = 'unknown' AND
      body_chars = 0) THEN 'type-holds-nothing-personal:' || content_type END, CASE WHEN content_type = 'vendor' THEN 'third-party-asset' END,
      CASE WHEN built THEN 'build-artifact' END, CASE WHEN dep THEN 'dependency-folder' END, CASE WHEN size = 0 THEN 'empty-file' END,
      CASE WHEN copy_of IS NOT NULL THEN 'same-name-and-size:' || name END] AS against,
    CASE WHEN body_chars > 0 THEN 'body-' || {CHARS} END AS has_body, CASE WHEN old THEN 'archived-may-be-superseded' END AS was_old FROM facts),
  tiered AS (SELECT *, CAST(CASE WHEN len(list_filter(against, lambda x: x IS NOT NULL)) > 0 THEN 5 WHEN content_type IN ('media', 'asset') THEN 3
      WHEN entry THEN 0 WHEN content_type IN ('code', 'structured') THEN 4 WHEN content_type IN ('prose', 'comms') AND body_chars >= 200
      AND NOT old THEN 1 ELSE 2 END AS BIGINT) AS tier FROM grounds),
  triaged AS (SELECT *, CAST(CASE content_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in DENSITY.items())} ELSE 0 END AS BIGINT) AS density,
      list_filter(CASE tier WHEN 5 THEN against WHEN 3 THEN ['content-not-machine-readable', 'name-and-path-searchable']
        WHEN 0 THEN ['entry-document:' || name, has_body, was_old] WHEN 4 THEN ['search-only:' || content_type, coalesce(has_body, 'no-body')]
        ELSE ['may-hold-personal-content:' || content_type, CASE WHEN body_chars >= 200 THEN 'substantial-' || {CHARS} WHEN body_chars > 0
          THEN 'short-' || {CHARS} ELSE 'no-body' END, was_old] END, lambda x: x IS NOT NULL) AS reasons FROM tiered)"""
TRIAGE_COLS = "path, root, rel, name, size, mtime_ms, content_type, tier, array_to_string(reasons, '|') AS reasons, density, copy_of"
add("triage", lambda s, d: triage.triage(meta(s, d), P), over(TRIAGED, f"SELECT {TRIAGE_COLS} FROM triaged"))
add("triage_order", lambda s, d: triage.triage_order(triage.triage(meta(s, d), P), limit=100).select("path", "tier", "density"),
    over(TRIAGED, "SELECT path, tier, density FROM triaged ORDER BY tier, density DESC, mtime_ms DESC, path LIMIT 100"))
add("tier_counts", lambda s, d: triage.tier_counts(triage.triage(meta(s, d), P)),
    over(TRIAGED, "SELECT tier, count(*) AS files FROM triaged GROUP BY tier"))
add("mark_copies", lambda s, d: triage.mark_copies(rollup.live(meta(s, d)), P).where("copy_of IS NOT NULL").select("path", "copy_of"),
    over(TRIAGED, "SELECT path, copy_of FROM facts WHERE copy_of IS NOT NULL"))


def lift(s, d):
    marked = triage.triage(meta(s, d), P, keep=["doc_id"]).join(
        fr.table(s, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    return triage.signal_lift(marked, {
        "good": F.coalesce(F.col("quality") == 1, F.lit(False)), "toxic": F.coalesce(F.col("toxic") == 1, F.lit(False)),
        "entry": F.contains("name", F.lit("readme"))})


SIGNALS = {"good": "coalesce(quality = 1, false)", "toxic": "coalesce(toxic = 1, false)", "entry": "contains(name, 'readme')"}
add("signal_lift", lift,
    over(f"{TRIAGED}, marked AS (SELECT t.*, quality, toxic FROM triaged t LEFT JOIN labels USING (doc_id))", " UNION ALL ".join(
        f"SELECT tier, '{n}' AS signal, round(avg(CAST({c} AS INT)), 6) AS rate, round(avg(CAST({c} AS INT)) / nullif((SELECT avg(CAST({c} AS INT)) FROM "
        f"marked), 0), 6) AS lift FROM marked GROUP BY tier" for n, c in SIGNALS.items())))

# -- discovery ------------------------------------------------------------------------------------


def patterns_case(patterns, name="name") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({name}, '{p}') THEN {v}" for p, v in patterns) + " ELSE 0 END"


IS_DOC = "kind IN ('doc', 'web', 'data') AND body_chars > 0"
IS_LEDGER = "ext IN ('.json', '.csv') AND size > 2"
IS_NOTE = "ext IN ('.md', '.txt', '.markdown') AND body_chars > 0"
DEPTH = "len(string_split(rel, '/')) - 1"


def scored_sql(patterns, where: str) -> str:
    return (f"SELECT *, base - depth * 15 AS score FROM (SELECT *, {DEPTH} AS depth, {patterns_case(patterns)} AS base FROM files WHERE "
            f"{LIVE} AND root = '/vault/src0' AND {where}) WHERE depth <= 2 AND base > 0")


ENTRY_DOCS = (f"SELECT path, rel, name, {squeeze('title')} AS title, score, depth FROM ("
              f"{scored_sql(discover.ENTRY_NAMES, IS_DOC)}) "
              f"ORDER BY score DESC, length(rel), rel LIMIT 12")
add("discover_entry_docs", lambda s, d: discover.discover_entry_docs(files(s, d), P), on_files(ENTRY_DOCS))
RANKED_NOTES = f"""SELECT root, top_dir, note, rel AS source FROM (SELECT *, row_number() OVER (PARTITION BY root, top_dir ORDER BY rank, length(rel), rel) AS rn
  FROM (SELECT *, {squeeze('title')} AS note, {patterns_case(discover.NOTE_NAMES)} AS rank FROM files WHERE {LIVE} AND ext IN ('.md', '.txt', '.markdown')
    AND body_chars > 0 AND {DEPTH} = 1) WHERE (rank > 0 OR regexp_matches(name, '{discover.NOTE_PREFIX}')) AND length(note) BETWEEN 2 AND 70) WHERE rn = 1"""
add("discover_dir_notes", lambda s, d: discover.discover_dir_notes(files(s, d), P), on_files(RANKED_NOTES))
add("dir_notes", lambda s, d: discover.dir_notes(files(s, d), P),
    on_files(f"SELECT t.*, CASE WHEN t.top_dir = 'releases' THEN 'built packages' ELSE note END AS note, CASE WHEN t.top_dir = 'releases' THEN "
             f"'config' ELSE source END AS note_source FROM (SELECT root, top_dir, {SUMS} FROM files WHERE {LIVE} AND {HERE} GROUP BY ALL) t "
             f"LEFT JOIN ({RANKED_NOTES}) n ON n.root = t.root AND n.top_dir = t.top_dir"))
LEDGERS = (f"SELECT path, rel, name, ext, score FROM ({scored_sql(discover.LEDGER_NAMES, IS_LEDGER)}) "
           f"ORDER BY score DESC, rel LIMIT 5")
RULES = (f"SELECT path, rel, name, score FROM ({scored_sql(discover.RULES_NAMES, IS_NOTE)}) "
         f"ORDER BY score DESC, length(rel), rel LIMIT 1")
def ruled(s, d):
    """The corpus with one document of rules in the main root: an item per nation."""
    items = fr.table(s, d, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))  # 25 rows
    made = items.select(
        F.lit("/vault/src0").alias("root"), F.lit("/vault/src0/rules.md").alias("path"), F.lit("rules.md").alias("rel"), F.lit("rules.md").alias("name"),
        F.lit(".md").alias("ext"), F.lit(False).alias("gone"), F.lit(False).alias("is_symlink"), F.lit(9).alias("body_chars"), F.concat(
            F.lit("## Rules\n\n"), F.array_join(F.transform("n", lambda x: F.concat(F.lit("1. "), x["n_name"])), "\n")).alias("body"))
    return files(s, d).unionByName(made, allowMissingColumns=True)


LEDGER_BODY = """CASE p_partkey % 4 WHEN 0 THEN concat('[{"id":"a', p_partkey, '"},{"id":"b"}]') WHEN 1 THEN concat('{"projects":[{"slug":"', p_brand, '"}]}')
  WHEN 2 THEN concat('{"x":{"title":"', p_type, '"},"y":{"name":"y"},"z":{"name":"z"}}') ELSE '{"note":"no list","n":1}' END"""


def with_ledgers(s, d):
    """The corpus with a file of JSON for every part, named like a list of projects, in the main root."""
    made = fr.table(s, d, "part").selectExpr(
        "'/vault/src0' AS root", "concat('/vault/src0/projects-', p_partkey, '.json') AS path", "concat('projects-', p_partkey, '.json') AS rel",
        "concat('projects-', p_partkey, '.json') AS name", "'.json' AS ext", f"{LEDGER_BODY} AS body", f"CAST(length({LEDGER_BODY}) AS BIGINT) AS size",
        "false AS gone", "false AS is_symlink")
    return files(s, d).select(*made.columns).unionByName(made)


def verified(s, d):
    rows = with_ledgers(s, d)
    return documents.verify_ledgers(discover.discover_ledger(rows, P, k=20), rows)


MADE = (f"made AS (SELECT 'projects-' || p_partkey || '.json' AS rel, {LEDGER_BODY} AS body, p_partkey % 4 AS form FROM part), "
        f"told AS (SELECT '/vault/src0/' || rel AS path, 80 AS score, rel, form FROM made ORDER BY rel LIMIT 20)")
add("discover_ledger_named", lambda s, d: discover.discover_ledger(with_ledgers(s, d), P, k=20).select("path", "score"),
    over(MADE, "SELECT path, score FROM told"))
add("verify_ledgers", verified,
    over(MADE, "SELECT path, score, CASE form WHEN 0 THEN 'array' WHEN 1 THEN 'object.projects' ELSE 'map' END AS shape, CASE form WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 3 END "
               "AS entries FROM told WHERE form < 3"))
add("projects_from_json", lambda s, d: documents.projects_from_json(fr.table(s, d, "part").selectExpr(f"{LEDGER_BODY} AS value")).select("id", "name"),
    """SELECT 'a' || p_partkey AS id, '' AS name FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'b', '' FROM part WHERE p_partkey % 4 = 0
      UNION ALL SELECT p_brand, '' FROM part WHERE p_partkey % 4 = 1 UNION ALL SELECT k, CASE k WHEN 'x' THEN p_type ELSE k END FROM part, (SELECT unnest(['x', 'y', 'z']) AS k)
      WHERE p_partkey % 4 = 2""")
add("corpus_map_kinds", lambda s, d: discover.corpus_map(files(s, d), P)["kinds"].select("kind", "files", "bytes"),
    on_files(f"SELECT kind, {TWO} FROM files WHERE {LIVE} AND {HERE} GROUP BY kind"))
add("corpus_map_groups", lambda s, d: discover.corpus_map(files(s, d), P, fr.projects(s, d))["ledger_groups"],
    'SELECT p_brand AS "group", count(*) OVER (PARTITION BY p_brand) AS projects, concat(\'P\', p_partkey) AS id, p_name AS name FROM part')
add("corpus_map_rules", lambda s, d: discover.corpus_map(ruled(s, d), P)["rules"],
    f"""SELECT '/vault/src0/rules.md' AS path, row_number() OVER (ORDER BY n_nationkey) - 1 AS position, {squeeze('n_name')} AS rule FROM nation""")
add("discover_ledger", lambda s, d: discover.discover_ledger(files(s, d), P), on_files(LEDGERS))
add("discover_rules", lambda s, d: discover.discover_rules(files(s, d), P), on_files(RULES))
TITLED = f"coalesce(nullif({squeeze('title')}, ''), name)"
add("entry_docs", lambda s, d: discover.entry_docs(files(s, d), P),
    on_files(f"SELECT rel, path, {clip(TITLED, 80)} AS title, 'auto' AS origin, size, mtime_ms, pos AS position FROM files JOIN (SELECT path, "
             f"row_number() OVER (ORDER BY score DESC, length(rel), rel) AS pos FROM ({ENTRY_DOCS})) USING (path)"))


def configured(s, d):
    """The first two paths of the main root as configured entry documents."""
    first = meta(s, d).where("NOT gone AND root = '/vault/src0'").select("rel").orderBy("rel").limit(2).collect()
    return discover.entry_docs(files(s, d), P.with_(entry_docs=tuple(r.rel for r in first)))


LISTED = f"SELECT rel, row_number() OVER (ORDER BY rel) - 1 AS place FROM (SELECT rel FROM files WHERE {LIVE} AND root = '/vault/src0' ORDER BY rel LIMIT 2)"
add("entry_docs_configured", configured,
    on_files(f"SELECT rel, path, {clip(TITLED, 80)} AS title, 'config' AS origin, size, mtime_ms, place AS position FROM files JOIN ({LISTED}) USING (rel) WHERE {LIVE} AND root = '/vault/src0' "
             f"UNION ALL SELECT rel, path, {clip(TITLED, 80)} AS title, 'auto' AS origin, size, mtime_ms, 1 + pos AS position FROM files JOIN (SELECT path, row_number() OVER "
             f"(ORDER BY score DESC, length(rel), rel) AS pos FROM (SELECT * FROM ({ENTRY_DOCS}) WHERE depth = 0 AND rel NOT IN (SELECT rel FROM ({LISTED})))) USING (path)"))
add("discovery", lambda s, d: discover.discovery(files(s, d), P.with_(ledger_file="projects.json")),
    on_files(f"SELECT 'ledger' AS what, 'projects.json' AS rel, 'config' AS origin UNION ALL SELECT 'rules', rel, CASE WHEN rel IS NULL THEN 'none' "
             f"ELSE 'auto' END FROM (SELECT max(rel) AS rel FROM ({RULES}))"))
