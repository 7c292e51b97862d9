"""The corpus frames once more, as SQL for the engine that checks the results."""

from __future__ import annotations

from shelfmark.functions.text import SPACE
from shelfmark.operators.extract import HEADING
from shelfmark.plans import frames as fr
from shelfmark.policy import MARKDOWN_EXTS, Policy

P: Policy = fr.POLICY


def words(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def kind_case(ext: str) -> str:
    return "CASE " + " ".join(
        f"WHEN {ext} IN ({words(exts)}) THEN '{kind}'" for kind, exts in P.kind_exts.items()) + " ELSE 'other' END"


def deny_test(name: str) -> str:
    return "(" + " OR ".join(f"lower({name}) GLOB '{g.lower()}'" for g in P.deny_globs) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}+', ' ', 'g'))"


def clip(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE substr({x}, 1, {n - 1}) || '…' END"


TITLE = f"""coalesce((SELECT CASE WHEN regexp_matches(l, '^#{{1,6}}\\s+') THEN {strip("regexp_replace(l, '^#{1,6}\\s+', '')")}
   ELSE substr(l, 1, 140) END
   FROM (SELECT list_filter(list_transform(string_split(body, chr(10)), lambda x: {strip('x')}),
     lambda x: x <> '' AND (regexp_matches(x, '^#{{1,6}}\\s+') OR NOT ((ext IN ({words(MARKDOWN_EXTS)}) AND
       regexp_matches(x, '^[-*_=]{{3,}}$')) OR (regexp_matches(x, '^[<>{{}}\\[\\]()]') AND length(x) < 8))))[1] AS l)), '')"""

HEADINGS = f"""CASE WHEN ext IN ({words(MARKDOWN_EXTS)}) THEN list_transform(regexp_extract_all(body, '{HEADING}'),
   lambda h: regexp_extract(h, '^(#{{1,6}})', 1) || ' ' ||
     {strip("regexp_extract(h, '^#{1,6}[ \\t]+(.+?)[ \\t]*#*[ \\t]*$', 1)")}) ELSE [] END"""

LISTING = f"""named AS (
  SELECT doc_id, lang, source, strlen(text) AS size, n_chars, text, {fr.ROOT} AS root, {fr.REL} AS rel,
    concat({fr.ROOT}, '/', {fr.REL}) AS path, concat({fr.STEM}, {fr.EXT}) AS name, {fr.EXT} AS ext,
    {fr.MTIME} AS mtime_ms, {fr.GONE} AS gone, {fr.SCAN_ID} AS scan_id
  FROM documents),
listing AS (
  SELECT *, {kind_case('ext')} AS kind, ext IN ({words(P.text_exts)}) AS is_text, {deny_test('name')} AS denied,
    regexp_extract(rel, '^(.*)/', 1) AS folder,
    CASE WHEN contains(rel, '/') THEN string_split(rel, '/')[1] ELSE '' END AS top_dir
  FROM named),
meta AS (
  SELECT *, is_text AND NOT denied AS readable, CASE WHEN is_text AND NOT denied THEN n_chars ELSE 0 END AS body_chars,
    CASE WHEN is_text AND NOT denied THEN text ELSE '' END AS body
  FROM listing)"""

FILES = f"""{LISTING},
files AS (SELECT *, {TITLE} AS title, array_to_string({HEADINGS}, chr(10)) AS headings FROM meta)"""

CLAIMS = "claims AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in fr.CLAIM_SQL.items()) + """,
  CAST(floor(epoch(ts)) AS BIGINT) AS ts, value FROM events)"""

CURRENT = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ts DESC, id DESC) AS rn
  FROM claims) WHERE rn = 1),
current AS (SELECT * FROM latest WHERE verdict IS DISTINCT FROM '撤回')"""

SCAN_RUNS = "scan_runs AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in fr.SCAN_RUN_SQL.items()) + """
  FROM orders)"""

SNAPSHOTS = f"""{LISTING},
marked AS (SELECT l.*, quality, toxic FROM listing l LEFT JOIN labels USING (doc_id)),
prev AS (SELECT * FROM marked WHERE coalesce(quality <> 0, true)),
cur AS (SELECT * EXCLUDE (size), CASE WHEN lang = 'es' THEN size + 1 ELSE size END AS size FROM marked
  WHERE coalesce(toxic <> 1, true)),
actions AS (
  SELECT coalesce(c.path, p.path) AS path, coalesce(c.root, p.root) AS root,
    CASE WHEN c.path IS NOT NULL AND p.path IS NOT NULL AND c.size = p.size AND c.mtime_ms = p.mtime_ms
        AND c.is_text = p.is_text AND c.denied = p.denied THEN 'reused'
      WHEN c.path IS NOT NULL AND p.path IS NOT NULL AND NOT p.gone THEN 'updated'
      WHEN c.path IS NOT NULL THEN 'added' WHEN p.gone THEN 'gone'
      WHEN p.root IN (SELECT root FROM cur) THEN 'removed' ELSE 'kept' END AS action
  FROM prev p FULL OUTER JOIN cur c ON p.path = c.path)"""


def over(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def on_meta(select: str) -> str:
    return over(LISTING, select)


def on_files(select: str) -> str:
    return over(FILES, select)


def on_claims(select: str) -> str:
    return over(f"{CLAIMS}, {CURRENT}", select)
