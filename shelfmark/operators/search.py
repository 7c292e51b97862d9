"""Substring search over the files table: filters, weighted scores, exact totals, snippets."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import dates, paths
from shelfmark.functions.text import all_true, any_true, clip, count_occurrences, in_list, squeeze
from shelfmark.operators.ranking import each, top_k
from shelfmark.policy import DAY_MS, SANE_MTIME_MS, SEARCH_SCOPES, SEARCH_WEIGHTS, Policy

MAX_LIMIT = 200
MAX_QUERIES = 256
# How much of a body is shown, and what being young adds to a score.
PREVIEW_CHARS = 4000
SNIPPET_BEFORE, SNIPPET_AFTER, SNIPPET_FALLBACK = 60, 90, 150
KEYWORD_BEFORE, KEYWORD_CHARS = 70, 200
BOOSTS = ((30, 3), (90, 1))  # days, points; below ``recent_days`` it is six
BOOST_RECENT = 6
# End of fixed values.
MATCH_LABELS = {"name": "name", "rel": "path", "title": "title", "headings": "heading", "body": "body"}
SORTS = ("relevance", "recent", "oldest", "size", "name")


# -- filters ------------------------------------------------------------------------------------


def _words(value: str | Iterable[str] | None) -> list[str]:
    if value is None:
        return []
    items = value.replace(",", " ").split() if isinstance(value, str) else list(value)
    return [w.lower() for w in items if w]


def resolve_root(value: str, policy: Policy) -> str:
    """A root by its path, its label or its last path segment."""
    for pick in (lambda r: r.path, lambda r: r.label, lambda r: r.path.rstrip("/").rsplit("/", 1)[-1]):
        for root in policy.roots:
            if pick(root) == value:
                return root.path
    raise ValueError(f"unknown root: {value!r}")


def filter_files(files: DataFrame, policy: Policy, *, root: str | Sequence[str] | None = None,
                 path_prefix: str | None = None, kind: str | Iterable[str] | None = None,
                 ext: str | Iterable[str] | None = None, since=None, before=None, min_size: int | None = None,
                 max_size: int | None = None, include_denied: bool = False, include_gone: bool = False) -> DataFrame:
    """Conjunction of the given filters; every literal is folded here, so all of them can reach the scan."""
    out = files
    if not include_gone:
        out = out.where(~F.col("gone"))
    if not include_denied:
        out = out.where(~F.col("denied"))
    if root:
        wanted = [root] if isinstance(root, str) else list(root)
        out = out.where(F.col("root").isin(*[resolve_root(r, policy) for r in wanted]))
    if path_prefix:
        prefix = path_prefix.replace("\\", "/").rstrip("/")
        out = out.where(paths.under(F.col("rel"), prefix) | paths.under(F.col("path"), prefix))
    kinds = [k for k in _words(kind) if k not in ("any", "all")]
    if kinds:
        out = out.where(F.col("kind").isin(*kinds))
    exts = [e if e.startswith(".") else "." + e for e in _words(ext)]
    if exts:
        out = out.where(F.col("ext").isin(*exts))
    if (low := dates.since_ms(since, policy)) is not None:
        out = out.where(F.col("mtime_ms") >= low)
    if (high := dates.since_ms(before, policy)) is not None:
        out = out.where(F.col("mtime_ms") <= high)
    if min_size is not None:
        out = out.where(F.col("size") >= min_size)
    if max_size is not None:
        out = out.where(F.col("size") <= max_size)
    return out


def page(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows if the caller asks for a page, else all."""
    return rows if limit is None else rows.limit(limit)


def _limit(limit: int, most: int) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    return limit


# -- weighted multi-term search -----------------------------------------------------------------


def terms_of(query: str) -> list[str]:
    """All words of the query; every one of them must be found."""
    return [t.lower() for t in query.split()]


def field(name: str) -> Column:
    col = F.array_join("headings", "\n") if name == "headings" else F.col(name)
    return F.lower(F.coalesce(col, F.lit("")))


def match_condition(terms: Sequence[str], scope: str = "all", column: Callable[[str], Column] = field) -> Column:
    """Every term somewhere, cheap fields first: the body is only searched when no shorter field matched."""
    fields = SEARCH_SCOPES[scope]
    return all_true([any_true([F.contains(column(f), F.lit(t)) for f in fields]) for t in terms])


def match_score(terms: Sequence[str], scope: str = "all", column: Callable[[str], Column] = field) -> Column:
    parts = [
        F.when(F.contains(column(f), F.lit(t)), F.lit(SEARCH_WEIGHTS[f])).otherwise(F.lit(0))
        for t in terms for f in SEARCH_SCOPES[scope]
    ]
    total = F.lit(0)
    for p in parts:
        total = total + p
    return total.cast("int")


def matched_in(terms: Sequence[str]) -> Column:
    """For each term the first field it was found in, each field named once."""
    found = []
    for t in terms:
        label = F.lit(None).cast("string")
        for f in reversed(SEARCH_SCOPES["all"]):
            label = F.when(F.contains(field(f), F.lit(t)), F.lit(MATCH_LABELS[f])).otherwise(label)
        found.append(label)
    return F.array_distinct(F.array_compact(F.array(*found)))


def snippet(terms: Sequence[str]) -> Column:
    """60 characters before and 90 after the first term found in the body, else headings, title or the body's head."""
    body = F.coalesce(F.col("body"), F.lit(""))
    low = F.lower(body)
    out = F.lit(None).cast("string")
    for t in reversed(list(terms)):
        at = F.instr(low, F.lit(t))
        start = F.greatest(at - SNIPPET_BEFORE, F.lit(1))
        end = F.least(at - 1 + len(t) + SNIPPET_AFTER, F.length(body))
        cut = F.concat(
            F.when(start > 1, F.lit("…")).otherwise(F.lit("")),
            squeeze(F.substring(body, start, end - start + 1)),
            F.when(end < F.length(body), F.lit("…")).otherwise(F.lit("")),
        )
        out = F.when(at > 0, cut).otherwise(out)
    heads = clip(squeeze(F.array_join("headings", "\n")), SNIPPET_FALLBACK)
    head_of_body = clip(squeeze(body), SNIPPET_FALLBACK)
    return F.coalesce(out, F.nullif(heads, F.lit("")), F.nullif(clip(squeeze(F.col("title")), SNIPPET_FALLBACK), F.lit("")),
                      head_of_body)


def ranked(df: DataFrame, sort: str) -> DataFrame:
    """Order by one of the advertised sorts; ``path`` always decides last."""
    by = {
        "relevance": [F.desc("score"), F.desc("mtime_ms")],
        "recent": [F.desc("mtime_ms"), F.desc("score")],
        "oldest": [F.asc("mtime_ms")],
        "size": [F.desc("size")],
        "name": [F.lower("name").asc()],
    }
    if sort not in by:
        raise ValueError(f"sort must be one of {SORTS}")
    return df.orderBy(*by[sort], F.asc("path"))


def search_matches(files: DataFrame, query: str, policy: Policy, scope: str = "all", **filters) -> DataFrame:
    """All matching files with their score. Totals and pages are both taken from this frame."""
    if scope not in SEARCH_SCOPES:
        raise ValueError(f"scope must be one of {tuple(SEARCH_SCOPES)}")
    terms = terms_of(query)
    kept = filter_files(files, policy, **filters)
    return kept.where(match_condition(terms, scope)).withColumn("score", match_score(terms, scope))


def search_files(files: DataFrame, query: str, policy: Policy, *, scope: str = "all", sort: str | None = None,
                 limit: int = 20, **filters) -> DataFrame:
    """The best ``limit`` matches with score, matched fields and a snippet.

    Labels and snippets are computed after the limit, for the returned rows only.
    """
    terms = terms_of(query)
    order = sort or ("relevance" if terms else "recent")
    top = ranked(search_matches(files, query, policy, scope, **filters), order).limit(_limit(limit, MAX_LIMIT))
    return top.select(
        "path", "root", "rel", "name", "kind", "ext", "size", "mtime_ms", squeeze(F.col("title")).alias("title"),
        "score", matched_in(terms).alias("matched_in"), snippet(terms).alias("snippet"),
    )


def search_total(files: DataFrame, query: str, policy: Policy, scope: str = "all", limit: int = 20,
                 **filters) -> DataFrame:
    """One row: how many files match in truth, and whether a page of ``limit`` leaves some out."""
    return (
        search_matches(files, query, policy, scope, **filters)
        .agg(F.count(F.lit(1)).alias("total"))
        .withColumn("has_more", F.col("total") > limit)
    )


def recency_boost(hits: DataFrame, policy: Policy) -> DataFrame:
    """Re-rank rows that are already limited: young files gain up to six points."""
    age = (F.lit(policy.as_of_ms) - F.col("mtime_ms")) / F.lit(DAY_MS)
    boost = F.when(age <= policy.recent_days, BOOST_RECENT)
    for days, points in BOOSTS:
        boost = boost.when(age <= days, points)
    boost = boost.otherwise(0)
    return hits.withColumn("score", F.col("score") + boost).orderBy(F.desc("score"), F.desc("mtime_ms"), "path")


def search_many(files: DataFrame, queries: dict[str, str], policy: Policy, k: int = 20, scope: str = "all",
                **filters) -> DataFrame:
    """Many queries in one scan: (query, rank, path, score), the best ``k`` per query.

    The query list is a bounded literal in the plan, so nothing is joined: each file is tested once against
    every query and emits a row only where all terms were found. Ranking keeps ``k`` rows per query and task
    before it shuffles.
    """
    if not queries or len(queries) > MAX_QUERIES:
        raise ValueError(f"between 1 and {MAX_QUERIES} queries")
    fields = SEARCH_SCOPES[scope]
    lowered = filter_files(files, policy, **filters).select("path", "mtime_ms", *[field(f).alias(f"_{f}") for f in fields])
    # Every query reads the same lower-case columns, computed once per file.
    column = lambda f: F.col(f"_{f}")
    hits = F.array(*[
        F.when(
            match_condition(terms_of(text), scope, column),
            F.struct(F.lit(name).alias("query"), match_score(terms_of(text), scope, column).alias("score")),
        )
        for name, text in queries.items()
    ])
    found = each(lowered, ["path", "mtime_ms"], hits, "_h").select("path", "mtime_ms", "_h.query", "_h.score")
    order = [F.desc("score"), F.desc("mtime_ms"), F.asc("path")]
    return top_k(found, ["query"], order, k, "rank").select("query", "rank", "path", "score")


# -- keyword search with hit counts -------------------------------------------------------------


def search_keyword(files: DataFrame, keyword: str, policy: Policy, kinds: Iterable[str] = (),
                   top_dir: str | None = None, since_days: float | None = None, limit: int | None = None) -> DataFrame:
    """One keyword: where it was found, how often in the body, and a cut of the body around it."""
    q = keyword.strip().lower()
    if not q:
        return files.limit(0).select("path")
    rows = files.where(~F.col("gone"))
    if kinds := list(kinds):
        rows = rows.where(F.col("kind").isin(*kinds))
    if top_dir is not None:
        rows = files_in_filter(rows, top_dir)
    if since_days is not None:
        rows = rows.where(F.col("mtime_ms") > policy.cutoff_ms(since_days))
    in_name, in_body, in_rel = (F.contains(field(f), F.lit(q)) for f in ("name", "body", "rel"))
    scored = rows.where(in_name | in_rel | in_body).withColumn(
        "score",
        (F.when(in_name, 100).otherwise(0) + F.when(in_body, 40).otherwise(0) + F.when(in_rel, 20).otherwise(0)),
    )
    top = page(scored.orderBy(F.desc("score"), F.desc("mtime_ms"), "path"), limit)
    at = F.instr(field("body"), F.lit(q))
    cut = F.substring(F.col("body"), F.greatest(at - KEYWORD_BEFORE, F.lit(1)), F.lit(KEYWORD_CHARS))
    why = F.when(F.col("body_chars") > 0, F.lit("found in the name or path, not in the body")).otherwise(
        F.concat(F.lit("no body ("), F.col("kind"), F.lit("); found by name or path"))
    )
    return top.select(
        "path", "rel", "name", "kind", "size", "mtime_ms", "score",
        F.when(in_name, "name").when(in_body, "body").when(in_rel, "path").alias("matched_in"),
        count_occurrences(field("body"), q).alias("hit_count"),
        F.when(at > 0, cut).otherwise(why).alias("snippet"),
    )


def search_simple(files: DataFrame, keyword: str, limit: int | None = None) -> DataFrame:
    """Name matches first, then the newest; an empty keyword lists the text assets."""
    q = keyword.strip().lower()
    if not q:
        return text_assets(files, limit)
    hit = {f: F.contains(field(f), F.lit(q)) for f in ("name", "rel", "body")}
    found = (
        files.where(~F.col("gone") & (hit["name"] | hit["rel"] | hit["body"]))
        .withColumn("name_hit", hit["name"])
        .select("path", "rel", "name", "kind", "size", "mtime_ms", "name_hit")
        .orderBy(F.desc("name_hit"), F.desc("mtime_ms"), "path")
    )
    return page(found, limit)


# -- listings -----------------------------------------------------------------------------------


def text_assets(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Live text files that have a body, newest first, with a preview and the true length."""
    rows = files.where(~F.col("gone") & F.col("is_text") & ~F.col("is_binary") & (F.col("body_chars") > 0)).select(
        "path", "rel", "name", "kind", "size", "mtime_ms", F.substring("body", 1, PREVIEW_CHARS).alias("preview"),
        "body_chars", "truncated")
    return page(rows.orderBy(F.desc("mtime_ms"), "path"), limit)


def all_files(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Live files, the largest first, links left out."""
    rows = files.where(~F.col("gone") & ~F.col("is_symlink")).select(
        "path", "rel", "name", "ext", "kind", "size", "mtime_ms", "body_chars")
    return page(rows.orderBy(F.desc("size"), "path"), limit)


def recent_files(files: DataFrame, limit: int = 12) -> DataFrame:
    return (
        files.where(~F.col("gone") & (F.col("mtime_ms") > SANE_MTIME_MS))
        .select("path", "rel", "name", "kind", "size", "mtime_ms")
        .orderBy(F.desc("mtime_ms"), "path").limit(limit)
    )


def files_in_filter(files: DataFrame, top: str) -> DataFrame:
    if top == paths.LOOSE:
        return files.where(~F.contains(F.col("rel"), F.lit("/")))
    return files.where(paths.under(F.col("rel"), top))


def files_in(files: DataFrame, top: str, by: str = "size", limit: int | None = None) -> DataFrame:
    """Files below a folder (the empty name means loose in a root), largest first or by path."""
    order = {"size": [F.desc("size"), F.asc("path")], "rel": [F.asc("rel"), F.asc("path")]}[by]
    rows = files_in_filter(files.where(~F.col("gone")), top).select("path", "rel", "name", "kind", "size", "mtime_ms")
    return page(rows.orderBy(*order), limit)


def _listed(files: DataFrame, policy: Policy, root, path_prefix, since, max_depth, files_only) -> DataFrame:
    out = files.where(~F.col("gone"))
    if root:
        out = out.where(F.col("root") == resolve_root(root, policy))
    if path_prefix:
        p = path_prefix.replace("\\", "/").rstrip("/")
        out = out.where((F.col("rel") == p) | paths.under(F.col("rel"), p))
    if (low := dates.since_ms(since, policy)) is not None:
        out = out.where(F.col("mtime_ms") >= low)
    if max_depth is not None:
        out = out.where(paths.depth(F.col("rel")) <= max_depth)
    return out.where(~F.col("is_symlink")) if files_only else out


def list_files(files: DataFrame, policy: Policy, *, root: str | None = None, path_prefix: str | None = None,
               since=None, max_depth: int | None = None, files_only: bool = True, limit: int = 50) -> DataFrame:
    """Newest files under the given conditions."""
    rows = _listed(files, policy, root, path_prefix, since, max_depth, files_only)
    return (
        rows.select("path", "root", "rel", "name", "ext", "kind", "size", "mtime_ms", squeeze(F.col("title")).alias("title"))
        .orderBy(F.desc("mtime_ms"), "path").limit(_limit(limit, 500))
    )


def list_files_total(files: DataFrame, policy: Policy, *, root: str | None = None, path_prefix: str | None = None,
                     since=None, max_depth: int | None = None, files_only: bool = True) -> DataFrame:
    return _listed(files, policy, root, path_prefix, since, max_depth, files_only).agg(
        F.count(F.lit(1)).alias("total"))


def count_denied(files: DataFrame, policy: Policy, name_like: str | None = None, root=None,
                 path_prefix: str | None = None) -> DataFrame:
    """How many files policy keeps out of search, so that "excluded" and "absent" can be told apart."""
    rows = files.where(~F.col("gone") & F.col("denied"))
    if root:
        wanted = [root] if isinstance(root, str) else list(root)
        rows = rows.where(F.col("root").isin(*[resolve_root(r, policy) for r in wanted]))
    if path_prefix:
        p = path_prefix.replace("\\", "/").rstrip("/")
        rows = rows.where((F.col("rel") == p) | paths.under(F.col("rel"), p))
    if name_like:
        q = F.lit(name_like.lower())
        rows = rows.where(F.contains(F.lower("name"), q) | F.contains(F.lower("rel"), q))
    return rows.agg(F.count(F.lit(1)).alias("denied_files"))


# Extension groups of the item filter.
ITEM_GROUPS = {
    "doc": (".md", ".markdown", ".txt", ".rtf", ".doc", ".docx", ".pdf", ".pages", ".ppt", ".pptx", ".key", ".epub"),
    "sheet": (".xlsx", ".xls", ".csv", ".tsv", ".numbers"),
    "image": (".jpg", ".jpeg", ".png", ".gif", ".webp", ".heic", ".heif", ".tiff", ".bmp", ".svg"),
    "video": (".mp4", ".mov", ".avi", ".mkv", ".webm", ".m4v", ".flv"),
    "audio": (".mp3", ".wav", ".m4a", ".aac", ".flac", ".ogg"),
    "archive": (".zip", ".tar", ".gz", ".tgz", ".7z", ".rar", ".xz"),
    "code": (".swift", ".js", ".ts", ".py", ".rb", ".go", ".rs", ".kt", ".java", ".c", ".h", ".cpp", ".sh",
             ".html", ".css", ".json", ".yaml", ".yml", ".toml", ".sql"),
}
# End of fixed values.


def filter_items(files: DataFrame, group: str = "all", keyword: str = "", sort: str = "name",
                 ascending: bool = True) -> DataFrame:
    """Items of one extension group whose name or path holds the keyword, ordered either way."""
    if group != "all" and group not in ITEM_GROUPS:
        raise ValueError(f"group must be 'all' or one of {tuple(ITEM_GROUPS)}")
    out = files.where(~F.col("gone"))
    if group != "all":
        out = out.where(in_list(paths.DOTTED, ITEM_GROUPS[group]))
    if keyword:
        q = F.lit(keyword.lower())
        out = out.where(F.contains(F.lower("name"), q) | F.contains(F.lower("rel"), q))
    key = {"name": F.lower("name"), "size": F.col("size"), "date": F.col("mtime_ms")}[sort]
    return out.select("path", "rel", "name", "ext", "size", "mtime_ms").orderBy(
        key.asc() if ascending else key.desc(), "path")


def body_detail(files: DataFrame, path: str | None = None) -> DataFrame:
    """Body, truncation and policy flags by path; without a path, for all live files."""
    rows = files.where(~F.col("gone")) if path is None else files.where(F.col("path") == path)
    return rows.select("path", F.when(~F.col("denied"), F.col("body")).otherwise(F.lit("")).alias("body"),
                       "body_chars", "truncated", "denied")
