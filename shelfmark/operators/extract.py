"""Columns read out of file content: title, headings, body, links, rules, line windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import names, paths
from shelfmark.functions.text import CJK, SPACE, any_true, let, squeeze, strip
from shelfmark.operators.ranking import each
from shelfmark.policy import Policy

# Patterns and limits that decide what is extracted.
FRONT_MATTER = r"(?s)^---\n(.*?)\n---\n?"
HEADING = r"(?m)^#{1,6}[ \t]+.+?[ \t]*#*[ \t]*$"
MARKDOWN_LINK = r"\[[^\]]*\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)"
HTML_LINK = r"(?i)<a\s[^>]*?href=[\"']([^\"'>\s]+)[\"']"
SCHEME = r"(?i)^[a-z][a-z0-9+.-]*:"
RULE_SECTION = r"(?i)日常规则|命名|规范|rule|convention|guideline"
MAX_TITLE = 140
# End of fixed values.


def looks_binary(content: Column) -> Column:
    """A zero byte anywhere."""
    return F.contains(content, F.lit(bytearray(b"\x00")))


def decode_text(content: Column) -> Column:
    """UTF-8 with bad bytes replaced, no byte order mark, line feeds only."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.regexp_replace(F.regexp_replace(text, r"^\x{FEFF}", ""), r"\r\n?", "\n")


def front_matter(text: Column) -> Column:
    """Scalar ``key: value`` pairs between ``---`` fences at the very start, quotes stripped."""
    lines = F.filter(
        F.split(F.regexp_extract(text, FRONT_MATTER, 1), "\n"),
        lambda line: line.rlike(r"^[A-Za-z0-9_-]+\s*:"),
    )
    unquote = lambda v: F.regexp_replace(v, r"""(?s)^(?:"(.*)"|'(.*)')$""", "$1$2")
    pairs = F.transform(
        lines,
        lambda line: F.struct(
            F.regexp_extract(line, r"^([A-Za-z0-9_-]+)", 1).alias("key"),
            unquote(strip(F.regexp_extract(line, r"^[A-Za-z0-9_-]+\s*:(.*)$", 1))).alias("value"),
        ),
    )
    # A repeated key keeps its last value.
    last = let(
        pairs,
        lambda ps: F.filter(
            ps,
            lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["key"] == p["key"]),
        ),
    )
    return F.map_from_entries(last)


def without_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, FRONT_MATTER, "")


def headings(body: Column, limit: int | None = None) -> Column:
    """``## Name`` for every heading line, closing hashes removed."""
    raw = F.regexp_extract_all(body, F.lit(HEADING), F.lit(0))
    clean = F.transform(
        raw,
        lambda h: F.concat(
            F.regexp_extract(h, r"^(#{1,6})", 1), F.lit(" "),
            strip(F.regexp_extract(h, r"^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$", 1)),
        ),
    )
    named = F.filter(clean, lambda h: ~h.rlike(r"^#{1,6} $"))
    return named if limit is None else F.slice(named, 1, limit)


def _first_line(skip_rules: bool) -> str:
    """Pattern of the first line that can serve as a title; matching stops there, whatever follows."""
    blank = SPACE.replace(r"\s", r"[^\S\n]")
    solid = SPACE.replace("[", "[^", 1)
    bracket = rf"[<>{{}}\[\]()](?:[^\n]{{0,5}}{solid})?{blank}*$"
    rule = rf"|[-*_=]{{3,}}{blank}*$" if skip_rules else ""
    return rf"(?md)^{blank}*+(?!{bracket}{rule})({solid}[^\n]*)$"


def first_line_title(body: Column, markdown: Column) -> Column:
    """The first usable line: not blank, not a rule of dashes in Markdown, not a short bracket line.

    A heading gives its text, any other line is cut at 140 characters.
    """
    found = F.when(markdown, F.regexp_extract(body, _first_line(True), 1)).otherwise(
        F.regexp_extract(body, _first_line(False), 1))
    return let(strip(found), lambda line: F.when(
        line.startswith("#") & line.rlike(r"^#{1,6}\s+"), strip(F.regexp_replace(line, r"^#{1,6}\s+", ""))
    ).otherwise(F.substring(line, 1, MAX_TITLE)))


def title_of(body: Column, matter: Column, markdown: Column) -> Column:
    declared = F.coalesce(
        F.nullif(F.element_at(matter, "title"), F.lit("")), F.nullif(F.element_at(matter, "name"), F.lit(""))
    )
    return F.coalesce(strip(declared), first_line_title(body, markdown))


def extract_text(docs: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """Title, headings, links and body of already decoded text; keeps the other columns of ``docs``."""
    md = names.is_markdown()
    staged = docs.withColumn("_fm", F.when(md, front_matter(F.col(text)))).withColumn(
        "_body", F.when(md, without_front_matter(F.col(text))).otherwise(F.col(text))
    )
    whole, cap = F.col("_body"), policy.max_body_chars
    return staged.withColumns({
        "title": title_of(F.col("_body"), F.col("_fm"), md),
        "headings": F.when(md, headings(F.col("_body"), policy.max_headings))
        .otherwise(F.array().cast("array<string>")),
        "body": whole if cap is None else F.substring(whole, 1, cap),
        "links": F.when(md, F.array_distinct(local_links(whole))).otherwise(F.array().cast("array<string>")),
        "truncated": F.lit(False) if cap is None else F.length(whole) > cap,
    }).drop("_fm", "_body").withColumn("body_chars", F.length("body").cast("bigint"))


def extract_documents(raw: DataFrame, policy: Policy) -> DataFrame:
    """Turn listed files with a binary ``content`` column into rows of the files table.

    Text is taken only from text files that policy lets us read, within its size limit if it sets one. The hash
    is that of the bytes as they are, before anything is decoded or cut; files that may not be read have none.
    """
    readable = F.col("is_text") & ~F.col("denied") & (F.col("size") > 0)
    if policy.max_text_bytes is not None:
        readable = readable & (F.col("size") <= policy.max_text_bytes)
    if "content_hash" not in raw.columns:
        raw = raw.withColumn("content_hash", F.when(~F.col("denied"), F.sha2("content", 256)))
    sniffed = raw.withColumn("is_binary", readable & F.coalesce(looks_binary(F.col("content")), F.lit(False)))
    decoded = sniffed.withColumn(
        "text",
        F.when(readable & ~F.col("is_binary"), F.coalesce(decode_text(F.col("content")), F.lit("")))
        .otherwise(F.lit("")),
    )
    return extract_text(decoded, policy).drop("text", "content")


def local_links(body: Column, syntax: str = "markdown") -> Column:
    """Targets of links that stay on this store: no scheme, no bare fragment, fragment cut, URL-decoded."""
    pattern = {"markdown": MARKDOWN_LINK, "html": HTML_LINK}[syntax]
    found = F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
    local = F.filter(found, lambda t: ~t.rlike(SCHEME) & ~t.startswith("#"))
    cut = F.filter(F.transform(local, lambda t: F.substring_index(t, "#", 1)), lambda t: t != "")
    # A plus sign is literal in a path, while the URL decoder reads it as a blank.
    return F.transform(
        cut, lambda t: F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t)
    )


def extract_links(docs: DataFrame, syntax: str = "markdown", body: str = "body") -> DataFrame:
    """One row per distinct link of a document."""
    keep = [c for c in docs.columns if c != body]
    return each(docs, keep, F.array_distinct(local_links(F.col(body), syntax)), "link")


def rules_of(body: Column, limit: int | None = None) -> Column:
    """Numbered items under ``##`` headings about rules, as an array of one-line texts.

    Sections are cut at ``##`` lines, so nothing has to be carried from line to line.
    """
    text = F.regexp_replace(F.regexp_replace(body, r"\r\n?", "\n"), rf"(?m)^[ \t]+|[ \t]+$", "")
    sections = F.filter(
        F.split(F.concat(F.lit("\n"), text), r"\n(?=##[ \t])"),
        lambda s: s.rlike(r"^##[ \t]") & F.substring_index(s, "\n", 1).rlike(RULE_SECTION),
    )
    items = F.flatten(
        F.transform(sections, lambda s: F.regexp_extract_all(s, F.lit(r"(?m)^\d+\.[ \t]+(.*)$"), F.lit(1)))
    )
    taken = items if limit is None else F.slice(items, 1, limit)
    return F.transform(taken, lambda i: squeeze(F.replace(i, F.lit("**"), F.lit(""))))


def extract_rules(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """(path, position, rule) for every rules document in ``docs``."""
    return docs.select("path", F.posexplode_outer(rules_of(F.col("body"), limit)).alias("position", "rule")).where(
        F.col("rule").isNotNull())


def line_window(files: DataFrame, path: str | None = None, start: int = 1, n: int = 400,
                numbered: bool = True) -> DataFrame:
    """Lines ``start`` … ``start + n - 1`` of a body, with the total and whether more follow.

    Without ``path`` every document gets its window. Denied files give their row without content.
    """
    if start < 1 or not 1 <= n <= 5000:
        raise ValueError("start must be at least 1 and n between 1 and 5000")
    rows = files if path is None else files.where(F.col("path") == path)
    lines = F.split(F.col("body"), "\n")
    cut = rows.where(~F.col("denied")).select(
        "path", F.size(lines).alias("total_lines"), F.slice(lines, start, n).alias("_lines")
    )
    width = F.length((F.lit(start - 1) + F.size("_lines")).cast("string"))
    text = (
        F.transform("_lines", lambda l, i: F.concat(F.lpad((i + start).cast("string"), width, F.lit(" ")), F.lit("| "), l))
        if numbered else F.col("_lines")
    )
    return cut.select(
        "path", "total_lines", F.lit(start).alias("start_line"), F.size("_lines").alias("returned_lines"),
        (F.lit(start - 1) + F.size("_lines") < F.col("total_lines")).alias("has_more"),
        F.array_join(text, "\n").alias("content"),
    )


def repeating_ngrams(files: DataFrame, n: int = 2, min_count: int = 2, char_class: str = CJK) -> DataFrame:
    """(path, ngram, hits): character n-grams that occur at least ``min_count`` times in one body.

    Counting happens inside the row: sorting the n-grams of a body puts equal ones side by side, and a run of them is cut out of the joined
    list, which costs as much as the text is long. An n-gram that can overlap itself is counted once more, without overlaps. The body itself goes no further than this row.
    """
    # Each match is one code point, so that none begins inside another; one that begins no n-gram gives an empty text.
    grams = F.regexp_extract_all("body", F.lit(f"(?s)(?:(?=({char_class}{{{n}}}))|)."), F.lit(1))
    joined = F.array_join(F.array_sort(F.array_remove(grams, "")), "")
    runs = F.regexp_extract_all(joined, F.lit(f"(?s)(.{{{n}}})\\1*+"), F.lit(0))
    often = F.transform(F.filter(runs, lambda r: F.length(r) >= n * min_count), lambda r: F.struct(
        F.substring(r, 1, n).alias("g"), F.floor(F.length(r) / n).alias("n")))

    def apart(g: Column) -> Column:
        return F.floor((F.length("body") - F.length(F.replace(F.col("body"), g, F.lit("")))) / n)

    def hits_of(x: Column) -> Column:
        overlaps = any_true([F.substring(x["g"], 1, k) == F.substring(x["g"], -k, k) for k in range(1, n)])
        return F.when(overlaps, apart(x["g"])).otherwise(x["n"])

    counted = F.transform(often, lambda x: F.struct(x["g"].alias("ngram"), hits_of(x).alias("hits")))
    kept = F.filter(counted, lambda x: x["hits"] >= min_count)
    return each(files.where(F.length("body") > 0), ["path"], kept, "_x").select("path", "_x.ngram", "_x.hits")


def path_parts(files: DataFrame) -> DataFrame:
    """Top folder, depth, stem and chain of folders of every file."""
    rel = F.col("rel")
    return files.select(
        "path", paths.top_dir(rel).alias("top_dir"), paths.depth(rel).alias("depth"),
        paths.stem(F.col("name")).alias("stem"), paths.folders_of(rel).alias("folders"),
    )

