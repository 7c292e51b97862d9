import pytest

from shelfmark.functions import dates
from shelfmark.operators import search

AS_OF, DAY = 1_767_225_600_000, 86_400_000

FILES = {
    "readme.md": "# Start here\n\nThe plan for the Harbour and more text.",
    "notes/harbour.md": {"text": "# Harbour\n\nnothing else", "mtime_ms": AS_OF - 40 * DAY},
    "notes/İstanbul.md": "Größe and HARBOUR again: harbour, Harbour.",
    "notes/secret-harbour.md": "never shown",
    "old.md": {"text": "harbour plan", "gone": True},
    "pic/harbour.png": {"size": 900, "mtime_ms": AS_OF - 400 * DAY},
    "50%_done.txt": "literal percent and under_score",
}


def by_path(df, *cols):
    return {r["path"]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_terms_are_anded_and_fields_are_weighted(make_files, policy):
    files = make_files(FILES)
    got = by_path(search.search_files(files, "harbour plan", policy), "score", "matched_in")
    assert got == {"/w/readme.md": (10, ["body"])}
    got = by_path(search.search_files(files, "HARBOUR", policy), "score", "matched_in")
    # name 40, rel 18, title 16, headings 10; the body holds the heading line too
    assert got["/w/notes/harbour.md"] == (40 + 18 + 16 + 10 + 5, ["name"])
    assert got["/w/pic/harbour.png"] == (58, ["name"])
    assert got["/w/notes/İstanbul.md"][0] == 16 + 5
    assert "/w/notes/secret-harbour.md" not in got and "/w/old.md" not in got


def test_like_wildcards_are_plain_characters(make_files, policy):
    files = make_files(FILES)
    assert set(by_path(search.search_files(files, "50%_", policy), "score")) == {"/w/50%_done.txt"}
    assert search.search_files(files, "h_rbour", policy).count() == 0


def test_total_does_not_depend_on_limit(make_files, policy):
    files = make_files(FILES)
    assert search.search_files(files, "harbour", policy, limit=1).count() == 1
    for limit in (1, 4, 50):
        row = search.search_total(files, "harbour", policy, limit=limit).first()
        assert row["total"] == 4 and row["has_more"] == (4 > limit)


def test_denied_is_told_apart_from_absent(make_files, policy):
    files = make_files(FILES)
    assert search.search_files(files, "secret", policy).count() == 0
    assert search.count_denied(files, policy, "SECRET").first()[0] == 1
    assert search.count_denied(files, policy, "nowhere").first()[0] == 0
    assert search.body_detail(files, "/w/notes/secret-harbour.md").first()["body"] == ""


def test_snippet_windows_and_fallbacks(make_files, policy):
    long = "a" * 100 + " needle " + "b" * 200
    files = make_files({"x.md": long, "n.md": "## Only heading", "t.txt": "tiny"})
    cut = search.search_files(files, "needle", policy).first()["snippet"]
    assert cut == "…" + "a" * 59 + " needle " + "b" * 89 + "…"
    assert search.search_files(files, "n.md", policy).first()["snippet"] == "## Only heading"
    assert search.search_files(files, "t.txt", policy).first()["snippet"] == "tiny"


def test_filters_sorts_and_refusals(make_files, policy):
    files = make_files(FILES)
    got = [r["name"] for r in search.search_files(files, "", policy, sort="name", ext="md,TXT").collect()]
    assert got == sorted(got, key=str.lower) and len(got) == 4
    assert search.search_files(files, "", policy, kind="image").count() == 1
    assert search.search_files(files, "", policy, since="30d").count() == 3
    assert search.search_files(files, "", policy, root="work", path_prefix="notes/").count() == 2
    assert search.search_files(files, "", policy, root="extra").count() == 0
    for bad in ({"sort": "best"}, {"limit": 0}, {"limit": 201}, {"scope": "all files"}, {"root": "nope"}, {"since": "soon"}):
        with pytest.raises(ValueError):
            search.search_files(files, "x", policy, **bad)


def test_recency_boost_reorders_only_what_was_returned(make_files, policy):
    files = make_files({
        "a-word.md": {"text": "x", "mtime_ms": AS_OF - 200 * DAY},
        "b.md": {"text": "word word", "mtime_ms": AS_OF - 2 * DAY},
        "c.md": {"text": "word", "mtime_ms": AS_OF - 45 * DAY},
    })
    hits = search.search_files(files, "word", policy, limit=3)
    assert by_path(search.recency_boost(hits, policy), "score") == {"/w/a-word.md": 58, "/w/b.md": 27, "/w/c.md": 22}


def test_keyword_counts_hits(make_files, policy):
    files = make_files(FILES)
    got = by_path(search.search_keyword(files, "harbour", policy), "score", "matched_in", "hit_count")
    assert got["/w/notes/İstanbul.md"] == (40, "body", 3)
    assert got["/w/pic/harbour.png"] == (120, "name", 0)
    # the keyword search of one word shows names that policy keeps out of the weighted search
    assert got["/w/notes/secret-harbour.md"][0] == 120
    snip = by_path(search.search_keyword(files, "harbour", policy), "snippet")
    assert snip["/w/pic/harbour.png"].startswith("no body (image)")


def test_many_queries_agree_with_single_ones(make_files, policy):
    files = make_files(FILES)
    queries = {"h": "harbour", "two": "harbour plan", "none": "zzz"}
    many = search.search_many(files, queries, policy, k=3).collect()
    for name, text in queries.items():
        single = [(r["path"], r["score"]) for r in search.search_files(files, text, policy, limit=3).collect()]
        assert [(r["path"], r["score"]) for r in sorted(many, key=lambda r: r["rank"]) if r["query"] == name] == single


@pytest.mark.parametrize("text,days", [("7d", 7), ("24h", 1), ("2周", 14), ("3个月", 90), ("1.5 weeks", 10.5), (3, 3)])
def test_periods(policy, text, days):
    assert dates.since_ms(text, policy) == AS_OF - days * DAY


def test_dates(policy):
    assert dates.since_ms("2025-12-31", policy) == AS_OF - DAY
    assert dates.since_ms(1_700_000_000_000, policy) == 1_700_000_000_000
    assert dates.since_ms(None, policy) is None
