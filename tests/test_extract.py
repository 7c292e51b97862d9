import pytest
from pyspark.sql import functions as F

from shelfmark.operators import extract
from shelfmark.policy import Root
from shelfmark.sources import corpus, walk


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string" if isinstance(value, str) else "v binary").select(expr).first()[0]


def test_binary_and_decoding(spark):
    v = F.col("v")
    assert one(spark, b"ab\x00c", extract.looks_binary(v)) is True
    assert one(spark, b"\x10\x01 0", extract.looks_binary(v)) is False  # half-byte zeros are no zero byte
    assert one(spark, b"x" * 9000 + b"\x00", extract.looks_binary(v)) is True
    assert one(spark, b"\xef\xbb\xbfa\r\nb\rc\n", extract.decode_text(v)) == "a\nb\nc\n"
    assert one(spark, b"A\xff\xfeB\n", extract.decode_text(v)) == "A��B\n"


def test_front_matter(spark):
    text = "---\ntitle: \"A: b\"\nauthor : 'me'\nlist:\n - x\ntitle: last\n---\nBody\n"
    assert one(spark, text, extract.front_matter(F.col("v"))) == {"author": "me", "list": "", "title": "last"}
    assert one(spark, text, extract.without_front_matter(F.col("v"))) == "Body\n"
    assert one(spark, "x\n---\na: b\n---\n", extract.front_matter(F.col("v"))) == {}


def test_headings(spark):
    text = "# One #\n\n##\tTab\n### Three ## x ##\n####### seven\n#no\n## \n"
    assert one(spark, text, extract.headings(F.col("v"), 60)) == ["# One", "## Tab", "### Three ## x"]
    assert len(one(spark, "# h\n" * 80, extract.headings(F.col("v"), 60))) == 60


@pytest.mark.parametrize("text,md,title", [
    ("\n\n  # Head line  \nx", True, "Head line"),
    ("---\n***\nfirst", True, "first"),
    ("---\nfirst", False, "---"),
    ("{\n[1],\n<html>\nlonger than eight <b>", False, "longer than eight <b>"),
    ("[a long bracket line]\nx", False, "[a long bracket line]"),
    ("<html>x", False, "x" * 0 or ""),
    ("　  padded　", False, "padded"),
    ("y" * 200, False, "y" * 140),
    ("   \n\t\n", True, ""),
    ("(12345)\n(123456)", False, "(123456)"),
])
def test_titles(spark, text, md, title):
    assert one(spark, text, extract.first_line_title(F.col("v"), F.lit(md))) == title


def test_links(spark):
    text = ("[a](x.md) [b](http://h/x) [c](#frag) [d](y.md#part \"t\") [e](a%20b+c.md) [f](mailto:x@y) ![img](i.png) [g](%zz)")
    assert one(spark, text, extract.local_links(F.col("v"))) == ["x.md", "y.md", "a b+c.md", "i.png", "%zz"]
    html = "<a class='q' href='/one'>1</a><A HREF=\"two#x\">2</A><a href=\"https://h\">3</a>"
    assert one(spark, html, extract.local_links(F.col("v"), "html")) == ["/one", "two"]


def test_rules(spark):
    text = ("# 文件管理方案\n\n## 日常规则\n\n1. **根目录不堆新文件。** 明确\n2. 第二\n不是\n### 细节\n3. third\n\n## 其他\n\n1. no\n## Naming rules\n 10.  last \n")
    assert one(spark, text, extract.rules_of(F.col("v"))) == ["根目录不堆新文件。 明确", "第二", "third", "last"]


def test_line_window(make_files):
    files = make_files({"a.md": "1\n2\n3\n4", "secret.md": "x"})
    row = extract.line_window(files, "/w/a.md", 2, 2).first()
    assert (row["content"], row["total_lines"], row["returned_lines"], row["has_more"]) == ("2| 2\n3| 3", 4, 2, True)
    raw = extract.line_window(files, "/w/a.md", 3, 10, numbered=False).first()
    assert (raw["content"], raw["has_more"]) == ("3\n4", False)
    assert extract.line_window(files, "/w/secret.md").count() == 0


def test_repeating_ngrams_count_without_overlap(make_files):
    files = make_files({"a.md": "这里是项目资料,项目。哈哈哈", "b.md": "哈哈哈哈 ab ab"})
    got = {(r["path"], r["ngram"]): r["hits"] for r in extract.repeating_ngrams(files).collect()}
    assert got == {("/w/a.md", "项目"): 2, ("/w/b.md", "哈哈"): 2}


def test_repeating_ngrams_overlap_by_more_than_a_letter(make_files):
    files = make_files({"a.md": "abababab abab 😀😀😀😀", "b.md": "ababab"})
    grams = lambda n, least, kind: {(r["path"], r["ngram"]): r["hits"] for r in extract.repeating_ngrams(files, n, least, kind).collect()}
    assert grams(4, 2, "[a-z]") == {("/w/a.md", "abab"): 3}
    assert grams(2, 2, "[^a-z ]") == {("/w/a.md", "😀😀"): 2}
    assert grams(1, 5, "[a-z]") == {("/w/a.md", "a"): 6, ("/w/a.md", "b"): 6}


def test_scan_extract_and_prune(spark, policy, scratch):
    import os

    def put(rel, data):
        path = os.path.join(scratch, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)

    put("A.MD", b"---\ntitle: T\n---\n# H\r\nbody")
    put("bin.txt", b"a\x00b")
    put("empty.md", b"")
    put(".env", b"KEY=1")
    put("big.txt", b"z" * (2 * 1024 * 1024 + 5000))
    put("pic.png", b"\x89PNG")
    put("node_modules/x.js", b"1")
    put("tools/My.app/Contents/x.plist", b"1")
    put("tools/My.app/y.md", b"1")
    put(".DS_Store", b"1")
    put("a/b/c/d/e/f/deep.md", b"deep")
    roots = (Root(scratch, "r"), Root(scratch + "/missing", "m"))
    assert [r["missing"] for r in corpus.root_status(spark, roots).orderBy("label").collect()] == [True, False]
    os.symlink(scratch + "/A.MD", scratch + "/link.md")
    visible = {"A.MD", "bin.txt", "big.txt", "pic.png", "tools/My.app", "a/b/c/d/e/f/deep.md"}
    # Spark's file source follows links and leaves out hidden and empty files; the walk sees the tree as it is.
    listed = extract.extract_documents(corpus.scan_files(spark, roots, policy, with_content=True), policy)
    assert {r["rel"] for r in listed.collect()} == visible | {"link.md"}
    rows = walk.index_folders(spark, roots[:1], policy)
    got = {r["rel"]: r for r in rows.collect()}
    assert set(got) == visible | {".env", "empty.md", "link.md"}
    same = ("size", "mtime_ms", "kind", "title", "body", "is_binary", "denied")
    assert {r["rel"]: [r[c] for c in same] for r in listed.where("kind <> 'bundle' AND rel <> 'link.md'").collect()} == {
        k: [r[c] for c in same] for k, r in got.items() if k in visible and r["kind"] != "bundle"}
    assert (got["link.md"]["kind"], got["link.md"]["is_symlink"], got["link.md"]["body"]) == ("symlink", True, "")
    stats = {r["root"]: r for r in walk.walk_stats(walk.walk(spark, roots, policy)).collect()}
    assert (stats[scratch]["dirs_seen"], stats[scratch]["skipped_dirs"], stats[scratch]["missing"]) == (8, 2, False)
    assert stats[scratch + "/missing"]["missing"]
    a = got["A.MD"]
    assert (a["ext"], a["kind"], a["title"], a["headings"], a["body"]) == (".md", "doc", "T", ["# H"], "# H\nbody")
    assert got["bin.txt"]["is_binary"] and got["bin.txt"]["body"] == ""
    assert got[".env"]["denied"] and got[".env"]["body"] == "" and got[".env"]["title"] == ""
    assert len(got["big.txt"]["body"]) == 2 * 1024 * 1024 + 5000 and got["pic.png"]["content_hash"] and not got[".env"]["content_hash"]
    assert (got["tools/My.app"]["kind"], got["tools/My.app"]["size"]) == ("bundle", 0)
    shallow = corpus.scan_files(spark, roots[:1], policy.with_(max_depth=3))
    assert "a/b/c/d/e/f/deep.md" not in {r["rel"] for r in shallow.collect()}


def test_body_cap(spark, policy):
    docs = spark.createDataFrame([("x.md", ".md", "𝄞" * 50)], "path string, ext string, text string")
    row = extract.extract_text(docs, policy.with_(max_body_chars=20)).first()
    assert row["body"] == "𝄞" * 20 and row["truncated"] and row["body_chars"] == 20
