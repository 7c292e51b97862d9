"""Roll-ups, audits, triage, discovery and projects on a small workspace."""

import json

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import names, paths
from shelfmark.operators import audit, discover, links, projects, ranking, rollup, skew, triage
from shelfmark.policy import IGNORED_DIRS, Policy, merge_defaults
from shelfmark.sources import documents

AS_OF, DAY = 1_767_225_600_000, 86_400_000

WORKSPACE = {
    "00-从这里开始.md": "# 从这里开始\n\n- [规则](协作资料/文件管理规则.md)\n- [坏](协作资料/不存在.md)\n- [台账](项目管理/01-项目台账)\n- [out](/etc/x)\n"
                      "- [dir](项目管理/)\n- [twice](协作资料/不存在.md)\n- [up](../w/dup-a.txt)\n- [home](~/x.md)",
    "协作资料/文件管理规则.md": "# 文件管理方案\n\n## 日常规则\n\n1. **一份内容。**\n2. b\n\n## 其他\n\n1. no\n",
    "协作资料/README.md": "# Shared material\n\nx",
    "项目管理/01-项目台账.md": "# 项目管理台账\n",
    "项目管理/项目台账.json": json.dumps({"projects": [{"id": "P001"}]}),
    "项目管理/项目卡片/P001.md": "# P001",
    "项目管理/项目资料/P001-演示项目/方案.md": "# 方案\n" + "字" * 250,
    "待整理/old.txt": {"text": "waiting", "mtime_ms": AS_OF - 40 * DAY},
    "待整理/new.txt": {"text": "just arrived", "mtime_ms": AS_OF - 2 * DAY},
    "最终版-方案.md": "final",
    "dup-a.txt": {"text": "完全相同 repeated", "mtime_ms": AS_OF - 5 * DAY},
    "dup-b.txt": {"text": "完全相同 repeated", "mtime_ms": AS_OF - 4 * DAY},
    "输出/截图.png": {"size": 900},
    "输出/访谈.mp4": {"size": 5000, "mtime_ms": AS_OF - 500 * DAY},
    "输出/包.zip": {"size": 70},
    ".env": "TOKEN=1",
    "empty.md": "",
    "big.txt": {"size": 3 * 1024 * 1024},
}


@pytest.fixture()
def ws(make_files):
    return make_files(WORKSPACE)


@pytest.fixture()
def pol(policy):
    return policy.with_(inbox_dir="待整理", project_card_dir="项目管理/项目卡片", dir_notes={"输出": "outputs"})


def col(df, name="rel"):
    return {r[name] for r in df.collect()}


def test_coverage_ladder(make_files, policy):
    files = make_files({
        "a.md": "x", "fix.md": {"size": 10}, "chunk.txt": {"size": 3 * 1024 * 1024}, "x.pdf": {"size": 5}, "x.png": {"size": 5}, "x.mp3": {"size": 5},
        "x.zip": {"size": 5}, "x.db": {"size": 5}, "x.ttf": {"size": 5}, "x.unknown": {"size": 5}, ".env": "k", "empty.md": "", "gone.md": {"text": "x", "gone": True}})
    got = {r["name"]: r["bucket"] for r in files.withColumn("bucket", rollup.coverage_class(policy.with_(max_text_bytes=2 ** 21))).collect()}
    assert got == {"a.md": "ok", "fix.md": "fix", "chunk.txt": "chunk", "x.pdf": "extractor", "x.png": "ocr", "x.mp3": "asr", "x.zip": "unpack", "x.db": "nosql",
                   "x.ttf": "skip", "x.unknown": "skip", ".env": "excluded", "empty.md": "excluded", "gone.md": "excluded"}
    report = rollup.coverage_report(files, policy).orderBy("ladder").collect()
    assert [r["bucket"] for r in report][:2] == ["ok", "fix"] and sum(r["files"] for r in report) == 12
    assert rollup.coverage_totals(files, policy).first()["searchable_files"] == 1


def test_listing_counts_whole_subtrees_at_any_depth(ws):
    for depth in (1, 2, 3):
        rows = {r["entry"]: r for r in rollup.list_directory(ws, "/w", depth).where("entry_type = 'dir'").collect()}
        assert rows["项目管理"]["files"] == 4
        assert ("项目管理/项目资料" in rows) == (depth > 1)
    files = rollup.list_directory(ws, "/w/项目管理", 1).where("entry_type = 'file'")
    assert col(files, "entry") == {"01-项目台账.md", "项目台账.json"}
    assert rollup.list_directory(ws, "/w", 1, dirs_only=True).where("entry_type = 'file'").count() == 0
    assert rollup.directory_total(ws, "/w/项目管理/").first()["files"] == 4
    with pytest.raises(ValueError):
        rollup.list_directory(ws, "/w", 7)


def test_months_without_files_count_zero(make_files, policy):
    files = make_files({"a.md": {"mtime_ms": AS_OF - DAY}, "b.md": {"mtime_ms": AS_OF - 70 * DAY}, "zip.md": {"mtime_ms": 500_000_000_000}})
    got = {r["month"]: r["files"] for r in rollup.monthly_activity(files, policy, 4).collect()}
    assert got == {"2025-10": 1, "2025-11": 0, "2025-12": 1, "2026-01": 0}


def test_broken_links(ws, pol):
    got = {(r["rel"], r["link"]) for r in links.broken_links(ws, pol).collect()}
    assert got == {("00-从这里开始.md", "协作资料/不存在.md")}
    row = links.link_summary(ws, pol).first()
    assert (row["checked_links"], row["broken"]) == (5, 1)


def test_duplicates(ws, pol):
    group = audit.duplicate_groups(ws).collect()
    assert [(g["n"], g["keep_rel"], g["wasted_bytes"]) for g in group] == [(2, "dup-b.txt", group[0]["size"])]
    members = audit.duplicate_members(ws, pol)
    assert {(r["rel"], r["is_keeper"]) for r in members.collect()} == {("dup-a.txt", False), ("dup-b.txt", True)}


def test_files_are_equal_by_their_bytes(make_files, policy):
    """Files without a body, with front matter or cut bodies are compared by what they hold, not by what was taken from them."""
    files = make_files({
        "a.png": {"text": "p1", "size": 2}, "b.png": {"text": "p2", "size": 2}, "c.png": {"text": "p1", "size": 2},
        "x.md": "---\ntitle: a\n---\nsame", "y.md": "---\ntitle: b\n---\nsame", ".env": "p1"}, pol=policy.with_(max_body_chars=1))
    assert [(r["n"], r["keep_rel"]) for r in audit.duplicate_groups(files).collect()] == [(2, "c.png")]
    unread = files.withColumn("content_hash", F.when(F.col("ext") != ".png", F.col("content_hash")))
    row = audit.duplicate_summary(unread).first()
    assert (row["exact_groups"], row["not_compared"], row["not_compared_bytes"]) == (0, 3, 6)


def test_trim_to_bytes(spark):
    lines = spark.createDataFrame([("d", i, "行" * (i % 4)) for i in range(60)], "doc string, position int, line string")
    used, keep = 0, 0
    for i in range(60):
        used += 3 * (i % 4) + 1
        if used > 100:
            break
        keep += 1
    assert ranking.trim_to_bytes(lines, 120, 20).count() == keep


def test_naming(make_files, policy):
    files = make_files({f"d/{n}": "x" for n in (
        "report-final.md", "new-keystore.sh", "最终版方案.md", "报告 (1).md", "方案 - 副本.md", "稿 第2版.md", "News2x", "folder.gif", "v-final3.md", "finale.md",
        "copy.md", "x" * 61 + ".md", "a" * 0 + "0123456789abcdef" * 4 + ".bin")} | {"node_modules/final.md": "x"})
    assert col(audit.version_names(files, policy), "name") == {
        "report-final.md", "最终版方案.md", "报告 (1).md", "方案 - 副本.md", "稿 第2版.md", "v-final3.md", "copy.md"}
    assert col(audit.long_names(files), "name") == {"x" * 61 + ".md"}
    assert col(audit.version_names(files, policy.with_(version_words=("zz",), detect_copy_suffix=False)), "name") == set()


def test_unconfigured_is_not_zero(ws, policy, pol):
    row = audit.inbox_summary(ws, policy).first()
    assert row["configured"] is False and row["files"] is None
    with pytest.raises(ValueError):
        audit.inbox(ws, policy)
    got = {(r["check"], r["metric"]): r["value"] for r in audit.audit(ws, policy).collect()}
    assert got[("inbox", "configured")] == 0 and got[("inbox", "files")] is None
    got = {(r["check"], r["metric"]): r["value"] for r in audit.audit(ws, pol).collect()}
    assert (got[("inbox", "configured")], got[("inbox", "files")], got[("inbox", "overdue_files")]) == (1, 2, 1)
    assert (got[("stale", "files")], got[("links", "broken")], got[("duplicates", "exact_groups")], got[("naming", "matched")]) == (1, 1, 1, 3)
    with pytest.raises(ValueError):
        audit.audit(ws, pol, ["duplicates", "typo"])


def test_root_clutter_and_proposals(ws, pol):
    assert col(audit.root_clutter(ws, pol)) == {"最终版-方案.md", "dup-a.txt", "dup-b.txt", ".env", "empty.md", "big.txt"}
    got = {(r["category"], r["from_rel"], r["to_path"]) for r in audit.propose_organize(ws, pol).collect()}
    assert ("duplicates", "dup-a.txt", "归档/2026/重复副本/dup-a.txt") in got
    assert ("inbox-backlog", "待整理/old.txt", None) in got and ("root-clutter", "big.txt", "待整理/2026-01/big.txt") in got
    summary = {r["category"]: (r["proposals"], r["risks"]) for r in audit.proposal_summary(audit.propose_organize(ws, pol)).collect()}
    assert summary["version-names"] == (3, ["manual"]) and summary["root-clutter"] == (6, ["low"])
    unset = audit.propose_organize(ws, pol.with_(inbox_dir=None)).where("category = 'root-clutter'").first()
    assert (unset["action"], unset["to_path"], unset["risk"]) == ("triage", None, "manual")


def test_same_names(make_files, policy):
    big = {"text": "x" * 2000}
    files = make_files({"a/Note.md": big, "b/note.md": big, "c/README.md": big, "d/readme.md": big, "e/small.md": "x", "f/small.md": "x"})
    assert {(r["name_key"], r["n"]) for r in audit.same_name_groups(files).collect()} == {("note.md", 2)}
    assert col(audit.same_name(files, policy)) == {"a/Note.md", "b/note.md"}


@pytest.mark.parametrize("name,kind", [
    (".DS_Store", "junk"), ("LICENSE", "vendor"), ("x.INI", "config"), ("x.dmg", "installer"), ("m.gguf", "model"), ("l.so", "binary"), ("n.md", "prose"),
    ("notes", "prose"), ("t.json", "structured"), ("c.swift", "code"), ("IMG_3188.PNG", "media"), ("l.svg", "asset"), ("wechat.xyz", "comms"),
    ("simple.xyz", "unknown"), ("a im b.xyz", "comms"), ("im-3.xyz", "comms"), ("time.xyz", "unknown"), ("m.eml", "comms"), ("x.webm2", "unknown")])
def test_content_types(make_files, name, kind):
    got = make_files({name: "x"}).select(triage.content_type()).first()[0]
    assert got == kind


@pytest.mark.parametrize("name,machine", [
    ("1000002066.jpg", True), ("IMG_20260918.jpg", True), ("eyJwIjoi" + "x" * 20 + ".mp4", True), ("deadbeefdeadbeef.bin", True), ("说明.pdf", False),
    ("ab.md", True), ("abc.md", False), ("screenshot 1.png", True), ("12345.txt", True), ("a1b2.txt", True)])
def test_machine_names(spark, name, machine):
    assert spark.range(1).select(names.machine_named(F.lit(name))).first()[0] is machine


def test_tiers_and_reasons(make_files, policy):
    long = "w" * 300
    files = make_files({
        "readme.md": long, "notes/deep.md": long, "notes/short.md": "x", "code/x.py": long, "pic.png": {"size": 9}, "setup.dmg": {"size": 9}, "a/archive/old.md": long,
        "a/归档/readme.md": long + "2", "node_modules/y/readme.md": long + "33", "one/same.txt": "equal text", "two/same.txt": "equal text", "empty.md": "", "conf.ini": "k=v",
        "odd.zzz": {"size": 3}, "gone.md": {"text": long, "gone": True}})
    got = {r["rel"]: r for r in triage.triage(files, policy).collect()}
    tiers = {k: r["tier"] for k, r in got.items()}
    assert tiers == {"readme.md": 0, "notes/deep.md": 1, "notes/short.md": 2, "code/x.py": 4, "pic.png": 3, "setup.dmg": 5, "a/archive/old.md": 2, "a/归档/readme.md": 2,
                     "node_modules/y/readme.md": 5, "one/same.txt": 2, "two/same.txt": 5, "empty.md": 5, "conf.ini": 5, "odd.zzz": 5}
    assert all(r["reasons"] for r in got.values())
    assert got["two/same.txt"]["copy_of"] == "/w/one/same.txt"
    order = [r["rel"] for r in triage.triage_order(triage.triage(files, policy), limit=2).collect()]
    assert order == ["readme.md", "notes/deep.md"]


def test_hot_groups_are_spread_and_stay_whole(spark, policy):
    rows = spark.createDataFrame([("same.md", 5, f"/w/{i:03d}") for i in range(60)] + [(f"n{i}", 1, f"/x/{i}") for i in range(40)],
                                 "name string, size long, path string")
    for hot in (10, 1000):
        marked = triage.mark_copies(rows, policy.with_(hot_group_rows=hot, salt_buckets=4))
        assert marked.count() == 100
        assert {r["path"] for r in marked.where("copy_of is null").collect()} == {"/w/000"} | {f"/x/{i}" for i in range(40)}
    groups = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    inner = skew.attach_group(rows, groups, ["name"], "path", policy.with_(hot_group_rows=2, salt_buckets=3), how="inner")
    assert inner.count() == 100 and {r["n"] for r in inner.where("name = 'same.md'").collect()} == {60}


def test_discovery(ws, pol):
    docs = [(r["rel"], r["score"]) for r in discover.discover_entry_docs(ws, pol).collect()]
    assert docs[:2] == [("00-从这里开始.md", 100), ("协作资料/README.md", 70)]
    notes = {r["top_dir"]: (r["note"], r["note_source"]) for r in discover.dir_notes(ws, pol).collect()}
    assert notes["协作资料"] == ("Shared material", "协作资料/README.md") and notes["输出"] == ("outputs", "config") and notes["项目管理"] == (None, None)
    assert [r["rel"] for r in discover.discover_ledger(ws, pol).collect()] == ["项目管理/项目台账.json"]
    checked = documents.verify_ledgers(discover.discover_ledger(ws, pol), ws).first()
    assert (checked["path"], checked["shape"], checked["entries"]) == ("/w/项目管理/项目台账.json", "object.projects", 1)
    assert discover.discover_rules(ws, pol).first()["rel"] == "协作资料/文件管理规则.md"
    configured = pol.with_(entry_docs=("dup-a.txt", "missing.md", "协作资料/README.md"))
    rows = [(r["rel"], r["origin"]) for r in discover.entry_docs(ws, configured).orderBy("position").collect()]
    assert rows == [("dup-a.txt", "config"), ("协作资料/README.md", "config"), ("00-从这里开始.md", "auto")]
    assert {(r["what"], r["origin"]) for r in discover.discovery(ws, pol.with_(rules_file="x.md")).collect()} == {("ledger", "auto"), ("rules", "config")}


def test_found_entry_docs_go_on_behind_the_configured_ones(ws, pol):
    for listed, want in ((("dup-a.txt", "协作资料/README.md"), [0, 1, 2]), (("dup-a.txt",), [0, 1]), ((), [1, 2])):
        rows = discover.entry_docs(ws, pol.with_(entry_docs=listed)).orderBy("position").collect()
        assert [r["position"] for r in rows][:3] == want


def test_ledger_candidates_are_checked_for_shape(make_files, policy):
    files = make_files({"projects.csv": "id,name\n1,a\n\n2,b\n", "a-ledger.csv": "id\n1", "registry.json": "not json", "inventory.json": "[1, 2, 3]",
                        "deep/er/than/projects.json": "[1]", "other.json": "[1]"})
    got = {(r["path"], r["shape"], r["entries"]) for r in documents.verify_ledgers(discover.discover_ledger(files, policy), files).collect()}
    assert got == {("/w/projects.csv", "csv", 2), ("/w/inventory.json", "array", 3)}


def test_corpus_map(ws, pol, spark):
    table = discover.corpus_map(ws, pol, documents.projects_from_json(spark.createDataFrame([(json.dumps([{"id": "a", "group": "g"}]),)], "value string")))
    assert set(table) == {"roots", "top_dirs", "kinds", "entry_docs", "rules", "discovery", "ledger_groups"}
    assert [r["rule"] for r in table["rules"].orderBy("position").collect()] == ["一份内容。", "b"]
    assert table["ledger_groups"].first()["group"] == "g"


@pytest.mark.parametrize("data,ids", [
    ([{"id": "a"}, {"slug": "b", "title": "B"}, {"note": "nobody"}, 5], ["a", "b"]),
    ({"items": [{"key": "k", "label": "L", "repos": ["r"], "urls": ["u"]}]}, ["k"]),
    ({"projects": [], "items": [{"id": "never"}]}, []),
    ({"x": {"name": "X"}, "y": {"id": "own", "name": "Y"}, "n": 1}, ["x", "own"]),
    ({"meta": 1, "other": 2, "z": {"id": "q"}}, []),
])
def test_ledger_shapes(spark, data, ids):
    df = documents.projects_from_json(spark.createDataFrame([(json.dumps(data),)], "value string"))
    assert sorted(r["id"] for r in df.collect()) == sorted(ids)


def test_ledger_fields_and_files(spark, scratch):
    entry = {"code": " c1 ", "name": "N", "category": "cat", "git": ["a/b"], "sites": ["s"], "locations": ["l"], "desc": "d", "kind": "k"}
    with open(scratch + "/l.json", "w") as f:
        json.dump({"baseline_date": "2026", "scope": "s", "entries": [entry]}, f)
    row = documents.read_ledger(spark, scratch + "/l.json").first().asDict()
    assert row == {"id": "c1", "name": "N", "group": "cat", "kind": "k", "domains": ["s"], "repositories": ["a/b"], "note": "d", "routes": ["l"]}
    assert documents.ledger_head(spark, scratch + "/l.json").first()["baseline"] == "2026"
    with open(scratch + "/l.csv", "w") as f:
        f.write("id,title,domains\n1,One,a.com;b.com\n,,\n")
    rows = documents.read_ledger(spark, scratch + "/l.csv").collect()
    assert [(r["id"], r["name"], r["domains"]) for r in rows] == [("1", "One", ["a.com", "b.com"])]


@pytest.mark.parametrize("text,shape,n", [
    ('{"items": [1, 2]}', "object.items", 2), ("[1, 2, 3]", "array", 3), ('{"a": {}, "b": {}, "c": 1}', "map", 3), ('{"a": {}}', None, None), ("nonsense", None, None)])
def test_ledger_shape(spark, text, shape, n):
    row = documents.ledger_shape(spark.createDataFrame([(text,)], "value string")).first()
    assert (row["shape"], row["entries"]) == (shape, n)


def test_find_project(ws, pol, spark):
    book = documents.projects_from_json(spark.createDataFrame([(json.dumps({"projects": [
        {"id": "P001", "name": "演示项目", "group": "测试分组", "domains": ["demo.example.com"], "repositories": ["demo/repo"], "note": "备注"},
        {"id": "P002", "name": "另一个项目", "group": "测试分组", "domains": ["other.example.com"]}]}),)], "value string"))
    got = projects.find_project(book, ws, {"id": "p001", "group": "测试分组", "url": "https://demo.example.com/x", "folder": "输出", "name": "演示"}, pol).collect()
    by = {(r["query"], r["rank"]): r for r in got}
    first = by[("id", 1)]
    # exact id 100, and the folder that carries the id adds 15
    assert (first["id"], first["score"], first["folder"], first["card_path"]) == ("P001", 115, "项目管理/项目资料/P001-演示项目", "/w/项目管理/项目卡片/P001.md")
    assert {by[("group", 1)]["score"], by[("group", 2)]["score"]} == {12}
    assert (by[("url", 1)]["id"], by[("url", 1)]["score"]) == ("P001", 35)
    assert (by[("folder", 1)]["source"], by[("folder", 1)]["score"], by[("folder", 1)]["name"]) == ("folder", 20, "输出")
    assert by[("name", 1)]["score"] == 45 + 15


def test_path_expressions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(paths.normalize(F.lit("/a/./b//../c/..//d"))) == "/a/d" and one(paths.normalize(F.lit("/../.."))) == "/"
    assert one(paths.folders_of(F.lit("a/b/c.md"))) == ["a", "a/b"] and one(paths.folders_of(F.lit("c.md"))) == []
    assert one(paths.ancestors(F.lit("/a/b"))) == ["/a", "/a/b"]
    for name, ext, stem in (("x.TAR.GZ", ".gz", "x.TAR"), (".env", "", ".env"), ("a.", ".", "a"), ("noext", "", "noext"), ("..x", "", "."), ("a..b", ".b", "a.")):
        assert one(paths.extension(F.lit(name))) == ext
        assert one(paths.stem(F.lit(name))) == stem


def test_defaults_can_only_be_added_to_or_cancelled():
    assert "build" not in merge_defaults(["!build", "mine"], IGNORED_DIRS) and "mine" in merge_defaults(["mine"], IGNORED_DIRS)
    assert merge_defaults(None, ("a",)) == ("a",) and merge_defaults([], ("a",)) == ("a",)
    assert Policy(as_of_ms=0).main_root == ""
