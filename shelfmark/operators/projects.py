"""Looking projects up in a ledger and in folder names.

Queries are a bounded literal list compiled into the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.operators.ranking import each, top_k
from shelfmark.operators.skew import attach_group
from shelfmark.policy import Policy

MAX_QUERIES = 256
SALTS = 16
# Points for what a query hits.
POINTS = {"id": 100, "id part": 40, "name": 90, "name part": 45, "in query": 30, "domain": 35, "repository": 30, "group": 12, "note": 8}
FOLDER_SCORE, FOLDER_BONUS = 20, 15
# End of fixed values.


def _queries(queries: dict[str, str]) -> dict[str, str]:
    clean = {k: " ".join(v.split()).lower() for k, v in queries.items()}
    if not clean or len(clean) > MAX_QUERIES or not all(clean.values()):
        raise ValueError(f"between 1 and {MAX_QUERIES} queries, none empty")
    return clean


def ledger_grounds(q: Column) -> Column:
    """What a lower-case query hits in a ledger row: an array of the names in ``POINTS``, at most one per field."""
    pid, name = F.lower(F.coalesce("id", F.lit(""))), F.lower(F.coalesce("name", F.lit("")))
    holds = lambda col: (col != "") & F.contains(col, q)
    domain = F.exists("domains", lambda d: F.contains(F.lower(d), q) | F.contains(q, F.lower(d)))
    repo = F.exists("repositories", lambda r: F.contains(F.lower(r), q))
    return F.array_compact(F.array(
        F.when((pid == q) & (pid != ""), "id").when(holds(pid), "id part"),
        F.when((name == q) & (name != ""), "name").when(holds(name), "name part")
        .when((F.length(name) >= 2) & F.contains(q, name), "in query"),
        F.when(domain, "domain"), F.when(repo, "repository"),
        F.when(holds(F.lower(F.coalesce("group", F.lit("")))), "group"),
        F.when(holds(F.lower(F.coalesce("note", F.lit("")))), "note")))


def points_of(grounds: Column) -> Column:
    points = F.lit(0)
    for name, value in POINTS.items():
        points = points + F.when(F.array_contains(grounds, name), value).otherwise(0)
    return points


def match_ledger(projects: DataFrame, queries: dict[str, str]) -> DataFrame:
    """(query, id, name, …, why, score) for every ledger row a query hits."""
    hits = F.array(*[
        F.struct(F.lit(key).alias("query"), ledger_grounds(F.lit(q)).alias("why"))
        for key, q in _queries(queries).items()
    ])
    found = each(projects, projects.columns, F.filter(hits, lambda h: F.size(h["why"]) > 0), "_h")
    return found.select("*", "_h.query", "_h.why").drop("_h").withColumn("score", points_of(F.col("why")))


def match_folders(files: DataFrame, queries: dict[str, str], policy: Policy) -> DataFrame:
    """(query, folder, segment) for every folder of the main root whose own name holds the query."""
    here = files.where(~F.col("gone") & (F.col("root") == policy.main_root))
    folders = each(here, [], paths.folders_of(F.col("rel")), "folder")
    segment = F.lower(paths.base_name(F.col("folder")))
    hit = F.array_compact(F.array(*[
        F.when(F.contains(segment, F.lit(q)), F.lit(key)) for key, q in _queries(queries).items()]))
    return (
        folders.where(F.size(hit) > 0).distinct()
        .select("folder", paths.base_name(F.col("folder")).alias("segment"), F.explode(hit).alias("query"))
    )


def find_project(projects: DataFrame, files: DataFrame, queries: dict[str, str], policy: Policy,
                 k: int = 8) -> DataFrame:
    """(query, rank, id, name, score, folder, source, card_path), best first.

    A folder that belongs to a project already hit raises that project; any other folder is an answer of its own.
    Projects hit and folders meet per query; folders are dealt over ``SALTS`` tasks, so a query that hits very many is no hot key.
    """
    ledger_hits = match_ledger(projects, queries)
    h = ledger_hits.select("query", "id", "name", "score", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).alias("h")
    f = match_folders(files, queries, policy).withColumn("salt", F.pmod(F.xxhash64("folder"), F.lit(SALTS)).cast("int")).alias("f")
    belongs = (((F.col("h.id") != "") & F.contains(F.col("f.folder"), F.col("h.id")))
               | ((F.col("h.name") != "") & F.contains(F.col("f.segment"), F.col("h.name"))))
    best = F.min(F.when(F.col("h.query").isNotNull(), F.struct((-F.col("h.score")).alias("o"), F.col("h.id").alias("id"), F.col("h.name").alias("name"))))
    owned = f.join(h, (F.col("f.query") == F.col("h.query")) & (F.col("f.salt") == F.col("h.salt")) & belongs, "left").groupBy(
        F.col("f.query").alias("query"), F.col("f.folder").alias("folder"), F.col("f.segment").alias("segment")).agg(best.alias("owner"))
    bonus = (
        owned.where(F.col("owner").isNotNull())
        .groupBy("query", F.col("owner.id").alias("id"), F.col("owner.name").alias("name"))
        .agg((F.count(F.lit(1)) * FOLDER_BONUS).alias("bonus"), F.min("folder").alias("folder"))
    )
    from_ledger = (
        ledger_hits.select("query", "id", "name", "score")
        .join(bonus, ["query", "id", "name"], "left")
        .select("query", "id", "name", (F.col("score") + F.coalesce("bonus", F.lit(0))).alias("score"), "folder",
                F.lit("ledger").alias("source"))
    )
    from_folders = owned.where(F.col("owner").isNull()).select(
        "query", F.lit("").alias("id"),
        F.regexp_replace("segment", r"^[A-Za-z]+\d+[-_]", "").alias("name"),
        F.lit(FOLDER_SCORE).cast("bigint").alias("score"), "folder", F.lit("folder").alias("source"))
    ranked = top_k(from_ledger.unionByName(from_folders), ["query"],
                   [F.desc("score"), F.desc("source"), F.asc("id"), F.asc("name"), F.asc("folder")], k)
    return with_cards(ranked, files, policy)


def with_cards(found: DataFrame, files: DataFrame, policy: Policy) -> DataFrame:
    """Add the path of the project card, where policy names a card folder and the card exists."""
    if not policy.project_card_dir:
        return found.withColumn("card_path", F.lit(None).cast("string"))
    folder = f"{policy.main_root.rstrip('/')}/{policy.project_card_dir}"
    cards = (
        files.where(~F.col("gone") & paths.under(F.col("path"), folder) & F.col("path").endswith(".md"))
        .select(F.col("path").alias("card_path"))
    )
    wanted = F.when(F.col("id") != "", F.concat(F.lit(folder + "/"), F.col("id"), F.lit(".md")))
    return found.withColumn("_card", wanted).join(cards, F.col("_card") == F.col("card_path"), "left").drop("_card")


def projects_by_group(projects: DataFrame, policy: Policy) -> DataFrame:
    """(group, projects, id, name): every ledger row with the size of its group."""
    rows = projects.withColumn("group", F.coalesce(F.nullif(F.col("group"), F.lit("")), F.lit("(none)")))
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    return attach_group(rows, sizes, ["group"], "id", policy).select(
        "group", F.col("n").alias("projects"), "id", "name")
