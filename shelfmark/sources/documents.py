"""Small documents that configure the work: the project ledger and the export manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.text import strip
from shelfmark.model import MANIFEST
from shelfmark.operators.export import attribute

# Accepted field names of a ledger, first match wins.
LIST_KEYS = ("projects", "items", "entries", "list", "rows", "records", "nodes")
TEXT_ALIASES = {
    "id": ("id", "key", "slug", "code"),
    "name": ("name", "title", "label"),
    "group": ("group", "category", "type", "section"),
    "kind": ("kind",),
    "note": ("note", "description", "desc", "summary"),
}
ARRAY_ALIASES = {
    "domains": ("domains", "urls", "sites"),
    "repositories": ("repositories", "repos", "git"),
    "routes": ("routes", "paths", "locations"),
}
MANIFEST_KEYS = tuple(f.name for f in MANIFEST.fields)
SCOPE_FORM = r"^agent:[a-z0-9-]+$"
# Keys under which a list makes a document look like a ledger.
SHAPE_KEYS = ("projects", "items", "entries", "list", "rows", "data")
# End of fixed values.

STRINGS = "array<string>"


def _first(value: Column, aliases: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object(value, f"$.{a}"), F.lit("")) for a in aliases])


def ledger_entries(text: Column) -> Column:
    """Entries of a ledger document as JSON texts: a list, an object with a list, or a map of objects."""
    is_list = lambda v: F.substring(F.ltrim(v), 1, 1) == "["
    as_list = lambda v: F.from_json(v, STRINGS)
    named = F.lit(None).cast(STRINGS)
    for key in reversed(LIST_KEYS):
        value = F.get_json_object(text, f"$.{key}")
        named = F.when(is_list(value), as_list(value)).otherwise(named)
    pairs = F.map_entries(F.from_json(text, "map<string,string>"))
    objects = F.filter(pairs, lambda e: F.substring(F.ltrim(e["value"]), 1, 1) == "{")
    # The key of a map stands for a missing id: it is put in front, so that an explicit id of the object wins.
    keyed = F.transform(
        objects,
        lambda e: F.concat(F.lit('{"_key":'), F.to_json(F.array(e["key"])), F.lit(","),
                           F.substr(F.ltrim(e["value"]), F.lit(2))),
    )
    mapped = F.when((F.size(pairs) > 0) & (F.size(objects) >= F.size(pairs) / 2), keyed)
    return F.when(is_list(text), as_list(text)).otherwise(F.coalesce(named, mapped))


def projects_from_json(texts: DataFrame, column: str = "value") -> DataFrame:
    """Ledger rows out of JSON documents; rows with neither id nor name are left out."""
    rows = texts.select(F.explode(ledger_entries(F.col(column))).alias("_e")).where(F.col("_e").startswith("{"))
    return _normalise(
        rows,
        lambda field: _first(F.col("_e"), TEXT_ALIASES[field]),
        lambda field: F.coalesce(*[
            F.when(F.substring(F.ltrim(v), 1, 1) == "[", F.from_json(v, STRINGS))
            for v in [_first(F.col("_e"), ARRAY_ALIASES[field])]
        ]),
        F.get(F.from_json(F.get_json_object("_e", "$._key"), STRINGS), F.lit(0)),
    )


def _normalise(rows: DataFrame, text, array, key: Column) -> DataFrame:
    clean = lambda c: F.coalesce(strip(c), F.lit(""))
    empty = F.array().cast(STRINGS)
    return rows.select(
        clean(F.coalesce(text("id"), key)).alias("id"), clean(text("name")).alias("name"),
        clean(text("group")).alias("group"), text("kind").alias("kind"),
        F.coalesce(array("domains"), empty).alias("domains"),
        F.coalesce(array("repositories"), empty).alias("repositories"),
        F.coalesce(text("note"), F.lit("")).alias("note"), F.coalesce(array("routes"), empty).alias("routes"),
    ).where((F.col("id") != "") | (F.col("name") != ""))


def projects_from_table(rows: DataFrame) -> DataFrame:
    """Ledger rows out of a table such as a CSV file; lists are cells split at ``;`` or ``|``."""
    have = {c.lower(): c for c in rows.columns}
    none = F.lit(None).cast("string")
    pick = lambda names: F.coalesce(*[F.nullif(F.col(f"`{have[a]}`").cast("string"), F.lit(""))
                                      for a in names if a in have], none)
    return _normalise(
        rows, lambda f: pick(TEXT_ALIASES[f]),
        lambda f: F.filter(F.transform(F.split(pick(ARRAY_ALIASES[f]), r"[;|]"), strip), lambda s: s != ""), none)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A ledger file, JSON or CSV. It is one document of a few megabytes at most."""
    if path.lower().endswith(".csv"):
        return projects_from_table(spark.read.csv(path, header=True))
    return projects_from_json(spark.read.text(path, wholetext=True))


def ledger_head(spark: SparkSession, path: str) -> DataFrame:
    """(baseline, scope, count_semantics) of a JSON ledger."""
    text = F.col("value")
    return spark.read.text(path, wholetext=True).select(
        _first(text, ("baseline", "baseline_date", "as_of")).alias("baseline"),
        _first(text, ("scope", "range")).alias("scope"),
        _first(text, ("count_semantics", "countSemantics")).alias("count_semantics"))


def ledger_shape(texts: DataFrame, column: str = "value", *keep: str | Column) -> DataFrame:
    """Does a candidate look like a list of things? (shape, entries), shape null when it does not."""
    text = F.col(column)
    keys = F.from_json(text, "map<string,string>")
    objects = F.filter(F.map_values(keys), lambda v: F.substring(F.ltrim(v), 1, 1).isin("{", "["))
    is_map = (F.size(keys) >= 3) & (F.size(objects) >= F.size(keys) / 2)
    shape, n = F.when(is_map, F.lit("map")), F.when(is_map, F.size(keys))
    for key in reversed(SHAPE_KEYS):
        size = F.json_array_length(F.get_json_object(text, f"$.{key}"))
        shape = F.when(size.isNotNull(), F.lit(f"object.{key}")).otherwise(shape)
        n = F.when(size.isNotNull(), size).otherwise(n)
    whole = F.json_array_length(text)
    return texts.select(*keep, F.when(whole.isNotNull(), F.lit("array")).otherwise(shape).alias("shape"),
                        F.when(whole.isNotNull(), whole).otherwise(n).alias("entries"))


def verify_ledgers(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(path, score, shape, entries) of the candidates whose content is a list of things.

    The candidates are a handful of small files, see ``discover_ledger``.
    """
    few = files.select("path", "body").join(F.broadcast(candidates.select("path", "ext", "score")), "path")
    lines = F.size(F.filter(F.split("body", "\n"), lambda line: strip(line) != ""))
    shapes = ledger_shape(few, "body", "path", "ext", "score", lines.alias("_lines"))
    csv = F.col("ext") == ".csv"
    return shapes.select(
        "path", "score",
        F.when(csv, F.when(F.col("_lines") >= 3, F.lit("csv"))).otherwise(F.col("shape")).alias("shape"),
        F.when(csv, F.col("_lines") - 1).otherwise(F.col("entries")).alias("entries"),
    ).where(F.col("shape").isNotNull())


# -- manifest -------------------------------------------------------------------------------------


def check_manifest(entries: DataFrame, default_root: str) -> DataFrame:
    """Manifest entries with attribution resolved and ``rejects`` for everything that is wrong with one.

    ``_unknown`` may hold the names of keys the format does not define.
    """
    rows = entries
    for name in MANIFEST_KEYS:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    path = F.trim(F.coalesce("path", F.lit("")))
    repeated = rows.groupBy(F.trim("path").alias("path")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    rows = attribute(rows.withColumns({
        "path": path, "root": F.coalesce(F.nullif(F.trim("root"), F.lit("")), F.lit(default_root))}))
    unknown = F.size("_unknown") > 0 if "_unknown" in rows.columns else F.lit(False)
    own = F.array_compact(F.array(
        F.when(unknown, F.lit("unknown-key")),
        F.when(F.col("path") == "", F.lit("path-missing")),
        F.when(F.col("path").startswith("/"), F.lit("path-not-relative")),
        F.when(F.array_contains(F.split("path", "/"), ".."), F.lit("path-goes-up")),
        F.when(F.col("_n").isNotNull(), F.lit("path-repeated")),
    ))
    return (
        rows.join(repeated, "path", "left").withColumn("rejects", F.concat(own, F.col("rejects")))
        .select(*MANIFEST_KEYS, "rejects")
    )


def read_manifest(spark: SparkSession, path: str, default_root: str = "") -> tuple[dict[str, str], DataFrame, DataFrame]:
    """({scope, instance, root}, good entries, rejected entries) of a manifest file."""
    text = spark.read.text(path, wholetext=True)
    head = text.select(
        _first(F.col("value"), ("scope",)).alias("scope"), _first(F.col("value"), ("instance",)).alias("instance"),
        _first(F.col("value"), ("primaryRoot",)).alias("root"),
        F.coalesce(F.json_array_length(F.get_json_object("value", "$.sources")), F.lit(0)).alias("n"),
        (F.coalesce(_first(F.col("value"), ("scope",)), F.lit(""))).rlike(SCOPE_FORM).alias("scope_ok"),
    ).first()  # one row
    if not head["scope_ok"]:
        raise ValueError(f"manifest scope {head['scope']!r} does not look like agent:name")
    if not head["n"]:
        raise ValueError("manifest sources must be a list with at least one entry")
    settings = {"scope": head["scope"], "instance": (head["instance"] or "default").strip(),
                "root": head["root"] or default_root}
    one = text.select(F.explode(F.from_json(F.get_json_object("value", "$.sources"), STRINGS)).alias("_e"))
    known = F.array(*[F.lit(k) for k in MANIFEST_KEYS])
    entries = one.select(
        *[F.get_json_object("_e", f"$.{k}").alias(k) for k in MANIFEST_KEYS],
        F.array_except(F.coalesce(F.json_object_keys("_e"), F.array().cast(STRINGS)), known).alias("_unknown"))
    checked = check_manifest(entries, settings["root"])
    bad = F.size("rejects") > 0
    return settings, checked.where(~bad).drop("rejects"), checked.where(bad)
