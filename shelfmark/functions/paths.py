"""Path and name expressions over ``/``-separated paths."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.text import any_true, let, regex_escape

LOOSE = ""  # the group of files that lie directly in a root


def posix(col: Column) -> Column:
    return F.regexp_replace(col, r"\\", "/")


def clean_rel(col: Column) -> Column:
    return F.regexp_replace(posix(col), r"^\./", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(name: Column) -> Column:
    """Lower-case, with its dot. A leading dot alone does not start an extension."""
    return F.lower(F.regexp_extract(name, r"(?s)^\.*[^.].*?(\.[^.]*)$", 1))


def stem(name: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")


# An extension in lower case with its dot, however it was stored.
DOTTED = "CASE WHEN ext = '' OR ext LIKE '.%' THEN lower(ext) ELSE concat('.', lower(ext)) END"


def depth(rel: Column) -> Column:
    return F.size(F.split(rel, "/")) - 1


def top_dir(rel: Column) -> Column:
    return F.when(F.contains(rel, F.lit("/")), F.substring_index(rel, "/", 1)).otherwise(F.lit(LOOSE))


def has_segment(rel: Column, names: Iterable[str]) -> Column:
    return F.lower(rel).rlike(f"(?:^|/)(?:{'|'.join(map(regex_escape, names))})(?:/|$)")


def under(path: Column, prefix: str) -> Column:
    return F.startswith(path, F.lit(prefix.rstrip("/") + "/"))


def inside_any(path: Column, folders: Iterable[str]) -> Column:
    return any_true([(path == F.lit(r.rstrip("/"))) | under(path, r) for r in folders])


def ancestors(path: Column) -> Column:
    """The path itself and every folder above it: ``/a/b/c`` gives ``/a``, ``/a/b``, ``/a/b/c``."""
    return let(
        F.split(path, "/"),
        lambda parts: F.filter(
            F.transform(
                F.sequence(F.lit(1), F.size(parts)),
                lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
            ),
            lambda p: p != "",
        ),
    )


def folders_of(rel: Column) -> Column:
    """Every folder on the way to a file: ``a/b/c.md`` gives ``a``, ``a/b``; nothing for a loose file."""
    return let(
        F.split(rel, "/"),
        lambda parts: F.when(
            F.size(parts) > 1,
            F.transform(
                F.sequence(F.lit(1), F.size(parts) - 1),
                lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )


def normalize(path: Column) -> Column:
    """Resolve ``.``, ``..`` and doubled separators of an absolute path."""
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))
