"""What a file name tells: its kind, whether it may be read, whether a machine or a habit made it up."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.paths import stem
from shelfmark.functions.text import CJK, contains_any, glob_regex, in_list, regex_escape, sql_list
from shelfmark.policy import MARKDOWN_EXTS, NAMING_VENDOR_MARKERS, Policy

# What counts as a copy suffix, a generated name and a camera default.
COPY_SUFFIX = r"(?:\s*\(\d+\)|\s*-\s*(?:副本|拷贝|复件)\s*\d*|\s+第?\d+\s*版)\s*$"
HEX_NAME = r"(?i)[0-9a-f]{32,}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
CAMERA_PREFIX = r"^(?:IMG_|DSC_|DSCN|VID_|MVIMG|PXL_|SCREENSHOT|MMEXPORT|WX_CAMERA)"
HAN = r"[㐀-鿿]"
LATIN_WORD = r"(?i)[a-z0-9][a-z0-9._-]*"
# End of fixed values.


def kind_of(policy: Policy, ext: str = "ext") -> Column:
    cases = " ".join(f"WHEN {ext} IN ({sql_list(exts)}) THEN '{kind}'" for kind, exts in policy.kind_exts.items())
    return F.expr(f"CASE {cases} ELSE 'other' END")


def is_text_ext(policy: Policy, ext: str = "ext") -> Column:
    return in_list(ext, policy.text_exts)


def is_markdown(ext: str = "ext") -> Column:
    return in_list(ext, MARKDOWN_EXTS)


def is_denied(name: Column, policy: Policy) -> Column:
    return name.rlike(glob_regex(policy.deny_globs))


def is_nav(name: Column, policy: Policy) -> Column:
    declared = [d for d in policy.entry_docs if "/" not in d]
    return name.rlike(glob_regex(policy.root_nav_globs)) | name.isin(*declared)


def vendored(rel: Column) -> Column:
    return contains_any(F.concat(F.lit("/"), rel, F.lit("/")), NAMING_VENDOR_MARKERS)


def version_words_regex(policy: Policy) -> tuple[str | None, str | None]:
    """(words that count anywhere, words that count at the end of a stem after a non-letter)."""
    words = [w for w in policy.version_words if w.strip()]
    han = [w for w in words if re.search(HAN, w)]
    latin = [w for w in words if w not in han and re.fullmatch(LATIN_WORD, w)]
    anywhere = "|".join(map(regex_escape, han)) or None
    at_end = rf"(?i)(?:^|[^a-z])(?:{'|'.join(map(regex_escape, latin))})\d*$" if latin else None
    return anywhere, at_end


def naming_reason(name: Column, policy: Policy) -> Column:
    """``copy-suffix``, ``version-word`` or null."""
    s = stem(name)
    anywhere, at_end = version_words_regex(policy)
    word = F.lit(False)
    if anywhere:
        word = word | s.rlike(anywhere)
    if at_end:
        word = word | s.rlike(at_end)
    copy = s.rlike(COPY_SUFFIX) if policy.detect_copy_suffix else F.lit(False)
    return F.when(copy, F.lit("copy-suffix")).when(word, F.lit("version-word"))


def looks_generated(name: Column) -> Column:
    """Hashes and UUIDs: long for a reason, and not a person's naming habit."""
    return stem(name).rlike(HEX_NAME)


def machine_named(name: Column) -> Column:
    """Names that carry no meaning: counters, encoded strings, camera and screenshot defaults."""
    s = stem(name)
    return (
        F.when(s == "", True)
        .when(s.rlike(r"^\p{N}{6,}$"), True)
        .when(s.startswith("eyJ") & (F.length(s) > 24), True)
        .when(s.rlike(r"^[0-9A-Fa-f]{16,}$"), True)
        .when(F.upper(s).rlike(CAMERA_PREFIX), True)
        .when(s.rlike(CJK), False)
        .when(F.length(F.regexp_replace(s, r"[^\p{L}]", "")) >= 3, False)
        .otherwise(True)
    )
