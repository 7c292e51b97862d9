"""Identity: stable ids, version hashes and the keys built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.paths import clean_rel
from shelfmark.policy import Policy

ID_HEX = 16

# Field order and separators decide the hash.
VERSION_FIELDS = ("stableId", "body", "role", "author", "originalDate", "locator", "parserVersion")
FIELD_SEP, VALUE_SEP, ABSENT = "\u001e", "\u001f", "\u0000"
# End of fixed values.


def short_sha(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, ID_HEX)


def short_hash(text: Column) -> Column:
    """Twelve hex digits, for grouping keys that need not resist collisions."""
    return F.substring(F.sha1(text), 1, 12)


def stable_id(root: Column, rel: Column) -> Column:
    return short_sha(F.concat_ws("\n", root, clean_rel(rel)))


def version_hash(values: dict[str, Column]) -> Column:
    """Absent and empty are different versions."""
    none = F.lit(None).cast("string")
    parts = [
        F.concat(F.lit(name + VALUE_SEP), F.coalesce(values.get(name, none).cast("string"), F.lit(ABSENT)))
        for name in VERSION_FIELDS
    ]
    return short_sha(F.concat_ws(FIELD_SEP, *parts))


def source_key(sid: Column, vhash: Column, policy: Policy) -> Column:
    return F.concat_ws(":", F.lit(policy.key_prefix), sid, vhash)


def original_ref(sid: Column, vhash: Column, policy: Policy) -> Column:
    return F.concat(F.lit(policy.key_prefix + "://"), sid, F.lit("/"), vhash)


def ordinal(n: Column) -> Column:
    """``p0007``: four digits at least, more when the number needs them."""
    digits = n.cast("string")
    return F.concat(F.lit("p"), F.when(F.length(digits) >= 4, digits).otherwise(F.lpad(digits, 4, "0")))


def part_key(key: Column, n: Column) -> Column:
    return F.concat(key, F.lit("#"), ordinal(n))
