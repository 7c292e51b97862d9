"""Row types of the stored tables."""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
STRINGS = T.ArrayType(S)

# ``body_chars`` is stored beside the body so that reports about metadata never read the body column.
FILES = _struct(
    ("root", S, False), ("path", S, False), ("rel", S, False), ("name", S, False), ("ext", S, False),
    ("kind", S, False), ("size", L, False), ("mtime_ms", L, False), ("birthtime_ms", L, True),
    ("is_text", B, False), ("is_symlink", B, False), ("denied", B, False), ("is_binary", B, False),
    ("truncated", B, False), ("gone", B, False), ("title", S, False), ("headings", STRINGS, False), ("links", STRINGS, False),
    ("body", S, False), ("body_chars", L, False), ("content_hash", S, True), ("scan_id", L, False),
)

SCAN_RUNS = _struct(
    ("run_id", L, False), ("root", S, False), ("started_ms", L, True), ("finished_ms", L, True),
    ("files_seen", L, True), ("files_added", L, True), ("files_updated", L, True), ("files_removed", L, True),
    ("dirs_seen", L, True), ("skipped_dirs", L, True), ("errors", L, True), ("elapsed_ms", L, True),
    ("ok", B, True), ("detail", S, True),
)

CLAIMS = _struct(
    ("id", L, False), ("kind", S, False), ("target_type", S, False), ("target", S, False), ("verdict", S, True),
    ("note", S, False), ("source_ref", S, False), ("holder", S, False), ("signed_by", S, False),
    ("actor_type", S, False), ("authority", S, False), ("ts", L, False),
)

PROJECTS = _struct(
    ("id", S, False), ("name", S, False), ("group", S, False), ("kind", S, True), ("domains", STRINGS, False),
    ("repositories", STRINGS, False), ("note", S, False), ("routes", STRINGS, False),
)

MANIFEST = _struct(
    ("path", S, True), ("root", S, True), ("stable_id", S, True), ("role", S, True), ("author", S, True),
    ("original_date", S, True), ("source_type", S, True), ("parent_source_key", S, True),
    ("locator", S, True), ("source_title", S, True),
)

SUBMISSIONS = _struct(
    ("instance", S, False), ("stable_id", S, False), ("version_hash", S, False), ("source_key", S, False),
    ("part_index", I, False), ("part_total", I, False), ("locator", S, True), ("payload_digest", S, False),
    ("scope", S, False), ("source_type", S, False), ("role", S, False), ("payload_json", S, False),
    ("stage", S, False), ("source_id", S, True), ("job_id", S, True), ("attempts", L, False),
    ("last_error", S, True), ("last_error_kind", S, True),
)

TOMBSTONES = _struct(
    ("instance", S, False), ("stable_id", S, False), ("source_key", S, False), ("reason", S, False),
    ("state", S, False),
)

# Columns that decide whether a file has to be read again.
CHANGE_KEYS = ("size", "mtime_ms", "is_text", "denied")
# Columns that come from reading the content.
CONTENT_COLUMNS = ("title", "headings", "links", "body", "body_chars", "truncated", "is_binary", "content_hash")
