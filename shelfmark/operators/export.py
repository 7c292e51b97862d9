"""Export of documents as segmented, size-limited batches with stable keys.

Everything from body to batches happens inside one row per document: paragraphs, parts and batches are arrays, so
no text is ever shuffled. The arrays are as long as the document they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import keys
from shelfmark.functions.text import SPACE, let, prefix_sums
from shelfmark.policy import PLACEHOLDER_AUTHORS, ROLES, SOURCE_TYPES, Policy

# Where an oversize paragraph may be cut, and the limits of a payload.
BREAKS = "\n。！？；.!?;"
MAX_SOURCE_KEY, MAX_MESSAGE_ID, MAX_META_VALUE = 300, 100, 1000
META_KEYS = ("original_ref", "original_date", "author", "locator", "parser_version", "parent_source_key")
# End of fixed values.


# -- attribution ----------------------------------------------------------------------------------


def attribute(entries: DataFrame) -> DataFrame:
    """Resolve role, author, date and source type of manifest entries; ``rejects`` lists what is wrong.

    Unknown stays unknown: an unnamed role is ``external``, a missing author or date stays null.
    """
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    role, author, day = F.nullif(F.col("role"), F.lit("")), blank("author"), blank("original_date")
    kind, parent = F.nullif(F.col("source_type"), F.lit("")), F.nullif(F.col("parent_source_key"), F.lit(""))
    rejects = [
        F.when(~role.isin(*ROLES), F.lit("role")),
        F.when(F.lower(author).isin(*PLACEHOLDER_AUTHORS), F.lit("placeholder-author")),
        F.when(~day.rlike(r"^\d{4}-\d{2}-\d{2}$") | (day.isNotNull() & F.try_to_date(day, "yyyy-MM-dd").isNull()),
               F.lit("original-date")),
        F.when(~kind.isin(*SOURCE_TYPES), F.lit("source-type")),
        F.when((kind == "imported_summary") & parent.isNull(), F.lit("summary-without-parent")),
    ]
    return entries.withColumns({
        "rejects": F.array_compact(F.array(*rejects)),
        "role": F.coalesce(role, F.lit("external")), "author": author, "original_date": day,
        "source_type": F.coalesce(kind, F.lit("document")),
    })


def with_identity(docs: DataFrame, policy: Policy, body: str = "body") -> DataFrame:
    """Add stable id, version hash, source key and reference of a document.

    Needs ``root``, ``rel``, the body and the resolved attribution columns.
    """
    given = F.nullif(F.col("stable_id"), F.lit("")) if "stable_id" in docs.columns else F.lit(None).cast("string")
    staged = docs.withColumn("stable_id", F.coalesce(given, keys.stable_id(F.col("root"), F.col("rel"))))
    vhash = keys.version_hash({
        "stableId": F.col("stable_id"), "body": F.col(body), "role": F.col("role"), "author": F.col("author"),
        "originalDate": F.col("original_date"), "parserVersion": F.lit(policy.parser_version),
    })
    staged = staged.withColumn("version_hash", vhash)
    return staged.withColumns({
        "base_source_key": keys.source_key(F.col("stable_id"), F.col("version_hash"), policy),
        "original_ref": keys.original_ref(F.col("stable_id"), F.col("version_hash"), policy),
    })


# -- segmentation ---------------------------------------------------------------------------------


def paragraphs(text: Column) -> Column:
    """Paragraphs of a text as an array of strings that concatenate to the text again.

    A paragraph is a run of lines up to and including the blank lines behind it; blank lines at the very start
    belong to the first one.
    """
    def build(lines: Column) -> Column:
        flagged = F.transform(lines, lambda l: l.rlike(f"^{SPACE}*$"))
        starts = let(
            flagged,
            lambda blank: F.filter(
                F.sequence(F.lit(0), F.size(blank) - 1),
                lambda i: ~F.get(blank, i) & ((i == 0) | F.get(blank, i - 1)),
            ),
        )
        # Where the text starts with blank lines the first paragraph still starts at line 0.
        opened = F.concat(F.array(F.lit(0)), F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1))))
        return let(
            opened,
            lambda s: F.transform(
                s,
                lambda at, k: F.concat(
                    F.array_join(F.slice(lines, at + 1, F.coalesce(F.get(s, k + 1), F.size(lines)) - at), "\n"),
                    F.when(k + 1 < F.size(s), F.lit("\n")).otherwise(F.lit("")),
                ),
            ),
        )

    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(let(F.split(text, "\n"), build))


def hard_split(text: Column, budget: int) -> Column:
    """Cut a text into pieces of at most ``budget`` code points, each ending at a sentence where the last quarter
    of the piece has one."""
    quarter = budget // 4
    state = "struct<rest:string,pieces:array<string>>"
    steps = F.sequence(F.lit(1), F.ceil(F.length(text) / F.lit(max(budget - quarter, 1))).cast("int") + 1)

    def cut(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        tail_at = max(budget - quarter, 1)  # characters that stay in front of any cut
        tail = F.substring(rest, tail_at + 1, budget - tail_at)
        last = F.length(F.regexp_extract(tail, f"(?s)^.*[{BREAKS}]", 0))
        size = F.when(last > 0, last + tail_at).otherwise(F.lit(budget))
        full = F.length(rest) > budget
        return F.when(rest == "", acc).otherwise(F.struct(
            F.when(full, F.substr(rest, size + 1)).otherwise(F.lit("")).alias("rest"),
            F.concat(acc["pieces"], F.array(F.when(full, F.substr(rest, F.lit(1), size)).otherwise(rest)))
            .alias("pieces"),
        ))

    start = F.struct(text.alias("rest"), F.array().cast("array<string>").alias("pieces")).cast(state)
    return F.aggregate(steps, start, cut, lambda acc: acc["pieces"])


def parts_of(text: Column, policy: Policy) -> Column:
    """All parts of a text with position, locator and id; their texts concatenate to the text."""
    budget = policy.segment_chars

    def pieces(paras: Column) -> Column:
        return F.flatten(F.transform(
            paras,
            lambda p, i: let(
                F.when(F.length(p) <= budget, F.array(p)).otherwise(hard_split(p, budget)),
                lambda ps: F.transform(ps, lambda t, k: F.struct(
                    t.alias("text"), i.alias("para"), k.alias("k"), F.size(ps).alias("n"),
                    (F.length(p) > budget).alias("cut"))),
            ),
        ))

    def place(ps: Column) -> Column:
        ends = prefix_sums(F.transform(ps, lambda p: F.length(p["text"])))
        return let(ends, lambda e: F.transform(ps, lambda p, i: F.struct(
            i.alias("ordinal"), p["text"].alias("text"),
            (F.get(e, i) - F.length(p["text"])).alias("start_cp"), F.get(e, i).alias("end_cp"),
            p["para"].alias("para"), p["k"].alias("k"), p["n"].alias("n"),
            keys.ordinal(i).alias("id"),
            F.concat(
                F.lit("paragraph-"), (p["para"] + 1).cast("string"),
                F.when(p["cut"], F.concat(F.lit("+part-"), (p["k"] + 1).cast("string"), F.lit("/"), p["n"].cast("string")))
                .otherwise(F.lit("")),
            ).alias("locator"),
        )))

    return let(let(paragraphs(text), pieces), place)


def segment(docs: DataFrame, policy: Policy, body: str = "body") -> DataFrame:
    """Add ``parts``, an array of the pieces of the body in order."""
    return docs.withColumn("parts", parts_of(F.col(body), policy))


def explode_parts(segmented: DataFrame, *carry: str) -> DataFrame:
    """One row per part. There is always one; the outer form only spares Spark a check that computes the array again."""
    return segmented.select(*carry, F.inline_outer("parts"))


# -- packing --------------------------------------------------------------------------------------


def message(part: Column, role: Column, title: Column, created: Column | None = None) -> Column:
    fields = [part["id"].alias("id"), role.alias("role"), part["text"].alias("text"), title.alias("source_title")]
    if created is not None:
        fields.append(created.alias("created_at"))
    return F.struct(*fields)


def batch_starts(sizes: Column, max_n: int, max_bytes: int) -> Column:
    """Greedy packing: indexes at which a new batch begins, for message sizes in bytes.

    A batch is a JSON array, so n messages take their bytes, n - 1 commas and two brackets. A message opens a
    new batch when one more would break a limit; a single message over the limit still gets its own. The fold only
    appends when a batch begins.
    """
    first = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("bytes"),
                     F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, size: Column) -> Column:
        grown = acc["bytes"] + size + 1
        full = (acc["n"] == 0) | (acc["n"] + 1 > max_n) | (grown > max_bytes)
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(full, F.lit(1)).otherwise(acc["n"] + 1).alias("n"),
            F.when(full, size + 2).otherwise(grown).cast("bigint").alias("bytes"),
            F.when(full, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"),
        )

    return F.aggregate(sizes, first, step, lambda acc: acc["starts"])


def cut_at(items: Column, starts: Column) -> Column:
    """Slices of an array beginning at the given indexes."""
    return F.transform(
        starts, lambda at, k: F.slice(items, at + 1, F.coalesce(F.get(starts, k + 1), F.size(items)) - at))


def pack(segmented: DataFrame, policy: Policy, role: Column | None = None, title: Column | None = None) -> DataFrame:
    """One row per batch of parts: ``batch`` counts from 0, ``members`` holds the parts in order."""
    who = role if role is not None else F.col("role")
    what = title if title is not None else F.col("source_title")
    sizes = F.transform("parts", lambda p: F.octet_length(F.to_json(message(p, who, what))).cast("bigint"))
    sliced = let(sizes, lambda s: let(batch_starts(s, policy.batch_messages, policy.batch_bytes),
                                      lambda starts: cut_at(F.col("parts"), starts)))
    return segmented.select(
        *[c for c in segmented.columns if c != "parts"], F.size("parts").alias("part_total"),
        F.posexplode_outer(sliced).alias("batch", "members"))


def batch_locator(members: Column) -> Column:
    first, last = F.get(members, F.lit(0))["locator"], F.element_at(members, -1)["locator"]
    return F.when(first == last, first).otherwise(F.concat(first, F.lit(".."), last))


def build_payloads(docs: DataFrame, policy: Policy, scope: str, instance: str = "default",
                   body: str = "body") -> DataFrame:
    """Attributed documents to one row per batch, ready to be sent, with keys and digest.

    ``docs`` has root, rel, name, the body and role, author, original_date, source_type, parent_source_key and
    source_title. Keys whose value is null do not appear in the JSON.
    """
    titled = docs.withColumn("source_title", F.coalesce("source_title", "name"))
    batches = pack(segment(with_identity(titled, policy, body), policy, body).drop(body), policy)
    meta = F.struct(
        F.col("original_ref"), F.lit(policy.parser_version).alias("parser_version"),
        batch_locator(F.col("members")).alias("locator"), F.col("author"), F.col("original_date"),
        F.col("parent_source_key"))
    rows = batches.select(
        F.lit(instance).alias("instance"), "stable_id", "version_hash", "base_source_key",
        F.get("members", F.lit(0))["ordinal"].alias("part_index"), "part_total",
        F.lit(scope).alias("scope"),
        keys.part_key(F.col("base_source_key"), F.col("batch") + 1).alias("source_key"),
        "source_type", F.lit("archive").alias("processing_policy"), meta.alias("source_metadata"), "role", "rel",
        F.transform("members", lambda p: message(p, F.col("role"), F.col("source_title"))).alias("messages"),
    )
    payload = F.to_json(F.struct("scope", "source_key", "source_type", "processing_policy", "source_metadata",
                                 "messages"))
    return rows.withColumn("payload_json", payload).withColumns({
        "payload_digest": F.sha2("payload_json", 256), "locator": F.col("source_metadata.locator")})


def validate_payloads(payloads: DataFrame, policy: Policy) -> DataFrame:
    """Add ``problems``: everything the receiving side would refuse."""
    msgs = F.col("messages")
    bad = lambda test: F.exists(msgs, test)
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    problems = [
        F.when(empty(F.col("scope")), F.lit("scope-missing")),
        F.when(empty(F.col("source_key")) | (F.length("source_key") > MAX_SOURCE_KEY), F.lit("source-key")),
        F.when(~F.col("processing_policy").eqNullSafe("archive"), F.lit("processing-policy")),
        F.when(~F.coalesce(F.col("source_type"), F.lit("")).isin(*SOURCE_TYPES), F.lit("source-type")),
        F.when(F.coalesce(F.size(msgs), F.lit(0)) <= 0, F.lit("no-messages")),
        F.when(F.size(msgs) > policy.batch_messages, F.lit("too-many-messages")),
        F.when(bad(lambda m: empty(m["id"]) | (F.length(m["id"]) > MAX_MESSAGE_ID)), F.lit("message-id")),
        F.when(F.size(F.array_distinct(F.transform(msgs, lambda m: m["id"]))) < F.size(msgs),
               F.lit("message-id-repeated")),
        F.when(bad(lambda m: empty(m["text"])), F.lit("message-empty")),
        F.when(bad(lambda m: ~F.coalesce(m["role"], F.lit("")).isin(*ROLES)), F.lit("message-role")),
        F.when(F.octet_length(F.to_json(msgs)) > policy.batch_bytes, F.lit("messages-too-long")),
        *[F.when(F.length(f"source_metadata.{k}") > MAX_META_VALUE, F.lit(f"metadata:{k}")) for k in META_KEYS],
    ]
    return payloads.withColumn("problems", F.array_compact(F.array(*problems)))


def unknown_keys(payload_json: Column) -> Column:
    """Keys of a payload, top level and metadata, that the receiving side does not define."""
    top = F.array(*[F.lit(k) for k in ("scope", "source_key", "source_type", "processing_policy", "source_metadata",
                                       "messages")])
    meta = F.array(*[F.lit(k) for k in META_KEYS])
    return F.concat(
        F.array_except(F.json_object_keys(payload_json), top),
        F.array_except(
            F.coalesce(F.json_object_keys(F.get_json_object(payload_json, "$.source_metadata")),
                       F.array().cast("array<string>")), meta),
    )


def export_plan(docs: DataFrame, policy: Policy, scope: str, body: str = "body") -> DataFrame:
    """What an export would send, per document: counts and hashes, never text."""
    return (
        validate_payloads(build_payloads(docs, policy, scope, body=body), policy)
        .select("rel", "role", "source_type", "base_source_key", "version_hash", "part_total",
                F.size("messages").alias("_m"), F.octet_length("payload_json").alias("_b"), "problems")
        .groupBy("base_source_key", "version_hash", "rel", "role", "source_type")
        .agg(F.count(F.lit(1)).alias("batches"), F.sum("_m").alias("messages"), F.sum("_b").alias("payload_bytes"),
             F.count_if(F.size("problems") > 0).alias("bad_batches"))
    )


def dry_run_errors(read: DataFrame, policy: Policy, scope: str) -> DataFrame:
    """(rel, kind, reason) of the documents a dry run would not send: unreadable ones (see ``read_whole``), and those
    with a batch that the receiving side would refuse."""
    unread = read.where("reason IS NOT NULL").select("rel", F.lit("read").alias("kind"), "reason")
    checked = validate_payloads(build_payloads(read.where("reason IS NULL"), policy, scope), policy)
    refused = checked.select("rel", F.explode("problems").alias("reason")).groupBy("rel").agg(
        F.array_join(F.array_sort(F.collect_set("reason")), "|").alias("reason"))
    return unread.unionByName(refused.select("rel", F.lit("payload").alias("kind"), "reason"))


def read_whole(changes: DataFrame, content: DataFrame) -> DataFrame:
    """Changed documents with their whole text, or the ``reason`` why it cannot be had.

    ``content`` has path, size in bytes and text as it is stored now; nothing that an index cut or took apart is used.
    """
    # Looked at before the join: whoever asks for reasons only moves no text.
    there = content.select(F.col("path").alias("_path"), F.col("size").alias("_actual"), F.col("text").alias("_text"),
                           F.contains("text", F.lit("\u0000")).alias("_nul"))
    joined = changes.join(there, F.col("path") == F.col("_path"), "left")
    reason = (
        F.when(F.col("denied"), "denied").when(F.col("_path").isNull(), "missing")
        .when((F.col("size") != 0) & (F.col("size") != F.col("_actual")), "size-mismatch")
        .when(F.col("_nul"), "binary")
    )
    return joined.withColumns({"reason": reason, "body": F.coalesce("_text", F.lit(""))}).drop("_path", "_actual", "_text", "_nul")


def check_read(files: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, ok, reason) of indexed files against what is really there: missing, other size, or not text.

    ``actual`` has path, size and text.
    """
    joined = files.select("path", F.col("size").alias("_size")).join(
        actual.select("path", F.col("size").alias("_actual"),
                      F.contains("text", F.lit("\u0000")).alias("_nul"), F.lit(True).alias("_in")), "path", "left")
    reason = (
        F.when(F.col("_in").isNull(), "missing")
        .when((F.col("_size") != 0) & (F.col("_size") != F.col("_actual")), "size-mismatch")
        .when(F.col("_nul"), "binary")
    )
    return joined.select("path", reason.isNull().alias("ok"), reason.alias("reason"))


def find_by_identity(files: DataFrame, ids: DataFrame) -> DataFrame:
    """File rows behind stable ids."""
    return files.withColumn("stable_id", keys.stable_id(F.col("root"), F.col("rel"))).join(
        ids.select("stable_id").distinct(), "stable_id", "left_semi")
