"""Chat formatting by relational operations: sorted turns, merged runs of one role, a template that can be read back.

Only DataFrame expressions are used. A conversation is one row of the result, so its turns meet in one task; nothing
else does. Layout of the text, one block for each run of turns of one role::

    <|turn|>role<|text|>first text<|more|>second text<|end|>\n

Control strings that occur inside a role or text get one more backslash after their first character, also when they
carry backslashes already, so that taking one away gives the input back. Control strings of other common templates
(``</s>``, ``[INST]`` ...) are escaped too, so no text can start or end a turn there either.

Defined results: null text or role is empty text; a null turn number sorts first, ties go by role, then text; repeated
rows are repeated turns; rows without a conversation id form one conversation; no rows, no result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, MORE, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>\n"
CONTROL = r"(\|(?:turn|text|more|end|im_start|im_end|endoftext)\|>|/?s>|/?INST\]|/?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, r"$1$2$3")


def format_conversations(rows: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): the text, and where the texts of role ``learn`` lie, in code points from 0."""
    turns = rows.select(
        "conv_id", F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    starts = F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 OR turns[i].role <> turns[i - 1].role)")
    merged = sorted_turns.withColumn("starts", starts).withColumn("runs", F.expr("""
        transform(starts, (s, k) -> named_struct(
            'role', turns[s].role,
            'texts', transform(slice(turns, s + 1, coalesce(get(starts, k + 1), size(turns)) - s), t -> t.text)))"""))
    safe = merged.withColumn("runs", F.transform("runs", lambda r: F.struct(
        escape(r["role"]).alias("role"), F.transform(r["texts"], escape).alias("texts"),
        (r["role"] == learn).alias("learn"))))
    block = lambda r: F.concat(F.lit(TURN), r["role"], F.lit(TEXT), F.array_join(r["texts"], MORE), F.lit(END))

    def spans(at: Column, r: Column) -> Column:
        """Position after the run, and the spans so far with those of the run."""
        head = at["pos"] + len(TURN) + F.length(r["role"]) + len(TEXT)
        inner = F.aggregate(
            r["texts"], F.struct(head.cast("long").alias("pos"), F.expr(
                "cast(array() as array<struct<start: bigint, length: bigint>>)").alias("spans")),
            lambda a, t: F.struct(
                (a["pos"] + F.length(t) + len(MORE)).cast("long").alias("pos"),
                F.array_append(a["spans"], F.struct(
                    a["pos"].alias("start"), F.length(t).cast("long").alias("length"))).alias("spans")))
        return F.struct((inner["pos"] - len(MORE) + len(END)).cast("long").alias("pos"),
                        F.when(r["learn"], F.concat(at["spans"], inner["spans"])).otherwise(at["spans"]).alias("spans"))

    nothing = F.struct(F.lit(0).cast("long").alias("pos"), F.expr(
        "cast(array() as array<struct<start: bigint, length: bigint>>)").alias("spans"))
    return safe.select(
        "conv_id", F.array_join(F.transform("runs", block), "").alias("formatted"),
        F.aggregate("runs", nothing, spans)["spans"].alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) behind a formatted conversation."""
    quote = lambda s: r"\Q" + s + r"\E"
    blocks = F.split(formatted, quote(END))
    parts = F.transform(F.slice(blocks, 1, F.size(blocks) - 1),
                        lambda b: F.split(F.substr(b, F.lit(len(TURN) + 1)), quote(TEXT)))
    return F.flatten(F.transform(parts, lambda p: F.transform(
        F.split(p[1], quote(MORE)),
        lambda t: F.struct(unescape(p[0]).alias("role"), unescape(t).alias("text")))))


def digest_conversations(done: DataFrame) -> DataFrame:
    """What reading the formatted text back gives: counts and digests of the turns and of the text to learn from."""
    read = done.withColumn("turns", read_turns(F.col("formatted"))).withColumn("learned", F.array_join(
        F.transform("loss_spans", lambda s: unescape(
            F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
