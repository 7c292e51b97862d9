"""Spelling variants: words one edit apart, found by an asymmetric join of chunks with positional grams.

Two words are near if they differ by exactly one code point put in, taken out or replaced. The longer word (either, where
lengths are equal) gives two disjoint chunks, its halves; the shorter one gives grams at every place where such a chunk can stand after one edit,
that is unmoved or moved by the difference of the lengths, one at most. An edit touches one chunk, so the other is met as a gram.

A half alone would join all words with a common stem. The argument therefore holds once more for the half that the edit is in: of its two parts
one stays as well. A key is the half that stays with the part that stays, a place, and the length: four keys from the longer word, eight
from the shorter. What is left open by a key is a quarter of a word, so keys have few words however many words there are. Every match is
verified on the words themselves. All steps are Spark expressions and joins on hashed keys.

A word's form is its near word with the largest count, if that is at least ``times`` the word's own; ties go to the smallest
in code-point order. Along forms counts grow ``times``-fold, so chains are short; their ends are found by doubling.

Defined results: null and empty texts have no words; a null id counts as an empty one in what is hashed; repeated rows count each;
words are counted over all documents and texts of any length; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import Steps

LETTERS = r"[A-Za-z\u00C0-\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def corpus_words(docs: DataFrame, least_length: int = 6, least_count: int = 5, one_in: int = 0) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case, of at least so many code points and occurrences.

    With ``one_in``, a run loses the code point ``h % length`` if ``one_in`` divides h, the crc32 of ``<doc_id>:<run>``.
    A run that is too short cannot become long enough, so shorter ones are never taken out of a text.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(LETTERS + "{%d,}" % least_length), F.lit(0))).alias("run"))
    runs = runs.select("doc", F.translate("run", UPPER, LOWER).alias("word"))
    if one_in:
        hashed = runs.select("word", F.crc32(F.concat("doc", F.lit(":"), "word").cast("binary")).alias("h"))
        cut = F.expr("concat(substring(word, 1, cast(h % length(word) AS int)), substring(word, cast(h % length(word) AS int) + 2))")
        runs = hashed.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("word")).alias("word"))
    return runs.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def open_quarters(length: Column) -> Column:
    """Start and end of the quarter that the edit is in, for each of four: halves of the halves of a word of that length."""
    half = F.floor(length / 2)
    low, high = F.floor(half / 2), half + F.floor((length - half) / 2)
    edges = [F.lit(0).cast("long"), low, half, high, length.cast("long")]
    return F.array(*(F.struct(F.lit(i).alias("g"), a.cast("int").alias("start"), b.cast("int").alias("end"))
                     for i, (a, b) in enumerate(zip(edges, edges[1:]))))


def keyed(words: DataFrame, shorter_by: Column) -> DataFrame:
    """(key, word, n): what stays on both sides of the quarter that the edit is in.

    As chunks of the word itself (``shorter_by`` 0), or as grams for a word that is longer by ``shorter_by``; then what
    stands behind the edit has moved by as much.
    """
    sized = words.select("word", "n", shorter_by.alias("d")).withColumn("l", F.length("word") + F.col("d"))
    parts = sized.select("word", "n", "d", "l", F.inline(open_quarters(F.col("l"))))
    head = F.expr("substring(word, 1, start)")
    tail = F.expr("substring(word, end - d + 1)")
    return parts.select(F.xxhash64("l", "g", head, tail).alias("key"), "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every unordered pair of near words of ``words(word, n)`` once."""
    chunks = keyed(words, F.lit(0)).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    grams = keyed(words, F.explode(F.array(F.lit(0), F.lit(1)))).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = chunks.join(grams, "key").where("(length(a) > length(b) OR a < b) AND levenshtein(a, b, 1) = 1")
    # One letter taken out of a run of equal ones may lie in either of two quarters.
    return met.select("a", "a_n", "b", "b_n").distinct()


def ends(links: DataFrame, steps: Steps) -> DataFrame:
    """(word, root): the last word along ``links(word, form)``. Each round follows twice as many links as the one before."""
    far = steps.store(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-ends")
    while far.where("moved").limit(1).count():
        ahead = far.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = steps.store(far.select("word", "root").join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-ends")
        steps.drop(far)
        far = further
    return far.select("word", "root")


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``words(word, n)``, whose words differ."""
    with Steps(words.sparkSession) as steps:
        words = steps.store(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
        pairs = steps.store(near_words(words), "spelling-pairs")
        both = pairs.union(pairs.select("b", "b_n", "a", "a_n"))
        best = both.groupBy(F.col("a").alias("word")).agg(
            F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
        chosen = (-F.col("best.less")) >= F.col("n") * times
        judged = steps.store(words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(chosen, F.col("best.form")).alias("form"),
            F.when(chosen, -F.col("best.less")).alias("form_n")), "spelling-forms")
        steps.drop(words, pairs)
        last = ends(judged.where("form IS NOT NULL"), steps)
        return judged.join(last, "word", "left").select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
