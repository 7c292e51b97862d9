"""Text expressions. All of them count Unicode code points."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space in the wide sense, line feed included. Valid in Java and RE2 patterns.
SPACE = (r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]")
# The same characters one by one, for trimming without a pattern.
SPACE_CHARS = (" \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
               + "\u2028\u2029\u202f\u205f\u3000\ufeff")
CJK = r"[\x{4E00}-\x{9FFF}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A lambda variable is bound once per row, while a repeated column expression may be evaluated again for
    every element of an array it is used in.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_true(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_true(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def contains_any(col: Column, words: Iterable[str]) -> Column:
    """One pattern for the whole list: a long disjunction of columns is slow to build and to compile."""
    return col.rlike("|".join(map(regex_escape, words)))


def sql_list(values: Iterable[str]) -> str:
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def in_list(sql: str, values: Iterable[str]) -> Column:
    """``sql IN (…)`` in one expression; a literal column per value is slow to build for long lists."""
    listed = sql_list(values)
    return F.expr(f"{sql} IN ({listed})") if listed else F.lit(False)


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACE_CHARS))


def squeeze(col: Column) -> Column:
    """One line: runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), f"{SPACE}+", " "))


def clip(col: Column, n: int) -> Column:
    """At most ``n`` characters, the last one an ellipsis when something was cut."""
    return F.when(F.length(col) <= n, col).otherwise(F.concat(F.substring(col, 1, n - 1), F.lit("…")))


def regex_escape(word: str) -> str:
    return "".join("\\" + ch if ch in r".*+?^${}()|[]\/-" else ch for ch in word)


def glob_regex(globs: Iterable[str]) -> str:
    """One case-insensitive alternation for a list of name globs (``*`` and ``?`` stay inside a segment)."""
    wild = {"*": "[^/]*", "?": "[^/]"}
    one = ["".join(wild.get(ch) or regex_escape(ch) for ch in g.removeprefix("./")) for g in globs]
    return f"(?i)^(?:{'|'.join(one)})$" if one else r"$^"


def human_bytes(n: Column) -> Column:
    """``512B``, ``1.50KB``, ``12.0MB``, ``340GB``: three significant digits, none for bytes."""
    units = ("B", "KB", "MB", "GB", "TB")
    out = F.lit(None).cast("string")
    for power in reversed(range(len(units))):
        v = n / F.lit(float(1024**power))
        digits = (
            F.when(v >= 100, F.format_string("%.0f", v)).when(v >= 10, F.format_string("%.1f", v))
            .otherwise(F.format_string("%.2f", v))
            if power else F.format_string("%.0f", v)
        )
        text = F.concat(digits, F.lit(units[power]))
        out = text if power == len(units) - 1 else F.when(n < 1024 ** (power + 1), text).otherwise(out)
    return F.when(n.isNull(), F.lit("?")).otherwise(out)


def count_occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a lower-case word in a lower-case text."""
    if not word:
        return F.lit(0).cast("bigint")
    gap = F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))
    return (gap / F.lit(len(word))).cast("bigint")


def token_pattern(word: str) -> str:
    """Words of five letters and more match anywhere, shorter ones only between non-alphanumerics."""
    quoted = regex_escape(word)
    return quoted if len(word) >= 5 else rf"(?<![\p{{L}}\p{{N}}]){quoted}(?![\p{{L}}\p{{N}}])"


def prefix_sums(values: Column, block: int = 256) -> Column:
    """Running sums of an int array. Summing in blocks keeps the cost near linear for long arrays."""
    empty = F.array().cast("array<int>")

    def running(xs: Column, start: Column) -> Column:
        first = F.struct(start.cast("int").alias("at"), empty.alias("out"))
        return F.aggregate(
            xs, first,
            lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")),
            lambda acc: acc["out"],
        )

    def blocks(xs: Column) -> Column:
        cut = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")),
            lambda b: F.slice(xs, b * block + 1, F.lit(block)))
        return let(cut, lambda bs: let(
            running(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)), F.lit(0)),
            lambda ends: F.flatten(F.transform(
                bs, lambda b, i: running(b, F.coalesce(F.get(ends, i - 1), F.lit(0)))))))

    return let(values, lambda xs: F.when(F.size(xs) == 0, empty).otherwise(blocks(xs)))
