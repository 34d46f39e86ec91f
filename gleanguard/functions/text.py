"""Column functions on texts and matches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: white space that trimming takes off.
_BLANK = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df and the columns, each computed once for a row: what is built on them refers to them and does not repeat them,
    as it would after the optimizer had put two projections together."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """What `then` makes of a value that is computed once, within an expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANK))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_number(prefix: Column) -> Column:
    """1 and the line feeds before a place."""
    return (F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1).cast("int")


def byte_column(prefix: Column) -> Column:
    """1 and the bytes since the last line feed before a place."""
    return (F.octet_length(F.substring_index(prefix, "\n", -1)) + 1).cast("int")


def line_start_column(prefix: Column) -> Column:
    """1 and the bytes before the place's line."""
    return (F.octet_length(prefix) - F.octet_length(F.substring_index(prefix, "\n", -1)) + 1).cast("int")


def source_line(text_lines: Column, line: Column) -> Column:
    return trimmed(F.coalesce(F.try_element_at(text_lines, line), F.lit("")))


def context(text_lines: Column, line: Column, radius: int = 2) -> Column:
    """The lines around one, trimmed, the one itself marked; each ends with a line feed."""
    first = F.greatest(line - radius, F.lit(1))
    around = F.slice(text_lines, first, line + radius - first + 1)
    marked = F.transform(around, lambda x, k: F.concat(F.when(first + k == line, F.lit("> ")).otherwise(F.lit("  ")), trimmed(x), F.lit("\n")))
    return F.array_join(marked, "")


def entropy(word: Column) -> Column:
    """Shannon entropy in bits of a word's characters, summed in the characters' order."""
    chars = F.split(word, "")
    size = F.length(word)
    share = lambda c: (size - F.length(F.replace(word, c, F.lit("")))) / size
    shares = F.transform(F.array_sort(F.array_distinct(F.filter(chars, lambda c: c != ""))), lambda c: share(c))
    return F.when(size == 0, F.lit(0.0)).otherwise(F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)))


def contains_any(text: Column, literals: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in literals))
