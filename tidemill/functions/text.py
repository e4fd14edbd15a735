"""Tokenising expressions. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The delimiter set of the default tokenizer (space, tab, LF, CR, FF; not VT).
DELIMITERS = " \t\n\r\f"


def split_tokens(text: Column, lower: bool = False) -> Column:
    """Array of whitespace tokens and, where delimiters follow one another, empty strings. Null text gives null.

    Delimiters become blanks first: splitting at one character needs no regular expression. Where tokens are
    exploded, a filter of the rows drops the empty ones within generated code.
    """
    text = F.lower(text) if lower else text
    return F.split(F.translate(text, DELIMITERS[1:], " " * (len(DELIMITERS) - 1)), " ")


def tokens(text: Column, lower: bool = False) -> Column:
    """Array of non-empty whitespace tokens; punctuation is kept. Null text gives null."""
    return F.array_remove(split_tokens(text, lower), "")


def fields(line: Column, delimiter: str) -> Column:
    """Array of trimmed fields; runs of the delimiter collapse, so no field is empty."""
    parts = F.split(line, "[" + "".join("\\" + c if c in "|\\^]-" else c for c in delimiter) + "]+")
    return F.transform(F.filter(parts, lambda t: t != ""), lambda t: F.trim(t))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units: one a code point and one more for each supplementary character, which has four bytes of UTF-8."""
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int"))


#: Elements that `running` adds up in one go; longer arrays are cut into blocks of so many.
BLOCK = 512


def running(sizes: Column) -> Column:
    """Sums of the elements before each one (long); sizes: a column of array<long>.

    Sums are appended block by block, so that a long array isn't copied once for each of its elements.
    """
    none = F.array().cast("array<bigint>")
    last = lambda sums, x: F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0).cast("long")) + x
    grown = lambda part: F.aggregate(part, none, lambda sums, x: F.concat(sums, F.array(last(sums, x))))
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    exclusive = lambda part, base: F.transform(F.arrays_zip(grown(part).alias("s"), part.alias("x")), lambda p: base + p["s"] - p["x"])
    starts = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int"))
    blocks = F.transform(starts, lambda b: exclusive(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)), total(F.slice(sizes, F.lit(1), b * BLOCK))))
    return F.when(F.size(sizes) == 0, none).when(F.size(sizes) <= BLOCK, exclusive(sizes, F.lit(0).cast("long"))).otherwise(F.flatten(blocks))
