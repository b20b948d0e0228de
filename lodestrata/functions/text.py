"""Text as columns: words, lines, positions, cleaned text. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_words(text: Column) -> Column:
    """Words of an identifier or text in lower case.

    Splits at all but letters and digits, from a small letter or digit to a
    capital, and before the last capital of an acronym (HTTPClient: http client).
    Digits stay with the letters before them.
    """
    t = F.regexp_replace(text, r"[^\p{IsAlphabetic}\p{N}]+", " ")
    t = F.regexp_replace(t, r"(?<=[\p{IsLowercase}\p{N}])(?=\p{IsUppercase})", " ")
    t = F.regexp_replace(t, r"(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase})", " ")
    return F.filter(F.split(F.lower(t), " +"), lambda w: w != "")


def lines(text: Column) -> Column:
    """Lines as LF ends them; text that ends in LF has an empty last line."""
    return F.split(text, "\n", -1)


def cap_lines(text: Column, most: int) -> Column:
    """struct(text, truncated): the first ``most`` lines; 0 is no limit."""
    if most == 0:
        return F.struct(text.alias("text"), F.lit(False).alias("truncated"))
    parts = lines(text)
    cut = F.size(parts) > most
    return F.struct(F.when(cut, F.array_join(F.slice(parts, 1, most), "\n")).otherwise(text).alias("text"), cut.alias("truncated"))


def window_lines(text: Column, start: int, most: int) -> Column:
    """struct(text, first, last, total): lines start to start + most - 1, counted from 1.

    A start beyond the end gives an empty text, null places and the total.
    """
    parts = lines(text)
    n = F.size(parts)
    last = F.least(n, F.lit(start + most - 1)) if most else n
    inside = n >= start
    return F.struct(
        F.when(inside, F.array_join(F.slice(parts, F.lit(start), F.greatest(last - start + 1, F.lit(0))), "\n")).otherwise("").alias("text"),
        F.when(inside, F.lit(start)).alias("first"),
        F.when(inside, last).alias("last"),
        n.alias("total"),
    )


def line_column(text: Column, offset: Column) -> Column:
    """struct(line, column) of a character offset, counted from 1; LF, CRLF and CR end lines.

    Null outside the text.
    """
    before = F.substring(text, F.lit(1), offset)
    # a CR whose LF lies behind the offset has not ended its line yet
    split_pair = before.endswith("\r") & F.substring(text, offset + 1, F.lit(1)).eqNullSafe("\n")
    counted = F.when(split_pair, F.substring(before, F.lit(1), offset - 1)).otherwise(before)
    parts = F.split(counted, "\r\n|\r|\n", -1)
    column = F.length(F.element_at(parts, -1)) + 1 + F.when(split_pair, 1).otherwise(0)
    ok = (offset >= 0) & (offset <= F.length(text))
    return F.when(ok, F.struct(F.size(parts).alias("line"), column.alias("column")))


def shorten(text: Column, most: int = 200) -> Column:
    """struct(text, cut): the first ``most`` characters."""
    return F.struct(F.substring(text, 1, most).alias("text"), (F.length(text) > most).alias("cut"))


def sanitize(text: Column) -> Column:
    """Control characters and marks that turn the writing direction become U+FFFD."""
    return F.regexp_replace(text, "[\\x00-\\x1f\\x7f-\\x9f\\u202A-\\u202E\\u2066-\\u2069]", "�")


def collapse_whitespace(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x0b\x85\p{Z}]+", " "))


def in_tests_directory(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_contains(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "tests")


def is_python_test_file(path: Column) -> Column:
    """test_*.py, *_test.py, tests.py and conftest.py."""
    return path.rlike(r"(?:^|/)(?:test_[^/]*\.py|[^/]*_test\.py|tests\.py|conftest\.py)$")


def is_discovered(path: Column, extension: str, skipped: tuple[str, ...] = ("target", "venv")) -> Column:
    """Whether a source scan takes the path: its extension, and no hidden or skipped folder."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return path.endswith("." + extension) & ~F.exists(folders, lambda p: p.startswith(".") | p.isin(*skipped))


def under_prefix(path: Column, prefix: Column) -> Column:
    """The path itself or anything below it."""
    return (path == prefix) | path.startswith(F.concat(F.rtrim(prefix, F.lit("/")), F.lit("/")))


def without_workspace(identity: Column) -> Column:
    return F.regexp_replace(identity, r"^[^:]*(?:::)", "")


def without_rank(identity: Column) -> Column:
    """The identity without the #number that tells collisions apart."""
    return F.regexp_replace(identity, r"#[0-9]+$", "")


def module_path_words(identity: Column) -> Column:
    """Words of the segments between workspace and name."""
    parts = F.split(without_rank(identity), "::")
    return F.flatten(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), split_words))


def own_documentation(signature: Column, interface: Column) -> Column:
    """What an interface says beyond its signature; null where that is nothing."""
    rest = F.when(interface.startswith(signature), F.substr(interface, F.length(signature) + 1)).when(interface.endswith(signature), F.left(interface, F.length(interface) - F.length(signature))).otherwise(interface)
    return F.nullif(F.regexp_replace(rest, r"^\s+|\s+$", ""), F.lit(""))


def paragraph_cuts(text: Column) -> Column:
    """How many paragraphs a text falls into: one ends after each run of blank lines."""
    return F.size(F.filter(F.split(text, r"\n[ \t\r]*\n\s*"), lambda p: F.trim(p) != ""))


def sentence_cuts(text: Column) -> Column:
    """Pieces cut after . ! ? and white space."""
    return F.split(text, r"(?<=[.!?])(?=\s)", -1)


def percentile_index(sorted_values: Column, p: float) -> Column:
    """The value at place min(n - 1, int(p n)) of a sorted array; not interpolated."""
    n = F.size(sorted_values)
    return F.when(n > 0, F.element_at(sorted_values, F.least(n, F.floor(F.lit(p) * n).cast("int") + 1)))


def epoch_seconds(value: Column) -> Column:
    """Seconds since 1970 of a number or an ISO-8601 time in text; null for anything else. Times without zone are UTC."""
    v = F.trim(value.cast("string"))
    zoned = v.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    text = F.when(zoned, v).otherwise(F.concat(v, F.lit("Z")))
    iso = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.unix_micros(F.try_to_timestamp(text)) / 1e6)
    return F.when(v.rlike(r"^[+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?$"), v.cast("double")).otherwise(iso)
