"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_camel(text: Column) -> Column:
    """A space between a lower-case letter or digit and the capital after it."""
    return F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")


def terms(text: Column) -> Column:
    """The different words of two or more characters, in order of first occurrence."""
    return F.array_distinct(F.filter(F.split(F.lower(split_camel(text)), "[^a-z0-9_]+"), lambda t: F.length(t) >= 2))


def squash(text: Column) -> Column:
    """Lower case without anything but letters, digits and underscores."""
    return F.regexp_replace(F.lower(split_camel(text)), "[^a-z0-9_]+", "")


def token_estimate(text: Column) -> Column:
    """Tokens at four characters each, rounded up; a null text has none."""
    return F.coalesce(F.ceil(F.length(text) / F.lit(4)), F.lit(0)).cast("long")


def byte_token_estimate(size: Column) -> Column:
    return F.coalesce(F.ceil(size / F.lit(4)), F.lit(0)).cast("long")


def budget_clamp(requested: Column, window: Column) -> Column:
    """At least 1000 and at most 60 % of the window; as requested where the window is unknown."""
    return F.when(window.isNull(), requested).otherwise(F.greatest(F.lit(1000), F.least(requested, F.floor(window * 0.6)))).cast("long")


def half_up(number: Column) -> Column:
    return F.floor(number + 0.5).cast("long")


def lines(text: Column) -> Column:
    return F.split(text, "\r\n|\r|\n")


def line_at(text: Column, offset: Column) -> Column:
    """The line, from 1, of a character offset from 0."""
    return (F.length(F.regexp_replace(F.substring(text, F.lit(1), offset), "[^\n]", "")) + 1).cast("int")


def shortened(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last of them an ellipsis where something is left out."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


def dominant_line_end(text: Column) -> Column:
    """``crlf`` if more than half of the line feeds follow a carriage return, else ``lf``."""
    crlf, lf = F.regexp_count(text, F.lit("\r\n")), F.regexp_count(text, F.lit("\n"))
    return F.when((lf > 0) & (crlf * 2 > lf), "crlf").otherwise("lf")


def query_hash(query: Column) -> Column:
    """One hash for queries that differ in case and white space only."""
    return F.sha2(F.regexp_replace(F.lower(F.trim(query)), r"\s+", " "), 256)


def short_hash(text: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def without_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;?]*[A-Za-z]", "")


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percent, 0 of nothing."""
    return F.coalesce(F.round(F.try_divide(part.cast("double") * 100, whole.cast("double")), digits), F.lit(0.0))


def regex_escaped(text: Column) -> Column:
    """A pattern that matches the text itself."""
    return F.regexp_replace(text, r"([\\.*+?^${}()|\[\]])", r"\\$1")


def _replaced(text: Column, pattern: Column, by: Column, everywhere: bool) -> Column:
    """Matches, or only the first, replaced by a text in which nothing has a meaning of its own."""
    if everywhere:
        return F.regexp_replace(text, pattern, F.regexp_replace(by, r"([\\$])", r"\\$1"))
    found = F.regexp_substr(text, pattern)
    at = F.regexp_instr(text, pattern)
    return F.concat(F.substring(text, F.lit(1), at - 1), by, F.substring(text, at + F.length(found), F.length(text)))


def tolerant_replace(text: Column, find: Column, by: Column, everywhere: bool = False) -> Column:
    """``(updated, count, strategy)`` of the first way that finds something: as it is; whatever the line ends; whatever the
    spaces at the ends of lines. The text keeps its line ends. Null where nothing is found or ``find`` is empty."""
    plain = lambda x: F.regexp_replace(x, "\r\n|\r", "\n")
    body, wanted, new = plain(text), plain(find), plain(by)
    crlf = dominant_line_end(text) == "crlf"
    back = lambda x: F.when(crlf, F.replace(x, F.lit("\n"), F.lit("\r\n"))).otherwise(x)
    literal = lambda x: F.concat(F.lit("(?s)"), regex_escaped(x))
    trimmed = F.transform(F.split(wanted, "\n"), lambda x: F.trim(x, F.lit(" \t")))
    loose = F.array_join(F.transform(trimmed, lambda x: F.when(F.length(x) == 0, "[ \\t]*").otherwise(F.concat(F.lit("[ \\t]*"), regex_escaped(x), F.lit("[ \\t]*")))), "\n")

    def result(source: Column, pattern: Column, put: Column, name: str, restore) -> Column:
        return F.struct(restore(_replaced(source, pattern, put, everywhere)).alias("updated"), (F.regexp_count(source, pattern) if everywhere or name != "flexible-whitespace" else F.lit(1)).cast("int").alias("count"), F.lit(name).alias("strategy"))

    way = F.when(F.contains(text, find), result(text, literal(find), by, "exact", lambda x: x))
    way = way.when(F.contains(body, wanted), result(body, literal(wanted), new, "normalized-eol", back))
    way = way.when(F.regexp_count(body, loose) > 0, result(body, loose, new, "flexible-whitespace", back))
    return F.when(F.length(find) > 0, way)


def stable_json(values: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def short_number(number: Column) -> Column:
    """Thousands as K and millions as M with one digit, others as they are."""
    return F.when(number >= 1_000_000, F.concat(F.format_number(number / 1_000_000, 1), F.lit("M"))).when(number >= 1000, F.concat(F.format_number(number / 1000, 1), F.lit("K"))).otherwise(number.cast("string"))
