"""Text expressions: white space, lines, previews, identity. All are Columns; none runs Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode text splits it, for use inside a character class.
SPACE = r"\t\n\x0b\f\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(x), use), 1)


#: The same characters as they are. Trimming looks at a text's ends only, where an expression tries each of its places.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def lstrip(x: Column) -> Column:
    return F.ltrim(x, F.lit(SPACES))


def rstrip(x: Column) -> Column:
    return F.rtrim(x, F.lit(SPACES))


def collapse(x: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return strip(F.regexp_replace(x, f"[{SPACE}]+", " "))


def words(x: Column) -> Column:
    """Parts between white space, without empty ones."""
    return F.filter(F.split(x, f"[{SPACE}]+"), lambda w: w != "")


def split_lines(x: Column) -> Column:
    """Lines ended by any line boundary; a boundary at the end opens no further line; '' has none."""
    parts = F.split(x, r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]")
    trimmed = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(x == "", F.array().cast("array<string>")).otherwise(trimmed)


def newlines(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def content_hash(x: Column) -> Column:
    return F.md5(F.encode(x, "UTF-8"))


def preview(x: Column, size: int = 240) -> Column:
    """The text if it is short enough, else its beginning without trailing space, and three dots."""
    return F.when(F.length(x) <= size, x).otherwise(F.concat(rstrip(F.substring(x, 1, size)), F.lit("...")))


def legacy_preview(x: Column, size: int = 200) -> Column:
    return F.concat(F.substring(x, 1, size), F.lit("..."))


def snippet(x: Column, size: int = 320) -> Column:
    flat = collapse(x)
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(rstrip(F.substring(flat, 1, size)), F.lit("...")))


def slug(x: Column, size: int = 80, default: str = "wiki-page") -> Column:
    """What may stand, with a dash for all between. What can't stand at the ends, space too, would be a dash that is cut off."""
    made = F.btrim(F.array_join(F.regexp_extract_all(x, F.lit("[A-Za-z0-9._-]+"), F.lit(0)), "-"), F.lit("-."))
    return once(F.substring(made, 1, size), lambda cut: F.when(cut == "", default).otherwise(cut))


def location(path: Column, url: Column, document_id: Column, start: Column, end: Column) -> Column:
    """Where a citation points: path, else URL, else document, and its lines where they are known."""
    base = first_filled(path, url, document_id)
    lines = F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")))
    return F.concat(base, F.coalesce(lines, F.lit("")))


def markers(x: Column) -> Column:
    """Citation markers in a text, as C1, C2, in order of appearance."""
    return F.transform(F.regexp_extract_all(x, F.lit(r"\[C(\d+)\]"), F.lit(1)), lambda n: F.concat(F.lit("C"), n))


def base64_bound(size: Column) -> Column:
    """Characters that so many bytes take in base64."""
    return F.floor((size + 2) / 3).cast("long") * 4


def response_bound(size: Column) -> Column:
    return F.greatest(F.lit(1024).cast("long"), 2 * size.cast("long") + 4096)


def extension(path: Column) -> Column:
    """The last extension of a path's last segment in lower case, with its dot; '' for none."""
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[A-Za-z0-9]+)$", 1))


def has_control_bytes(x: Column) -> Column:
    return x.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
