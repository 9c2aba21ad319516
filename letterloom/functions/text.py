"""Text columns: cleaning, slugs, names and keys."""

from __future__ import annotations

import unicodedata
from functools import cache
from itertools import filterfalse

from pyspark.sql import Column, DataFrame, functions as F

#: What Python calls white space; Java's Unicode class lacks the four separators.
_SPACES = r"(?U)[\s\x{1C}-\x{1F}]+"


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x{1C}-\x{1F}]+|[\s\x{1C}-\x{1F}]+\z", "")


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _SPACES, " "))


def clean_text(c: Column) -> Column:
    """Null becomes empty; UTF-8 that was read as Latin-1 is read again, unless that brings replacement characters;
    white space is collapsed."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    narrow = text.rlike(r"^[\x{00}-\x{FF}]*$")
    again = F.when(narrow, F.encode(text, "ISO-8859-1")).cast("string")
    good = F.is_valid_utf8(again) & ~F.contains(again, F.lit("�"))
    ascii_only = F.octet_length(text) == F.char_length(text)  # nothing to read again
    return collapse_space(F.when(ascii_only, text).when(narrow & good, again).otherwise(text))


#: Where characters that become several ones are marked: private ones, which no slug shows.
_MARKS = 0xE000


@cache
def _folds() -> tuple[str, str, tuple[str, ...]]:
    """How code points look without accents, as far as a slug can tell, for ``translate``: characters that become another
    one, or nothing, and marks for those that become the strings listed last. Made from the compatibility forms."""
    single, gone, longer = {}, [], {}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        char = chr(code)
        plain = "".join(filterfalse(unicodedata.combining, unicodedata.normalize("NFKD", char)))
        if not plain:
            gone.append(char)
        elif plain != char and any(c.isascii() and (c.isalnum() or c == "&") for c in plain):
            (single if len(plain) == 1 else longer)[char] = plain
    marks = "".join(chr(_MARKS + i) for i in range(len(longer)))
    known = "".join(single) + marks + "".join(longer) + "".join(gone)
    return known, "".join(single.values()) + " " * len(marks) + marks, tuple(longer.values())


def without_accents(c: Column) -> Column:
    """A text's letters and digits as they are without accents and in their plain forms; what no slug shows may stay. Each
    character is looked up once; a text is cut only before those that become several."""
    known, plain, longer = _folds()
    cut = F.split(F.translate(c, known, plain), f"(?=[\\x{{{_MARKS:X}}}-\\x{{{_MARKS + len(longer) - 1:X}}}])")
    told = lambda x: F.get(F.array(*map(F.lit, longer)), F.ascii(x) - _MARKS)
    wide = F.array_join(F.transform(cut, lambda x: F.coalesce(F.concat(told(x), F.substr(x, F.lit(2))), x)), "")
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(wide)


def ascii_slug(c: Column) -> Column:
    """The slug of a text without accents, in the JVM."""
    low = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit(" and "))
    slug = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(slug, "^$", "untitled")  # a condition on the slug would work it out twice


def with_slug(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """``df`` with the slug of a column; null is empty."""
    return df.withColumn(out_col, ascii_slug(without_accents(F.coalesce(F.col(text_col), F.lit("")))))


def stable_hash(c: Column, length: int = 10) -> Column:
    return F.substring(F.sha2(F.coalesce(c, F.lit("")), 256), 1, length)


def view_name(slug: Column, key: Column) -> Column:
    return F.concat(slug, F.lit("--"), stable_hash(key, 8))


VIEW_FOLDERS = {"person": "people", "group": "groups", "thread": "threads", "project": "projects", "tag": "tags"}


def view_path(kind: Column, slug: Column, key: Column) -> Column:
    """The path of a view; a kind without a folder is an error."""
    folders = F.create_map(*(F.lit(x) for pair in VIEW_FOLDERS.items() for x in pair))
    folder = F.coalesce(F.element_at(folders, kind), F.raise_error(F.concat(F.lit("unknown view kind: "), kind)))
    return F.concat(folder, F.lit("/"), view_name(slug, key))


def handle_key(c: Column) -> Column:
    key = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), _SPACES, "")
    return F.when(key == "", "unknown").otherwise(key)


def snippet(c: Column, limit: int = 180) -> Column:
    text = collapse_space(F.coalesce(c, F.lit("")))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def normalize_account_key(c: Column) -> Column:
    """Trimmed, without leading @, lower case; what is no account key then is an error."""
    key = F.lower(F.ltrim(F.trim(c), F.lit("@")))
    return F.when(key.rlike(r"^[a-z0-9][a-z0-9._-]*$"), key).otherwise(
        F.raise_error(F.concat(F.lit("not an account key: "), F.coalesce(c, F.lit("null"))))
    )
