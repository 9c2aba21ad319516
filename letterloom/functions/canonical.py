"""Payloads as text that is equal wherever payloads are: keys sorted, ``", "`` and ``": "`` between parts, numbers as
Python's ``json`` prints them. All of it is built-in expressions on the text of a VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# JSON text holds no raw control characters, so these stand for an escaped backslash and an escaped quote.
_BACKSLASH, _QUOTE = "\x01", "\x02"


def _outside(text: Column, change, within=None) -> Column:
    """JSON ``text`` with ``change`` made to what is outside of its strings, and ``within`` to what is inside."""
    marked = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    parts = F.transform(F.split(marked, '"'), lambda part, i: F.when(i % 2 == 0, change(part)).otherwise(within(part) if within else part))
    return F.replace(F.replace(F.array_join(parts, '"'), F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))


def parse_payload(text: Column) -> Column:
    """JSON as VARIANT, null if it is none. Numbers with a point are doubles, as in Python: the parser alone would make
    decimals of them, of which 1.0 is a whole number like 1. Text without such numbers is parsed as it is."""
    pointed = text.rlike(r"\d\.\d+\s*([,\]}]|$)") & ~text.rlike(rf"[{_BACKSLASH}{_QUOTE}]")
    exact = lambda part: F.regexp_replace(part, r"(\d\.\d+)(?![\deE])", "$1e0")
    return F.try_parse_json(F.when(pointed, _outside(text, exact)).otherwise(text))


def _number(token: Column) -> Column:
    """A number with a point in Python's way: the fewest digits that read as the same double (Java may print more), and
    exponents from -4 to 15 written out."""
    value = token.cast("double")
    tried = [F.format_string(f"%.{n}e", value) for n in (14, 15, 16)]
    short = F.when(tried[0].cast("double") == value, tried[0]).when(tried[1].cast("double") == value, tried[1]).otherwise(tried[2])
    mantissa, power = F.split_part(short, F.lit("e"), F.lit(1)), F.split_part(short, F.lit("e"), F.lit(2)).cast("int")
    plain = F.rtrim(short.cast("decimal(38,21)").cast("string"), F.lit("0"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    wide = F.when(F.abs(power) > 99, F.abs(power).cast("string")).otherwise(F.lpad(F.abs(power).cast("string"), 2, "0"))
    scientific = F.concat(F.regexp_replace(mantissa, r"\.?0+$", ""), F.when(power < 0, "e-").otherwise("e+"), wide)
    return F.when(value == 0, token).when(power.between(-4, 15), plain).otherwise(scientific)


def _spaced(part: Column) -> Column:
    """What is outside of strings: numbers rewritten that Java prints otherwise, a space after each comma and colon."""
    number = r"(-?\d+\.\d+(?:E-?\d+)?)"
    told = lambda t: F.concat(F.regexp_extract(t, r"^([^\d-]*)", 1), _number(F.regexp_extract(t, number, 1)), F.regexp_extract(t, r"\d([^\dE.-]*)$", 1))
    rewritten = F.array_join(F.transform(F.split(part, ","), lambda t: F.when(t.rlike(number), told(t)).otherwise(t)), ",")
    told_all = F.when(part.rlike(r"E|[\d.]{16}"), rewritten).otherwise(part)
    return F.replace(F.replace(told_all, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": "))


def _small_letters(part: Column) -> Column:
    """Escapes of control characters with small hexadecimal digits."""
    small = part
    for digit in "ABCDEF":
        small = F.regexp_replace(small, rf"\\u00([01]){digit}", rf"\\u00$1{digit.lower()}")
    return F.when(part.contains("\\u00"), small).otherwise(part)


def canonical_json(payload: Column) -> Column:
    """The text of a VARIANT of ``parse_payload``, byte for byte what Python's ``json.dumps(sort_keys=True,
    ensure_ascii=False)`` makes of what its ``json.loads`` reads. Whole numbers may have up to 38 digits. Null gives null.

    Not covered, as VARIANT or Java holds them otherwise: subnormal doubles, a key that comes twice (such text is no VARIANT), numbers beyond a
    double (Python's Infinity), lone surrogates, and the order of keys beyond U+FFFF among those from U+E000 up.
    """
    return _outside(F.to_json(payload), _spaced, _small_letters)
