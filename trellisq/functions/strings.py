"""string: tests and functions on text. Lengths and places count UTF-16 units, as the rule language has them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col, number


def _test(op):  # noqa: ANN001, ANN202
    return lambda a, b: F.coalesce(op(col(a).cast("string"), col(b).cast("string")), F.lit(False))


def _fold(op):  # noqa: ANN001, ANN202
    return _test(lambda a, b: op(F.lower(a), F.lower(b)))


def valid_pattern(pattern: str) -> bool:
    """Whether a literal pattern compiles; one that doesn't makes matches and notMatches fail alike."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def matches(s, pattern: str) -> Column:  # noqa: ANN001
    return F.coalesce(col(s).rlike(pattern), F.lit(False)) if valid_pattern(pattern) else F.lit(False)


def not_matches(s, pattern: str) -> Column:  # noqa: ANN001
    return F.coalesce(~col(s).rlike(pattern), F.lit(False)) if valid_pattern(pattern) else F.lit(False)


def replace(s, pattern: str, new: str) -> Column:  # noqa: ANN001
    """All matches replaced; $1 is a group, $$ and \\$ are a dollar sign."""
    if not valid_pattern(pattern):
        return F.lit(None).cast("string")
    return F.regexp_replace(col(s), F.lit(pattern), F.lit(new.replace("$$", r"\$")))


def scrape(s, pattern: str) -> Column:  # noqa: ANN001
    """The first group of the first match; null without a match."""
    if not valid_pattern(pattern) or re.compile(pattern).groups < 1:
        return F.lit(None).cast("string")
    return F.when(col(s).rlike(pattern), F.regexp_extract(col(s), pattern, 1))


def length(s) -> Column:  # noqa: ANN001
    """UTF-16 units: code points, and one more for each beyond U+FFFF."""
    s = col(s).cast("string")
    return F.length(s) + F.length(F.regexp_replace(s, r"[\x{0}-\x{FFFF}]", ""))


def _units(s) -> Column:  # noqa: ANN001
    """The text's UTF-16 units, four hexadecimal digits each."""
    return F.hex(F.encode(col(s).cast("string"), "UTF-16BE"))


def _half(units: Column, at: Column) -> Column:
    """Whether the unit at a place is half of a pair: no text can hold it alone."""
    return F.substring(units, 4 * at + 1, F.lit(2)).rlike("^D[89A-F]")


def _of_units(units: Column) -> Column:
    return F.decode(F.unhex(units), "UTF-16BE")


def char_at(s, i) -> Column:  # noqa: ANN001
    """The character at a place from 0 on; empty beyond the ends; null where the place is in a character beyond U+FFFF."""
    u, i = _units(s), col(i).cast("int")
    return F.when((i < 0) | (4 * i >= F.length(u)), F.lit("")).when(~_half(u, i), _of_units(F.substring(u, 4 * i + 1, F.lit(4))))


def set_char_at(s, i, c) -> Column:  # noqa: ANN001
    """The text with the character at a place replaced; unchanged beyond the ends; null as for char_at."""
    u, i = _units(s), col(i).cast("int")
    new = F.concat(F.substring(u, F.lit(1), 4 * i), _units(c), F.substring(u, 4 * i + 5, F.length(u)))
    return F.when((i < 0) | (4 * i >= F.length(u)), col(s)).when(~_half(u, i), _of_units(new))


def formatted(pattern: str, *args) -> Column:  # noqa: ANN002
    """printf for %s %d %i %u %f %F %e %E %g %G %c %%, with width, precision and the flags - and 0; other directives have no solution."""
    directive = r"%(?:%|[-0]*\d*(?:\.\d+)?([a-zA-Z]))"
    kinds = [k for k in re.findall(directive, pattern) if k]
    if any(k not in "sdiufFeEgGc" for k in kinds) or len(kinds) > len(args) or "%" in re.sub(directive, "", pattern):
        return F.lit(None).cast("string")
    java = re.sub(r"(%[-0]*\d*(?:\.\d+)?)([iuF])", lambda m: m[1] + {"i": "d", "u": "d", "F": "f"}[m[2]], pattern)
    types = {"s": "string", "c": "string", "d": "long", "i": "long", "u": "long"} | dict.fromkeys("fFeEgG", "double")
    java = re.sub(r"(%[-0]*\d*)c", r"\1.1s", java)
    cast = [number(a) if types[k] == "double" else col(a).try_cast(types[k]) for a, k in zip(args, kinds, strict=False)]
    parts = [m for m in re.finditer(r"%(?:%|([-0]*)(\d*)((?:\.\d+)?)([a-zA-Z]))", pattern) if m[4]]
    for k, (flags, width, digits, kind) in enumerate(m.groups() for m in parts):
        if kind in "gG":  # shortest form: no zeros at the fraction's end
            shown = F.format_string(f"%{digits}{kind}", cast[k])
            shown = F.regexp_replace(F.regexp_replace(shown, r"(\.\d*?)0+($|[eE])", "$1$2"), r"\.($|[eE])", "$1")
            if "0" in flags and "-" not in flags and width:
                sign = F.when(shown.startswith("-"), "-").otherwise("")
                bare = F.ltrim(shown, F.lit("-"))
                shown = F.concat(sign, F.lpad(bare, F.greatest(F.length(bare), F.lit(int(width)) - F.length(sign)), F.lit("0")))
            cast[k] = shown
    java = re.sub(r"%([-0]*)(\d*)(?:\.\d+)?[gG]", lambda m: f"%{'-' if '-' in m[1] and m[2] else ''}{m[2]}s", java)
    ok = F.lit(True)
    for c in cast:
        ok &= c.isNotNull()
    return F.when(ok, F.format_string(java, *cast) if cast else F.lit(java.replace("%%", "%")))


BUILTINS = {
    "string:concatenation": lambda *xs: F.concat(*[col(x).cast("string") for x in xs]) if xs else F.lit(""),
    "string:contains": _test(F.contains),
    "string:containsIgnoringCase": _fold(F.contains),
    "string:startsWith": _test(F.startswith),
    "string:endsWith": _test(F.endswith),
    "string:equalIgnoringCase": _fold(lambda a, b: a == b),
    "string:notEqualIgnoringCase": _fold(lambda a, b: a != b),
    "string:greaterThan": _test(lambda a, b: a > b),
    "string:lessThan": _test(lambda a, b: a < b),
    "string:notGreaterThan": _test(lambda a, b: a <= b),
    "string:notLessThan": _test(lambda a, b: a >= b),
    "string:matches": matches,
    "string:notMatches": not_matches,
    "string:replace": replace,
    "string:scrape": scrape,
    "string:format": formatted,
    "string:length": length,
    "string:charAt": char_at,
    "string:setCharAt": set_char_at,
}
