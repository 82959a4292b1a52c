"""dt: validity, canonical form and value equality of typed literals, given as text and a datatype's local name.

Unsupported datatypes have no solution: neither valid nor invalid, neither same nor different.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col

#: Fixed bounds of the integer types; None is open.
INTEGERS = {
    "integer": (None, None), "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1),
    "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127),
    "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 2**16 - 1), "unsignedByte": (0, 255),
}
#: Fixed character classes of names, and fixed lexical patterns.
NAME_START, NAME_MORE = r"\p{L}_", r"\p{L}\p{N}._\-\x{B7}\x{300}-\x{36F}\x{203F}-\x{2040}"
_REAL = r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|INF|-INF|NaN)$"
PATTERNS = {
    "boolean": r"^(true|false|0|1)$",
    "decimal": r"^[+-]?(\d+(\.\d*)?|\.\d+)$",
    "double": _REAL,
    "float": _REAL,
    "hexBinary": r"^([0-9a-fA-F]{2})*$",
    "base64Binary": r"^((\s*[A-Za-z0-9+/]){4})*((\s*[A-Za-z0-9+/]){2}\s*=\s*=|(\s*[A-Za-z0-9+/]){3}\s*=)?\s*$",
    "language": r"^[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*$",
    "Name": rf"^[{NAME_START}:][{NAME_MORE}:]*$",
    "NCName": rf"^[{NAME_START}][{NAME_MORE}]*$",
    "NMTOKEN": rf"^[{NAME_MORE}:]+$",
    "normalizedString": r"^[^\t\n\r]*$",
    "token": r"^(|[^\s]+( [^\s]+)*)$",
    "string": r"(?s)^.*$",
    # a colon before any slash, question mark or hash ends a scheme
    "anyURI": r"^(?![^a-zA-Z/?#][^/?#]*:|:|[a-zA-Z][^/?#:]*[^a-zA-Z0-9+.\-/?#:][^/?#:]*:)([^\x00-\x20<>\"{}|^`\\%\x7f-\x{10FFFF}]|%[0-9a-fA-F]{2})*$",
    "dateTime": r"^-?([1-9]\d{4,}|\d{4})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T(([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?|24:00:00(\.0+)?)(Z|[+-](0\d|1[0-3]):[0-5]\d|[+-]14:00)?$",
}
#: Fixed least and greatest magnitudes of binary numbers other than 0.
RANGES = {"float": (2.0**-149, (2 - 2.0**-23) * 2.0**127), "double": (5e-324, 1.7976931348623157e308)}
_EXACT = "decimal(38,0)"


def _integer(lex: Column, low, high) -> Column:  # noqa: ANN001
    n = lex.try_cast(_EXACT)
    ok = lex.rlike(r"^[+-]?\d+$")
    if low is not None:
        ok &= F.coalesce(n >= F.lit(low).cast(_EXACT), ~lex.startswith("-"))
    if high is not None:
        ok &= F.coalesce(n <= F.lit(high).cast(_EXACT), lex.startswith("-"))
    return ok


def valid(lex, datatype: str) -> Column:  # noqa: ANN001
    """Whether the text is in the datatype's lexical and value space; null if the datatype isn't supported."""
    lex = col(lex)
    if datatype in INTEGERS:
        return _integer(lex, *INTEGERS[datatype])
    if datatype == "dateTimeStamp":
        return valid(lex, "dateTime") & lex.rlike(r"(Z|[+-]\d\d:\d\d)$")
    if datatype == "dateTime":
        day = F.regexp_extract(lex, r"^-?\d*(\d{4}-\d\d-\d\d)T", 1)
        return lex.rlike(PATTERNS["dateTime"]) & day.try_cast("date").isNotNull()
    if datatype in RANGES:
        low, high = RANGES[datatype]
        special, n = lex.isin("INF", "-INF", "NaN"), F.abs(lex.try_cast("double"))
        zero = ~F.regexp_extract(lex, r"^[^eE]*", 0).rlike("[1-9]")
        return lex.rlike(PATTERNS[datatype]) & (special | F.coalesce(zero | ((n >= low) & (n <= high)), F.lit(False)))
    if datatype in PATTERNS:
        return lex.rlike(PATTERNS[datatype])
    return F.lit(None).cast("boolean")


def _shortest(lex: Column, datatype: str) -> Column:
    """A binary number's shortest decimal text: plain from 1e-6 to 1e21, else with an exponent; 0 has no sign."""
    n = lex.try_cast("double")
    shown = n.cast("string")  # d.dddE-x, or plain digits near 1
    sign, digits = F.when(n < 0, "-").otherwise(""), F.regexp_replace(F.regexp_extract(shown, r"^-?([\d.]+)", 1), r"\.0$", "")
    e = F.coalesce(F.nullif(F.regexp_extract(shown, r"E(-?\d+)$", 1), F.lit("")).try_cast("int"), F.lit(0))
    plain = F.regexp_replace(F.regexp_replace(F.abs(n).cast("decimal(38,16)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    with_e = F.concat(digits, F.when(e >= 0, "E+").otherwise("E"), e.cast("string"))
    special = F.when(lex.isin("INF", "-INF", "NaN"), lex).when(n == 0, "0")
    return special.otherwise(F.concat(sign, F.when((F.abs(n) >= 1e-6) & (F.abs(n) < 1e21), plain).otherwise(with_e)))


def canonical(lex, datatype: str) -> Column:  # noqa: ANN001
    """The canonical text of a valid literal; null for others."""
    lex = col(lex)
    plain = F.regexp_replace(F.regexp_replace(lex, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    if datatype in INTEGERS:
        out = F.when(plain == "-0", "0").otherwise(plain)
    elif datatype == "decimal":
        whole = F.regexp_replace(F.regexp_replace(plain, r"^(-?)\.", r"$10."), r"\.$", "")
        full = F.when(F.contains(whole, F.lit(".")), whole).otherwise(F.concat(whole, F.lit(".0")))
        out = F.regexp_replace(F.regexp_replace(full, r"(\.\d+?)0+$", "$1"), r"^-0\.0$", "0.0")
    elif datatype == "boolean":
        out = F.when(lex.isin("1", "true"), "true").otherwise("false")
    elif datatype == "hexBinary":
        out = F.upper(lex)
    elif datatype == "language":
        out = F.lower(lex)
    elif datatype in RANGES:
        out = _shortest(lex, datatype)
    elif datatype == "base64Binary":
        out = F.regexp_replace(lex, r"\s+", "")
    else:
        out = lex
    return F.when(valid(lex, datatype), out)


def same_value(a, datatype_a: str, b, datatype_b: str) -> Column:  # noqa: ANN001
    """Whether two valid literals have equal values; null if they can't be compared."""
    a, b = col(a), col(b)
    both = valid(a, datatype_a) & valid(b, datatype_b)
    exact = {*INTEGERS, "decimal"}
    numeric = exact | {"double", "float"}
    if {datatype_a, datatype_b} <= exact:
        same = a.try_cast("decimal(38,18)") == b.try_cast("decimal(38,18)")
    elif {datatype_a, datatype_b} <= numeric:
        x, y = (F.regexp_replace(v, "INF", "Infinity").try_cast("double") for v in (a, b))
        same = F.when(~F.isnan(x) & ~F.isnan(y), x == y)
    elif {datatype_a, datatype_b} <= {"hexBinary", "base64Binary"}:
        raw = lambda v, d: F.unhex(v) if d == "hexBinary" else F.unbase64(v)
        same = raw(a, datatype_a) == raw(b, datatype_b)
    elif {datatype_a, datatype_b} <= {"dateTime", "dateTimeStamp"}:
        zoned = r"(Z|[+-]\d\d:\d\d)$"
        same = F.when(a.rlike(zoned) == b.rlike(zoned), F.try_to_timestamp(a) == F.try_to_timestamp(b))
    elif datatype_a == datatype_b or {datatype_a, datatype_b} <= {"string", "normalizedString", "token", "Name", "NCName", "NMTOKEN", "language"}:
        same = canonical(a, datatype_a) == canonical(b, datatype_b)
    else:
        return F.lit(None).cast("boolean")
    return F.when(both, same)


BUILTINS = {
    "dt:datatype": lambda term: col(term)["dt"],
    "dt:lexicalForm": lambda term: col(term)["lex"],
    "dt:language": lambda term: F.nullif(col(term)["lang"], F.lit("")),
    "dt:canonicalLiteral": canonical,
    "dt:validForDatatype": lambda lex, d: F.coalesce(valid(lex, d), F.lit(False)),
    "dt:invalidForDatatype": lambda lex, d: F.coalesce(~valid(lex, d), F.lit(False)),
    "dt:sameValueAs": lambda *a: F.coalesce(same_value(*a), F.lit(False)),
    "dt:differentValueFrom": lambda *a: F.coalesce(~same_value(*a), F.lit(False)),
}
