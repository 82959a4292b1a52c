"""math: arithmetic and comparisons. Integers stay exact; everything else is a double; no solution is null, never an error.

Comparisons put numbers, durations (by their seconds) and dates and dateTimes (by the seconds since 1970) on one scale.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col, number

#: Days of a mean year and month, for durations in seconds.
YEAR_DAYS, MONTH_DAYS = 365.2425, 30.436875
#: Within this a bound numeric output equals the computed one.
NEAR = 1e-9


def finite(x: Column) -> Column:
    """x, or null where it's NaN or infinite."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), x)


def real(x) -> Column:  # noqa: ANN001
    return number(x)


INTEGER = "decimal(38,0)"


def whole(x) -> Column:  # noqa: ANN001
    """x as a 64-bit integer, fractions cut off."""
    return F.coalesce(col(x).cast("string").try_cast("long"), real(x).try_cast("long"))


def added(*xs) -> Column:  # noqa: ANN002
    """Sum of the arguments; 0 for none."""
    return reduce(F.try_add, map(col, xs)) if xs else F.lit(0)


def multiplied(*xs) -> Column:  # noqa: ANN002
    """Product of the arguments; 1 for none."""
    return reduce(F.try_multiply, map(col, xs)) if xs else F.lit(1)


def quotient(a, b) -> Column:  # noqa: ANN001
    return finite(F.try_divide(real(a), real(b)))


def integer_quotient(a, b) -> Column:  # noqa: ANN001
    """Truncates toward zero; null for a divisor of 0."""
    a, b = whole(a), whole(b)
    rest = F.try_mod(a, b)
    return F.try_divide(a - rest, b).cast("long")


def remainder(a, b) -> Column:  # noqa: ANN001
    """Has the dividend's sign; null for a divisor of 0."""
    return F.try_mod(whole(a), whole(b))


def rounded(x) -> Column:  # noqa: ANN001
    """To the nearest integer, ties upward, as decimal(38,0): integers of up to 38 digits stay as they are."""
    text, d = col(x).cast("string"), real(x)
    low = F.floor(d)
    near_ = F.when(F.abs(d) < 2.0**52, (low + F.when(d - low >= 0.5, 1).otherwise(0)).try_cast(INTEGER)).otherwise(finite(d).try_cast(INTEGER))
    return F.when(text.rlike(r"^[+-]?\d+(\.0*)?$"), text.try_cast("decimal(38,0)")).otherwise(near_)


def exponentiation(base, e) -> Column:  # noqa: ANN001
    return finite(F.pow(real(base), real(e)))


def integer_power(base, e) -> Column:  # noqa: ANN001
    """The exact power of integers, e from 0 on, as decimal(38,0); null if it has more than 38 digits."""
    b, e = col(base).cast("string").try_cast(INTEGER), whole(e)
    one = F.lit(1).cast(INTEGER)
    small = F.when(e == 0, one).when(b.isin(0, 1), b).when(b == -1, F.when(e % 2 == 0, one).otherwise(b))
    steps = F.sequence(F.lit(1), F.least(F.greatest(e, F.lit(1)), F.lit(127)))
    product = F.aggregate(steps, one, lambda a, _: F.try_multiply(a, b).try_cast(INTEGER))
    return F.when(e < 0, F.lit(None)).otherwise(F.coalesce(small, F.when(e < 127, product)))


def exponent(base, result) -> Column:  # noqa: ANN001
    """The inverse of exponentiation: the exponent that gives the result."""
    return finite(F.try_divide(F.ln(F.nullif(F.greatest(real(result), F.lit(0.0)), F.lit(0.0))), F.ln(F.nullif(F.greatest(real(base), F.lit(0.0)), F.lit(0.0)))))


def duration_seconds(text) -> Column:  # noqa: ANN001
    """Seconds of an ISO 8601 duration such as P1Y2M3DT4H5M6.5S or P2W; null if it isn't one."""
    t = col(text)
    n = r"(\d+(?:\.\d+)?)"
    form = rf"^-?P(?=.)(?:{n}Y)?(?:{n}M)?(?:{n}W)?(?:{n}D)?(?:T(?=.)(?:{n}H)?(?:{n}M)?(?:{n}S)?)?$"
    parts = F.split(F.regexp_replace(t, form[:-1] + r"\R?$", ";".join(f"0${k}" for k in range(1, 8))), ";")  # an absent part is 0

    def total(p: Column) -> Column:
        y, m, w, d, hours, minutes, seconds = (p[k].try_cast("double") for k in range(7))
        date = y * YEAR_DAYS + m * MONTH_DAYS + w * 7 + d
        return F.when(t.startswith("-"), -1.0).otherwise(1.0) * (date * 86400 + (hours * 3600 + minutes * 60 + seconds))

    # in a lambda the text is taken apart once, and the row's compiled code stays small enough for the JVM's compiler
    return F.when(t.rlike(form), F.transform(F.array(parts), total)[0])


def date_difference(a, b) -> Column:  # noqa: ANN001
    """Duration from timestamp b to timestamp a, as text PTnS."""
    micros = F.unix_micros(col(a).cast("timestamp")) - F.unix_micros(col(b).cast("timestamp"))
    return F.concat(F.lit("PT"), F.regexp_replace((micros / 1_000_000).cast("decimal(30,6)").cast("string"), r"\.?0+$", ""), F.lit("S"))


def date_plus(moment, seconds) -> Column:  # noqa: ANN001
    """A timestamp so many seconds later."""
    return F.timestamp_micros(F.unix_micros(col(moment).cast("timestamp")) + (real(seconds) * 1_000_000).cast("long"))


def moment(x) -> Column:  # noqa: ANN001
    """Seconds since 1970 of a date, a dateTime or their text (UTC where there is no zone); null for others."""
    text = col(x).cast("string")
    return F.when(text.rlike(r"^-?\d{4,}-\d\d-\d\d"), F.unix_micros(text.try_cast("timestamp")) / 1_000_000)


def moved(x, by, sign: int = 1) -> Column:  # noqa: ANN001
    """A date or dateTime later (sign 1) or earlier (-1) by a duration or a number of seconds, as dateTime text in UTC."""
    seconds = F.coalesce(real(by), duration_seconds(col(by).cast("string")))
    micros = (F.round((moment(x) + sign * seconds) * 1_000_000)).try_cast("long")
    return F.regexp_replace(F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), r"\.?0+Z$", "Z")


def magnitude(x) -> Column:  # noqa: ANN001
    """A number, a duration's seconds, or a date's or dateTime's moment, whichever x is."""
    text = col(x).cast("string")
    return F.coalesce(number(text), duration_seconds(text), moment(x))


def near(bound, computed) -> Column:  # noqa: ANN001
    """Test that a bound output agrees with the computed one."""
    return F.abs(real(bound) - real(computed)) <= NEAR


def _both(op):  # noqa: ANN001, ANN202
    """Text is compared by magnitude, integers among it exactly; columns of other types as they are, so that filters reach the scan.

    Which case it is depends on the columns' types alone, and the optimiser keeps that one only.
    """

    def test(a, b) -> Column:  # noqa: ANN001
        a, b = col(a), col(b)
        x, y = (v.cast("string").try_cast(INTEGER) for v in (a, b))
        exact = F.when(a.cast("string").rlike(r"^[+-]?\d+$") & b.cast("string").rlike(r"^[+-]?\d+$"), op(x, y))
        by_text = F.coalesce(exact, op(magnitude(a), magnitude(b)))
        return F.coalesce(F.when((F.typeof(a) == "string") | (F.typeof(b) == "string"), by_text).otherwise(op(a, b)), F.lit(False))

    return test


def _real(f):  # noqa: ANN001, ANN202
    return lambda x: finite(f(real(x)))


BUILTINS = {
    "math:equalTo": _both(lambda a, b: a == b),
    "math:notEqualTo": _both(lambda a, b: a != b),
    "math:greaterThan": _both(lambda a, b: a > b),
    "math:lessThan": _both(lambda a, b: a < b),
    "math:notLessThan": _both(lambda a, b: a >= b),
    "math:notGreaterThan": _both(lambda a, b: a <= b),
    "math:sum": added,
    "math:product": multiplied,
    "math:difference": lambda a, b: F.try_subtract(col(a), col(b)),
    "math:quotient": quotient,
    "math:integerQuotient": integer_quotient,
    "math:remainder": remainder,
    "math:rounded": rounded,
    "math:exponentiation": exponentiation,
    "math:exponentiation of integers": integer_power,
    "math:sum of dateTime and duration": moved,
    "math:difference of dateTime and duration": lambda x, by: moved(x, by, -1),
    "math:difference of dateTimes": date_difference,
    "math:absoluteValue": lambda x: F.abs(col(x)),
    "math:negation": lambda x: -col(x),
} | {
    f"math:{name}": _real(f)
    for name, f in {
        "acos": F.acos, "asin": F.asin, "atan": F.atan, "sin": F.sin, "cos": F.cos, "tan": F.tan,
        "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "degrees": F.degrees,
    }.items()
}
#: For a bound result and an unbound argument.
INVERSES = {
    f"math:{name}": _real(f)
    for name, f in {
        "acos": F.cos, "asin": F.sin, "atan": F.tan, "sin": F.asin, "cos": F.acos, "tan": F.atan,
        "sinh": F.asinh, "cosh": F.acosh, "tanh": F.atanh, "degrees": F.radians,
    }.items()
} | {"math:negation": lambda y: -col(y)}
