from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed pattern that holds all text that casts to a double.
NUMBER = r"(?i)^[\x00-\x20]*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?[df]?|0x[0-9a-f.]+p[+-]?\d+[df]?|inf(?:inity)?|nan)[\x00-\x20]*$"


def col(x) -> Column:  # noqa: ANN001
    """A column as it is, a string as a column's name, anything else as a literal."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def number(x) -> Column:  # noqa: ANN001
    """x as a double, null for text that is none. Such text isn't cast at all: each failed cast throws and catches an exception."""
    x = col(x)
    d = x.try_cast("double")
    return F.when(F.typeof(x) == "string", F.when(x.cast("string").rlike(NUMBER), d)).otherwise(d)
