"""time: the parts of a dateTime's text as they are written, whatever its zone; null where a part is out of range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col

#: Fixed pattern of a dateTime's parts, with their ranges; a day need not be one of its month.
PARTS = r"^(-?\d{4,})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):([0-5]\d):([0-5]\d)(?:\.\d+)?(Z|[+-]\d\d:\d\d)?$"


def _text(x, group: int) -> Column:  # noqa: ANN001
    return F.when(col(x).rlike(PARTS), F.nullif(F.regexp_extract(col(x), PARTS, group), F.lit("")))


def _part(group: int):  # noqa: ANN202
    return lambda x: _text(x, group).try_cast("int")


def zone(x) -> Column:  # noqa: ANN001
    """Z or an offset; null if there is none."""
    return _text(x, 7)


def local_time(now: str) -> Column:
    """The moment that the run fixes once, given as text."""
    return F.lit(now)


BUILTINS = {
    "time:year": _part(1), "time:month": _part(2), "time:day": _part(3), "time:hour": _part(4), "time:minute": _part(5), "time:second": _part(6),
    "time:timeZone": zone, "time:localTime": local_time,
}
