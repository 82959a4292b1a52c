"""crypto: hexadecimal digests of a literal's text in UTF-8."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import col

BUILTINS = {
    "crypto:sha": lambda x: F.sha1(col(x).cast("binary")),
    "crypto:md5": lambda x: F.md5(col(x).cast("binary")),
    "crypto:sha256": lambda x: F.sha2(col(x).cast("binary"), 256),
    "crypto:sha512": lambda x: F.sha2(col(x).cast("binary"), 512),
}
