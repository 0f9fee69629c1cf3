"""Feature hashing: signed sparse vectors of a fixed length from named features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(key: Column, dim: int, salt: str) -> Column:
    """A struct (bucket, sign) of a feature: from the SHA-256 of salt, a zero byte and the key, the first eight bytes modulo dim, and the last bit of the ninth."""
    digest = F.sha2(F.concat(F.lit(salt).cast("binary"), F.unhex(F.lit("00")), key.cast("binary")), 256)
    place = F.pmod(F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(dim).cast("decimal(20,0)")).cast("int")
    odd = F.conv(F.substring(digest, 17, 2), 16, 10).cast("int") % 2 == 1
    return F.struct(place.alias("bucket"), F.when(odd, 1.0).otherwise(-1.0).alias("sign"))
