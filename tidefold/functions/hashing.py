"""Hash functions as SQL expressions: ring positions, FNV-1 and FNV-1a."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidefold.plans.model import UINT32

#: Offset basis and prime of the 32-bit FNV hashes.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619


def ring_hash(key: Column) -> Column:
    """The first four bytes of MD5, as an unsigned number."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def fnv_pair(key: Column) -> Column:
    """(h1, h2): FNV-1 and FNV-1a of the UTF-8 bytes, in one pass over them. Read as Latin-1, bytes are characters."""
    letters = F.split(F.decode(F.encode(key, "UTF-8"), "ISO-8859-1"), "")
    first = F.struct(F.lit(FNV_BASIS).cast("long").alias("h1"), F.lit(FNV_BASIS).cast("long").alias("h2"))

    def step(h: Column, c: Column) -> Column:
        byte = F.ascii(c)
        return F.struct((h["h1"] * FNV_PRIME).bitwiseAND(F.lit(UINT32)).bitwiseXOR(byte).alias("h1"), (h["h2"].bitwiseXOR(byte) * FNV_PRIME).bitwiseAND(F.lit(UINT32)).alias("h2"))

    return F.when(key == "", first).otherwise(F.aggregate(letters, first, step))


def fnv1(key: Column) -> Column:
    return fnv_pair(key)["h1"]


def fnv1a(key: Column) -> Column:
    return fnv_pair(key)["h2"]
