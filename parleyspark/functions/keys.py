"""Compact, reversible binary keys for uuid strings, and instants from ISO text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CANONICAL = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
_OTHER = "00" * 17


def pack_key(c: Column) -> Column:
    """A canonical lower-case uuid as its 16 bytes; any other string as 17 zero bytes and its UTF-8, so nothing collides."""
    return F.when(c.rlike(_CANONICAL), F.unhex(F.regexp_replace(c, "-", ""))).otherwise(F.concat(F.unhex(F.lit(_OTHER)), F.encode(c, "UTF-8")))


def unpack_key(c: Column) -> Column:
    h = F.lower(F.hex(c))
    dashed = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return F.when(c.isNull(), F.lit(None).cast("string")).when(F.octet_length(c) == 16, dashed).otherwise(F.decode(F.substring(c, 18, 2**30), "UTF-8"))


def instant(c: Column) -> Column:
    """ISO text with a zone as a TIMESTAMP; NULL where it can't be read."""
    return c.try_cast("timestamp")
