"""Object ids of 96 bits: 24 hexadecimal digits, which sort as the numbers do, or two numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def oid_text(high: Column, low: Column) -> Column:
    """Id of the upper 32 and lower 64 bits (as a signed number); null if ``high`` has more bits."""
    text = F.lower(F.concat(F.lpad(F.hex(high), 8, "0"), F.lpad(F.hex(low), 16, "0")))
    return F.when((high >= 0) & (high < 1 << 32), text)


def is_oid(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-fA-F]{24}$"), F.lit(False))


def oid_parts(text: Column) -> Column:
    """Struct (high, low) of an id, or null for anything else."""
    high = F.conv(F.substring(text, 1, 8), 16, 10).try_cast("bigint")
    low = F.conv(F.substring(text, 9, 16), 16, -10).try_cast("bigint")
    return F.when(is_oid(text), F.struct(high.alias("high"), low.alias("low")))
