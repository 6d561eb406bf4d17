"""Sizes in bytes as text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")


def parse_size(text: str) -> int:
    """Bytes of '1.5kb', '2 MB' or '500'; units are powers of 1024, case doesn't count."""
    m = re.fullmatch(r"([+-]?\d+|[+-]?\d*\.?\d+(?=\s*[a-z]))\s*([kmgt]?b)?", text.strip().lower())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) if not m[2] else int(float(m[1]) * 1024 ** UNITS.index(m[2].upper()))


def size_bytes(text: Column) -> Column:
    """parse_size() of a column; null for what isn't a size."""
    low = F.lower(F.trim(text))
    number, unit = F.regexp_extract(low, r"^([+-]?\d*\.?\d+)\s*([kmgt]?b)?$", 1), F.regexp_extract(low, r"^([+-]?\d*\.?\d+)\s*([kmgt]?b)?$", 2)
    scaled = number.try_cast("double")
    out = F.when((unit == "") & ~F.contains(number, F.lit(".")), number.try_cast("bigint"))
    for k, u in enumerate(UNITS):
        out = out.when(unit == u.lower(), (scaled * float(1024**k)).cast("bigint"))
    return out


def size_text(n: Column) -> Column:
    value, unit = n.cast("double"), F.lit(UNITS[0])
    for k in range(1, len(UNITS)):
        big = n.cast("double") >= float(1024**k)
        value, unit = F.when(big, n.cast("double") / float(1024**k)).otherwise(value), F.when(big, F.lit(UNITS[k])).otherwise(unit)
    return F.format_string("%6.1f %s", value, unit)
