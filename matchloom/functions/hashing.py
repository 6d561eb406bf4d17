"""64-bit fingerprints as BIGINT bit patterns, distances and sampled checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Checksums read contents of up to LIMIT bytes whole, larger ones in three windows.
LIMIT = 12 * 1024 * 1024
WINDOW = 4 * 1024 * 1024


def valid_hex(s: Column) -> Column:
    """Not empty and hex digits only."""
    return F.coalesce(s.rlike("^[0-9a-fA-F]+$"), F.lit(False))


def hex_to_bits(s: Column) -> Column:
    """Unsigned hex of up to 16 digits as a signed bit pattern; null for anything else."""
    return F.when(valid_hex(s) & (F.length(s) <= 16), F.conv(s, 16, -10).cast("bigint"))


def bits_to_hex(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bits_of(values: Column, n: int, test) -> Column:
    """A pattern of n bits, the first value's the highest: bit i is test(values, i)."""
    bit = lambda i: F.when(test(values, i), F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    out = F.lit(0).cast("bigint")
    for i in range(n):
        out = F.shiftleft(out, 1).bitwiseOR(bit(i))
    return out


def frame_distance(a: Column, b: Column) -> Column:
    """Mean Hamming distance over the frames both have, infinite if that is none."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    total = F.aggregate(pairs, F.lit(0), lambda s, v: s + v)
    return F.when(n <= 0, F.lit(float("inf"))).otherwise(total.cast("double") / n)


def duration_close(a: Column, b: Column) -> Column:
    """Within ten seconds or five per cent of the longer one."""
    return F.abs(a - b) <= F.greatest(F.lit(10.0), F.lit(0.05) * F.greatest(a, b))


def duration_bucket(d: Column) -> Column:
    """Durations that duration_close() accepts are at most one bucket apart."""
    phi = F.when(d <= 200, d / 10).otherwise(F.lit(20.0) + F.log(d / 200) / F.lit(0.05129329438755058))
    return F.floor(phi / 1.01).cast("long")


def sampled_checksum(content: Column, limit: int = LIMIT, window: int = WINDOW) -> Column:
    """SHA-256 of the size as eight little-endian bytes and the content, or its first, middle and last window."""
    n = F.octet_length(content)
    size = _little(n)
    mid = (F.floor(n / 2) - window // 2 + 1).cast("int")
    parts = F.concat(F.substring(content, 1, window), F.substring(content, mid, F.lit(window)), F.substring(content, (n - window + 1).cast("int"), F.lit(window)))
    return F.sha2(F.concat(size, F.when(n <= limit, content).otherwise(parts)), 256)


def _little(n: Column) -> Column:
    text = F.lpad(F.hex(n.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(text, 15 - 2 * k, 2) for k in range(8)]))
