"""Parts of paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The folders of trash and caches, which scans leave out, and the suffixes that count as media.
TRASH = "__duplicate_files_trash"
DATABASES = "__databases"
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp", ".heic", ".heif")
VIDEO_SUFFIXES = (".mp4", ".mov", ".avi", ".mkv", ".wmv", ".webm", ".flv", ".3gp", ".m4v", ".mts", ".m2ts")
MEDIA_SUFFIXES = IMAGE_SUFFIXES + VIDEO_SUFFIXES


def without_drive(path: Column, windows: bool = False) -> Column:
    """Strips a drive letter or a server and share; POSIX paths stay."""
    return F.regexp_replace(path, r"^(?:[A-Za-z]:|[\\/]{2}[^\\/]+[\\/][^\\/]+)", "") if windows else path


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def suffix(path: Column) -> Column:
    """Last suffix with its dot, none for names that begin with their only dot."""
    return F.regexp_extract(base_name(path), r"(?<=.)(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def has_suffix(path: Column, suffixes: tuple[str, ...]) -> Column:
    return F.lower(suffix(path)).isin(*suffixes)


def relative(path: Column, base: Column) -> Column:
    """Path as seen from base, with '..' for what isn't below it; '.' for base itself. Both absolute, without '.' parts."""
    of = lambda p: F.filter(F.split(p, "/"), lambda x: x != "")
    parts, root = of(path), of(base)
    same = F.aggregate(
        F.sequence(F.lit(0), F.least(F.size(parts), F.size(root))),
        F.lit(0),
        lambda n, k: F.when((n == k) & F.get(parts, k).eqNullSafe(F.get(root, k)) & F.get(parts, k).isNotNull(), k + 1).otherwise(n),
    )
    up = F.array_repeat(F.lit(".."), F.size(root) - same)
    down = F.slice(parts, same + 1, F.greatest(F.size(parts) - same, F.lit(0)))
    return F.when(path == base, F.lit(".")).otherwise(F.array_join(F.concat(up, down), "/"))


def shown(path: Column, windows: bool = False) -> Column:
    """A path as it is printed: a file URI on Windows, where terminals open those."""
    return F.concat(F.lit("file:///"), F.replace(path, F.lit("\\"), F.lit("/"))) if windows else path


def trash_path(path: Column, root: Column) -> Column:
    """Place in the trash folder; null for what isn't below root."""
    below = F.startswith(path, F.concat(root, F.lit("/")))
    return F.when(below, F.concat(root, F.lit(f"/{TRASH}/"), F.substr(path, F.length(root) + 2)))
