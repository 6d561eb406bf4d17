"""How much a name says: letters left when camera and backup words are taken out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions.paths import base_name, stem

# Words without meaning in names and folders.
NAME_NOISE = (
    "PXL", "IMG", "DSC", "DSCF", "DSCN", "DCIM", "WA", "VID", "MVI", "FB", "PICT", "IMGP", "IMGD", "DCF",
    "WHATSAPP", "IMAGES", "PHOTO", "PHOTOS", "IMAGE", "BACKUP", "BKP",
)
FOLDER_NOISE = ("PHOTO", "PHOTOS", "IMAGE", "IMAGES", "WHATSAPP", "BACKUP", "BKP")


def token_score(text: Column, noise: Sequence[str], extra: Sequence[str] = ()) -> Column:
    """ASCII letters in the parts between blanks, '_', '-' and digits, without noise words; 0 if the whole is an extra word."""
    low = [w.lower() for w in extra]
    parts = F.filter(F.split(text, r"(?U)[\s\x1c-\x1f_\-\d]+"), lambda t: ~F.upper(t).isin(*noise) & (~F.lower(t).isin(*low) if low else F.lit(True)))
    letters = F.length(F.regexp_replace(F.array_join(parts, ""), "[^a-zA-Z]", ""))
    return F.when(F.lower(text).isin(*low), F.lit(0)).otherwise(letters) if low else letters


def name_score(name: Column, extra: Sequence[str] = ()) -> Column:
    return token_score(stem(name), NAME_NOISE, extra)


def folder_score(folder: Column, extra: Sequence[str] = (), base: Column | None = None) -> Column:
    """Sum over the folders below base, or of the last one; -1 if any of them is an extra word; 0 for no folder."""
    last = F.array(base_name(folder))
    if base is None:
        parts = last
    else:
        below = F.startswith(folder, F.concat(base, F.lit("/")))
        parts = F.when(folder == base, F.array().cast("array<string>")).when(below, F.split(F.substr(folder, F.length(base) + 2), "/")).otherwise(last)
    low = [w.lower() for w in extra]
    total = F.aggregate(F.transform(parts, lambda p: token_score(p, FOLDER_NOISE, extra)), F.lit(0), lambda s, v: s + v)
    if low:
        total = F.when(F.exists(parts, lambda p: F.lower(p).isin(*low)), F.lit(-1)).otherwise(total)
    return F.when(F.coalesce(F.length(folder), F.lit(0)) == 0, F.lit(0)).otherwise(total)
