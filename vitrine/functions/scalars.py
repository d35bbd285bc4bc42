"""Scalar column rules: keys, ages, seasons, paths and hash draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper edges and labels of the two age groupings.
AGE_INTERVALS = [
    (25, "[16, 25]"),
    (35, "[26, 35]"),
    (45, "[36, 45]"),
    (55, "[46, 55]"),
    (65, "[56, 65]"),
]
AGE_INTERVAL_LAST = "[66, 99]"
AGE_GROUPS = [
    (16, 20, "16-20"),
    (20, 30, "20-30"),
    (30, 40, "30-40"),
    (40, 50, "40-50"),
    (50, 60, "50-60"),
    (60, 70, "60-70"),
    (70, None, "70+"),
]

# Months of the warm season and the two season names.
WARM_MONTHS = [3, 4, 5, 6, 7, 8]
WARM_SEASON = "summer_spring"
COLD_SEASON = "winter_autumn"
ANY_SEASON = "all_seasons"
UNKNOWN_SEASON = "unknown"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_key(c: Column | str, width: int | None = None) -> Column:
    """Key as text without leading zeros; padded back to ``width`` when given."""
    text = F.trim(_col(c).cast("string"))
    bare = F.ltrim(text, F.lit("0"))
    bare = F.when(bare == "", F.when(text == "", text).otherwise("0")).otherwise(bare)
    if width is None:
        return bare
    # lpad would cut a longer key, so longer keys pass through unchanged
    return F.when(F.length(bare) >= width, bare).otherwise(F.lpad(bare, width, "0"))


def image_path(c: Column | str) -> Column:
    """``/images/<first three digits>/<ten-digit id>.jpg``."""
    key = norm_key(c, 10)
    return F.concat(F.lit("/images/"), F.substring(key, 1, 3), F.lit("/"), key, F.lit(".jpg"))


def age_interval(c: Column | str) -> Column:
    """Closed age intervals; a null or an age above the last edge is the last label."""
    age = _col(c)
    out = F.when(age <= AGE_INTERVALS[0][0], AGE_INTERVALS[0][1])
    for edge, label in AGE_INTERVALS[1:]:
        out = out.when(age <= edge, label)
    return out.otherwise(AGE_INTERVAL_LAST)


def age_groups(c: Column | str) -> Column:
    """Right-closed age bins; 16 and below, and null, give null."""
    age = _col(c)
    out = None
    for low, high, label in AGE_GROUPS:
        inside = age > low if high is None else (age > low) & (age <= high)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def to_day(c: Column | str) -> Column:
    return F.to_date(_col(c))


def day_number(c: Column | str) -> Column:
    """Days since 1970-01-01, the integer a range window can order by."""
    return F.datediff(_col(c), F.lit("1970-01-01").cast("date"))


def season_of(ts: Column | str, tz: str | None = None) -> Column:
    """Season of a day, or of a UTC instant seen from ``tz``."""
    at = _col(ts)
    if tz is not None:
        at = F.from_utc_timestamp(at, tz)
    return F.when(F.month(at).isin(WARM_MONTHS), WARM_SEASON).otherwise(COLD_SEASON)


def hash_unit(*cols: Column | str, salt: str = "") -> Column:
    """Uniform draw in [0, 1) from the md5 of the columns: the same on every run and engine."""
    digest = F.md5(F.concat_ws("|", *[_col(c).cast("string") for c in cols], F.lit(salt)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
