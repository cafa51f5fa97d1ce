"""Column expressions over paths, URLs, hashes and ISO times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_md(path: Column) -> Column:
    """The path without one trailing `.md`."""
    return F.regexp_replace(path, r"\.md$", "")


def last_part(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def raw_path(path: Column) -> Column:
    """A raw path in its one notation: no blanks around, then without one leading `./`, then one `raw/`."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"^\s+|\s+$", ""), r"^\./", ""), r"^raw/", "")


def is_url(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^(?i)https?://"), F.lit(False))


def url_key(url: Column) -> Column:
    """A URL with lower-case scheme and host and without one final slash of its path; anything else as it stands."""
    parts = r"^((?i)https?)://([^/?#]*)([^?#]*)(.*)$"
    path = F.regexp_replace(F.regexp_extract(url, parts, 3), r"/$", "")
    normal = F.concat(
        F.lower(F.regexp_extract(url, parts, 1)), F.lit("://"), F.lower(F.regexp_extract(url, parts, 2)), path, F.regexp_extract(url, parts, 4)
    )
    return F.when(is_url(url), normal).otherwise(url)


def iso_micros(text: Column) -> Column:
    """Microseconds since 1970 of an ISO time; no zone means UTC, what is no time gives null."""
    clean = F.trim(text)
    zoned = F.when(clean.rlike(r"[Tt ]\d{1,2}:.*([Zz]|[+-]\d{1,2}:?\d{0,2})$"), clean).when(
        clean.rlike(r"[Tt ]\d{1,2}:"), F.concat(clean, F.lit("Z"))
    ).otherwise(clean)
    return F.unix_micros(zoned.try_cast("timestamp"))


def stamp_micros(stamp: Column) -> Column:
    """Microseconds since 1970 of a timestamp column, with or without zone."""
    return F.unix_micros(stamp.cast("timestamp"))


def sha_key(text: Column) -> Column:
    """A hash without letter case, blanks around and a `sha256:` prefix; empty ones count as missing."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"^\s+|\s+$", ""), r"^sha256:\s*", "")
    return F.when(bare != "", bare)
