"""String, URL and identifier rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: identifier, digest and date shapes
KEBAB_ID = "^[a-z0-9]+(-[a-z0-9]+)*$"
SHA256_HEX = "^[0-9a-f]{64}$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
LINK_MARKER, PATH_MARKER = "[link]", "[path]"

# what a link, a drive's path and a rooted path look like; a path starts a word or follows a bracket, quote or sign
# a link begins where no letter stands before: one that does would begin it earlier
_LINK = r"(?<![A-Za-z])[A-Za-z][A-Za-z0-9+.-]*+:/{2,}[^\s<>\"']+"
_DRIVE = r"\b[A-Za-z]:[\\/][^\s<>\"':]+"
_ROOTED = r"(^|[\s(\[{<=,;\"'])/[^\s/<>\"':]+/[^\s<>\"':]*"


def redact(text: Column) -> Column:
    """The first line, with links and absolute paths (of either kind of system) replaced by markers."""
    line = F.substring_index(text, "\n", 1)
    line = F.when(F.contains(line, F.lit("://")), F.regexp_replace(line, _LINK, LINK_MARKER)).otherwise(line)
    line = F.regexp_replace(line, _DRIVE, PATH_MARKER)
    return F.regexp_replace(line, _ROOTED, "$1" + PATH_MARKER)


def origin(url: Column) -> Column:
    """Scheme, host and port; empty when the text is no absolute URL."""
    return F.regexp_extract(url, r"^([a-z][a-z0-9+.-]*://[^/?#]+)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]+([^?#]*)", 1)


def is_kebab_id(text: Column) -> Column:
    return text.rlike(KEBAB_ID)


def is_sha256(text: Column) -> Column:
    return text.rlike(SHA256_HEX)


def is_iso_date(text: Column, real_day: bool = False) -> Column:
    """Shape only; ``real_day`` also asks that the day exists."""
    shaped = text.rlike(ISO_DATE)
    return shaped & text.try_cast("date").isNotNull() if real_day else shaped


def escapes_root(path: Column) -> Column:
    """True when a relative path leaves its root or is absolute."""
    return path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)") | path.contains("\\")
