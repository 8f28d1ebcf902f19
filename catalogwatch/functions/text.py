"""Text cleaning, hashes, truncation, entropy, time stamps, user-agent versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogwatch.functions.values import let

# Longest text kept per field.
FIELD_LIMITS = {"title": 512, "meta_description": 1024, "image_alt": 512, "diff_title": 200}
DISPLAY_ZONE = "Europe/Moscow"
# Browser version patterns, first match wins.
BROWSER_PATTERNS = (r"Chrome/(\d+)", r"Firefox/(\d+)")
SAFARI_PATTERN = r"Version/(\d+)"


def sanitise(c: Column) -> Column:
    """No control characters, single blanks, trimmed."""
    t = F.regexp_replace(c, r"[\x00-\x1f\x7f-\x9f]", "")
    return F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), r"^ | $", "")


def truncate(c: Column, field: str) -> Column:
    return F.substring(c, 1, FIELD_LIMITS[field])


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def utc_stamp(ts: Column) -> Column:
    """ISO text with a ``Z``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_stamp(c: Column) -> Column:
    """Time stamp from ISO text; null when it does not parse."""
    return F.try_to_timestamp(F.nullif(F.trim(c), F.lit("")))


def display_stamp(ts: Column, zone: str = DISPLAY_ZONE, label: str = "MSK") -> Column:
    """Local wall time for reports (session zone must be UTC)."""
    return F.concat(F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd HH:mm:ss"), F.lit(f" {label}"))


def browser_version(agent: Column) -> Column:
    """Major version of Chrome, Firefox or Safari; 0 when unknown."""
    parts = [F.nullif(F.regexp_extract(agent, p, 1), F.lit("")) for p in BROWSER_PATTERNS]
    parts.append(F.when(agent.contains("Safari"), F.nullif(F.regexp_extract(agent, SAFARI_PATTERN, 1), F.lit(""))))
    return F.coalesce(F.coalesce(*parts).try_cast("int"), F.lit(0))


def normalised_entropy(text: Column) -> Column:
    """Shannon entropy of the characters over its maximum, 0 for texts under ten characters.

    Counted inside the row: for each distinct character, how much shorter the text gets without it.
    """

    def counts(t: Column) -> Column:
        kinds = F.array_distinct(F.split(t, ""))
        return F.filter(F.transform(kinds, lambda ch: F.length(t) - F.length(F.replace(t, ch, F.lit("")))), lambda n: n > 0)

    def entropy(n: Column) -> Column:
        size = F.aggregate(n, F.lit(0), lambda a, x: a + x)
        weighted = F.aggregate(n, F.lit(0.0), lambda a, x: a + x * F.log2(x))
        # H = log2(N) - sum(n log2 n) / N
        value = (F.log2(size) - weighted / size) / F.log2(F.least(F.lit(256), F.size(n)))
        return F.when((size >= 10) & (F.size(n) > 1), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))).otherwise(0.0)

    t = F.lower(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", ""))
    return F.coalesce(let(let(t, counts), entropy), F.lit(0.0))
