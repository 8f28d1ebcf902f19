"""Error classes and retry rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogwatch.functions.values import contains_any

# Fixed values, tried in this order: phrases of the text with blanks for underscores ...
ERROR_PHRASES = (
    ("timeout", ("timeout", "timed out")),
    ("rate_limit", ("rate limit", "429")),
    ("captcha", ("captcha", "recaptcha")),
    ("blocked", ("blocked", "access denied")),
    ("network", ("network", "connection")),
    ("http_5xx", ("500", "502", "503", "504")),
    ("http_4xx", ("400", "401", "403", "404")),
    ("proxy_error", ("proxy",)),
    ("authentication", ("auth", "unauthorized")),
)
# ... and per class: first delay, factor per attempt, attempts allowed.
RETRY_RULES = {
    "timeout": (2.0, 1.5, 3),
    "rate_limit": (10.0, 3.0, 5),
    "captcha": (30.0, 5.0, 2),
    "blocked": (0.0, 1.0, 1),
    "network": (1.0, 2.0, 4),
    "http_5xx": (5.0, 2.0, 3),
    "http_4xx": (0.0, 1.0, 1),
    "proxy_error": (3.0, 1.5, 2),
    "authentication": (0.0, 1.0, 1),
}
DEFAULT_RULE = (1.0, 2.0, 5)
MAX_DELAY = 300.0
UNKNOWN_ERROR = "unknown"


def classify_error(text: Column) -> Column:
    """First class one of whose phrases occurs in the text."""
    t = F.translate(F.lower(text), "_", " ")
    out = None
    for name, phrases in ERROR_PHRASES:
        hit = contains_any(t, phrases)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(UNKNOWN_ERROR))


def _rule(error_class: Column, part: int) -> Column:
    out = None
    for name, rule in RETRY_RULES.items():
        hit = error_class == name
        out = F.when(hit, F.lit(rule[part])) if out is None else out.when(hit, F.lit(rule[part]))
    return out.otherwise(F.lit(DEFAULT_RULE[part]))


def retry_plan(error_class: Column, attempt: Column, success_rate: Column | None = None) -> tuple[Column, Column]:
    """Delay before the next attempt (no jitter) and whether to try again.

    With a success rate, poor histories wait half as long again and good ones a fifth less.
    """
    delay = F.least(_rule(error_class, 0) * F.pow(_rule(error_class, 1), attempt), F.lit(MAX_DELAY))
    if success_rate is not None:
        delay = delay * F.when(success_rate < 0.3, 1.5).when(success_rate > 0.8, 0.8).otherwise(1.0)
    tries = _rule(error_class, 2)
    retry = (
        F.when(attempt >= tries, F.lit(False))
        .when(error_class.isin("blocked", "authentication"), F.lit(False))
        .when(error_class == "captcha", attempt < 2)
        .when(error_class == "rate_limit", attempt < F.greatest(F.lit(5), tries))
        .otherwise(F.lit(True))
    )
    return delay, retry
